"""The corpus pipeline: stages from raw documents to token ids, each a table in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm import toxicity
from threatlake.llm.bpe import encode_documents
from threatlake.llm.common import table
from threatlake.llm.exact_dedup import drop_duplicates
from threatlake.llm.mixing import mixed_documents
from threatlake.llm.ngram_join import one_of_each
from threatlake.llm.queries import TARGET_WEIGHTS, TOXIC, held_out
from threatlake.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.keep_clean(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, percent=75)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, TARGET_WEIGHTS, rest_weight=1, position_col="mix_position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids, each decoded again: one that doesn't decode to a token for each of its ids is an error."""
    coded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["mix_position"])
    decoded = F.when(F.col("decoded") == "", 0).otherwise(F.size(F.split("decoded", " ")))
    wrong = F.raise_error(F.concat(F.lit("ids and decoded text differ in document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without an id"))))
    return coded.select("doc_id", "mix_position", "n_tokens", F.when(decoded == F.col("n_tokens"), F.col("ids")).otherwise(wrong).alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: The classifier's scores and the token ids are beyond SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
