"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm import html_extract, toxicity
from threatlake.llm.bpe import encode_documents
from threatlake.llm.common import table
from threatlake.llm.conversations import damage, repair_conversations
from threatlake.llm.exact_dedup import exact_duplicates
from threatlake.llm.line_dedup import drop_common_lines
from threatlake.llm.mixing import mix_sources
from threatlake.llm.ngram_join import ngram_components
from threatlake.llm.sharding import shard_documents
from threatlake.llm.simhash import simhash_components
from threatlake.llm.spelling import spelling_groups
from threatlake.llm.token_files import tokenize_to_files
from threatlake.llm.topk import top_inner_products

#: Slots of 100: the largest source is held to its even share; sources that aren't named share one slot.
TARGET_WEIGHTS = {"src0": 4, **{f"src{i}": 5 for i in range(1, 20)}}


#: A document is called toxic from this score on.
TOXIC = 0.3


def held_out(column: str = "doc_id") -> Column:
    """Documents that no label is learnt from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=5, percent=75)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), TARGET_WEIGHTS, rest_weight=1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_points=1)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train_on(pages))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), least=7, min_count=2, factor=10).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(turns), turns.select("conv_id"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_ngram_join, op3_exact_dedup, op4_sharding, op5_token_files, op6_topk, op7_bpe, op8_mixing, op9_line_dedup, op10_html,
    op11_simhash, op12_spelling, op13_conversations)}

SQL = {
    "op3_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
               row_number() over w = 1 as kept, text_sha256
        from t window w as (partition by text_sha256 order by length(text) desc, doc_id)
    """,
    "op6_topk": r"""
        with v as (select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
                   where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
    """,
    "op9_line_dedup": r"""
        with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
        keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
        select doc_id, count(*) as n_lines, count(*) filter (key in (from common)) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by n) filter (key not in (from common)), '')) as kept_sha256
        from keyed group by doc_id
    """,
}
