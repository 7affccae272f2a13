"""The pipeline's stages together, on a small table of several files."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import _components, _order, _plain
from threatlake.llm import queries, toxicity
from threatlake.llm.common import table
from threatlake.llm.mixing import REST, schedule
from threatlake.llm.pretokens import Splitter


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Real documents of four sources in several files, and labels for half of them."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "text", "lang", "concat('src', doc_id % 4) as source", "n_chars")
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id % 2 = 0").selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{path}/labels.parquet")
    return path


def _positions(spark, corpus, weights, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "TARGET_WEIGHTS", weights)
    return {r.doc_id: r.mix_position for r in corpus_pipeline.run(spark, corpus).collect()}


def test_rows_tell_the_mix(spark, corpus, monkeypatch):
    source = {r.doc_id: r.source for r in table(spark, corpus, "documents").collect()}
    found = _positions(spark, corpus, {"src0": 1, "src1": 6, "src2": 1}, monkeypatch)
    other = _positions(spark, corpus, {"src0": 6, "src1": 1, "src2": 1}, monkeypatch)
    assert set(found) == set(other) and found != other
    assert sorted(found.values()) == sorted(other.values()) == list(range(len(found)))
    # Six of nine blocks of eight rows, for as long as there are any.
    first = sorted(found, key=found.get)[:36], sorted(other, key=other.get)[:36]
    for (own, heavy) in zip(first, ("src1", "src0")):
        assert sum(source[i] == heavy for i in own) >= 20
    with pytest.raises(Exception, match="mix_position"):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[1] is not corpus_pipeline.mix])
        corpus_pipeline.run(spark, corpus)


def test_drops_what_the_operator_calls_toxic(spark, tmp_path, monkeypatch):
    """Scores of all sizes, from a model of random n-grams."""
    model = toxicity.Model(np.random.default_rng(4).normal(size=toxicity.BUCKETS) * 3, -0.4)
    monkeypatch.setattr(toxicity, "train_on", lambda *a, **b: model)
    docs = spark.createDataFrame([(k, f"w{k * 7919 % 1009}") for k in range(400)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).selectExpr("doc_id", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op1_toxicity(spark, str(tmp_path)).collect()
    assert sum(0.3 <= r.score < 0.5 for r in found) > 20
    kept = corpus_pipeline.drop_toxic(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in found if not r.predicted)


def _mix_by_hand(rows, hashes):
    """{id: position}: blocks of eight rows of each group, in order of their slots."""
    groups = defaultdict(list)
    for i, _, source in rows:
        groups[source if source in queries.TARGET_WEIGHTS else REST].append(i)
    dealt = {}
    for g, own in groups.items():
        own.sort(key=lambda i: (hashes[i], i))
        dealt[g] = [own[k:k + 8] for k in range(0, len(own), 8)]
    at = {}
    for g, first, last, p, base, period, slots in schedule({g: len(b) for g, b in dealt.items()}, {**queries.TARGET_WEIGHTS, REST: 1}):
        for j in range(first, last):
            at[base + (j - first) // p * period + slots[(j - first) % p]] = dealt[g][j]
    order = [i for slot in sorted(at) for i in at[slot]]
    return {i: k for k, i in enumerate(order)}


def test_run_by_hand(spark, tmp_path):
    """All five stages in plain Python, with the trained model's scores as given."""
    rows = []
    for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(160).collect():
        bad = " grobulish snarviko" * (3 + len((r.text or "").split()) // 20) if r.doc_id % 5 == 0 else ""
        rows.append((r.doc_id, (r.text or "") + bad, r.source))
    clean = [r for r in rows if r[0] % 5]
    rows += [(10_000 + i, f" {t}\n", "src1") for i, t, _ in clean[:15]] + [(20_000 + i, t + " more", None) for i, t, _ in clean[20:50]]
    rows += [(30_000, None, "src2"), (30_001, "", None), (30_002, "one", "elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("grobul" in (t or ""))) for i, t, _ in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train_on(docs, table(spark, str(tmp_path), "labels"), ~queries.held_out())
    scores = model.score(Splitter(spaced=False), [t or "" for _, t, _ in rows])
    left = [[r for r, s in zip(rows, scores) if s < queries.TOXIC]]
    copies = defaultdict(list)
    for r in left[-1]:
        copies[_plain(r[1])].append(r)
    left.append([min(own, key=_order) for own in copies.values()])
    links = _components([(i, t) for i, t, _ in left[-1]])
    left.append([r for r in left[-1] if links[r[0]][1] == r[0]])
    assert len(rows) > len(left[0]) > len(left[1]) > len(left[2])
    position = _mix_by_hand(left[-1], {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in left[-1]}
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "mix_position", "n_tokens", "ids"]
    assert Counter(map(tuple, found.collect())) == Counter((i, position[i], len(x), " ".join(map(str, x))) for i, x in ids.items())


def test_encoded_documents_are_decoded(spark, monkeypatch):
    """The last stage decodes its ids, and notices a document that loses a token by it."""
    docs = spark.createDataFrame([(1, "one two  three", 0), (2, "", 1), (3, None, 2)], "doc_id bigint, text string, mix_position bigint")
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert found[1] >= 3 and found[2] == found[3] == 0
    whole = corpus_pipeline.encode_documents
    monkeypatch.setattr(corpus_pipeline, "encode_documents", lambda *a, **b: whole(*a, **b).withColumn("decoded", F.regexp_replace("decoded", " [^ ]+$", "")))
    with pytest.raises(Exception, match="document 1"):
        corpus_pipeline.encode(spark, docs, "").collect()
