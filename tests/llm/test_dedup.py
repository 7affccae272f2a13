"""Exact dedup, line dedup and the n-gram join against brute force."""

import glob
import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatlake.llm import exact_dedup, line_dedup
from threatlake.llm.components import connected
from threatlake.llm.exact_dedup import drop_duplicates, exact_duplicates, without_ids
from threatlake.llm.line_dedup import build_hash, drop_common_lines, number_of
from threatlake.llm.ngram_join import ngram_components, one_of_each
from threatlake.session import shared_dir

SPACES = " \t\n\r\x0b\x0c"


def _plain(text):
    return "".join(c for c in text or "" if c not in SPACES)


def _order(row):
    return -len(row[1] or ""), row[0] is None, row[0] or 0


def test_exact_duplicates(odd_docs, odd_rows, no_docs):
    groups = defaultdict(list)
    for row in odd_rows:
        groups[_plain(row[1])].append(row)
    wanted = Counter()
    for key, rows in groups.items():
        rows.sort(key=_order)
        for k, row in enumerate(rows):
            wanted[row[0], rows[0][0], len(rows), k == 0, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_duplicates(odd_docs).collect()) == wanted
    assert exact_duplicates(no_docs).count() == 0
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == Counter((rows[0][0], rows[0][1]) for rows in groups.values())
    assert drop_duplicates(no_docs).count() == 0


def test_exact_duplicates_in_rounds(odd_docs, monkeypatch):
    one = sorted(exact_duplicates(odd_docs).collect(), key=str)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 32)
    monkeypatch.setattr(exact_dedup, "PIECE_BYTES", 8)
    assert sorted(exact_duplicates(odd_docs).collect(), key=str) == one


def test_without_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id bigint, text string")
    left = without_ids(df, spark.createDataFrame([(2,), (9,)], "x bigint"))
    assert sorted(r.text for r in left.collect()) == ["a", "c"]


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, True), (2, "ab", "y", 2, False), (3, "c", "z", 3, True)], "doc_id bigint, text string, _sha string, _h int, _maybe boolean")
    kept = drop_duplicates(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "a b", "x", 1, True), (3, "c", "z", 3, True)]
    left = without_ids(df.withColumn("_gone", F.lit("g")), spark.createDataFrame([(1,)], "doc_id bigint"))
    assert left.columns == [*df.columns, "_gone"] and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_common_lines(odd_docs, odd_rows, no_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    docs = Counter(k for _, t, _ in odd_rows for k in {key(x) for x in (t or "").split("\n")})
    wanted = Counter()
    for i, text, _ in odd_rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < 10]
        wanted[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter(tuple(r) for r in drop_common_lines(odd_docs).collect()) == wanted
    assert sum(n for (_, _, d, _), n in wanted.items() if d) >= 12
    assert drop_common_lines(no_docs).count() == 0


def test_common_lines_in_shards(odd_docs, monkeypatch):
    one = sorted(drop_common_lines(odd_docs, min_docs=2).collect(), key=str)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    assert sorted(drop_common_lines(odd_docs, min_docs=2).collect(), key=str) == one


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert sorted(number_of(build_hash(keys), keys).tolist()) == list(range(len(keys)))


def _components(rows, words=5, percent=75):
    sets = defaultdict(set)
    for i, t in rows:
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(str.maketrans(SPACES, " " * len(SPACES))).split(" ")
        own = [w for w in own if w]
        sets[i] = {tuple(own[k:k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for a, b in {p for own in by.values() for p in itertools.combinations(sorted(own), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_components(odd_docs, odd_rows, no_docs):
    wanted = _components([(i, t) for i, t, _ in odd_rows if i is not None])
    found = ngram_components(odd_docs).collect()
    assert len(found) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert wanted[1008][1] == 1007 and wanted[1011][1] == 1009
    assert ngram_components(no_docs).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, _, _ in odd_rows if i is None or wanted[i][1] == i)


def test_ngram_components_of_a_large_group(spark):
    """Near copies of which the smallest links with few: chains have to be found among the rest."""
    rows, base = [], [f"t{k}" for k in range(120)]
    for k in range(60):
        rows.append((k, " ".join(base[k // 2:] + [f"s{k}_{j}" for j in range(k // 2)])))
    rows += [(100 + k, " ".join(base[:60] + [f"o{k}_{j}" for j in range(8 + k % 30)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df).collect()} == _components(rows)


def test_ngram_components_alike_by_chance(spark):
    """Documents that share a few phrases with many others are in no list; those that link are found."""
    rng = np.random.default_rng(7)
    phrases = [" ".join(f"p{k}_{j}" for j in range(7)) for k in range(900)]
    rows = [(i, " ".join(x for j, k in enumerate(rng.integers(0, 900, 6)) for x in (*(f"d{i}_{j}_{m}" for m in range(10)), phrases[k]))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 600, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()
    folder = shared_dir(spark)
    before = set(glob.glob(f"{folder}/lists-*"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df).collect()}
    made = [p for p in set(glob.glob(f"{folder}/lists-*")) - before if "apart" not in p]
    docs = {r.doc for r in spark.read.parquet(*made).select("doc").collect()}
    assert found == _components(rows)
    assert sum(r != i for i, (_, r) in found.items()) == 12
    assert {i for i in docs if i >= 1000} == {i for i, _ in rows[600:]} and len(docs) < 60


def test_connected(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50), (60, 100), (7, 7)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "node bigint, root bigint")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 60: 50, 100: 50}
    assert connected(spark.createDataFrame([], "node bigint, root bigint")).where(F.lit(True)).count() == 0
