"""Sharding, mixing and token files against brute force and round trips."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threatlake.llm import simple8b
from threatlake.llm.mixing import REST, mix_sources, mixed_documents, pfair_template, schedule
from threatlake.llm.sharding import shard_documents, write_shards
from threatlake.llm.token_files import tokenize_to_files


def test_shards(odd_docs, odd_rows, no_docs):
    found = shard_documents(odd_docs, shards=5).collect()
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    # Brute force: rows in order, their bytes before them.
    order = sorted(texts.elements(), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, start, wanted, slots = sum(r[1] for r in order), 0, Counter(), Counter()
    for row in order:
        shard = start * 5 // total
        wanted[(*row, shard, slots[shard])] += 1
        slots[shard] += 1
        start += row[1]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found) == wanted
    assert {r.law for r in found} == {"bytes"} and all(r.grown_shard is None for r in found)
    assert shard_documents(no_docs).count() == 0


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(docs, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    sizes = [r.n for r in back.selectExpr("shard", "octet_length(text) + 16 as n").groupBy("shard").sum("n").toDF("shard", "n").collect()]
    assert back.count() == docs.count() and len(sizes) == 4
    largest = docs.selectExpr("max(octet_length(text)) + 16").first()[0]
    assert max(sizes) - min(sizes) <= 2 * largest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_pfair_deviation(parts):
    named = {f"g{k}": p for k, p in enumerate(parts)}
    slots, period = pfair_template(named), sum(parts)
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for g, p in named.items():
        for t in range(period + 1):
            assert abs(sum(s < t for s in slots[g]) - t * p / period) < 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 40), max_size=5))
def test_schedule_places_every_block(blocks):
    weights = {"a": 1, "b": 2, "c": 3, "d": 5, "e": 1}
    at = {}
    for g, first, last, p, base, period, slots in schedule(blocks, weights):
        for j in range(first, last):
            at[g, j] = base + (j - first) // p * period + slots[(j - first) % p]
    assert set(at) == {(g, j) for g, n in blocks.items() for j in range(n)}
    assert sorted(at.values()) == list(range(sum(blocks.values())))


def test_mixing(spark, odd_docs, odd_rows, no_docs):
    weights = {"src0": 3, "src3": 2, "src5": 1}
    found = mix_sources(odd_docs, weights, rest_weight=2, block_rows=2).collect()
    assert len(found) == len(odd_rows) and sorted(r.position for r in found) == list(range(len(odd_rows)))
    assert Counter(r.mix_group for r in found) == Counter(s if s in weights else REST for _, _, s in odd_rows)
    by_slot = {}
    for r in sorted(found, key=lambda r: r.position):
        by_slot.setdefault(r.slot, (r.mix_group, r.block))
    assert list(by_slot) == sorted(by_slot)
    # Up to the first group's end, each is within one block of its share.
    blocks = Counter(g for g, _ in by_slot.values())
    had, whole = Counter(), {**weights, REST: 2}
    for t, (g, _) in enumerate(by_slot.values()):
        if any(had[x] == blocks[x] for x in blocks):
            break
        had[g] += 1
        assert all(abs(had[x] - (t + 1) * whole[x] / sum(whole[y] for y in blocks)) < 1 for x in blocks)
    assert mix_sources(no_docs, weights).count() == 0
    assert mix_sources(odd_docs, {}).where(f"mix_group <> '{REST}'").count() == 0
    with pytest.raises(ValueError):
        mix_sources(odd_docs, {"a": 0})
    kept = mixed_documents(odd_docs, weights)
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, _, _ in odd_rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    coded = simple8b.encode(values)
    assert simple8b.decode(coded).tolist() == values.tolist()
    if len(values) > 256:
        assert simple8b.decode(coded, 1, 2).tolist() == values[256:512].tolist()


def test_token_files(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = tokenize_to_files(odd_docs, path, end_id=0, file_ids=500).collect()
    wanted = {}
    for i, t, _ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in wanted.items()}
    start = 0
    for r in sorted(found, key=lambda r: (r.start)):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokenize_to_files(no_docs, path).count() == 0
