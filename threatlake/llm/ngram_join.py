"""Jaccard join of documents on word shingles, by vertical partitioning of the shingle order.

All shingles have one global order: those found in few documents by hash, then the frequent
ones by hash. A link needs a shingle that is in the prefixes of both documents in this order;
prefixes give the candidates. Candidates are counted fragment by fragment: the order is cut into
fragments, each pair's common shingles are counted in every fragment on its own, and the counts
are summed by pair.

Before that, a pair's bit maps (a bit for each shingle's hash, flipped by every shingle that has it)
are compared: bits that differ are at most the shingles that do, so pairs with too many are out.

A document links only with documents that have as many of its shingles as the threshold asks for. While
shingles are counted, each document is told how many of its own others have too; where these are too few,
as in texts that are alike by chance, it has no links and is in no list.

Only components are wanted, so a link inside a component that is known already need not be
counted: each prefix shingle first links its documents to one of them, the one with most frequent
shingles, so that a group of copies meets in one near its common origin. Of documents that share a
shingle and are still in different components all pairs are looked at, by their bit maps and in
blocks, and those that may link are counted. Documents with the same shingles are one class from
the start, of which one is listed, and shingles with the same documents one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.components import connected
from threatlake.llm.exact_dedup import bloom, may_hold, without_ids
from threatlake.llm.pretokens import release
from threatlake.llm.shingles import Shingler, batches_of
from threatlake.session import materialise

#: Shingles of a bucket, in which they are counted in one task, and of prefixes that are joined in one.
BUCKET_SHINGLES, PREFIX_SHINGLES = 2_500_000, 600_000
#: Shingles in at least so many documents may come last in the order; at most so many do, the
#: least frequent of them first given up. The bound is on what is broadcast: any order is right.
FREQUENT_DOCS, FREQUENT_SHINGLES = 16, 1_000_000
#: Fragments of the global order: FRAGMENTS - 1 of rare shingles and one of frequent ones.
FRAGMENTS = 4
#: Shingles that a task holds before it passes them on.
PENDING = 1_200_000
#: Documents of a list that are compared in one block, and rows of lists in one task.
BLOCK_DOCS, LIST_ROWS = 2_048, 100_000


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _texts(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[list[tuple[int | None, str]]]:
    """Ids and texts, with a filter those of the documents that it may hold."""

    def rows() -> Iterator[tuple[int | None, str]]:
        for b in batches:
            names, texts = b.column(0), b.column(1)
            if wanted is None:
                yield from ((i, t.as_py() or "") for i, t in zip(names.to_pylist(), texts))
                continue
            ids = names.fill_null(0).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(may_hold(wanted.value, ids) & names.is_valid().to_numpy(zero_copy_only=False)).tolist():
                yield int(ids[k]), texts[k].as_py() or ""

    return batches_of(rows())


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """Documents with an id, of those with the same shingles only a task's first."""
    shingler, seen = Shingler(words), set()
    for rows in _texts(batches, wanted):
        for (name, _), tokens in zip(rows, shingler.sets([t for _, t in rows])):
            if name is None or not len(tokens) or (mark := _signature(tokens)) in seen:
                continue
            seen.add(mark)
            yield name, tokens
    release()


def _bitmap(tokens: np.ndarray) -> bytes:
    """Four bits or more for each shingle, a power of two."""
    bits = max(512, 1 << int(4 * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Bits that differ, the longer map folded to the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum())


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for rows in _texts(batches):
            sets = shingler.sets([t for _, t in rows])
            marks = [_signature(s) if len(s) else (None, None) for s in sets]
            yield pa.record_batch({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                                   "s1": pa.array([a for a, _ in marks], pa.int64()), "s2": pa.array([b for _, b in marks], pa.int64()),
                                   "bits": pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary())})
        release()

    return run


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens >> np.uint64(32)) % np.uint64(buckets)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(sorted_))


def _key(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What documents are counted by: bucket and low half. Shingles that share it are counted together."""
    return _bucket(tokens, buckets) << np.uint64(32) | tokens & np.uint64(0xFFFFFFFF)


_COUNTED = "bucket int, block bigint, keys binary, owners binary, places binary, counts binary, about binary"


def _count_shingles(words: int, buckets: int):
    """Rows of a bucket's keys with their documents, counted within a block of the task before they are shuffled.

    A key that several documents of the block have is shared already: they are credited for it here. Of the
    others the owner goes along, so that the bucket can tell the block which of them other blocks have too.
    """

    def flush(block: int, held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(k) for _, k in held]
        keys, owner = np.concatenate([k for _, k in held]), np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        starts, ends = _runs(keys)
        counts = ends - starts
        more = counts > 1
        credit = np.bincount(owner[np.repeat(more, counts)], minlength=len(held))
        about = np.stack([np.array([i for i, _ in held], np.int64), np.array(sizes, np.int64), credit], axis=1).tobytes()
        keys, owner = keys[starts], owner[starts]
        bucket, low = keys >> np.uint64(32), keys.astype(np.uint32)
        for a, b in zip(*_runs(bucket)):
            several = np.flatnonzero(more[a:b])
            packed = {"keys": low[a:b], "owners": owner[a:b], "places": several.astype(np.uint32), "counts": counts[a:b][several].astype(np.uint32)}
            yield pa.record_batch({"bucket": pa.array([int(bucket[a])], pa.int32()), "block": pa.array([block], pa.int64()),
                                   **{c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()}, "about": pa.array([b"" if a else about], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32
        for name, tokens in _distinct_sets(batches, words):
            held.append((name, _key(tokens, buckets)))
            size += len(tokens)
            if size >= PENDING:
                yield from flush(block, held)
                held, size, block = [], 0, block + 1
        if held:
            yield from flush(block, held)

    return run


_SUMMED = "key bigint, docs bigint, block bigint, owners binary, about binary"


def _sum_bucket(rows: pa.Table) -> pa.Table:
    """The frequent keys of a bucket, and for each block the owners of keys that other blocks have too, once for each."""
    keys, counts = [], []
    for low, places, several in zip(*(rows.column(c) for c in ("keys", "places", "counts"))):
        keys.append(np.frombuffer(low.as_py(), np.uint32))
        counts.append(n := np.ones(len(keys[-1]), np.uint32))
        n[np.frombuffer(places.as_py(), np.uint32)] = np.frombuffer(several.as_py(), np.uint32)
    edges = np.cumsum([0, *(len(k) for k in keys)]).tolist()
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    low = keys[order]
    starts, ends = _runs(low)
    totals = np.add.reduceat(counts[order].astype(np.int64), starts)
    often = totals >= FREQUENT_DOCS
    names = np.uint64(rows.column("bucket")[0].as_py()) << np.uint64(32) | low[starts][often]
    shared = np.zeros(len(keys), bool)
    shared[order] = np.repeat(totals > 1, ends - starts)
    shared &= counts == 1
    told = [np.frombuffer(o.as_py(), np.uint32)[shared[a:b]].tobytes() for o, a, b in zip(rows.column("owners"), edges, edges[1:])]
    none, blocks = [None] * len(names), [None] * len(told)
    return pa.table({"key": pa.array([*names.view(np.int64).tolist(), *blocks], pa.int64()), "docs": pa.array([*totals[often].tolist(), *blocks], pa.int64()),
                     "block": pa.array([*none, *rows.column("block").to_pylist()], pa.int64()), "owners": pa.array([*none, *told], pa.binary()),
                     "about": pa.array([*none, *rows.column("about").to_pylist()], pa.binary())})


def frequent_shingles(summed: DataFrame) -> np.ndarray:
    """Sorted keys of the shingles that come last in the order."""
    often = summed.where("key is not null").select("key", "docs")
    # How many have at least 2^k documents: a few rows.
    steps = often.groupBy(F.floor(F.log2("docs")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    edge, total = None, 0
    for row in steps:
        if total + row.n > FREQUENT_SHINGLES:
            break
        edge, total = 1 << row.k, total + row.n
    if edge is None:
        return np.zeros(0, np.uint64)
    keys = often.where(F.col("docs") >= edge).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.view(np.uint64))


def _enough_shared(percent: int):
    """Documents of a block with as many shared shingles as a link asks for: a union has at least all of their own."""

    def run(rows: pa.Table) -> pa.Table:
        about = np.frombuffer(b"".join(rows.column("about").to_pylist()), np.int64).reshape(-1, 3)
        owners = np.frombuffer(b"".join(rows.column("owners").to_pylist()), np.uint32)
        shared = about[:, 2] + np.bincount(owners, minlength=len(about))
        enough = about[100 * shared >= percent * about[:, 1]]
        return pa.table({"doc": pa.array(enough[:, 0]), "n": pa.array(enough[:, 1])})

    return run


def _among(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(keys), bool)
    return frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys


def _prefix(tokens: np.ndarray, frequent: np.ndarray, buckets: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rare and the frequent shingles of the prefix, and how many are frequent in all: without
    one of the prefix in common, two sets can't reach the threshold."""
    last = _among(_key(tokens, buckets), frequent)
    size = len(tokens) - -(-percent * len(tokens) // 100) + 1
    rare = tokens[~last][:size]
    return rare, tokens[last][:size - len(rare)], int(last.sum())


def _rare_prefixes(words: int, buckets: int, percent: int, frequent, wanted, deal: int):
    """Rows of a bucket's shingles of rare prefixes with their documents, in ``deal`` buckets."""

    def flush(held: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for *_, t in held])
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for *_, t in held])
        about = np.array([x[:3] for x in held], np.int64)
        bucket = _bucket(tokens, deal)
        order = np.argsort(bucket, kind="stable")
        for a, b in zip(*_runs(bucket[order])):
            own = order[a:b]
            who, place = np.unique(owner[own], return_inverse=True)
            yield pa.record_batch({"bucket": pa.array([int(bucket[own[0]])], pa.int32()), "tokens": pa.array([tokens[own].tobytes()], pa.binary()),
                                   "owners": pa.array([place.astype(np.uint32).tobytes()], pa.binary()), "docs": pa.array([about[who].tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name, tokens in _distinct_sets(batches, words, wanted):
            rare, _, common = _prefix(tokens, frequent.value, buckets, percent)
            held.append((name, len(tokens), common, rare))
            size += len(rare) + 1
            if size >= PENDING // 4:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _frequent_prefixes(words: int, buckets: int, percent: int, frequent, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, tokens in _distinct_sets(batches, words, wanted):
            _, last, common = _prefix(tokens, frequent.value, buckets, percent)
            if len(last):
                yield pa.record_batch({"list": pa.array(last.view(np.int64)), **{c: pa.array(np.full(len(last), x, np.int64)) for c, x in (("doc", name), ("n", len(tokens)), ("common", common))}})

    return run


def _as_lists(rows: pa.Table) -> pa.Table:
    """Documents of each rare shingle of a bucket that has several; shingles with the same documents are one list."""
    tokens, about = [], []
    for t, o, d in zip(*(rows.column(c) for c in ("tokens", "owners", "docs"))):
        tokens.append(np.frombuffer(t.as_py(), np.uint64))
        about.append(np.frombuffer(d.as_py(), np.int64).reshape(-1, 3)[np.frombuffer(o.as_py(), np.uint32)])
    tokens, about = np.concatenate(tokens), np.concatenate(about)
    order = np.lexsort((about[:, 0], tokens))
    tokens, about = tokens[order], about[order]
    starts, ends = _runs(tokens)
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    if not len(starts):
        return pa.table({c: pa.array([], pa.int64()) for c in ("list", "doc", "n", "common")})
    with np.errstate(over="ignore"):
        x = about[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(32)), dtype=np.uint64)])
        marks = (total[ends] - total[starts]) ^ (ends - starts).astype(np.uint64)
    marks, first = np.unique(marks, return_index=True)
    size = (ends - starts)[first]
    at = np.arange(size.sum()) + np.repeat(starts[first] - (np.cumsum(size) - size), size)
    return pa.table({"list": pa.array(np.repeat(marks, size).view(np.int64)), **{c: pa.array(about[at, k]) for k, c in enumerate(("doc", "n", "common"))}})


def _cross(percent: int):
    """Pairs of a block that are in different components and may link by their sizes and bit maps."""

    def fold(maps: list[np.ndarray], words: int) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(m.reshape(-1, words), axis=0) for m in maps])

    def block(doc, n, root, side, maps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = np.array([len(m) for m in maps])
        for low in np.unique(words):
            # Documents that may link differ by less than a power of two in size.
            own = np.flatnonzero((words == low) | (words == 2 * low))
            bits = fold([maps[k] for k in own], low)
            for i in range(len(own) - 1):
                k, rest = own[i], own[i + 1:]
                fits = (root[rest] != root[k]) & ((words[rest] == low) | (words[k] == low)) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
                fits &= (side[rest] != side[k]) | (side[k] < 0)
                if not fits.any():
                    continue
                near = np.flatnonzero(fits)
                apart = np.bitwise_count(bits[i + 1:][near] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = rest[near[apart * (100 + percent) <= (n[rest[near]] + n[k]) * (100 - percent)]]
                if len(near):
                    yield np.minimum(doc[near], doc[k]), np.maximum(doc[near], doc[k])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("list", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key = np.stack([rows.column(c).to_numpy() for c in ("list", "i", "j")])
        doc, n, root = (rows.column(c).to_numpy() for c in ("doc", "n", "root"))
        side, bits = rows.column("side").to_numpy(), rows.column("bits").combine_chunks()
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)]):
            if b - a > 1 and (root[a:b] != root[a]).any():
                maps = [np.frombuffer(bits[k].as_buffer(), np.uint64) for k in range(a, b)]
                found += [np.stack(p, axis=1) for p in block(doc[a:b], n[a:b], root[a:b], side[a:b], maps)]
                if len(found) > 10_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _plausible(percent: int):
    """Pairs that their sizes and bit maps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = np.array([_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"))], np.int64)
            # 100 I >= p (n - I) and a difference D = n - 2 I bound D by n (100 - p) / (100 + p).
            fits = apart * (100 + percent) <= n * (100 - percent)
            yield batch.drop_columns(["bits_a", "bits_b"]).filter(pa.array(fits))

    return run


def _fragments(words: int, buckets: int, frequent, wanted):
    """Shingles by fragment of the documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for some in _texts(batches, wanted):
            out = []
            for (name, _), tokens in zip(some, shingler.sets([t for _, t in some])):
                if not len(tokens):
                    continue
                mark, last = _signature(tokens), _among(_key(tokens, buckets), frequent.value)
                rare = tokens[~last]
                cut = np.searchsorted(rare, np.array([k * (1 << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)], np.uint64))
                for k, part in enumerate([*np.split(rare, cut), tokens[last]]):
                    if len(part):
                        out.append((name, *mark, k, part.tobytes()))
            yield pa.record_batch({"doc": pa.array([x[0] for x in out], pa.int64()), "s1": pa.array([x[1] for x in out], pa.int64()), "s2": pa.array([x[2] for x in out], pa.int64()),
                                   "fragment": pa.array([x[3] for x in out], pa.int32()), "tokens": pa.array([x[4] for x in out], pa.binary())})
        release()

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("tokens_a"), batch.column("tokens_b")
        common = [len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(x, y)]
        yield pa.record_batch({**{c: batch.column(c) for c in ("a", "b", "n_a", "n_b", "fragment")}, "common": pa.array(common, pa.int64())})


def _linked(pairs: DataFrame, narrow: DataFrame, class_of: DataFrame, words: int, percent: int, buckets: int, frequent) -> DataFrame:
    """Of ``a, b`` the pairs that link: overlaps by fragment, summed by pair."""
    spark = pairs.sparkSession
    own = class_of.where("doc_id = class_id")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("s1", "s2", "bits")), F.col("n_shingles").alias(f"n_{side}")), side)
    kinds = "a bigint, b bigint, s1_a bigint, s2_a bigint, s1_b bigint, s2_b bigint, n_a bigint, n_b bigint"
    columns = [c.split(" ")[0] for c in kinds.split(", ")]
    some = materialise(pairs.select(*columns, "bits_a", "bits_b").mapInArrow(_plausible(percent), kinds), "plausible-pairs")
    docs = some.select(F.col("a").alias("doc")).unionAll(some.select("b"))
    wanted = spark.sparkContext.broadcast(bloom(docs, 2 * some.count()))
    fragments = narrow.mapInArrow(_fragments(words, buckets, frequent, wanted), "doc bigint, s1 bigint, s2 bigint, fragment int, tokens binary")
    cut = some.select("*", F.explode(F.array(*(F.lit(k) for k in range(FRAGMENTS)))).alias("of"))
    # Both joins have the same keys of the fragments, so these are shuffled once.
    for side in ("a", "b"):
        f = fragments.alias(f"f_{side}")
        match = F.col("of") == F.col(f"f_{side}.fragment")
        for mine, its in ((side, "doc"), (f"s1_{side}", "s1"), (f"s2_{side}", "s2")):
            match = match & (F.col(mine) == F.col(f"f_{side}.{its}"))
        cut = cut.join(f, match)
    counted = cut.select("a", "b", "n_a", "n_b", F.col("of").alias("fragment"), F.col("f_a.tokens").alias("tokens_a"), F.col("f_b.tokens").alias("tokens_b")).mapInArrow(
        _overlaps, "a bigint, b bigint, n_a bigint, n_b bigint, fragment int, common bigint")
    # Rows that repeat a document count a fragment once.
    summed = counted.dropDuplicates(["a", "b", "fragment"]).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("common").alias("common"))
    return summed.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select(F.col("a").alias("node"), F.col("b").alias("root"))


def _linkable(summed: DataFrame, class_of: DataFrame, percent: int) -> DataFrame:
    """One document of each class that may link, and its shingles: copies of one document need be in no list."""
    told = summed.where("block is not null").select("block", "owners", "about")
    enough = told.groupBy("block").applyInArrow(_enough_shared(percent), "doc bigint, n bigint")
    of_class = class_of.select(F.col("doc_id").alias("doc"), "class_id")
    return materialise(enough.join(of_class, "doc").groupBy(F.col("class_id").alias("doc")).agg(F.max("n").alias("n")), "may-link")


def _lists(narrow: DataFrame, linkable: DataFrame, words: int, percent: int, buckets: int, frequent) -> DataFrame:
    """``list, doc, n, common``: documents that have a shingle of their prefixes in common."""
    docs, shingles = linkable.agg(F.count("doc"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = narrow.sparkSession.sparkContext.broadcast(bloom(linkable.select("doc"), docs))
    # Shingles with the same documents are one list only within a bucket: no more buckets than prefixes ask for.
    deal = max(1, -(-(shingles * (100 - percent) // 100 + docs) // PREFIX_SHINGLES))
    rare = narrow.mapInArrow(_rare_prefixes(words, buckets, percent, frequent, wanted, deal), "bucket int, tokens binary, owners binary, docs binary")
    lists = rare.groupBy("bucket").applyInArrow(_as_lists, "list bigint, doc bigint, n bigint, common bigint")
    return lists.unionAll(narrow.mapInArrow(_frequent_prefixes(words, buckets, percent, frequent, wanted), "list bigint, doc bigint, n bigint, common bigint"))


def ngram_components(df: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, class_id``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` of their shingle sets (see
    :class:`Shingler`); ``component_id`` is the smallest id that links lead to and ``class_id``
    the smallest with the same shingles. Documents without words (null texts too) have 0
    shingles and are their own component. Rows without an id have neither and link nothing.
    Rows that share an id share its component; if their texts differ, the one with the
    smallest signature stands for the id. An empty table gives no rows; other columns are not
    read. Ids are integers.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(narrow.mapInArrow(_describe(words), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bits binary"), "shingle-sets")
    known = sets.where("doc_id is not null and s1 is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n_shingles", "bits")).alias("x")).select("doc_id", "x.*")
    classes = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"))
    class_of = materialise(known.join(classes, ["s1", "s2"]).select("doc_id", "class_id", "s1", "s2", "n_shingles", "bits"), "shingle-classes")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_SHINGLES))
    counted = narrow.mapInArrow(_count_shingles(words, buckets), _COUNTED)
    summed = materialise(counted.groupBy("bucket").applyInArrow(_sum_bucket, _SUMMED), "shingle-counts")
    frequent = spark.sparkContext.broadcast(frequent_shingles(summed))
    lists = _lists(narrow, _linkable(summed, class_of, percent), words, percent, buckets, frequent)
    # Copies in other tasks are one class; lists of buckets that are the same become one.
    by_class = lists.join(class_of.select(F.col("doc_id").alias("doc"), "class_id"), "doc").groupBy("list", F.col("class_id").alias("doc")).agg(
        F.first("n").alias("n"), F.first("common").alias("common"))
    lists = materialise(by_class, "lists")

    centre = lists.groupBy("list").agg(F.max(F.struct("common", "n", F.bitwise_not("doc").alias("last"), "doc")).alias("centre"), F.count(F.lit(1)).alias("members"))
    centre = centre.where("members > 1").select("list", F.col("centre.doc").alias("c"), F.col("centre.n").alias("c_n"), "members")
    stars = lists.join(centre, "list").where((F.col("c") != F.col("doc")) & (F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent))
    first = materialise(stars.select(F.least("doc", "c").alias("a"), F.greatest("doc", "c").alias("b")).distinct(), "first-pairs")
    how = (narrow, class_of, words, percent, buckets, frequent)
    roots = connected(_linked(first, *how))

    # Lists of more than two whose documents are still apart, in blocks: with c blocks of a list, a
    # document is in c pairs of blocks. Blocks of one list go to tasks of their own.
    rooted = lists.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    apart = rooted.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members")).where("members > 2 and x <> y")
    left = materialise(rooted.join(apart.select("list", F.ceil(F.col("members") / BLOCK_DOCS).cast("int").alias("blocks")), "list"), "lists-apart")
    mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "list", "doc", "n", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1)).alias("side"))
    with_bits = dealt.join(class_of.where("doc_id = class_id").select(F.col("doc_id").alias("doc"), "bits"), "doc")
    tasks = max(1, -(-left.count() // LIST_ROWS)) * 4
    pairs = with_bits.withColumn("task", F.pmod(F.xxhash64("list", "i", "j"), F.lit(tasks))).groupBy("task").applyInArrow(_cross(percent), "a bigint, b bigint")
    second = materialise(pairs.distinct().join(first, ["a", "b"], "left_anti"), "second-pairs")
    if not second.isEmpty():
        roots = connected(roots.unionAll(_linked(second, *how)))

    of_class = class_of.select(F.col("doc_id").alias("_id"), "class_id").join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    joined = sets.drop("bits", "s1", "s2").join(of_class, F.col("doc_id") == F.col("_id"), "left")
    own = F.coalesce("root", "class_id", "doc_id")
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df``, all columns, with one document of each component: that of the smallest id."""
    found = ngram_components(df, id_col=id_col, text_col=text_col, **options)
    gone = materialise(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return without_ids(df, gone, id_col)
