"""Near duplicates by fingerprints that differ in few bits, met in the middle.

Two fingerprints within a radius have a common variant within half the radius of each, so every
distinct fingerprint emits the whole ball of its variants and those that collide are linked. All
that share a variant are within the radius of each other: a star links them, no pairs are formed.

Variants are shuffled in buckets. The 64 bits are dealt to groups and a bucket is the parities of
the groups, so a flipped bit flips one parity: the thousands of variants of a fingerprint fall into
a few hundred buckets that are known beforehand. Those of a bucket travel as one row, the
fingerprint, and are written out where they arrive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.common import heavy_lookup, width
from threatlake.llm.components import connected
from threatlake.session import materialise

#: Bytes of a text that are hashed at a time.
PIECE_BYTES = 1 << 20
#: Fingerprints of a bucket, on average, from which the bits are dealt to more groups.
BUCKET_ROWS = 100_000
#: Rows (fingerprints in buckets) of one task and of one block of it, variants sorted at a time.
TASK_ROWS, BLOCK_ROWS, SLICE = 4_000_000, 200_000, 1 << 22
#: Links that a task holds before it reduces and passes them on.
PENDING = 1_000_000
_BLANK = re.compile(rb"[ \t-\r]")


def _digests(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """Bytes (shingles x 8, the first the highest) of the shingles' XXH64, in pieces of the text."""
    data = text.encode().lower()  # of bytes, only A-Z have a lower case
    at, carry, digest, any_ = 0, [], xxhash.xxh64_digest, False
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        own = carry + data[at:end].split()
        at, carry = end, own[-(words - 1):] if words > 1 else []
        if len(own) < words:
            continue
        joined, last = b" ".join(own), np.cumsum([len(w) + 1 for w in own])
        first = np.concatenate([[0], last[:-1]])
        any_ = True
        yield np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(first.tolist(), (last[words - 1:] - 1).tolist())]), np.uint8).reshape(-1, 8)
    if not any_ and carry:
        yield np.frombuffer(digest(b" ".join(carry), seed), np.uint8).reshape(1, 8)


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number: bits that are set in over half of all shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for digests in _digests(text, words, seed):
        for k in range(0, len(digests), 1 << 16):
            ones += np.unpackbits(digests[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
        n += len(digests)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _prints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or "", words, seed) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "print": pa.array(prints, pa.int64())})

    return run


class Ball:
    """Masks of up to ``radius`` bits, by the bucket shift that they cause among ``groups`` groups of bits."""

    def __init__(self, radius: int, groups: int):
        self.members = [sum(1 << b for b in range(64) if b % groups == g) for g in range(groups)]
        by_shift: dict[int, list[int]] = {}
        for r in range(radius + 1):
            for bits in combinations(range(64), r):
                shift = 0
                for b in bits:
                    shift ^= 1 << b % groups
                by_shift.setdefault(shift, []).append(sum(1 << b for b in bits))
        self.shifts = sorted(by_shift)
        self.masks = {s: np.array(m, np.uint64) for s, m in by_shift.items()}

    def own(self, prints: np.ndarray) -> np.ndarray:
        """The bucket of each fingerprint itself."""
        out = np.zeros(len(prints), np.int64)
        for g, members in enumerate(self.members):
            out |= (np.bitwise_count(prints & np.uint64(members)) & 1).astype(np.int64) << g
        return out

    def own_column(self, column: str) -> Column:
        out = F.lit(0).cast("long")
        for g, members in enumerate(self.members):
            signed = members - (1 << 64) if members >> 63 else members
            out = out.bitwiseOR(F.shiftleft((F.bit_count(F.col(column).bitwiseAND(F.lit(signed))) % 2).cast("long"), g))
        return out


def groups_for(prints: int, radius: int) -> int:
    """Groups of bits such that a bucket holds about BUCKET_ROWS of so many fingerprints or fewer."""
    for groups in range(16, 64, 4):
        if prints * sum(comb(groups, r) for r in range(radius + 1)) <= BUCKET_ROWS << groups:
            return groups
    return 64


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes, one for each node but the first of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _collisions(z: np.ndarray, owner: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that have a variant in common: of each variant, all with one."""
    # The high bits of a hash and the place below them are sorted as one number; what is alike in
    # the high bits is sorted by the variant itself.
    place = np.uint64((1 << len(z).bit_length()) - 1)
    with np.errstate(over="ignore"):
        key = z * np.uint64(0x9E3779B97F4A7C15) & ~place | np.arange(len(z), dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) <= place
    some = (key[np.append(False, same) | np.append(same, False)] & place).astype(np.int64)
    if not len(some):
        return prints[:0], prints[:0]
    some = some[np.argsort(z[some], kind="stable")]
    variant, who = z[some], prints[owner[some]]
    first = np.append(True, variant[1:] != variant[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    a, b = who[lead][~first], who[~first]
    near = np.bitwise_count(a ^ b) <= radius
    return a[near], b[near]


def _meet(ball: Ball, radius: int):
    """Links among the fingerprints of a task's buckets, which come one after the other."""

    def block(bucket: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        shift = bucket ^ ball.own(prints)
        order = np.argsort(shift, kind="stable")
        kinds, starts = np.unique(shift[order], return_index=True)
        rows = list(zip(kinds.tolist(), np.split(order, starts[1:])))
        slices = -(-sum(len(ball.masks[s]) * len(r) for s, r in rows) // SLICE)
        for k in range(slices):
            z, owner = [], []
            for s, own in rows:
                masks = ball.masks[s]
                for i in range(0, len(own), step := max(1, SLICE // len(masks))):
                    variants = (prints[own[i:i + step]][:, None] ^ masks).ravel()
                    holders = np.repeat(own[i:i + step], len(masks))
                    if slices > 1:
                        with np.errstate(over="ignore"):
                            mine = (variants * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(slices) == k
                        variants, holders = variants[mine], holders[mine]
                    z.append(variants)
                    owner.append(holders)
            yield _collisions(np.concatenate(z), np.concatenate(owner), prints, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            a, b = forest(*(np.concatenate(x) for x in zip(*links)))
            links[:] = [(a, b)]
            return a, b

        def out() -> pa.RecordBatch:
            a, b = reduced()
            links.clear()
            return pa.record_batch({"node": pa.array(a.view(np.int64)), "root": pa.array(b.view(np.int64))})

        def add(bucket: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in block(bucket, prints):
                if len(a):
                    links.append((a, b))
            if sum(len(a) for a, _ in links) >= PENDING and len(reduced()[0]) >= PENDING // 2:
                yield out()

        buckets, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(x) for x, _ in held) < BLOCK_ROWS:
                continue
            buckets, prints = (np.concatenate(x) for x in zip((buckets, prints), *held))
            held = []
            cut = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            if cut:
                yield from add(buckets[:cut], prints[:cut])
                buckets, prints = buckets[cut:], prints[cut:]
        buckets, prints = (np.concatenate(x) for x in zip((buckets, prints), *held))
        if len(buckets):
            yield from add(buckets, prints)
        if links:
            yield out()

    return run


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """``node, root``: links that join what pairs of the distinct fingerprints within ``radius`` (even) join."""
    n = prints.count()
    ball = Ball(radius // 2, groups := groups_for(n, radius // 2))
    rows = prints.select(F.explode(F.array(*(F.lit(s).cast("long") for s in ball.shifts))).alias("shift"), "print").select(
        ball.own_column("print").bitwiseXOR(F.col("shift")).alias("bucket"), "print")
    tasks = max(width(prints.sparkSession), -(-n * len(ball.shifts) // TASK_ROWS))
    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(ball, radius), "node bigint, root bigint")


def simhash_components(df: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A-Z are lower-cased and words are what white space of ``[\\x20\\x09-\\x0D]`` separates; a text of
    fewer than ``words`` words is one shingle, one without words (null too) has the fingerprint
    zero and links like any other. Fingerprints link at ``radius`` (even) or fewer differing bits;
    ``component_id`` is the smallest id that links lead to, the row's own included. Rows without
    an id link like others and give no component its id: it is null if none has one. Rows that
    share an id are rows of their own. An empty table gives no rows; other columns are not read.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(narrow.mapInArrow(_prints(words, seed), "doc_id bigint, print bigint"), "fingerprints")
    classes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    roots = connected(near_links(classes.select("print"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = materialise(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = heavy_lookup(rooted.select("print", "root", F.col("n").alias("rows")), least, "root", rooted.count())
    found = heavy_lookup(prints, materialise(named.select("print", "component_id", F.col("rows").alias("n")), "fingerprint-components"), "print", prints.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
