"""Exact duplicates by two-pass Bloom filtering: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.llm.common import SPACES, text_or_empty, unused
from threatlake.session import materialise

#: Bits of filter for each row, and hashes set for each row: about 0.3 % false alarms.
BITS_PER_ROW, PROBES = 12, 4
#: No filter is larger than this; more rows are taken in more rounds, each over its own range of hashes.
FILTER_BYTES = 64 << 20
#: A piece of a filter as it is shuffled.
PIECE_BYTES = 16 << 10
#: Tasks that build one filter: the pieces of a place, one a task, meet in one task.
BUILDERS = 64


def normalised(text: str = "text") -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(text_or_empty(text), SPACES, "")


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions (rows x PROBES) of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        step = (y ^ (y >> np.uint64(31))) | np.uint64(1)
        return (x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _holds(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _put(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _builder(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, times = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            at = _bits(hashes, bits)
            _put(again, at[(times > 1) | _holds(seen, at)])
            _put(seen, at)
        for k in range(0, len(seen), PIECE_BYTES):
            piece = seen[k:k + PIECE_BYTES]
            if piece.any():
                yield pa.record_batch({"piece": pa.array([k // PIECE_BYTES], pa.int32()), "seen": pa.array([piece.tobytes()], pa.binary()),
                                       "again": pa.array([again[k:k + PIECE_BYTES].tobytes()], pa.binary())})

    return build


def _merge(pieces: pa.Table) -> pa.Table:
    """A hash in two tasks' filters has all its bits in both, so their common bits are added to the repeats."""
    seen = again = None
    for a, b in zip(pieces.column("seen"), pieces.column("again")):
        a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
        seen, again = (a, b) if seen is None else (seen | a, again | b | (seen & a))
    return pa.table({"piece": pieces.column("piece").slice(0, 1), "seen": pa.array([seen.tobytes()], pa.binary()), "again": pa.array([again.tobytes()], pa.binary())})


def bloom(hashes: DataFrame, rows: int, which: str = "seen") -> np.ndarray:
    """A Bloom filter of the one column of ``hashes``: of those ``seen``, or seen ``again``.

    Its size follows ``rows`` up to FILTER_BYTES.
    """
    wanted = min(rows * BITS_PER_ROW, FILTER_BYTES * 8)
    bits = max(1, -(-wanted // (PIECE_BYTES * 8))) * PIECE_BYTES * 8
    built = hashes.coalesce(BUILDERS).mapInArrow(_builder(bits), "piece int, seen binary, again binary")
    merged = built.groupBy("piece").applyInArrow(_merge, "piece int, seen binary, again binary").select("piece", which)
    out = np.zeros(bits // 8, np.uint8)
    for piece, held in merged.collect():
        out[piece * PIECE_BYTES:(piece + 1) * PIECE_BYTES] = np.frombuffer(held, np.uint8)
    return out


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return _holds(filter_, _bits(hashes, len(filter_) * 8))


def _flagged(rows: DataFrame, held) -> DataFrame:
    """``rows`` with ``maybe``: the hash in column ``h`` may be one that repeats, by a broadcast filter."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("maybe", pa.array(may_hold(held.value, batch.column("h").to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(flag, T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())]))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same without white space; null is empty, and empty texts
    are equal to each other. Of a group the text with most code points stays, then the smallest
    id (a null id only if there is no other), then one of the rows that tie in both. An empty
    table gives no rows; other columns are not read.

    Ids, lengths and hashes are stored once. Each round takes the rows of one range of hashes:
    tasks set two filters (seen, seen again), pieces of which are merged; rows outside the merged
    filter of repeats pass straight through. The others are counted by their whole SHA-256, so
    false alarms cost a shuffle and change nothing.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"),
                       F.char_length(text_or_empty(text_col)).cast("long").alias("points"))
    narrow = narrow.withColumns({"h": F.xxhash64("text_sha256"), "row": F.monotonically_increasing_id()}).sortWithinPartitions("h")
    narrow = materialise(narrow, "dedup-hashes")
    rows = narrow.count()
    rounds = max(1, -(-rows * BITS_PER_ROW // (FILTER_BYTES * 8)))
    edges = [-(1 << 63) + k * (1 << 64) // rounds for k in range(rounds + 1)]
    parts = []
    for low, high in zip(edges, edges[1:]):
        own = narrow.where(F.col("h").between(low, high - 1))
        held = spark.sparkContext.broadcast(bloom(own.select("h"), -(-rows // rounds), "again"))
        part = _flagged(own, held)
        if rounds > 1:  # stored, so that a filter is let go before the next is built; with one round nothing is gained
            part = materialise(part, "dedup-flags")
            held.destroy()
        parts.append(part)
    flagged = parts[0]
    for part in parts[1:]:
        flagged = flagged.unionAll(part)
    single = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = flagged.where("maybe")
    # ``~`` turns the order round without the overflow of ``-``; a null is the least.
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("last"), F.bitwise_not("row").alias("tie"), "doc_id", "row")).alias("best")
    groups = some.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size"))
    repeated = some.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    return single.unionAll(repeated)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, chosen as in :func:`exact_duplicates`.

    Texts move only where their hash is among the repeats: of these a task sends one row a
    group. One filter serves here, FILTER_BYTES at most; where more hashes repeat than it can
    tell apart, more rows are shuffled and the result is the same.
    """
    names = df.columns
    sha, h, repeats = unused(names, "_sha", "_h", "_maybe")
    hashed = df.withColumns({sha: F.sha2(normalised(text_col), 256)}).withColumn(h, F.xxhash64(sha))
    hashes = materialise(hashed.select(h), "dedup-hashes")
    held = df.sparkSession.sparkContext.broadcast(bloom(hashes, hashes.count(), "again"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held.value, h.to_numpy()))

    flagged = hashed.withColumn(repeats, maybe(h))
    points = F.char_length(text_or_empty(text_col))
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    kept = flagged.where(F.col(repeats)).groupBy(sha).agg(
        F.max_by(row, F.struct(points.alias("points"), F.bitwise_not(F.col(id_col)).alias("last"))).alias("row")).select("row.*")
    return flagged.where(~F.col(repeats)).select(*(F.col(f"`{c}`") for c in names)).unionAll(kept)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is not in the one column of ``ids``. Only rows that a Bloom filter
    of the ids holds are shuffled; a null id is in no list. An empty table or list changes nothing."""
    held = df.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held.value, h.to_numpy()))

    held_name, gone_id = unused(df.columns, "_maybe", "_gone")
    flagged = df.withColumn(held_name, F.col(id_col).isNotNull() & maybe(F.coalesce(F.col(id_col).cast("long"), F.lit(0))))
    rest = flagged.where(F.col(held_name)).join(ids.toDF(gone_id), F.col(id_col) == F.col(gone_id), "left_anti")
    return flagged.where(~F.col(held_name)).unionAll(rest).drop(held_name)
