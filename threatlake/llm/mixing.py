"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.common import range_parts, with_offsets
from threatlake.session import small_table

#: The group of rows whose source has no weight of its own, null sources included.
REST = "(rest)"


def pfair_template(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of one period of ``sum(parts)`` slots, by group, earliest deadline first.

    Block j of a group with p of Q slots is released at floor(j * Q / p) and due at
    ceil((j + 1) * Q / p). Weights sum to 1, so every deadline is met, and after t slots a
    group has had less than one block more or less than t * p / Q.
    """
    period = sum(parts.values())
    releases: list[list[tuple[int, int, str]]] = [[] for _ in range(period)]
    for group, p in parts.items():
        for j in range(p):
            releases[j * period // p].append((-(-(j + 1) * period // p), j, group))
    slots: dict[str, list[int]] = {group: [] for group in parts}
    ready: list[tuple[int, int, str]] = []
    for t in range(period):
        for x in releases[t]:
            heapq.heappush(ready, x)
        due, _, group = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        slots[group].append(t)
    return slots


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple]:
    """``(group, first, last, share, base, period, slots)``: where blocks first..last-1 of a group go.

    As long as every group has blocks for a whole period, periods repeat. The period in which
    groups run out has the weights of what is left of them; after it the others go on with
    their weights among themselves. The list has less than 2 * groups**2 rows, whatever the data.
    """
    left = {g: n for g, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    base, out = 0, []
    while left:
        whole = min(n // weights[g] for g, n in left.items())
        for periods, share in ((whole, {g: weights[g] for g in left}), (1, None)):
            share = share or {g: min(weights[g], n) for g, n in left.items() if n}
            if not periods or not share:
                continue
            period = sum(share.values())
            for g, slots in pfair_template(share).items():
                out.append((g, done[g], done[g] + periods * share[g], share[g], base, period, slots))
                done[g] += periods * share[g]
                left[g] -= periods * share[g]
            base += periods * period
        left = {g: n for g, n in left.items() if n}
    return out


def mix_sources(df: DataFrame, weights: Mapping[str, int], rest_weight: int = 1, block_rows: int = 8, source_col: str = "source", id_col: str = "doc_id",
                order_by: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, mix_group, block, slot, position``.

    Each source's rows are cut, in order of ``order_by`` (a hash of the id if not given, then
    the id), into blocks of ``block_rows``. ``slot`` is the block's place in the mix and
    ``position`` the row's, gapless from 0. Up to the first slot at which a source has no
    block left, every source is within one block of its weight at every slot; then the rest
    share by their weights. No row is dropped or repeated.

    Weights are positive integers, slots out of their sum. Sources without a weight, null
    ones included, form one group with ``rest_weight``. Null ids are ordered first; repeated
    rows are rows of their own. An empty table gives no rows; other columns are not read.

    A source may hold any share of the rows: it is ranked over ranges of (group, order), from
    totals of the ranges. The schedule depends on the number of groups alone and is broadcast.
    """
    if rest_weight < 1 or any(w < 1 for w in weights.values()) or REST in weights:
        raise ValueError("weights are positive integers")
    spark = df.sparkSession
    known = [g for g in weights]
    group = F.when(F.col(source_col).isin(known), F.col(source_col)).otherwise(F.lit(REST)) if known else F.lit(REST)
    key = F.xxhash64(F.col(id_col)) if order_by is None else order_by
    narrow = df.select(F.col(id_col).alias("doc_id"), group.alias("mix_group"), key.alias("_key"))
    order = [F.col("mix_group"), F.col("_key"), F.col("doc_id")]
    parts = range_parts(narrow, order, "mix-ranges")
    ranked = with_offsets(parts, order, {"_rank": F.lit(1)}, by=["mix_group"])
    sizes = {r["mix_group"]: r["n"] for r in parts.groupBy("mix_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {g: -(-n // block_rows) for g, n in sizes.items()}
    plan = schedule(blocks, {**weights, REST: rest_weight})
    # Rows before each block: every block is full but the last of each group.
    short = sorted((base + (last - 1 - first) // p * period + slots[(last - 1 - first) % p], blocks[g] * block_rows - sizes[g])
                   for g, first, last, p, base, period, slots in plan if last == blocks[g])
    layout = small_table(spark, [(*row, [s for s, _ in short], [m for _, m in short]) for row in plan],
                         "of string, first bigint, last bigint, share int, base bigint, period bigint, slots array<int>, short_at array<bigint>, short_by array<bigint>")
    block = F.floor(F.col("_rank") / F.lit(block_rows)).cast("long")
    inside = F.col("block") - F.col("first")
    placed = ranked.withColumn("block", block).join(
        F.broadcast(layout), (F.col("mix_group") == F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    slot = F.col("base") + F.floor(inside / F.col("share")).cast("long") * F.col("period") + F.get("slots", (inside % F.col("share")).cast("int"))
    missing = F.aggregate(F.arrays_zip("short_at", "short_by"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["short_at"] < F.col("slot"), x["short_by"]).otherwise(0))
    return placed.withColumn("slot", slot.cast("long")).select(
        "doc_id", "mix_group", "block", "slot", (F.col("slot") * block_rows + F.col("_rank") % block_rows - missing).cast("long").alias("position"))


def mixed_documents(df: DataFrame, weights: Mapping[str, int], source_col: str = "source", id_col: str = "doc_id", position_col: str | None = None, **options) -> DataFrame:
    """All rows of ``df`` with their columns, stored order following the mix. Rows that share an
    id follow each other at the first one's place.

    Readers pack files as they like, so the stored order is lost on reading. ``position_col``
    names a column with each row's position in the mix, which is not; rows that share an id
    share its first position.
    """
    names = df.columns
    order = mix_sources(df, weights, source_col=source_col, id_col=id_col, **options).groupBy(F.col("doc_id").alias("_mixed_id")).agg(F.min("position").alias("_mix_position"))
    placed = df.join(order, F.col(id_col).eqNullSafe(F.col("_mixed_id")))
    position = [F.col("_mix_position").alias(position_col)] if position_col else []
    return placed.repartitionByRange("_mix_position").sortWithinPartitions("_mix_position").select(*(F.col(f"`{c}`") for c in names), *position)
