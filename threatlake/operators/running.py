"""Running aggregates and short row histories that stay balanced when one key is huge.

Ordinary keys use one plain window per key. The few keys that hold more than their share of
the table (:class:`HotKeys`, measured once per pipeline) are cut into time slots; every slot is
its own window group and receives what came before it as a carried value. The result is the
same as the uncut window for sums, counts and maxima, which combine associatively. When no key
is hot the plan is just the window.

Positions are BIGINT microseconds, or twice that where half steps are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.session import small_table

SLOT = "_slot"
WHOLE = -(2**62)  # slot of a key that is not cut


@dataclass(frozen=True)
class HotKeys:
    """Keys above their share with a salt count, and their dense time cells with a part count."""

    keys: tuple[tuple[str, int], ...] = ()
    cells: tuple[tuple[str, int, int], ...] = ()
    rows: int = 0  # of the table that was measured

    def __bool__(self) -> bool:
        return bool(self.keys)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def measure(df: DataFrame, key: str, time_us: Column, cfg: Config = DEFAULT) -> HotKeys:
    """Find the hot keys of ``df``: a row count, then one counting pass over two columns.

    At most ``shares`` keys and ``shares`` cells can exceed ``1/shares`` of the rows, so what
    comes back to the driver is bounded by the setting, not by the data. So are the salts of a
    key: it has at most ``shares`` of them.
    """
    skew = cfg.skew
    total = df.count()
    if total < skew.min_rows:
        return HotKeys(rows=total)
    cell = F.floor(time_us / F.lit(skew.cell_us)).cast("bigint")
    cells = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), cell.alias("cell")).agg(F.count("*").alias("n"))
    edge = max(skew.min_rows, -(-total // skew.shares))
    parts = F.least(F.ceil(F.col("n") * skew.shares / F.lit(total)), F.ceil(F.col("n") / F.lit(max(skew.min_rows, 1))))
    keys = cells.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= edge).select("key", parts.cast("int").alias("salts")).collect()
    if not keys:
        return HotKeys(rows=total)
    dense = cells.where(F.col("n") >= edge).select("key", "cell", parts.cast("bigint").alias("parts")).collect()
    return HotKeys(tuple(map(tuple, keys)), tuple(map(tuple, dense)), total)


def with_slot(df: DataFrame, key: str, time_us: Column, hot: HotKeys, cfg: Config) -> DataFrame:
    """Add ``_slot``: one constant for ordinary keys, the start of the time slot for hot ones."""
    if not hot:
        return df.withColumn(SLOT, F.lit(WHOLE))
    spark, width = df.sparkSession, cfg.skew.cell_us
    keys = small_table(spark, [(k, True) for k, _ in hot.keys], f"{key} string, _hot boolean")
    cells = small_table(spark, list(hot.cells), f"{key} string, _cell bigint, _parts bigint")
    start = F.col("_cell") * width
    step = F.ceil(F.lit(width) / F.coalesce(F.col("_parts"), F.lit(1))).cast("bigint")
    slot = start + F.floor((F.col("_time") - start) / step).cast("bigint") * step
    return (
        df.withColumn("_time", time_us)
        .withColumn("_cell", F.floor(F.col("_time") / F.lit(width)).cast("bigint"))
        .join(F.broadcast(keys), key, "left")
        .join(F.broadcast(cells), [key, "_cell"], "left")
        .withColumn(SLOT, F.when(F.col("_hot"), slot).otherwise(F.lit(WHOLE)))
        .drop("_time", "_cell", "_hot", "_parts")
    )


def dealt(df: DataFrame, keys: Sequence[str], hot: HotKeys | None, cfg: Config) -> DataFrame:
    """Rows of large tables dealt by ``keys`` to as many tasks as their number asks for, so that what a
    task sorts doesn't grow with the table. Steps of the same keys and measure share the shuffle."""
    tasks = -(-(hot.rows if hot is not None else 0) // cfg.skew.task_rows)
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def _hot(df: DataFrame, key: str, time_us: Column, cfg: Config) -> HotKeys:
    return measure(df, key, time_us, cfg) if cfg.hot is None else cfg.hot


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    measures: dict[str, tuple[str, Column]],
    *,
    tie: str | None = None,
    inclusive: bool = False,
    backwards: bool = False,
    scale: int = 1,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Add, per row, aggregates over the rows of the key that come before it.

    ``measures`` maps an output name to ``("sum" | "max", expression)``. Without ``tie`` rows at
    the same position are not before each other (``inclusive`` counts them all); with ``tie``
    rows are taken one by one in (position, tie) order. ``backwards`` reverses time. Hot keys
    are looked up by ``keys[0]``.
    """
    keys = list(keys)
    time_us = F.floor(F.col(pos) / F.lit(scale)).cast("bigint")
    hot = _hot(df, keys[0], time_us, cfg)
    slotted = dealt(with_slot(df, keys[0], time_us, hot, cfg), [*keys, SLOT] if hot else keys, hot, cfg)
    order = [-F.col(pos)] if backwards else [F.col(pos)]
    if backwards and hot:
        slotted = slotted.withColumn(SLOT, F.when(F.col(SLOT) == WHOLE, F.col(SLOT)).otherwise(-F.col(SLOT)))
    by_slot = Window.partitionBy(*keys, SLOT)
    end = 0 if inclusive else -1
    if tie is None:
        window = by_slot.orderBy(*order).rangeBetween(Window.unboundedPreceding, end)
    else:
        window = by_slot.orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, end)
    agg = {"sum": F.sum, "max": F.max}
    if not hot:
        return slotted.withColumns({n: agg[how](e).over(window) for n, (how, e) in measures.items()}).drop(SLOT)

    inside = slotted.select("*", *[agg[how](e).over(window).alias(f"_in_{n}") for n, (how, e) in measures.items()])
    slot_totals = (
        slotted.where(F.col(SLOT) != WHOLE)
        .groupBy(*keys, SLOT)
        .agg(*[agg[how](e).alias(f"_all_{n}") for n, (how, e) in measures.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = slot_totals.select(*keys, SLOT, *[agg[how](f"_all_{n}").over(earlier).alias(f"_pre_{n}") for n, (how, _) in measures.items()])
    joined = inside.join(carried, [*keys, SLOT], "left")
    result = {}
    for name, (how, _) in measures.items():
        within, before = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        result[name] = F.coalesce(within + before, within, before) if how == "sum" else F.greatest(within, before)
    helper = [SLOT] + [f"_{p}_{n}" for n in measures for p in ("in", "pre")]
    return joined.withColumns(result).drop(*helper)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    tie: str,
    depth: int,
    build: Callable[[object], dict[str, Column]],
    *,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Add columns computed over the last ``depth`` rows of the key.

    ``build`` gets the window ordered by (pos, tie) and returns column expressions using row
    frames that reach back at most ``depth`` rows.
    """
    keys = list(keys)
    hot = _hot(df, keys[0], F.col(pos), cfg)
    slotted = dealt(with_slot(df, keys[0], F.col(pos), hot, cfg), [*keys, SLOT] if hot else keys, hot, cfg)
    window = Window.partitionBy(*keys, SLOT).orderBy(pos, tie)
    if not hot:
        return slotted.withColumns(build(window)).drop(SLOT)

    payload = [c for c in slotted.columns if c not in (*keys, SLOT)]
    newest = Window.partitionBy(*keys, SLOT).orderBy(F.desc(pos), F.desc(tie))
    tails = (
        slotted.where(F.col(SLOT) != WHOLE)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= depth)
        .groupBy(*keys, SLOT)
        .agg(F.collect_list(F.struct(F.col(pos).alias("_p"), F.col(tie).alias("_t"), F.struct(*payload).alias("_row"))).alias("_tail"))
    )
    # every slot has at least one row, so `depth` earlier slots always hold the last `depth` rows
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(-depth, -1)
    carried = (
        tails.withColumn("_before", F.sort_array(F.flatten(F.collect_list("_tail").over(earlier)), asc=False))
        .select(*keys, SLOT, F.explode(F.slice("_before", 1, depth)).alias("_h"))
        .select(*keys, SLOT, "_h._row.*", F.lit(False).alias("_own"))
    )
    stacked = slotted.withColumn("_own", F.lit(True)).unionByName(carried)
    return stacked.withColumns(build(window)).where("_own").drop("_own", SLOT)


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    measures: dict[str, Column],
    *,
    include_now: bool = False,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Sum integer ``measures`` over the rows of the key in ``[t - seconds, t)`` (or ``.. t]``).

    Each row adds its amount at its own time and takes it back when it leaves the window, so a
    sliding sum is a plain running sum: linear in the rows however dense the window is.
    """
    payload = df.columns
    late = 1 if include_now else 0
    # one pass over df: every row is exploded into its entry and its exit
    marked = df.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("_own"))
    own = F.col("_own")
    leave_at = (micros(ts) + seconds * 1_000_000) * 2 + late
    signed = marked.select(
        *[F.col(c) if c in keys else F.when(own, F.col(c)).alias(c) for c in payload],
        *[F.when(own, e).otherwise(-e).alias(f"_d_{n}") for n, e in measures.items()],
        F.when(own, micros(ts) * 2).otherwise(leave_at).alias("_pos"),
        "_own",
    )
    sums = {n: ("sum", F.col(f"_d_{n}")) for n in measures}
    summed = running(signed, keys, "_pos", sums, inclusive=include_now, scale=2, cfg=cfg)
    return summed.where("_own").select(*payload, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures])


def salted_lookup(big: DataFrame, small: DataFrame, key: str, row_id: str, cfg: Config = DEFAULT) -> DataFrame:
    """Left-join ``small`` (one row per key) to ``big``, spreading the rows of hot keys over tasks."""
    hot = _hot(big, key, F.lit(0).cast("bigint"), cfg)
    if not hot:
        return dealt(big, [key], hot, cfg).join(small, key, "left")
    table = F.broadcast(small_table(big.sparkSession, list(hot.keys), f"{key} string, _salts int"))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(table, key, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), salts).cast("int")).drop("_salts")
    right = small.join(table, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt(left, [key, "_salt"], hot, cfg).join(right, [key, "_salt"], "left").drop("_salt")


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    key: str,
    probe_ts: str,
    fact_ts: str,
    fact_tie: str,
    payload: Sequence[str],
    *,
    cfg: Config = DEFAULT,
    name: str = "matched",
) -> DataFrame:
    """Attach to each probe the latest fact of its key at or before the probe's time (a struct)."""
    probe_rows = probes.select("*", micros(probe_ts).alias("_pos"), F.lit(True).alias("_own"))
    fact_rows = facts.select(
        key,
        micros(fact_ts).alias("_pos"),
        F.struct(micros(fact_ts).alias("_p"), F.col(fact_tie).alias("_t"), *[F.col(c) for c in payload]).alias("_fact"),
        F.lit(False).alias("_own"),
    )
    stacked = probe_rows.unionByName(fact_rows, allowMissingColumns=True)
    found = running(stacked, [key], "_pos", {"_last": ("max", F.col("_fact"))}, inclusive=True, cfg=cfg)
    return found.where("_own").select(
        *probes.columns,
        F.when(F.col("_last").isNotNull(), F.struct(*[F.col(f"_last.{c}").alias(c) for c in payload])).alias(name),
    )


def cells_of(value: Column, sizes: Sequence[int]) -> Column:
    """Names of the cells, one of each size, that a whole number is in."""
    return F.array(*(F.concat(F.lit(f"{size}:"), F.floor(value / F.lit(size)).cast("string")) for size in sizes))


def range_cells(low: Column, high: Column, sizes: Sequence[int]) -> Column:
    """Names of the cells that make up the whole numbers from ``low`` to ``high``, the largest that fit.

    A range and a number share exactly one cell if the number is in the range, else none, so
    containment is an equality of names. Each size is a multiple of the next, the last is 1.
    """
    def span(a: Column, b: Column, size: int) -> Column:
        named = F.transform(F.sequence(a.cast("bigint"), (b - 1).cast("bigint")), lambda x: F.concat(F.lit(f"{size}:"), x.cast("string")))
        return F.when(a < b, named).otherwise(F.array().cast("array<string>"))

    out, larger, before = [], None, 0
    for size in sizes:
        first, last = F.ceil(low / F.lit(size)), F.floor((high + 1) / F.lit(size))
        if larger is None:
            out.append(span(first, last, size))
        else:
            a, b = (x * (before // size) for x in larger)
            out.append(F.when(a < b, F.concat(span(first, a, size), span(b, last, size))).otherwise(span(first, last, size)))
        larger, before = (first, last), size
    return F.concat(*out)
