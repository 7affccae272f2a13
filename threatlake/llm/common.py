"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlake.session import materialise, shared_dir

#: ``[\x20\x09-\x0D]``: the white space of the line, shingle and copy rules.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that all executors see."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of one's own, none of which a table with ``columns`` has (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_tables(*frames: DataFrame) -> None:
    """Delete stored intermediate tables that no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        for file in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if file.startswith(shared_dir(spark)):
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def range_parts(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Rows dealt to ranges of ``order`` and stored with the number of their range in ``_part``.

    The table is stored because a range exchange that runs twice need not cut at the same
    values twice; ranges are numbered in the given order.
    """
    parts = max(1, width(df.sparkSession))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return materialise(dealt, label)


def with_offsets(parts: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its expression over all rows before this one.

    ``by`` restarts the sums for each combination of those columns (which must lead ``order``).
    Only totals of the ranges are summed in order of the ranges; rows are ordered inside a range.
    """
    by = by or []
    totals = parts.groupBy("_part", *by).agg(*(F.sum(e).alias(f"_t_{n}") for n, e in sums.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part", *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums))
    # One row for each range, or for each range and each group that starts or ends in it.
    match = F.col("_part") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    carried = carried.withColumnRenamed("_part", "_at")
    joined = parts.join(carried if by else F.broadcast(carried), match)
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumns({n: F.col(f"_c_{n}") + F.coalesce(F.sum(e).over(within), F.lit(0)) for n, e in sums.items()}).drop(
        "_at", *(f"_by_{c}" for c in by), *(f"_c_{n}" for n in sums))


#: A key is heavy when more than one row in so many has it; there are fewer heavy keys than that.
HEAVY = 1_000


def heavy_lookup(rows: DataFrame, held: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``held``, which has each ``key`` (never null) once and in ``n`` how many
    of the ``total`` rows have it. Heavy keys, fewer than HEAVY, are broadcast, so their rows stay
    where they are; the others are shuffled by the key. Columns of ``held`` but ``n`` are added."""
    common = held.where(F.col("n") * HEAVY <= total).drop("n")
    heavy = F.broadcast(held.where(F.col("n") * HEAVY > total).drop("n"))
    rest = rows.join(heavy.select(key), key, "left_anti").join(common, key, how)
    return rest.unionByName(rows.join(heavy, key))
