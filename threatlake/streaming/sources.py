"""Stream inputs and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threatlake.operators.reports import newest
from threatlake.schemas import NETWORK_LOGS
from threatlake.sources.versions import committed, remove


def read_files(spark: SparkSession, path: str, schema: str = NETWORK_LOGS, fmt: str = "json", files_per_batch: int = 10) -> DataFrame:
    """Log files as they arrive, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def replay_table(df: DataFrame, path: str, ts: str = "ts", files: int = 3) -> DataFrame:
    """A table as a stream: its rows in ``files`` files in order of time, one a micro-batch."""
    at = F.unix_micros(ts)
    cuts = df.select(F.percentile_approx(at, [k / files for k in range(1, files)]).alias("c")).first().c or []
    return _replayed(df, path, at, list(cuts))


def replay_periods(df: DataFrame, path: str, arrival: str, minutes: int) -> DataFrame:
    """A table as a stream: what arrived in each period is a micro-batch; ``arrival`` isn't passed on."""
    at, period = F.unix_micros(arrival), minutes * 60_000_000
    low, high = df.agg(F.min(at), F.max(at)).first()
    cuts = [k * period - 1 for k in range(low // period + 1, high // period + 1)] if low is not None else []
    return _replayed(df, path, at, cuts, drop=[arrival])


def _replayed(df: DataFrame, path: str, at: Column, cuts: list[int], drop: list[str] = ()) -> DataFrame:
    """A file for each part between the cuts. The table is made once, by all tasks, and laid down by parts;
    what one task copies then is only its own part."""
    spark, part = df.sparkSession, f"{path}-parts"
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(at > cut, 1).otherwise(0)
    df.withColumn("_part", number).drop(*drop).hint("rebalance", "_part").write.partitionBy("_part").parquet(part)
    kept = df.drop(*drop).schema
    made = spark.read.schema(StructType([*kept.fields, StructField("_part", LongType())])).parquet(part)
    for k in range(len(cuts) + 1):
        made.where(F.col("_part") == k).select(*kept.names).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", 1).parquet(path)


def changed_rows(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Write the rows that each micro-batch of an update stream has changed; a repeated one replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_changed(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last row of each key that an update stream has written."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [f.name for f in schema if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}") for c in schema.names))


def event_log(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append event envelopes to a log partitioned by type; a replayed micro-batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("event_type").json(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_feed(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", row_id: str = "log_id", keep: int = 50, **trigger):
    """Keep the newest ``keep`` rows of the stream in a small table, a version a batch.

    A batch joins the version before its own, so one that is repeated gives the same rows; a row
    found twice counts once before the limit. The last two versions stay for readers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"v-{batch_id:012d}"
        older = [v for v in committed(spark, path, "v-") if v < own]
        current = batch.unionByName(spark.read.parquet(f"{path}/{older[-1]}")) if older else batch
        newest(current.dropDuplicates([row_id]), ts, row_id, keep).coalesce(1).write.mode("overwrite").parquet(f"{path}/{own}")
        for version in older[:-1]:
            remove(spark, f"{path}/{version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{committed(spark, path, 'v-')[-1]}")
