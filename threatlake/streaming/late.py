"""Rows that come too late for a stream, kept as a table and added to its results by batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.session import small_table
from threatlake.sources.versions import committed


def split_late(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", cfg: Config = DEFAULT, **trigger):
    """Write the rows of each micro-batch to ``path/ontime`` or, if the watermark had passed them, to ``path/late``.

    The watermark is that of the engine: the greatest time of all earlier micro-batches less
    ``watermark_seconds``. A micro-batch reads the mark of the one before it and writes its own last,
    so one that is repeated makes the same split and replaces its own files. A job that reads the
    rows in time with the same watermark drops none of them.
    """
    delay = cfg.watermark_seconds * 1000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"v-{batch_id:012d}"
        older = [v for v in committed(spark, f"{path}/marks", "v-") if v < own]
        before = spark.read.parquet(f"{path}/marks/{older[-1]}").first().ms if older else None
        batch = batch.persist()
        late = F.lit(False) if before is None else F.coalesce(F.unix_millis(ts) < before - delay, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/ontime/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        newest = batch.agg(F.max(F.unix_millis(ts))).first()[0]
        batch.unpersist()
        marks = [m for m in (before, newest) if m is not None]
        small_table(spark, [(max(marks) if marks else None,)], "ms bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def in_time(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows in time as a stream, in the order in which they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ontime/batch=*")


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/late").drop("batch")


def reconcile(windows: DataFrame, late: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Windows of activity with late rows added: counts add up and the greatest score is that of both."""
    missed = late.groupBy(F.window("ts", width).start.alias("window_start")).agg(
        F.count("*").alias("flows"), F.count_if(F.col("risk_level") != "LOW").alias("flagged"), F.max("combined").alias("max_score"))
    return windows.unionByName(missed).groupBy("window_start").agg(F.sum("flows").alias("flows"), F.sum("flagged").alias("flagged"), F.max("max_score").alias("max_score"))
