"""From raw records to log rows: defaults, casts, trusted sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import number_or
from threatlake.operators.allowlist import drop_trusted, flag_trusted
from threatlake.schemas import NETWORK_LOGS

# Defaults of agent records.
AGENT_DEFAULTS = {
    "dest_ip": "server", "dest_port": 80, "protocol": "HTTP", "bytes_sent": 0, "packets": 1, "duration_seconds": 0.0, "request_rate": 1.0,
}
# Defaults of records made from data-set rows.
RECORD_DEFAULTS = {"source_ip": "192.168.1.1", "dest_ip": "10.0.0.1", "dest_port": 80, "protocol": "TCP", "bytes_sent": 0, "bytes_received": 0, "duration_seconds": 0.0}


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Log files with the enforced schema."""
    return spark.read.schema(NETWORK_LOGS).format(fmt).load(path)


def ingest(batch: DataFrame, entries: DataFrame, cfg: Config = DEFAULT, row_id: str = "log_id") -> DataFrame:
    """Rows to store: trusted sources are left out. Counts are observed as ``ingest``."""
    flagged = flag_trusted(batch, entries, cfg, row_id)
    counted = flagged.observe("ingest", F.count_if(~F.col("is_trusted")).alias("enqueued"), F.count_if("is_trusted").alias("skipped_trusted"))
    return counted.where(~F.col("is_trusted")).drop("is_trusted")


def batch_counts(batch: DataFrame, entries: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    flagged = flag_trusted(batch.select("log_id", "source_ip"), entries, cfg)
    return flagged.agg(F.count_if(~F.col("is_trusted")).alias("enqueued"), F.count_if("is_trusted").alias("skipped_trusted"))


def agent_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in AGENT_DEFAULTS.items() if c in df.columns})


def to_records(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order`` as ingest records, tolerant of bad numbers."""
    kinds = {"dest_port": "int", "bytes_sent": "bigint", "bytes_received": "bigint", "duration_seconds": "double"}
    columns = []
    for name, default in RECORD_DEFAULTS.items():
        present = name in df.columns
        if name in kinds:
            value = number_or(name, default).cast(kinds[name]) if present else F.lit(default).cast(kinds[name])
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit(default)) if present else F.lit(default)
        columns.append(value.alias(name))
    return df.orderBy(order).limit(limit).select(order, *columns)


__all__ = ["read_logs", "ingest", "batch_counts", "agent_defaults", "to_records", "drop_trusted"]
