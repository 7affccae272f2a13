"""Outputs: event envelopes, CSV export, scenario files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The typed events and the fields each carries.
EVENT_FIELDS = {
    "threat_detected": ["source_ip", "anomaly_score", "risk_level", "log_id"],
    "action_executed": ["source_ip", "action", "success", "execution_time_ms"],
    "ip_blocked": ["ip", "reason"],
    "threshold_updated": ["new_high", "new_low", "reason"],
    "approval_requested": ["queue_id", "ip", "proposed_action", "confidence", "expires_at"],
    "rollback_executed": ["ip", "action_log_id", "rolled_back_by"],
    "kill_chain_progression": ["ip", "old_stage", "new_stage", "predicted_next"],
    "shadow_decision": ["ip", "would_have_acted", "action", "score"],
    "validation_complete": ["action_log_id", "success", "delta_score"],
}


def envelopes(rows: DataFrame, event_type: str, at: str, fields: list[str] | None = None) -> DataFrame:
    """Rows as ``(event_type, timestamp, payload json)``; unknown types need explicit ``fields``."""
    fields = fields or EVENT_FIELDS[event_type]
    return rows.select(F.lit(event_type).alias("event_type"), F.col(at).alias("timestamp"), F.to_json(F.struct(*fields)).alias("payload"))


def export_actions_csv(actions: DataFrame, path: str) -> None:
    """Action log as CSV with the report headers. The headers."""
    actions.select(
        F.col("executed_at").alias("Time"), F.col("target_ip").alias("IP"), F.col("action_type").alias("Action"), F.col("success").alias("Success"),
        F.col("execution_time_ms").alias("Execution Time (ms)"), F.coalesce("error_message", F.lit("")).alias("Error"),
    ).write.mode("overwrite").option("header", True).csv(path)


def store_scenarios(scenarios: DataFrame, path: str) -> None:
    scenarios.withColumn("dt", F.to_date("created_at")).write.mode("overwrite").partitionBy("dt").json(path)


def list_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scenario_id string").json(path).distinct()
