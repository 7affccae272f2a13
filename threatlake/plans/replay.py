"""Replay of stored attack scenarios against the present detector and decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.operators import decisions, features, scoring
from threatlake.operators.running import as_of

LOG_FIELDS = ["request_rate", "dest_port", "src_port", "bytes_sent", "duration_seconds", "packets", "protocol"]


def scenarios(threats: DataFrame, flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each threat with the latest flow of its source at that time."""
    asked = threats.select("log_id", "source_ip", "created_at", F.col("action_taken").alias("original_action"), F.col("confidence_score").alias("original_confidence"))
    logs = flows.select("source_ip", "ts", F.col("log_id").alias("net_log_id"), *LOG_FIELDS)
    found = as_of(asked, logs, "source_ip", "created_at", "ts", "net_log_id", LOG_FIELDS, cfg=cfg, name="network_log")
    return found.withColumn("scenario_id", F.concat(F.lit("sc_"), F.col("log_id").cast("string")))


def regression(stored: DataFrame, flows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Re-score every scenario without history, decide again, and compare with the original action."""
    logs = stored.select("log_id", "source_ip", "created_at", "original_action", "original_confidence", "network_log.*")
    rated = logs.withColumns({
        "ip_share": F.lit(0.0),
        "session_deviation": features.session_heuristic("duration_seconds", "bytes_sent"),
    })
    scored = scoring.ensemble(scoring.fallback_scores(rated).drop("risk_level"))
    # fixed context of a replay: one earlier threat, noon, no stage, confidence of the ensemble
    case = scored.withColumns({
        "prior": F.lit(1), "past_severity": F.lit(0), "is_progressing": F.lit(False), "stage": F.lit(None).cast("string"),
        "noon": F.to_timestamp(F.lit("2024-01-01 12:00:00")),
    })
    decided = decisions.choose_action(case, score="combined_score", ts="noon", kill_chain=False, fp=False, confidence="confidence")
    again = F.when(F.col("is_anomaly"), F.col("action"))
    return decided.select(
        "log_id", "original_action", again.alias("replayed_action"), F.col("is_anomaly").alias("would_detect"),
        F.col("confidence").alias("new_confidence"), (~F.col("original_action").eqNullSafe(again)).alias("changed"))


def would_catch(threats: DataFrame) -> DataFrame:
    """Text and score heuristic: would the kill chain have caught it."""
    mentioned = F.lower(F.coalesce("agent_reasoning", F.lit(""))).contains("kill chain")
    return threats.select("log_id", (mentioned | (F.col("confidence_score") > 0.7)).alias("would_catch"), F.col("action_taken").alias("simulated_action"))
