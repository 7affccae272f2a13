"""The detection loop over tables: flows to scores, threats, decisions, actions, validations.

Each stage is written once and read back, so later stages start from a table instead of
recomputing the plan above, and a lost executor costs one stage at most.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.operators import allowlist, decisions, features, killchain, response, scoring, validation
from threatlake.operators.running import measure, micros
from threatlake.sources.sinks import envelopes


def _store(df: DataFrame, path: str, day: str) -> DataFrame:
    dated = df.withColumn("dt", F.to_date(day))
    dated.write.mode("overwrite").partitionBy("dt").parquet(path)
    return df.sparkSession.read.schema(dated.schema).parquet(path)


def run(flows: DataFrame, entries: DataFrame, out: str, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Run all stages for a set of flows and return the written tables by name."""
    if cfg.hot is None:
        cfg = replace(cfg, hot=measure(flows.select("source_ip", "ts"), "source_ip", micros("ts"), cfg))
    kept = allowlist.drop_trusted(flows, entries, cfg)
    rated = killchain.classify_stage(scoring.fallback_scores(features.detect7(kept, cfg)))
    scores = _store(rated, f"{out}/scores", "ts")

    counted = decisions.prior_threats(scoring.gate(decisions.correlation(scores, cfg), cfg), cfg)
    entropy = features.behaviour6(scores.select(*flows.columns), cfg).select("log_id", "port_entropy")
    typed = counted.join(entropy, "log_id").withColumns({
        "created_at": F.col("ts"), "confidence_score": F.col("combined"),
        "action_taken": decisions.simple_action("combined", "risk_level", F.col("prior") >= 3),
        "threat_type": decisions.threat_type("request_rate", "port_entropy", "session_deviation", F.col("prior") >= 3),
    })
    threats = _store(typed, f"{out}/threats", "created_at")

    stages = scores.where(F.col("stage").isNotNull()).select(
        "log_id", "source_ip", F.col("ts").alias("detected_at"), "stage", F.col("stage_confidence").alias("confidence"))
    progress = killchain.progression(stages, cfg).select("log_id", "is_progressing")
    context = decisions.recent_severity(decisions.cooldown(threats, cfg), cfg).join(progress, "log_id", "left").withColumn(
        "is_progressing", F.coalesce("is_progressing", F.lit(False)))
    decided = decisions.score_decision(decisions.fp_risk(context), cfg)
    flagged = decided.withColumn("is_trusted", F.lit(False))  # trusted sources were dropped at the start
    gated = decisions.execution_gate(flagged, cfg).withColumn(
        "explanation", decisions.with_breakdown(decisions.explanation(
            decisions.decision_chain(), F.col("action"), F.col("final_score"), F.col("risk_level"), F.col("source_ip"), F.col("prior"), F.col("threat_type"))))
    decision_table = _store(gated, f"{out}/decisions", "created_at")

    shadow = _store(decisions.shadow_rows(decision_table), f"{out}/shadow", "timestamp")
    queue = _store(decisions.approval_rows(decision_table, cfg), f"{out}/approvals", "expires_at")
    allowed = decision_table.where("allowed").withColumn("action_taken", F.col("action"))
    actions = _store(response.respond(allowed), f"{out}/actions", "executed_at")
    checked = _store(validation.validate_actions(actions, scores, cfg), f"{out}/validations", "executed_at")

    found = threats.select("created_at", "source_ip", F.col("confidence_score").alias("anomaly_score"), "risk_level", "log_id")
    done = checked.select("executed_at", F.col("action_id").alias("action_log_id"), "success", F.col("delta").alias("delta_score"))
    events = envelopes(found, "threat_detected", "created_at").unionByName(envelopes(done, "validation_complete", "executed_at"))
    event_log = _store(events, f"{out}/events", "timestamp")
    return {"scores": scores, "threats": threats, "decisions": decision_table, "shadow": shadow, "approvals": queue,
            "actions": actions, "validations": checked, "events": event_log}
