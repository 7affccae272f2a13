"""The registered queries, part 5: state kept by incremental runs, and counts that add up over days."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.operators import reports
from threatlake.plans import incremental
from threatlake.plans.derived import Derived
from threatlake.plans.registry import query
from threatlake.session import shared_dir


def _in_two_runs(d: Derived, *tables: str) -> str:
    """The state after two runs: one over the first half of time, one over what came then."""
    out = f"{shared_dir(d.spark)}/state-{uuid.uuid4().hex}"
    times = {"stage_events": "detected_at", "threats": "created_at", "actions": "executed_at", "validations": "executed_at", "feedback": "created_at", "shadow": "timestamp"}
    feeds = {
        "stage_events": lambda: d.stage_events.select("log_id", "source_ip", "detected_at", "stage"),
        "threats": lambda: d.threats.select("log_id", "source_ip", "created_at", "action_taken"),
        "actions": lambda: d.actions.select("target_ip", "action_type", "executed_at", "execution_time_ms"),
        "validations": lambda: d.validations.select("executed_at", "success"),
        "feedback": lambda: d.feedback.select("log_id", "created_at", "was_false_positive"),
        "shadow": lambda: d.shadow.select("timestamp", "would_have_taken_action"),
    }
    middle = d.flows.agg(F.timestamp_micros(((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).cast("bigint")).alias("t")).first().t
    wanted = {i: feeds[i]() for t in tables for i in incremental.INPUTS[t]}
    for half in (True, False):
        for name, rows in wanted.items():
            at = F.col(times[name])
            incremental.commit(rows.where(at < F.lit(middle) if half else at >= F.lit(middle)), f"{out}/in/{name}")
        incremental.advance(d.spark, f"{out}/in", f"{out}/out", tables, d.cfg)
    return f"{out}/out"


def _state(d: Derived, table: str) -> DataFrame:
    out = _in_two_runs(d, table)
    return d.spark.read.parquet(f"{incremental.current(d.spark, out)}/{table}")


@query
def g9_profiles(d: Derived):
    return incremental.profiles(d.spark, _in_two_runs(d, "profiles"), d.as_of()).select(
        "source_ip", "first_stage_seen", "current_stage", "last_activity", "stage_events", "is_active")


@query
def g9_reputation(d: Derived):
    return _state(d, "reputation")


@query
def g9_thresholds(d: Derived):
    return _state(d, "thresholds")


@query
def g9_metrics(d: Derived):
    found = incremental.metrics(d.spark, _in_two_runs(d, "metrics"), d.cfg)
    return found.select("window_start", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "false_positive_rate", "avg_latency_ms")])


@query
def g9_impact(d: Derived):
    return incremental.impact(d.spark, _in_two_runs(d, "impact_days", "impact_targets"), d.cfg).withColumns(
        {"cost_saved_usd": F.round("cost_saved_usd", 6), "analyst_hours_saved": F.round("analyst_hours_saved", 6)})


@query
def a8_weekly_sources(d: Derived):
    """Distinct sources with a high score per week, counted and from the sketches of its days."""
    seen = d.scores_raw.where("combined > 0.4e0").select(F.to_date("ts").alias("day"), "source_ip")
    sketches = reports.daily_sketches(seen, "day", "source_ip")
    guessed = reports.sketched_counts(sketches, F.date_trunc("week", "day").cast("date"), "week")
    exact = seen.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count_distinct("source_ip").alias("sources"))
    return exact.join(guessed, "week").select("week", "sources", "days", (F.abs(F.col("estimate") - F.col("sources")) <= 3 * reports.SKETCH_ERROR * F.col("sources")).alias("within_error"))
