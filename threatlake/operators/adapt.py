"""Analyst feedback, threshold updates, retraining triggers, shadow baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import ratio
from threatlake.operators.running import SLOT, measure, micros, with_slot

UNIT = 10**12  # thresholds are handled as integers of 1e-12, so steps of any learning rate add up exactly


def mark(threats: DataFrame, feedback: DataFrame) -> DataFrame:
    """Threats after analyst marks: resolved, with the verdict appended to the reasoning.

    A threat marked more than once carries every verdict in order of time. Fixed value: the suffix.
    """
    line = F.concat(F.lit("\n\n[ANALYST FEEDBACK] "), F.when(F.col("was_false_positive"), "FALSE_POSITIVE").otherwise("TRUE_POSITIVE"),
                    F.lit(" by "), F.col("reporter"))
    marks = feedback.groupBy("log_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", line.alias("line")))), lambda m: m["line"]), "").alias("_suffix"),
        F.max("created_at").alias("_at"))
    return threats.join(marks, "log_id", "left").select(
        *[c for c in threats.columns if c not in ("agent_reasoning", "resolved", "resolved_at")],
        F.concat(F.coalesce("agent_reasoning", F.lit("")), F.coalesce("_suffix", F.lit(""))).alias("agent_reasoning"),
        F.col("_at").isNotNull().alias("resolved"),
        F.col("_at").alias("resolved_at"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count_if("was_false_positive").alias("false_positives"),
        F.count_if(~F.col("was_false_positive")).alias("true_positives"),
        F.count("*").alias("total"),
    )


def feedback_steps(feedback: DataFrame, threats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each feedback row with the threshold it moves and by how much (in UNIT parts): up by
    ``ema_alpha`` of 0.02 for a false positive, down by ``ema_alpha`` of 0.01 for a true one."""
    up, down = round(cfg.ema_alpha * 0.02 * UNIT), round(cfg.ema_alpha * 0.01 * UNIT)
    action = threats.select("log_id", "action_taken")
    return feedback.join(action, "log_id").select(
        "log_id", "created_at",
        F.when(F.col("action_taken").isin("BLOCK", "RATE_LIMIT"), "HIGH").otherwise("MEDIUM").alias("level"),
        F.when(F.col("was_false_positive"), up).otherwise(-down).cast("bigint").alias("step"),
    )


def compose_steps(shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the composition of all functions ``x -> min(max(x + shift, low), high)`` up to it.

    Two of them, one after the other, are one of the same form, so the compositions of 1, 2, 4, ...
    neighbours are made in turn, all places at once.
    """
    shift, low, high = shift.copy(), low.copy(), high.copy()
    step = 1
    while step < len(shift):
        first, then = slice(None, -step), slice(step, None)
        # The later function's floor and ceiling bound what the earlier one's become.
        s, lo, hi = shift[then], low[then], high[then]
        new = shift[first] + s, np.minimum(np.maximum(low[first] + s, lo), hi), np.minimum(np.maximum(high[first] + s, lo), hi)
        shift[then], low[then], high[then] = new
        step *= 2
    return shift, low, high


def threshold_path(steps: DataFrame, cfg: Config = DEFAULT, values: dict[str, float] | None = None) -> DataFrame:
    """Threshold before and after every feedback row, in order, kept within the level's bounds.

    Levels start at ``values``, else at those of the settings.

    A step followed by clamping is a function x -> clamp(x + c, low, high); such functions
    compose into one of the same form (:func:`compose_steps`). Rows of a level are cut into bounded
    time slots, each slot is composed on its own, the few slot summaries are composed to get every
    slot's starting value, and the slots are played from there in parallel.
    """
    placed = steps.withColumn("_pos", micros("created_at"))
    slotted = with_slot(placed, "level", F.col("_pos"), measure(placed, "level", F.col("_pos"), cfg), cfg)
    bounds = {lv: tuple(round(b * UNIT) for b in cfg.bounds.get(lv, (0.0, 1.0))) for lv in cfg.thresholds}
    start = {lv: round(v * UNIT) for lv, v in {**cfg.thresholds, **(values or {})}.items()}

    def composed(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        group = group.sort_values(["_pos", "log_id"])
        low, high = bounds[group["level"].iloc[0]]
        n = len(group)
        return group, *compose_steps(group["step"].to_numpy(np.int64), np.full(n, low, np.int64), np.full(n, high, np.int64))

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        group, shift, low, high = composed(group)
        return pd.DataFrame({"level": group["level"].iloc[:1], SLOT: group[SLOT].iloc[:1], "shift": shift[-1:], "floor": low[-1:], "ceil": high[-1:]})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(SLOT)
        shift, low, high = compose_steps(*(group[c].to_numpy(np.int64) for c in ("shift", "floor", "ceil")))
        first = start[group["level"].iloc[0]]
        after = np.minimum(np.maximum(first + shift, low), high)
        return pd.DataFrame({"level": group["level"], SLOT: group[SLOT], "begin": np.concatenate([[first], after[:-1]])})

    def play(group: pd.DataFrame) -> pd.DataFrame:
        group, shift, low, high = composed(group)
        begin = int(group["begin"].iloc[0])
        new = np.minimum(np.maximum(begin + shift, low), high)
        return pd.DataFrame({"log_id": group["log_id"], "created_at": group["created_at"], "level": group["level"], "old_units": np.concatenate([[begin], new[:-1]]), "new_units": new})

    work = slotted.select("log_id", "created_at", "level", "step", "_pos", SLOT)
    summaries = work.groupBy("level", SLOT).applyInPandas(summary, f"level string, {SLOT} bigint, shift bigint, floor bigint, ceil bigint")
    begins = summaries.groupBy("level").applyInPandas(chain, f"level string, {SLOT} bigint, begin bigint")
    return (
        work.join(begins, ["level", SLOT])
        .groupBy("level", SLOT)
        .applyInPandas(play, "log_id bigint, created_at timestamp, level string, old_units bigint, new_units bigint")
        .select("log_id", "created_at", "level", (F.col("old_units") / F.lit(float(UNIT))).alias("old_threshold"), (F.col("new_units") / F.lit(float(UNIT))).alias("new_threshold"))
    )


def weekly_health(metrics: DataFrame, as_of: Column, cfg: Config = DEFAULT, days: int = 7) -> DataFrame:
    """Mean precision and recall of the last week, their F1, and the nudged thresholds."""
    since = F.unix_micros(as_of) - F.lit(days * 86_400_000_000)
    p, r = F.col("precision"), F.col("recall")
    summary = metrics.where(micros("window_start") >= since).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count("*").alias("windows"))
    return summary.where("windows > 0").select(
        "windows", "precision", "recall",
        F.when(p + r > 0, F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0).alias("f1_score"),
        nudge_high(p, cfg).alias("high_threshold"), nudge_low(r, cfg).alias("low_threshold"),
    )


def nudge_high(precision: Column, cfg: Config = DEFAULT) -> Column:
    current = F.lit(cfg.thresholds["HIGH"])
    return F.when(precision < 0.80, F.least(F.lit(cfg.bounds["HIGH"][1]), current + 0.05)).otherwise(current)


def nudge_low(recall: Column, cfg: Config = DEFAULT) -> Column:
    current = F.lit(cfg.thresholds["LOW"])
    return F.when(recall < 0.70, F.greatest(F.lit(cfg.bounds["LOW"][0]), current - 0.05)).otherwise(current)


def shadow_summary(shadow: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Would-block and would-alert counts with the ten most frequent sources as rows."""
    recent = _since(shadow, "timestamp", as_of, days)
    top = recent.groupBy("source_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_ip").limit(10)
    totals = recent.agg(F.struct(
        F.count_if(F.col("would_have_taken_action").isin("BLOCK", "RATE_LIMIT")).alias("b"),
        F.count_if(F.col("would_have_taken_action") == "ALERT").alias("a"))).scalar()
    return top.withColumn("_t", totals).select("source_ip", "n", F.col("_t.b").alias("would_block"), F.col("_t.a").alias("would_alert"))


def shadow_baseline(shadow: DataFrame, as_of: Column, days: int = 7, default_rate: float = 0.05) -> DataFrame:
    """Shadow period report. The rate is the rejected share of reviewed rows, or the default. The texts."""
    counts = _since(shadow, "timestamp", as_of, days).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("would_have_taken_action").isin("BLOCK", "RATE_LIMIT")).alias("would_block"),
        F.count_if(F.col("would_have_taken_action") == "ALERT").alias("would_alert"),
        F.count("was_approved_by_human").alias("reviewed"),
        F.count_if(~F.col("was_approved_by_human")).alias("rejected"),
    )
    rate = F.when(F.col("reviewed") > 0, ratio("rejected", "reviewed")).when(F.col("total") > 0, F.lit(default_rate)).otherwise(0.0)
    return counts.withColumn("fp_rate", rate).withColumn("recommendation", F.when(
        F.col("fp_rate") > 0.15, F.format_string("Extend shadow period — estimated FP rate %.1f%%", F.col("fp_rate") * 100)
    ).otherwise("Ready to enable ALERT actions")).withColumn("ready_to_enable", F.col("fp_rate") <= 0.15)


def retrain_trigger(feedback: DataFrame, metrics: DataFrame, as_of: Column, cfg: Config = DEFAULT, since: Column | None = None) -> DataFrame:
    """One row: should the models be retrained, and why."""
    fresh = feedback if since is None else feedback.where(F.col("created_at") > since)
    latest = _since(metrics, "window_start", as_of, 1).agg(F.max_by("false_positive_rate", "window_start")).scalar()
    return fresh.agg(F.count("*").alias("feedback_rows")).select(
        "feedback_rows", F.coalesce(latest, F.lit(0.0)).alias("latest_fpr")
    ).withColumn("retrain", (F.col("feedback_rows") >= cfg.retrain_feedback_rows) | (F.col("latest_fpr") > cfg.retrain_fpr))


def oversample(df: DataFrame, positive: Column, times: int = 2) -> DataFrame:
    """Repeat confirmed positives so they weigh ``times`` as much."""
    copies = F.sequence(F.lit(1), F.when(positive, F.lit(times)).otherwise(F.lit(1)))
    return df.withColumn("copy", F.explode(copies))


def _since(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(micros(ts) >= F.unix_micros(as_of) - F.lit(days * 86_400_000_000))
