"""From features or raw model outputs to anomaly scores and risk levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import NORMAL_PORTS, clip, risk_level


def fallback_scores(features: DataFrame) -> DataFrame:
    """Model-free score from ``detect7`` features: ``combined`` and its two parts, unrounded."""
    rate = F.col("request_rate")
    iso = F.col("session_deviation") * 0.8 + F.col("ip_share") * 0.2
    svm = rate / F.greatest(rate + 1.0, F.lit(1.0))
    return features.withColumns({"iso_score": iso, "svm_score": svm}).withColumn(
        "combined", F.lit(0.6) * F.col("iso_score") + F.lit(0.4) * F.col("svm_score")
    ).withColumn("risk_level", risk_level("combined", "detect"))


def score_records(scored: DataFrame) -> DataFrame:
    """Score rows as they are stored: four decimals."""
    return scored.select(
        "log_id", "source_ip", F.col("ts").alias("created_at"),
        F.round("iso_score", 4).alias("isolation_forest_score"),
        F.round("svm_score", 4).alias("svm_score"),
        F.round("combined", 4).alias("combined_score"),
        F.round("session_deviation", 4).alias("behavioral_deviation"),
        "risk_level",
    )


def offset_score(raw: Column | str) -> Column:
    """Signed decision value (negative = outlier) to [0, 1]."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return clip(F.lit(0.5) - raw, 0.0, 1.0)


def minmax_batch(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Flip and scale raw values by the extremes of this DataFrame; 0 everywhere when they agree."""
    extremes = df.agg(F.struct(F.min(raw).alias("low"), F.max(raw).alias("high"))).scalar()
    span = F.col("_x.high") - F.col("_x.low")
    return (
        df.withColumn("_x", extremes)
        .withColumn(out, F.when(span == 0, F.lit(0.0)).otherwise(F.lit(1.0) - (F.col(raw) - F.col("_x.low")) / F.nullif(span, F.lit(0.0))))
        .drop("_x")
    )


def minmax_fitted(raw: Column, low: float, high: float) -> Column:
    """The same scale with extremes stored at training time, clipped to [0, 1]."""
    if low == high:
        return F.lit(0.0)
    return clip(F.lit(1.0) - (raw - low) / (high - low), 0.0, 1.0)


def ensemble(df: DataFrame, iso: str = "iso_score", svm: str = "svm_score") -> DataFrame:
    """Weighted combination of two detectors with their agreement as confidence."""
    combined = F.lit(0.6) * F.col(iso) + F.lit(0.4) * F.col(svm)
    return (
        df.withColumn("combined_score", combined)
        .withColumn("agreement", F.lit(1.0) - F.abs(F.col(iso) - F.col(svm)))
        .withColumn("confidence", F.col("agreement") * F.col("combined_score"))
        .withColumn("is_anomaly", F.col("combined_score") > 0.3)
        .withColumn("risk_level", risk_level("combined_score", "ensemble"))
    )


def rule_score(flows: DataFrame, tick_seconds: int = 60) -> DataFrame:
    """Deterministic rule score; the source's volume is its number of flows in the same tick."""
    tick = F.floor(F.unix_micros("ts") / F.lit(tick_seconds * 1_000_000)).cast("bigint")
    ticked = flows.withColumn("tick", tick)
    volume = ticked.groupBy("source_ip", "tick").agg(F.count("*").alias("tick_rows"))
    duration, sent = F.coalesce("duration_seconds", F.lit(0.0)), F.coalesce("bytes_sent", F.lit(0))
    score = F.least(
        F.when(sent < 60, 0.25).otherwise(0.0)
        + F.when(duration < 0.05, 0.2).otherwise(0.0)
        + F.when(F.col("dest_port").isin(NORMAL_PORTS), 0.0).otherwise(0.15)
        + F.least(F.col("tick_rows") / F.lit(100.0), F.lit(0.4)),
        F.lit(1.0),
    )
    action = {"CRITICAL": "BLOCK_IP", "HIGH": "RATE_LIMIT", "MEDIUM": "ALERT"}
    level = F.col("risk_level")
    choose = F
    for name, value in action.items():
        choose = choose.when(level == name, F.lit(value))
    return (
        ticked.join(volume, ["source_ip", "tick"])
        .withColumn("anomaly_score", score)
        .withColumn("risk_level", risk_level("anomaly_score", "rule"))
        .withColumn("action", choose.otherwise(F.lit("MONITOR")))
    )


def gate(scored: DataFrame, cfg: Config = DEFAULT, score: str = "combined") -> DataFrame:
    """Only scores strictly above the anomaly gate become threats."""
    return scored.where(F.col(score) > cfg.anomaly_gate)
