"""Human approval queue as snapshot transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Queue after applying each entry's first review made before its deadline; only PENDING entries change."""
    first = reviews.groupBy("log_id").agg(
        F.min_by(F.struct("reviewer", "reviewed_at", "approved"), F.struct("reviewed_at", "reviewer")).alias("r"))
    joined = queue.join(first, "log_id", "left")
    applies = (F.col("status") == "PENDING") & F.col("r").isNotNull() & (F.col("r.reviewed_at") < F.col("expires_at"))
    return joined.select(
        *[c for c in queue.columns if c not in ("status", "reviewed_by", "reviewed_at")],
        F.when(applies, F.when(F.col("r.approved"), "APPROVED").otherwise("REJECTED")).otherwise(F.col("status")).alias("status"),
        F.when(applies, F.col("r.reviewer")).alias("reviewed_by"),
        F.when(applies, F.col("r.reviewed_at")).alias("reviewed_at"),
    )


def expire(queue: DataFrame, as_of: Column) -> DataFrame:
    overdue = (F.col("status") == "PENDING") & (F.col("expires_at") <= as_of)
    return queue.withColumn("status", F.when(overdue, "EXPIRED").otherwise(F.col("status")))


def approved_actions(queue: DataFrame) -> DataFrame:
    """Approved entries become actions."""
    return queue.where(F.col("status") == "APPROVED").select(
        F.col("log_id").alias("action_id"), F.col("proposed_action").alias("action_type"), F.col("source_ip").alias("target_ip"),
        F.col("reviewed_at").alias("executed_at"))


def apply_to_threats(threats: DataFrame, queue: DataFrame) -> DataFrame:
    """Threats after the queue: rejected ones resolved, expired ones downgraded to ALERT."""
    outcome = queue.select("log_id", F.col("status").alias("approval_status"))
    return threats.join(outcome, "log_id", "left").select(
        *[c for c in threats.columns if c not in ("action_taken", "resolved")],
        F.when(F.col("approval_status") == "EXPIRED", "ALERT").otherwise(F.col("action_taken")).alias("action_taken"),
        F.coalesce(F.col("approval_status") == "REJECTED", F.lit(False)).alias("resolved"),
        "approval_status",
    )


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status") == "PENDING").orderBy("expires_at", "log_id")
