"""Did the response work, and how well does detection do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import ratio
from threatlake.operators.response import mean_before
from threatlake.operators.running import micros, running


def scores_after(actions: DataFrame, scores: DataFrame, seconds: int = 60, cfg: Config = DEFAULT) -> DataFrame:
    """Per action: count, sum and maximum of the target's scores in ``(t, t + seconds]``.

    Time is cut into blocks as long as the interval, so an interval is the end of one block
    plus the start of the next. Both parts are running aggregates from the block's edge: linear
    work, no pair of action and score is ever formed. Scores are summed as integers (1e-12).
    """
    width = seconds * 1_000_000
    at, block = micros("ts"), lambda at: F.floor(at / F.lit(width)).cast("bigint")
    units = F.round(F.col("combined") * F.lit(1e12)).cast("bigint")
    facts = scores.select("source_ip", block(at).alias("_block"), at.alias("_pos"), F.lit(1).cast("bigint").alias("_one"), units.alias("_u"), F.col("combined").alias("_v"))
    # an action asks its own block for what follows it, the next block for what precedes t + seconds
    asked = actions.select(F.col("target_ip").alias("source_ip"), "action_id", micros("executed_at").alias("_at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_next"))
    reach = F.col("_at") + F.col("_next") * width
    probes = asked.select("source_ip", block(reach).alias("_block"), reach.alias("_pos"), "action_id", "_next")
    stacked = facts.unionByName(probes, allowMissingColumns=True)

    keys = ["source_ip", "_block"]
    named = lambda p: {f"{p}n": ("sum", F.col("_one")), f"{p}u": ("sum", F.col("_u")), f"{p}m": ("max", F.col("_v"))}
    rest = running(stacked, keys, "_pos", named("r"), backwards=True, cfg=cfg)
    both = running(rest, keys, "_pos", named("s"), inclusive=True, cfg=cfg).where(F.col("action_id").isNotNull())
    part = lambda c: F.when(F.col("_next") == 0, F.col(f"r{c}")).otherwise(F.col(f"s{c}"))
    return both.groupBy("action_id").agg(
        F.coalesce(F.sum(part("n")), F.lit(0)).alias("n_after"), F.coalesce(F.sum(part("u")), F.lit(0)).alias("units_after"), F.max(part("m")).alias("max_after"))


def validate_actions(actions: DataFrame, scores: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mean score before and after each action, whether it helped, whether the attack resumed."""
    before = mean_before(actions, scores, 5, cfg)
    after = scores_after(actions, scores, 60, cfg)
    joined = before.join(after, "action_id")
    mean_after = F.when(F.col("n_after") > 0, F.col("units_after") / F.lit(1e12) / F.nullif("n_after", F.lit(0))).otherwise(0.0)
    return (
        joined.withColumn("mean_after", mean_after)
        .withColumn("delta", F.col("mean_before") - F.col("mean_after"))
        .withColumn("success", F.col("delta") > 0.15)
        .withColumn("attack_resumed", (F.col("n_after") > 0) & (F.col("max_after") > F.col("mean_before") - 0.1))
        .drop("units_after")
    )


def detection_quality(tp, fp, fn, true_negatives: int) -> dict:
    """Rates from counts; 0 where a denominator is 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1_score": F.when(precision + recall > 0, F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(0.0),
        "false_positive_rate": fp.cast("double") / (fp + true_negatives).cast("double"),
    }


METRIC_SUMS = ("tp", "fp", "fn", "lat_sum", "lat_n")


def metric_sums(validations: DataFrame, feedback: DataFrame, shadow: DataFrame, actions: DataFrame, minutes: int = 15) -> DataFrame:
    """Counts per tumbling window, which add up over parts of the tables; each source is counted on its own, then stacked."""
    zero = F.lit(0).cast("bigint")

    def counted(df, ts, **cols):
        wanted = {"tp": zero, "fp": zero, "fn": zero, "lat_sum": zero, "lat_n": zero, **cols}
        window = F.window(ts, f"{minutes} minutes")
        return df.groupBy(window["start"].alias("window_start")).agg(*[F.sum(e).cast("bigint").alias(n) for n, e in wanted.items()])

    flag = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    parts = [
        counted(validations, "executed_at", tp=flag(F.col("success"))),
        counted(feedback, "created_at", fp=flag(F.col("was_false_positive"))),
        counted(shadow, "timestamp", fn=flag(F.col("would_have_taken_action").isin("BLOCK", "RATE_LIMIT"))),
        counted(actions, "executed_at", lat_sum=F.col("execution_time_ms").cast("bigint"), lat_n=F.lit(1).cast("bigint")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return add_metrics(stacked)


def add_metrics(sums: DataFrame) -> DataFrame:
    return sums.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in METRIC_SUMS])


def quality_of(total: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    quality = detection_quality(F.col("tp"), F.col("fp"), F.col("fn"), cfg.true_negatives)
    return total.select("window_start", "tp", "fp", "fn", *[e.alias(n) for n, e in quality.items()], ratio("lat_sum", "lat_n").alias("avg_latency_ms"))


def window_metrics(validations: DataFrame, feedback: DataFrame, shadow: DataFrame, actions: DataFrame, minutes: int = 15, cfg: Config = DEFAULT) -> DataFrame:
    """Detection metrics per tumbling window."""
    return quality_of(metric_sums(validations, feedback, shadow, actions, minutes), cfg)


def daily_impact(actions: DataFrame, threats: DataFrame, feedback: DataFrame, cfg: Config = DEFAULT, approximate: bool = False) -> DataFrame:
    """Blocked sources, requests and cost avoided, analyst hours saved, false blocks per day."""
    distinct = (lambda c: F.approx_count_distinct(c, 0.01)) if approximate else F.count_distinct
    blocked = actions.where(F.col("action_type") == "BLOCK").groupBy(F.to_date("executed_at").alias("day")).agg(
        distinct("target_ip").alias("ips_blocked"))
    seen = threats.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("threats"))
    wrong = (
        feedback.where("was_false_positive").join(threats.where(F.col("action_taken") == "BLOCK").select("log_id"), "log_id", "left_semi")
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("false_blocks"))
    )
    return impact_of(seen.join(blocked, "day", "full_outer").join(wrong, "day", "full_outer"), cfg)


def impact_of(days: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The report of ``day, threats, ips_blocked, false_blocks``."""
    requests = F.coalesce("ips_blocked", F.lit(0)) * cfg.requests_per_block
    return days.select(
        "day",
        F.coalesce("ips_blocked", F.lit(0)).alias("ips_blocked"),
        requests.alias("requests_blocked"),
        F.coalesce("false_blocks", F.lit(0)).alias("false_blocks"),
        (requests * F.lit(cfg.cost_per_blocked_request)).alias("cost_saved_usd"),
        (F.coalesce("threats", F.lit(0)) * F.lit(cfg.hours_per_threat)).alias("analyst_hours_saved"),
    )
