"""Dashboard and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.functions.scalars import ratio, risk_level
from threatlake.operators.adapt import _since
from threatlake.operators.running import micros
from threatlake.schemas import ACTIONS

COST_PER_BLOCK = 45.50  # fixed value of the overview card


def newest(df: DataFrame, ts: str, row_id: str, limit: int, skip: int = 0) -> DataFrame:
    """One page, newest first; ties broken by id so pages never overlap."""
    page = df.orderBy(F.desc(ts), F.desc(row_id))
    return (page.offset(skip) if skip else page).limit(limit)


def newest_before(df: DataFrame, ts: str, row_id: str, limit: int, after: tuple | None = None) -> DataFrame:
    """Keyset paging for deep scans: the page that follows the (ts, id) last seen."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(row_id) < last)))
    return newest(df, ts, row_id, limit)


def last_per_key(df: DataFrame, key: str, ts: str, row_id: str, n: int) -> DataFrame:
    window = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(row_id))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def search_threats(threats: DataFrame, *, ip: str | None = None, contains: str | None = None, since: Column | None = None,
                   until: Column | None = None, risk: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    tests = [
        None if ip is None else F.col("source_ip") == ip,
        None if contains is None else F.col("source_ip").contains(contains),
        None if since is None else F.col("created_at") >= since,
        None if until is None else F.col("created_at") <= until,
        None if risk is None else F.col("risk_level") == risk,
    ]
    for test in tests:
        threats = threats if test is None else threats.where(test)
    return newest(threats, "created_at", "log_id", limit, skip)


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(F.col(key).isin(values))


def unscored(logs: DataFrame, scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs without a score."""
    rest = logs.join(scores.select("log_id"), "log_id", "left_anti")
    return rest if limit is None else rest.orderBy("ts", "log_id").limit(limit)


def recent_range(df: DataFrame, ts: str, as_of: Column, days: int, *order: Column) -> DataFrame:
    return _since(df, ts, as_of, days).orderBy(*order)


def threat_stats(threats: DataFrame, scores: DataFrame, metrics: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """The combined statistics record: two count maps, latest FP rate of 24 h, mean latency."""
    to_map = lambda df, c: count_by(df, c).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n"))))).scalar()
    rate = _since(metrics, "window_start", as_of, 1).agg(F.max_by("false_positive_rate", "window_start")).scalar()
    return actions.agg(F.sum(F.col("execution_time_ms").cast("bigint")).alias("s"), F.count("*").alias("n")).select(
        to_map(scores, "risk_level").alias("risk_level_counts"),
        to_map(threats, "action_taken").alias("action_taken_counts"),
        F.coalesce(rate, F.lit(0.0)).alias("fp_rate_last_24h"),
        ratio(F.coalesce("s", F.lit(0)), F.col("n")).alias("avg_detection_latency_ms"),
    )


def batch_summary(events: DataFrame, batch: Column) -> DataFrame:
    """Per batch: totals, kinds of attack and action, distinct sources, top score, criticals.

    Kinds and actions are small fixed sets and are listed; sources are counted here and listed
    as rows by :func:`batch_sources`.
    """
    attack = F.col("attack_type") != "normal"
    listed = lambda c: F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(attack, F.col(c)))), ", "), F.lit("")), F.lit("none"))
    return events.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("total"), F.count_if(attack).alias("anomalous"), F.count_if(~attack).alias("normal"),
        listed("attack_type").alias("attack_types"), listed("action").alias("actions"),
        F.count_distinct(F.when(attack, F.col("source_ip"))).alias("sources"),
        F.max("anomaly_score").alias("max_score"), F.count_if(attack & (F.col("risk_level") == "CRITICAL")).alias("criticals"),
    )


def batch_sources(events: DataFrame, batch: Column) -> DataFrame:
    return events.where(F.col("attack_type") != "normal").select(batch.alias("batch"), "source_ip").distinct()


def daily_risk(threats: DataFrame) -> DataFrame:
    """Per day: threats, confident ones, and one column per action."""
    day = F.to_date("created_at").alias("day")
    counts = [F.count_if(F.col("action_taken") == a).alias(a.lower()) for a in ACTIONS]
    return threats.groupBy(day).agg(F.count("*").alias("threats"), F.count_if(F.col("confidence_score") > 0.8).alias("high_confidence"), *counts)


def confusion(events: DataFrame, batch: Column) -> DataFrame:
    """Per batch and cumulative confusion against the known labels."""
    attack, flagged = F.col("is_attack"), F.col("risk_level") != "LOW"
    per = events.groupBy(batch.alias("batch")).agg(
        F.count_if(attack & flagged).alias("tp"), F.count_if(~attack & flagged).alias("fp"), F.count_if(attack & ~flagged).alias("fn"))
    # totals of spans of a thousand batches are summed in order, batches inside their span
    names = ("tp", "fp", "fn")
    spanned = per.withColumn("_span", F.floor(F.col("batch") / F.lit(1000)))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    spans = spanned.groupBy(F.col("_span").alias("_of")).agg(*[F.sum(c).alias(f"_{c}") for c in names])
    spans = spans.select("_of", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names])
    within = Window.partitionBy("_span").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return spanned.join(spans, F.col("_span") == F.col("_of")).select("batch", *names, *[(F.col(f"_{c}") + F.sum(c).over(within)).alias(f"cum_{c}") for c in names])


def dataset_statistics(df: DataFrame, label: str, features: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("attack")).select(
        "*", (ratio("attack", "total") * 100.0).alias("attack_pct"), F.lit(features).alias("features"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages, from four counts."""
    t, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    counts = df.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    def line(name, hit, wrong, missed):
        pr, rc = ratio(F.col(hit), F.col(hit) + F.col(wrong)), ratio(F.col(hit), F.col(hit) + F.col(missed))
        f1 = F.when(pr + rc > 0, F.lit(2.0) * pr * rc / F.nullif(pr + rc, F.lit(0.0))).otherwise(0.0)
        return F.struct(F.lit(name).alias("class"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), (F.col(hit) + F.col(missed)).alias("support"))
    normal, attack = line("normal", "c00", "c10", "c01"), line("attack", "c11", "c01", "c10")
    both = counts.select("*", normal.alias("a"), attack.alias("b"))
    n = F.col("a.support") + F.col("b.support")
    measures = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro").alias("class"), *[((F.col(f"a.{m}") + F.col(f"b.{m}")) / 2.0).alias(m) for m in measures], n.alias("support"))
    weighted = F.struct(F.lit("weighted").alias("class"), *[((F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support")) / F.nullif(n, F.lit(0))).alias(m) for m in measures], n.alias("support"))
    return both.select(F.explode(F.array(F.col("a"), F.col("b"), macro, weighted)).alias("r")).select("r.*")


def time_to_detect(flows: DataFrame, actions: DataFrame) -> DataFrame:
    """Per source: first activity, first block or rate limit, seconds between."""
    seen = flows.groupBy("source_ip").agg(F.min("ts").alias("first_activity"))
    acted = actions.where(F.col("action_type").isin("BLOCK", "RATE_LIMIT")).groupBy(F.col("target_ip").alias("source_ip")).agg(F.min("executed_at").alias("first_action"))
    return seen.join(acted, "source_ip", "left").withColumn("latency_us", micros("first_action") - micros("first_activity"))


def detection_report(latencies: DataFrame, by: Column) -> DataFrame:
    """Detected and evaded sources, mean latency and detection rate per group."""
    return latencies.groupBy(by.alias("strategy")).agg(
        F.count("*").alias("sources"), F.count("latency_us").alias("detected"),
        F.count_if(F.col("latency_us").isNull()).alias("evaded"), F.sum("latency_us").alias("_us"),
    ).select("strategy", "sources", "detected", "evaded", (ratio(F.coalesce("_us", F.lit(0)), F.col("detected")) / 1e6).alias("mean_latency_s"),
             ratio("detected", "sources").alias("detection_rate"))


def ip_cards(events: DataFrame) -> DataFrame:
    """Intelligence card per source: latest attack score, category, counts."""
    attack = F.col("attack_type") != "normal"
    latest = lambda c: F.max_by(F.when(attack, F.col(c)), F.when(attack, F.struct("ts", "log_id")))
    return events.groupBy("source_ip").agg(
        latest("anomaly_score").alias("reputation_score"), latest("attack_type").alias("attack_pattern"),
        F.count("*").alias("total_events"), F.count_if(attack).alias("attack_events"),
    ).where("attack_events > 0").withColumn("risk_category", risk_level("reputation_score", "profile"))


def overview(events: DataFrame, as_of: Column, baseline_fp_pct: float = 12.5, fp_rate_pct: float = 0.5) -> DataFrame:
    """Totals of the overview page in one pass."""
    fresh = (F.unix_micros(as_of) - micros("ts")) < F.lit(30_000_000)
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("criticals"), F.count_if(F.col("risk_level") == "HIGH").alias("highs"),
        F.count_distinct(F.when(F.col("action") == "BLOCK_IP", F.col("source_ip"))).alias("blocked"),
        F.count_if((F.col("risk_level") != "LOW") & fresh).alias("active_threats"),
    ).select("*", (F.col("blocked") * F.lit(COST_PER_BLOCK)).alias("cost_saved"),
             F.lit((baseline_fp_pct - fp_rate_pct) / baseline_fp_pct * 100.0).alias("fp_reduction_pct"))


def merge_feeds(scored: DataFrame, threats: DataFrame) -> DataFrame:
    """Scored attack events and recorded threats as one feed."""
    action = F.when(F.col("action") == "BLOCK_IP", "BLOCK").otherwise(F.col("action"))
    stage = F.when(F.col("risk_level") == "CRITICAL", "EXPLOITATION").when(F.col("risk_level") == "HIGH", "ENUMERATION").otherwise("RECONNAISSANCE")
    left = scored.where(F.col("attack_type") != "normal").select(
        "log_id", F.col("ts").alias("created_at"), "source_ip", F.col("anomaly_score").alias("confidence_score"), "risk_level",
        action.alias("action_taken"), stage.alias("kill_chain_stage"), F.lit(True).alias("is_scored_event"))
    right = threats.select("log_id", "created_at", "source_ip", "confidence_score", "risk_level", "action_taken",
                           F.lit(None).cast("string").alias("kill_chain_stage"), F.lit(False).alias("is_scored_event"))
    return left.unionByName(right)


def minute_series(scores: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Highest score per minute over the last hour, empty minutes as 0."""
    minute = 60_000_000
    end = F.floor(F.unix_micros(as_of) / F.lit(minute)).cast("bigint")
    spine = scores.sparkSession.range(1).select(F.explode(F.sequence(end - (minutes - 1), end)).alias("minute"))
    seen = scores.select(F.floor(micros("ts") / F.lit(minute)).cast("bigint").alias("minute"), "combined").groupBy("minute").agg(
        F.max("combined").alias("max_score"), F.count("*").alias("n"))
    return spine.join(seen, "minute", "left").select(
        F.timestamp_micros(F.col("minute") * minute).alias("minute"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("n", F.lit(0)).alias("n"))


#: Sketches of 2^12 registers: one standard error of their counts.
SKETCH_BITS, SKETCH_ERROR = 12, 0.0163


def daily_sketches(df: DataFrame, day: str, value: str) -> DataFrame:
    """``day, sketch``: one small sketch of the distinct values of each day, to be stored. Sketches of
    several days or of parts of a day merge into that of all of them; counts of distinct values don't."""
    return df.groupBy(day).agg(F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch"))


def sketched_counts(sketches: DataFrame, period: Column, name: str) -> DataFrame:
    """Estimated distinct values of each period of days, and the days that have a sketch."""
    return sketches.groupBy(period.alias(name)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.count_distinct("day").alias("days"))
