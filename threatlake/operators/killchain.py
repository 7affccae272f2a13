"""Attack stages: classification, progression, attacker profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.operators.running import micros, running, salted_lookup
from threatlake.schemas import PAYLOAD, STAGES
from threatlake.session import small_table

# Score multiplier per stage.
STAGE_MULTIPLIER = {"RECONNAISSANCE": 1.1, "ENUMERATION": 1.3, "EXPLOITATION": 1.6, "PERSISTENCE": 1.8}
# Confidence per stage.
STAGE_CONFIDENCE = {"PERSISTENCE": 0.9, "EXPLOITATION": 0.85, "ENUMERATION": 0.75, "RECONNAISSANCE": 0.65}
MIN_STAGE_CONFIDENCE = 0.4


def parse_payload(logs: DataFrame, column: str = "raw_payload") -> DataFrame:
    """Known payload keys as columns; unreadable JSON gives nulls."""
    return logs.withColumn("_p", F.from_json(column, PAYLOAD)).select("*", "_p.*").drop("_p")


def _lookup(values: dict, key: Column, default: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(key == name, F.lit(value))
    return chain.otherwise(default)


def stage_multiplier(stage: Column | str) -> Column:
    return _lookup(STAGE_MULTIPLIER, F.col(stage) if isinstance(stage, str) else stage, F.lit(1.0))


def stage_index(stage: Column | str) -> Column:
    return _lookup({s: i for i, s in enumerate(STAGES)}, F.col(stage) if isinstance(stage, str) else stage, F.lit(None).cast("int"))


def next_stage(stage: Column | str) -> Column:
    following = dict(zip(STAGES, STAGES[1:]))
    return _lookup(following, F.col(stage) if isinstance(stage, str) else stage, F.lit(None).cast("string"))


def classify_stage(flows: DataFrame) -> DataFrame:
    """Add ``stage``, ``stage_confidence`` and ``signals``; payload keys may be absent."""
    present = set(flows.columns)
    col = lambda name, kind: F.col(name) if name in present else F.lit(None).cast(kind)
    agent = F.lower(col("user_agent", "string"))
    web = F.col("dest_port").isin(80, 443)
    tests = {
        "PERSISTENCE": [
            ((F.col("duration_seconds") > 3600) & (F.coalesce("bytes_sent", F.lit(0)) < 1000), "long_session_low_rate"),
            (col("repeated_beaconing", "boolean"), "repeated_beaconing"),
        ],
        "EXPLOITATION": [
            (F.length(col("sqli_pattern", "string")) > 0, "sqli_pattern"),
            (col("failed_logins", "int") > 10, "brute_force_login"),
        ],
        "ENUMERATION": [
            (web & (F.col("request_rate") > 50), "endpoint_probing"),
            (web & (agent.contains("dirbuster") | agent.contains("nmap")), "scanner_agent"),
        ],
        "RECONNAISSANCE": [
            (F.coalesce(F.col("request_rate") > 100, F.lit(False)) | F.coalesce(col("port_entropy", "double") > 0.8, F.lit(False)),
             "high_connection_rate_to_many_ports"),
            (F.col("protocol") == "ICMP", "ping_sweep"),
        ],
    }
    stage, signals = F, F
    for name, rules in tests.items():  # listed from the most to the least advanced stage
        hit = F.lit(False)
        for rule, _ in rules:
            hit = hit | F.coalesce(rule, F.lit(False))
        stage = stage.when(hit, F.lit(name))
        signals = signals.when(F.col("stage") == name, F.array_compact(F.array(*[F.when(rule, F.lit(signal)) for rule, signal in rules])))
    return (
        flows.withColumn("stage", stage.otherwise(F.lit(None).cast("string")))
        .withColumn("signals", signals.otherwise(F.array().cast("array<string>")))
        .withColumn("stage_confidence", _lookup(STAGE_CONFIDENCE, F.col("stage"), F.lit(0.0)))
    )


def stage_events(flows: DataFrame) -> DataFrame:
    """The stage rows worth recording."""
    sure = [s for s, confidence in STAGE_CONFIDENCE.items() if confidence >= MIN_STAGE_CONFIDENCE]
    return classify_stage(flows).where(F.col("stage").isin(sure)).select(
        "log_id", "source_ip", F.col("ts").alias("detected_at"), "stage",
        F.col("stage_confidence").alias("confidence"), "signals", next_stage("stage").alias("predicted_next_stage"),
    )


def progression(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Flag stage events that are further than the source's previous one, within an hour."""
    numbered = events.select("*", micros("detected_at").alias("_pos"), stage_index("stage").alias("_idx"))
    previous = F.struct(F.col("_pos").alias("at"), F.col("log_id").alias("id"), F.col("_idx").alias("idx"))
    joined = running(numbered, ["source_ip"], "_pos", {"_prev": ("max", previous)}, tie="log_id", cfg=cfg)
    advancing = (F.col("_idx") > F.col("_prev.idx")) & (F.col("_pos") - F.col("_prev.at") <= 3_600_000_000)
    return joined.withColumn("is_progressing", F.coalesce(advancing, F.lit(False))).drop("_pos", "_idx", "_prev")


def stage_history(events: DataFrame) -> DataFrame:
    """The whole stage history of every source: a row per stage event, to be appended to its table."""
    return events.select("source_ip", F.col("log_id").alias("threat_event_id"), F.col("detected_at").alias("timestamp"), "stage", "confidence")


def attacker_profiles(events: DataFrame, as_of: Column) -> DataFrame:
    """One row per source: first and current stage, number of stage events, activity flag.

    The events themselves are the rows of :func:`stage_history`.
    """
    return profile_of(profile_parts(events), as_of)


def profile_parts(events: DataFrame) -> DataFrame:
    """What a profile needs of its source's events; parts of two sets of events are merged by :func:`merge_profiles`."""
    event = F.struct("detected_at", "log_id", "stage")
    return events.groupBy("source_ip").agg(F.min(event).alias("first"), F.max(event).alias("last"), F.count("*").alias("stage_events"))


def merge_profiles(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source_ip").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("stage_events").alias("stage_events"))


def profile_of(parts: DataFrame, as_of: Column) -> DataFrame:
    return (
        parts.select("source_ip", F.col("first.stage").alias("first_stage_seen"), F.col("last.stage").alias("current_stage"),
                     F.col("last.detected_at").alias("last_activity"), "stage_events")
        .withColumn("predicted_next_action", next_stage("current_stage"))
        .withColumn("is_active", (F.unix_micros(as_of) - micros("last_activity")) <= F.lit(2 * 3600 * 1_000_000))
    )


def upkeep(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Profiles silent for more than two hours become inactive."""
    silent = (F.unix_micros(as_of) - micros("last_activity")) > F.lit(2 * 3600 * 1_000_000)
    return profiles.withColumn("is_active", F.when(silent, F.lit(False)).otherwise(F.col("is_active")))


def active_attackers(profiles: DataFrame) -> DataFrame:
    return profiles.where("is_active").orderBy(F.desc("last_activity"), "source_ip")


def current_context(new_stages: DataFrame, profiles: DataFrame, cfg: Config = DEFAULT, row_id: str = "log_id") -> DataFrame:
    """Stage of the flow itself, or else the stored stage of its source while that is active."""
    stored = profiles.where("is_active").select("source_ip", F.col("current_stage").alias("_stored"))
    joined = salted_lookup(new_stages, stored, "source_ip", row_id, cfg)
    return joined.withColumn("context_stage", F.coalesce("stage", "_stored")).drop("_stored")


def stage_stats(profiles: DataFrame) -> DataFrame:
    """Active attackers per stage, zero rows included, with the share that ever moved."""
    active = profiles.where("is_active")
    counts = active.groupBy(F.col("current_stage").alias("stage")).agg(F.count("*").alias("n"))
    moved = active.agg(F.avg((F.col("stage_events") > 1).cast("double"))).scalar()
    total = active.agg(F.count("*")).scalar()
    stages = small_table(active.sparkSession, [(s,) for s in STAGES], "stage string")
    return stages.join(counts, "stage", "left").select(
        "stage", F.coalesce("n", F.lit(0)).alias("attackers"),
        total.alias("total_active"), F.coalesce(moved, F.lit(0.0)).alias("progression_rate"),
    )


def dashboard_profiles(events: DataFrame) -> DataFrame:
    """Attacker rows built from scored events alone: risk decides the stage."""
    stage = (
        F.when(F.col("attack_type").isin("ransomware", "zero_day"), "PERSISTENCE")
        .when(F.col("risk_level") == "CRITICAL", "EXPLOITATION")
        .when(F.col("risk_level") == "HIGH", "ENUMERATION")
        .otherwise("RECONNAISSANCE")
    )
    return (
        events.where(F.col("attack_type") != "normal")
        .withColumn("stage", stage)
        .groupBy("source_ip")
        .agg(
            F.max_by("stage", F.struct("ts", "log_id")).alias("current_stage"),
            F.min("ts").alias("first_stage_seen"),
            F.max("ts").alias("last_activity"),
            F.count("*").alias("history_rows"),
            F.max("anomaly_score").alias("max_confidence"),
        )
    )
