"""Incremental runs: state that takes only what was committed to its input tables since the run before.

An input is a change table: a folder of versions, each a set of new rows that counts once it is
written whole. A run reads the versions that the last state has not seen, reduces them to partial
aggregates, merges these with the state, and writes a new version of the state. The names of the
versions it covers are written last and commit it, so a run that dies leaves the old state, and a
run that is repeated takes the same rows again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.operators import adapt, killchain, response, validation
from threatlake.session import small_table
from threatlake.sources.versions import committed, remove

#: The input tables of each state table.
INPUTS = {
    "profiles": ("stage_events",),
    "reputation": ("threats",),
    "thresholds": ("feedback", "threats"),
    "metrics": ("validations", "feedback", "shadow", "actions"),
    "impact_days": ("threats", "feedback"),
    "impact_targets": ("actions",),
}
APPLIED = "applied"


def commit(df: DataFrame, table: str) -> str:
    """Add rows to a change table. One writer at a time; a version that was not written whole is replaced."""
    names = committed(df.sparkSession, table, "v-")
    name = f"v-{int(names[-1][2:]) + 1 if names else 0:012d}"
    df.write.mode("overwrite").parquet(f"{table}/{name}")
    return name


def _read(spark: SparkSession, table: str, names: list[str]) -> DataFrame | None:
    return spark.read.parquet(*(f"{table}/{n}" for n in names)) if names else None


def _profiles(old, new, every, cfg):
    parts = killchain.profile_parts(new["stage_events"])
    return killchain.merge_profiles(parts if old is None else old.unionByName(parts))


def _reputation(old, new, every, cfg):
    if old is None:
        old = small_table(new["threats"].sparkSession, [], "ip_address string, threat_count bigint, last_seen timestamp, is_blocked boolean, reputation_points bigint")
    return response.upsert_reputation(old, new["threats"])


def _thresholds(old, new, every, cfg):
    """The few levels' values, moved by the new feedback in its order; feedback comes after its threat and in order of time."""
    values = {} if old is None else {r.level: r.value for r in old.collect()}
    if new["feedback"] is None:
        return old
    path = adapt.threshold_path(adapt.feedback_steps(new["feedback"], every("threats"), cfg), cfg, values)
    last = path.groupBy("level").agg(F.max_by("new_threshold", F.struct("created_at", "log_id")).alias("value"))
    return last if old is None else last.unionByName(old.join(last, "level", "left_anti"))


def _metrics(old, new, every, cfg):
    empty = {n: every(n).limit(0) for n in INPUTS["metrics"] if new[n] is None}
    sums = validation.metric_sums(*(empty.get(n, new[n]) for n in INPUTS["metrics"]))
    return validation.add_metrics(sums if old is None else old.unionByName(sums))


def _impact_days(old, new, every, cfg):
    parts = [] if old is None else [old]
    zero = F.lit(0).cast("bigint")
    if new["threats"] is not None:
        parts.append(new["threats"].groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("threats"), zero.alias("false_blocks")))
    if new["feedback"] is not None:
        blocks = every("threats").where(F.col("action_taken") == "BLOCK").select("log_id")
        wrong = new["feedback"].where("was_false_positive").join(blocks, "log_id", "left_semi")
        parts.append(wrong.groupBy(F.to_date("created_at").alias("day")).agg(zero.alias("threats"), F.count("*").alias("false_blocks")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("day").agg(F.sum("threats").alias("threats"), F.sum("false_blocks").alias("false_blocks"))


def _impact_targets(old, new, every, cfg):
    own = new["actions"].where(F.col("action_type") == "BLOCK").select(F.to_date("executed_at").alias("day"), "target_ip")
    return (own if old is None else old.unionByName(own)).distinct()


STEPS = {"profiles": _profiles, "reputation": _reputation, "thresholds": _thresholds, "metrics": _metrics, "impact_days": _impact_days, "impact_targets": _impact_targets}


def current(spark: SparkSession, out: str) -> str | None:
    """The folder of the last committed state."""
    names = committed(spark, out, "v-", f"{APPLIED}/_SUCCESS")
    return f"{out}/{names[-1]}" if names else None


def advance(spark: SparkSession, base: str, out: str, tables: tuple[str, ...] = tuple(STEPS), cfg: Config = DEFAULT) -> bool:
    """One run: take the new versions of the change tables below ``base`` into the state below ``out``.

    False if there is nothing new. The last two states are kept.
    """
    state = current(spark, out)
    applied = {r["table"]: r["version"] for r in spark.read.parquet(f"{state}/{APPLIED}").collect()} if state else {}
    inputs = sorted({i for t in tables for i in INPUTS[t]})
    versions = {i: committed(spark, f"{base}/{i}", "v-") for i in inputs}
    new = {i: _read(spark, f"{base}/{i}", [v for v in versions[i] if v > applied.get(i, "")]) for i in inputs}
    if all(df is None for df in new.values()):
        return False
    number = int(state.rpartition("v-")[2]) + 1 if state else 0
    target = f"{out}/v-{number:012d}"
    every = lambda i: _read(spark, f"{base}/{i}", versions[i])
    for table in tables:
        old = spark.read.parquet(f"{state}/{table}") if state and table in applied_tables(spark, state) else None
        if all(new[i] is None for i in INPUTS[table]):
            made = old
        else:
            made = STEPS[table](old, new, every, cfg)
        if made is not None:
            made.write.mode("overwrite").parquet(f"{target}/{table}")
    rows = [(i, versions[i][-1]) for i in inputs if versions[i]]
    small_table(spark, rows, "table string, version string").coalesce(1).write.mode("overwrite").parquet(f"{target}/{APPLIED}")
    for name in committed(spark, out, "v-", f"{APPLIED}/_SUCCESS")[:-2]:
        remove(spark, f"{out}/{name}")
    return True


def applied_tables(spark: SparkSession, state: str) -> list[str]:
    """State tables that a version holds."""
    return committed(spark, state, "")


def profiles(spark: SparkSession, out: str, as_of: Column) -> DataFrame:
    return killchain.profile_of(spark.read.parquet(f"{current(spark, out)}/profiles"), as_of)


def metrics(spark: SparkSession, out: str, cfg: Config = DEFAULT) -> DataFrame:
    return validation.quality_of(spark.read.parquet(f"{current(spark, out)}/metrics"), cfg)


def impact(spark: SparkSession, out: str, cfg: Config = DEFAULT) -> DataFrame:
    days, targets = (spark.read.parquet(f"{current(spark, out)}/{t}") for t in ("impact_days", "impact_targets"))
    blocked = targets.groupBy("day").agg(F.count("*").alias("ips_blocked"))
    return validation.impact_of(days.join(blocked, "day", "full_outer"), cfg)


def tuned(spark: SparkSession, out: str, cfg: Config = DEFAULT) -> Config:
    """The settings with the thresholds that feedback has led to: what the next run of the loop uses."""
    state = current(spark, out)
    if state is None or "thresholds" not in applied_tables(spark, state):
        return cfg
    values = {r.level: r.value for r in spark.read.parquet(f"{state}/thresholds").collect()}
    return replace(cfg, thresholds={**cfg.thresholds, **values})
