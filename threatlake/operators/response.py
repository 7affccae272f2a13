"""Responses and their state: actions, reputation, blocking, rollback."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.operators.running import as_of, cells_of, micros, range_cells, running, salted_lookup, trailing

# Reputation change per action, in hundredths.
REPUTATION_STEP = {"BLOCK": 50, "RATE_LIMIT": 25, "PORT_CLOSE": 40}
BLOCK_REASON = "Automated block — high-confidence threat"


def reputation_step(action: Column | str) -> Column:
    action = F.col(action) if isinstance(action, str) else action
    chain = F
    for name, value in REPUTATION_STEP.items():
        chain = chain.when(action == name, F.lit(value))
    return chain.otherwise(F.lit(0)).cast("bigint")


def with_reputation(threats: DataFrame, reputation: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Threats with the stored reputation of their source, or the default row."""
    stored = reputation.select(F.col("ip_address").alias("source_ip"), "threat_count", "is_blocked", "reputation_score")
    joined = salted_lookup(threats, stored, "source_ip", "log_id", cfg)
    return joined.withColumns({
        "threat_count": F.coalesce("threat_count", F.lit(0)),
        "is_blocked": F.coalesce("is_blocked", F.lit(False)),
        "reputation_score": F.coalesce("reputation_score", F.lit(1.0)),
    })


def respond(threats: DataFrame) -> DataFrame:
    """Action rows for every threat that is more than monitored."""
    step = reputation_step("action_taken")
    return threats.where(F.col("action_taken") != "MONITOR").select(
        F.col("log_id").alias("action_id"), F.col("log_id").alias("threat_id"), F.col("action_taken").alias("action_type"),
        F.col("source_ip").alias("target_ip"), F.lit(True).alias("success"),
        (F.col("created_at") + F.expr("interval 2 seconds")).alias("executed_at"),
        (-step / F.lit(100.0)).alias("reputation_delta"),
        (F.col("action_taken") == "BLOCK").alias("blocks_source"),
        F.when(F.col("action_taken") == "BLOCK", F.lit(BLOCK_REASON)).alias("block_reason"),
    )


def reputation_path(actions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Reputation of the target after each action. All steps lower it, so stopping at 0 after
    every step equals stopping the running sum at 0."""
    rows = actions.withColumn("_pos", micros("executed_at")).withColumn("_step", reputation_step("action_type"))
    summed = running(rows, ["target_ip"], "_pos", {"_spent": ("sum", F.col("_step"))}, tie="action_id", inclusive=True, cfg=cfg)
    return summed.withColumn("reputation", F.greatest(F.lit(0), F.lit(100) - F.col("_spent")) / F.lit(100.0)).drop("_pos", "_step", "_spent")


def attack_history(threats: DataFrame) -> DataFrame:
    """The whole attack history of every source: a row per threat, to be appended to its table.

    It is not nested in the snapshot, where one source's list would have no bound.
    """
    return threats.select(F.col("source_ip").alias("ip_address"), F.col("log_id"), F.col("created_at").alias("timestamp"),
                          F.col("confidence_score").alias("score"), F.col("action_taken").alias("action"), "threat_type")


def upsert_reputation(snapshot: DataFrame, threats: DataFrame) -> DataFrame:
    """New reputation snapshot after a batch of threats: one row per source, old or new.

    Reputation points are integers (hundredths). The entries behind the counts are those of
    :func:`attack_history`.
    """
    batch = (
        threats.groupBy("source_ip")
        .agg(F.count("*").alias("new_threats"), F.max("created_at").alias("new_seen"),
             F.sum(reputation_step("action_taken")).alias("spent"),
             F.max((F.col("action_taken") == "BLOCK").cast("int")).alias("blocks"))
        .withColumnRenamed("source_ip", "ip_address")
    )
    points = F.coalesce("reputation_points", F.lit(100).cast("bigint")) - F.coalesce("spent", F.lit(0).cast("bigint"))
    return snapshot.join(batch, "ip_address", "full_outer").select(
        "ip_address",
        (F.coalesce("threat_count", F.lit(0)) + F.coalesce("new_threats", F.lit(0))).cast("bigint").alias("threat_count"),
        F.greatest("last_seen", "new_seen").alias("last_seen"),
        (F.coalesce("is_blocked", F.lit(False)) | (F.coalesce("blocks", F.lit(0)) > 0)).alias("is_blocked"),
        F.greatest(points, F.lit(0)).alias("reputation_points"),
    )


def first_blocks(actions: DataFrame) -> DataFrame:
    """The first block of every target."""
    return actions.where(F.col("action_type") == "BLOCK").groupBy("target_ip").agg(
        F.min_by("action_id", F.struct("executed_at", "action_id")).alias("action_id"), F.min("executed_at").alias("first_blocked_at"))


def trailing_mean(scores: DataFrame, depth: int = 5, cfg: Config = DEFAULT) -> DataFrame:
    """Mean of the source's ``depth`` latest scores as of every score."""
    rows = scores.withColumn("_pos", micros("ts"))
    build = lambda w: {"recent_mean": F.avg("combined").over(w.rowsBetween(-(depth - 1), 0))}
    return trailing(rows, ["source_ip"], "_pos", "log_id", depth - 1, build, cfg=cfg).drop("_pos")


def mean_before(actions: DataFrame, scores: DataFrame, depth: int = 5, cfg: Config = DEFAULT, at: str = "executed_at") -> DataFrame:
    """Add ``mean_before``: mean of the target's ``depth`` latest scores at or before the action."""
    means = trailing_mean(scores.select("source_ip", "ts", "log_id", "combined"), depth, cfg)
    probes = actions.withColumnRenamed("target_ip", "source_ip")
    found = as_of(probes, means, "source_ip", at, "ts", "log_id", ["recent_mean"], cfg=cfg, name="_m")
    return found.withColumn("mean_before", F.coalesce("_m.recent_mean", F.lit(0.0))).drop("_m").withColumnRenamed("source_ip", "target_ip")


#: Sizes of the cells of a check's phase, microseconds.
PHASES = tuple(4**k for k in range(16, -1, -1))


def cool_runs(scores: DataFrame, cfg: Config = DEFAULT, depth: int = 5) -> DataFrame:
    """``source_ip, begin, end``: times (microseconds, without the end) in which the mean of the source's
    ``depth`` latest scores is below ``rollback_below``. The mean is constant between two scores, so
    only its changes are kept. The last run has no end; the time before the first score isn't listed."""
    means = trailing_mean(scores.select("source_ip", "ts", "log_id", "combined"), depth, cfg)
    at = means.groupBy("source_ip", micros("ts").alias("begin")).agg(F.max_by("recent_mean", "log_id").alias("mean"))  # of one time the last
    cool = at.select("source_ip", "begin", (F.col("mean") < cfg.rollback_below).alias("cool"))
    was = trailing(cool, ["source_ip"], "begin", "begin", 1, lambda w: {"was": F.lag("cool").over(w)}, cfg=cfg)
    changes = was.where(F.col("was").isNull() | (F.col("was") != F.col("cool"))).drop("was")
    ends = running(changes, ["source_ip"], "begin", {"_next": ("max", -F.col("begin"))}, backwards=True, cfg=cfg)
    return ends.where("cool").select("source_ip", "begin", (-F.col("_next")).alias("end"))


def first_cool_checks(actions: DataFrame, scores: DataFrame, as_of: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Every block with the number of its checks up to ``as_of`` (``checks``, at least one) and of the
    first that finds its source cool (``ended``, null if none does).

    Checks of a block all have one phase of the interval. A cool run as long as the interval meets
    every phase, a shorter one a range of phases, which is cut into cells like the axis of
    :func:`range_cells`; the first run that begins after a block's first check in one of the cells of
    its phase ends it. Rows grow with blocks and changes of the mean, not with checks.
    """
    every = cfg.auto_rollback_minutes * 60_000_000
    blocks = actions.where(F.col("action_type") == "BLOCK")
    checks = F.greatest(F.lit(1), F.floor((F.unix_micros(as_of) - micros("executed_at")) / F.lit(every))).cast("bigint")
    due = blocks.withColumn("checks", checks).withColumn("_due", micros("executed_at") + every).withColumn("due_at", F.timestamp_micros("_due"))
    first = mean_before(due, scores, 5, cfg, at="due_at")

    runs = cool_runs(scores, cfg)
    low, high = F.pmod("begin", F.lit(every)), F.pmod(F.col("end") - 1, F.lit(every))
    whole = F.col("end").isNull() | (F.col("end") - F.col("begin") >= every)
    phases = F.when(whole, F.array(F.lit("all"))).when(low <= high, range_cells(low, high, PHASES)).otherwise(
        F.concat(range_cells(low, F.lit(every - 1), PHASES), range_cells(F.lit(0), high, PHASES)))
    named = lambda cell: F.concat("source_ip", F.lit(" "), cell)
    facts = runs.withColumn("cell", F.explode(phases)).select(named(F.col("cell")).alias("key"), F.col("begin").alias("_pos"), F.lit(None).cast("bigint").alias("action_id"))
    # A first check that is not cool lies outside all runs, so the run that ends the block begins later.
    hot = first.where(F.col("mean_before") >= cfg.rollback_below)
    asked = hot.withColumn("cell", F.explode(F.concat(F.array(F.lit("all")), cells_of(F.pmod("_due", F.lit(every)), PHASES)))).withColumnRenamed("target_ip", "source_ip")
    asked = asked.select(named(F.col("cell")).alias("key"), F.col("_due").alias("_pos"), "action_id")
    begin = F.when(F.col("action_id").isNull(), -F.col("_pos"))
    found = running(facts.unionByName(asked), ["key"], "_pos", {"_run": ("max", begin)}, backwards=True, cfg=replace(cfg, hot=None))
    ending = found.where("action_id is not null").groupBy("action_id").agg((-F.max("_run")).alias("_begin"))
    joined = first.join(ending, "action_id", "left")
    later = F.ceil((F.col("_begin") - F.col("_due")) / F.lit(every)).cast("bigint") + 1
    ended = F.when(F.col("mean_before") < cfg.rollback_below, F.lit(1).cast("bigint")).otherwise(later)
    return joined.withColumn("ended", F.when(ended <= F.col("checks"), ended)).drop("_begin", "_due", "due_at", "mean_before")


def auto_rollback(actions: DataFrame, scores: DataFrame, as_of: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Checks of every block: ``check`` 1 after thirty minutes, then one every thirty minutes.

    A block stays while the source's latest scores are hot (EXTEND) and ends with the first check
    that finds them cooler (ROLLBACK). Other actions are not checked. A block has its first
    check however late it is, and later ones up to ``as_of``; only checks that take place get a row.
    """
    every = cfg.auto_rollback_minutes * 60_000_000
    blocks = first_cool_checks(actions, scores, as_of, cfg)
    due = blocks.withColumn("check", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("ended", "checks")))).withColumn(
        "due_at", F.timestamp_micros(micros("executed_at") + F.col("check") * F.lit(every)))
    checked = mean_before(due, scores, 5, cfg, at="due_at").withColumnRenamed("mean_before", "recent_mean")
    return checked.withColumn("outcome", F.when(F.col("recent_mean") >= cfg.rollback_below, "EXTEND").otherwise("ROLLBACK")).drop("checks", "ended")


def rollback(actions: DataFrame, reputation: DataFrame, actor: str, reason: str, at: Column) -> DataFrame:
    """Rollback records of the given actions, successful when the target was blocked."""
    stored = reputation.select(F.col("ip_address").alias("target_ip"), "is_blocked")
    return actions.join(stored, "target_ip", "left").select(
        "action_id", "target_ip", at.alias("rolled_back_at"), F.lit(actor).alias("rolled_back_by"),
        F.lit(reason).alias("rollback_reason"), F.coalesce("is_blocked", F.lit(False)).alias("was_successful"),
    )


def unblock(reputation: DataFrame, records: DataFrame) -> DataFrame:
    """Reputation snapshot after rollbacks."""
    freed = records.select(F.col("target_ip").alias("ip_address")).distinct().withColumn("_free", F.lit(True))
    return reputation.join(freed, "ip_address", "left").withColumn(
        "is_blocked", F.col("is_blocked") & F.col("_free").isNull()).drop("_free")
