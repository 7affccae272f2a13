"""What is known about a source: profile, reputation, patterns, similar cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import clip, ratio, risk_level
from threatlake.operators.running import micros, trailing
from threatlake.session import materialise


def ip_reputation(timeline: DataFrame, as_of: Column) -> DataFrame:
    """Per source: counts and the 0..1 reputation score. Scores are averaged as 1e-4 integers.

    ``timeline`` has ``source_ip, ts, log_id, score, kind, outcome``.
    """
    now = F.unix_micros(as_of)
    recent = (now - micros("ts")) <= F.lit(7 * 86_400_000_000)
    units = F.round(F.col("score") * 10_000).cast("bigint")
    grouped = timeline.groupBy("source_ip").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("total_events"),
        F.count_if((F.col("kind") == "ATTACK") | (F.col("score") > 0.3)).alias("attack_events"),
        F.count_if(F.col("outcome") == "FALSE_POSITIVE").alias("false_positives"),
        F.count_if(recent).alias("recent_events"),
        F.sum(F.when(recent, units)).alias("_units"),
        F.count(F.when(recent, F.col("score"))).alias("_scored"),
        F.max(F.when(recent, micros("ts"))).alias("_latest"),
    )
    days = F.floor((now - F.col("_latest")) / F.lit(86_400_000_000))
    score = (
        F.least(F.col("recent_events") / F.lit(50.0), F.lit(1.0)) * 0.4
        + ratio(F.coalesce("_units", F.lit(0)), F.col("_scored")) / 10_000.0 * 0.3
        + F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(7.0)), F.lit(0.0)) * 0.2
        - F.least(ratio("false_positives", "total_events"), F.lit(1.0)) * 0.1
    )
    return grouped.withColumn("reputation_score", clip(score, 0.0, 1.0)).drop("_units", "_scored", "_latest")


def ip_profiles(timeline: DataFrame, as_of: Column, last: int = 20) -> DataFrame:
    """Reputation plus category and the newest ``last`` events, nested."""
    newest = Window.partitionBy("source_ip").orderBy(F.desc("ts"), F.desc("log_id"))
    recent = (
        timeline.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
        .groupBy("source_ip").agg(F.sort_array(F.collect_list(F.struct("ts", "log_id", "score"))).alias("attack_timeline"))
    )
    return (
        ip_reputation(timeline, as_of)
        .withColumn("risk_category", risk_level("reputation_score", "ensemble"))
        .withColumn("reputation_score", F.round("reputation_score", 4))
        .join(recent, "source_ip")
    )


def attack_pattern(timeline: DataFrame) -> DataFrame:
    """First matching pattern per source; sources with fewer than five events have none.

    Only the twenty newest events of a source are ranked; ports are counted as distinct pairs.
    """
    newest = Window.partitionBy("source_ip").orderBy(F.desc("ts"), F.desc("log_id"))
    ranked = timeline.select("source_ip", "ts", "log_id", "score").withColumn("r", F.row_number().over(newest)).where("r <= 20")
    at = lambda k: F.max(F.when(F.col("r") == k, micros("ts")))
    tail = ranked.groupBy("source_ip").agg(
        *[at(k).alias(f"t{k}") for k in (1, 5, 6, 10, 20)],
        F.max(F.coalesce("score", F.lit(0.0))).alias("top_score"), F.count("*").alias("tail_rows"),
    )
    ports = timeline.where(F.coalesce("dest_port", F.lit(0)) != 0).groupBy("source_ip", "dest_port").agg(F.lit(1).alias("one")).groupBy("source_ip").agg(F.count("*").alias("ports"))
    events = timeline.groupBy("source_ip").agg(F.count("*").alias("events"))
    recent, older = F.col("t1") - F.col("t5"), F.col("t6") - F.col("t10")
    pattern = (
        F.when(F.col("events") < 5, F.lit(None).cast("string"))
        .when((F.coalesce("ports", F.lit(0)) > 10) & (F.col("events") >= 10), "port_scan")
        .when((F.col("tail_rows") >= 20) & (F.col("top_score") < 0.4) & (F.col("t1") - F.col("t20") > 3_600_000_000), "slow_burn")
        .when((F.col("events") >= 10) & (recent > 0) & (older > 0) & (older > recent * 3), "ddos_buildup")
    )
    return events.join(tail, "source_ip").join(ports, "source_ip", "left").select("source_ip", "events", pattern.alias("pattern"))


def sequence_deviation(flows: DataFrame, cfg: Config = DEFAULT, length: int = 20) -> DataFrame:
    """How far each request rate is from the smoothed expectation of the rates before it."""
    rows = flows.select("log_id", "source_ip", "ts", "request_rate").withColumn("_pos", micros("ts"))
    build = lambda w: {"_seq": F.collect_list("request_rate").over(w.rowsBetween(-(length - 1), 0))}
    listed = trailing(rows, ["source_ip"], "_pos", "log_id", length - 1, build, cfg=cfg)
    have = F.size("_seq")
    padded = F.concat(F.array_repeat(F.get("_seq", F.lit(0)), F.lit(length) - have), F.col("_seq"))
    past = F.slice("_full", 1, length - 1)
    smooth = F.aggregate(past, F.get("_full", F.lit(0)), lambda acc, v: F.lit(0.3) * v + F.lit(0.7) * acc)
    mean = F.aggregate(past, F.lit(0.0), lambda acc, v: acc + v) / float(length - 1)
    spread = F.sqrt(F.aggregate(past, F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))) / float(length - 1))
    out = (
        listed.withColumn("_n", have).withColumn("_full", padded).withColumn("_expected", smooth).withColumn("_mean", mean)
        .withColumn("_dev", F.abs(F.get("_full", F.lit(length - 1)) - F.col("_expected")) / F.greatest(spread, F.lit(0.001)))
    )
    enough = F.col("_n") >= 2
    return out.select(
        "log_id", "source_ip", "ts",
        F.when(enough, F.round("_expected", 4)).otherwise(0.0).alias("predicted_rate"),
        F.when(enough, F.round(F.least(F.col("_dev") / 5.0, F.lit(1.0)), 4)).otherwise(0.0).alias("deviation_score"),
        (enough & (F.col("_dev") > 2.5)).alias("is_anomalous"),
    )


#: Sizes of the cells of the score axis.
CELLS = (1024, 256, 64, 16, 4, 1)
#: Cases looked at one by one before a probe's range is searched by cells.
_STEPS = 200


def _in_cells(unit: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """For each range of units the ``k`` latest places ahead of ``before``, newest first, -1 for none.

    A range is a few cells, the largest that fit, each with its places in order.
    """
    best, m = np.full((len(before), k), -1), len(unit)
    low, high = low.copy(), high + 1
    for size, larger in zip(CELLS[::-1], (*CELLS[-2::-1], None)):
        key = np.sort(unit // size * m + np.arange(m))
        for side, at in ((low, 0), (high, -1)):
            while len(own := np.flatnonzero((low < high) & (larger is None or side % (larger // size) != 0))):
                start = (side[own] + at) * m
                last = np.searchsorted(key, start + before[own])[:, None] - np.arange(1, k + 1)
                found = np.where(last >= 0, key[np.maximum(last, 0)] - start[:, None], -1)
                best[own] = -np.sort(-np.concatenate([best[own], np.maximum(found, -1)], axis=1), axis=1)[:, :k]
                side[own] += 1 if at == 0 else -1
        if larger:
            low, high = low // (larger // size), high // (larger // size)
    return best


def _newest_in_reach(k: int, reach: int):
    """Cases of one slot and those carried into it, with the slot's probes, to the probes' newest cases."""

    def run(rows: pa.Table) -> pa.Table:
        cases, probes = rows.filter(pc.invert(rows.column("ask"))), rows.filter(rows.column("ask"))
        cases = cases.sort_by([("at", "ascending"), ("id", "ascending")])
        unit, u = (x.column("unit").to_numpy().astype(np.int64) for x in (cases, probes))
        before = np.searchsorted(cases.column("at").to_numpy(), probes.column("at").to_numpy(), side="left")
        found, n, open_ = np.full((len(u), k), -1), np.zeros(len(u), np.int64), np.flatnonzero(before > 0)
        for back in range(1, _STEPS + 1):
            place = before[open_] - back
            hit = np.abs(unit[place] - u[open_]) <= reach
            own = open_[hit]
            found[own, n[own]] = place[hit]
            n[own] += 1
            open_ = open_[(n[open_] < k) & (place > 0)]
            if not len(open_):
                break
        else:
            found[open_] = _in_cells(unit, before[open_], np.maximum(u[open_] - reach, 0), u[open_] + reach, k)
        of, rank = np.nonzero(found >= 0)
        taken = cases.take(pa.array(found[of, rank]))
        return pa.table([probes.column("id").take(pa.array(of)), pa.array(rank + 1, pa.int32()), *(taken.column(c) for c in ("id", "action", "confidence", "was_false_positive"))],
                        names=["log_id", "rank", "case_id", "action_taken", "confidence", "was_false_positive"])

    return run


def similar_cases(probes: DataFrame, cases: DataFrame, k: int = 5, reach: int = 500, cfg: Config = DEFAULT) -> DataFrame:
    """For each probe (``log_id, created_at, confidence_score``) the ``k`` newest of the cases that are
    earlier than itself, within ±``reach`` 1e-4 score units.

    Rows are cut into slots of time. What a slot needs of those before it are the newest ``k`` cases of each of
    the 10 001 units; a case is carried on until ``k`` newer ones of its unit have come. A slot's probes look
    back case by case, and where that is long, through cells of units. Rows grow with probes and cases.
    """
    unit = F.round(clip(F.col("confidence_score"), 0.0, 1.0) * 10_000).cast("int").alias("unit")
    known = F.col("created_at").isNotNull() & F.col("confidence_score").isNotNull()
    told = F.coalesce(F.col("agent_reasoning").contains("FALSE_POSITIVE"), F.lit(False))
    own = cases.where(known).select(F.lit(False).alias("ask"), micros("created_at").alias("at"), F.col("log_id").alias("id"), unit,
                                    F.col("action_taken").alias("action"), F.col("confidence_score").alias("confidence"), told.alias("was_false_positive"))
    asked = probes.where(known).select(F.lit(True).alias("ask"), micros("created_at").alias("at"), F.col("log_id").alias("id"), unit)
    both = own.unionByName(asked, allowMissingColumns=True)
    slots = max(1, min(cfg.skew.shares, -(-both.count() // cfg.skew.min_rows)))
    slotted = materialise(both.repartitionByRange(slots, "at").withColumn("slot", F.spark_partition_id()), "case-slots")

    newest = Window.partitionBy("slot", "unit").orderBy(F.desc("at"), F.desc("id"))
    kept = slotted.where("not ask").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= k).drop("_r")
    until = F.coalesce(F.lead("slot", k).over(Window.partitionBy("unit").orderBy("at", "id")), F.lit(slots - 1))
    later = kept.withColumn("_until", until).where(F.col("_until") > F.col("slot"))
    carried = later.withColumn("slot", F.explode(F.sequence(F.col("slot") + 1, F.col("_until")))).drop("_until")
    kinds = {f.name: f.dataType.simpleString() for f in slotted.schema}
    found = f"log_id {kinds['id']}, rank int, case_id {kinds['id']}, action_taken {kinds['action']}, confidence {kinds['confidence']}, was_false_positive boolean"
    return slotted.unionByName(carried).groupBy("slot").applyInArrow(_newest_in_reach(k, reach), found)
