"""Skew-safe windows against brute force, with keys cut and uncut."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threatlake.config import Config, SkewConfig
from threatlake.operators.running import HotKeys, as_of, lookback, measure, micros, running, salted_lookup, trailing

SETTINGS = {
    "whole": Config(),
    "cut": Config(skew=SkewConfig(shares=50, min_rows=5, cell_us=400_000_000)),
    "cut_cells": Config(skew=SkewConfig(shares=1000, min_rows=2, cell_us=3_600_000_000)),
}
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(8)}"
        rows.append((i, key, T0 + timedelta(seconds=rng.randrange(3000)), rng.randrange(100)))  # many equal times
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return make(request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, ts timestamp, v bigint").withColumn("pos", micros("ts"))


@pytest.mark.parametrize("setting", SETTINGS)
def test_lookback(spark, rows, setting):
    for now in (False, True):
        got = {r.id: r.s for r in lookback(frame(spark, rows), ["key"], "ts", 300, {"s": F.col("v")}, include_now=now, cfg=SETTINGS[setting]).collect()}
        for i, k, t, _ in rows:
            want = sum(v for _, k2, t2, v in rows if k2 == k and t - timedelta(seconds=300) <= t2 and (t2 < t or (now and t2 == t)))
            assert got[i] == want


@pytest.mark.parametrize("setting", SETTINGS)
def test_running_and_backwards(spark, rows, setting):
    cfg = SETTINGS[setting]
    df = frame(spark, rows)
    ahead = {r.id: (r.s, r.m) for r in running(df, ["key"], "pos", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, tie="id", cfg=cfg).collect()}
    back = {r.id: r.m for r in running(df, ["key"], "pos", {"m": ("max", F.col("v"))}, backwards=True, cfg=cfg).collect()}
    for i, k, t, _ in rows:
        before = [v for j, k2, t2, v in rows if k2 == k and (t2, j) < (t, i)]
        after = [v for _, k2, t2, v in rows if k2 == k and t2 > t]
        assert ahead[i] == ((sum(before), max(before)) if before else (None, None))
        assert back[i] == (max(after) if after else None)


@pytest.mark.parametrize("setting", SETTINGS)
def test_trailing(spark, rows, setting):
    build = lambda w: {"last": F.collect_list("id").over(w.rowsBetween(-4, -1))}
    got = {r.id: r["last"] for r in trailing(frame(spark, rows), ["key"], "pos", "id", 4, build, cfg=SETTINGS[setting]).collect()}
    for i, k, t, _ in rows:
        assert got[i] == [j for _, j in sorted((t2, j) for j, k2, t2, _ in rows if k2 == k and (t2, j) < (t, i))][-4:]


@pytest.mark.parametrize("setting", SETTINGS)
def test_as_of(spark, rows, setting):
    facts, probes = rows[:150], rows[150:]
    got = {r.id: r.m.fid if r.m else None for r in as_of(
        frame(spark, probes).drop("pos"), frame(spark, facts).select(F.col("id").alias("fid"), "key", F.col("ts").alias("fts")),
        "key", "ts", "fts", "fid", ["fid"], name="m", cfg=SETTINGS[setting]).collect()}
    for i, k, t, _ in probes:
        known = [(t2, j) for j, k2, t2, _ in facts if k2 == k and t2 <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_measure_is_bounded_and_lookup_is_whole(spark, rows):
    cfg = SETTINGS["cut"]
    df = frame(spark, rows)
    hot = measure(df, "key", micros("ts"), cfg)
    assert "hot" in dict(hot.keys) and len(hot.keys) <= cfg.skew.shares
    small = df.groupBy("key").agg(F.count("*").alias("n"))
    joined = salted_lookup(df, small, "key", "id", cfg)
    assert joined.count() == len(rows)
    counts = {k: sum(1 for r in rows if r[1] == k) for k in {r[1] for r in rows}}
    assert all(r.n == counts[r.key] for r in joined.collect())
    assert not HotKeys()


def test_tasks_grow_with_the_table(spark):
    """Windows and lookups of large tables are dealt to more tasks than the session's number, with the same rows."""
    df = spark.range(4000).selectExpr("concat('k', id % 300) as source_ip", "id as log_id", "id * 1000 as pos")
    small = df.groupBy("source_ip").agg(F.count("*").alias("n"))
    few, many = (Config(skew=SkewConfig(min_rows=200_000, task_rows=t)) for t in (50_000, 100))
    steps = [lambda cfg: running(df, ["source_ip"], "pos", {"s": ("sum", F.col("log_id"))}, tie="log_id", cfg=cfg),
             lambda cfg: trailing(df, ["source_ip"], "pos", "log_id", 1, lambda w: {"was": F.lag("log_id").over(w)}, cfg=cfg),
             lambda cfg: salted_lookup(df, small, "source_ip", "log_id", cfg)]
    for step in steps:
        plan = lambda cfg: step(cfg)._jdf.queryExecution().executedPlan().toString()
        assert ", 40), REPARTITION_BY_NUM" in plan(many) and "REPARTITION_BY_NUM" not in plan(few)
        assert sorted(map(tuple, step(many).collect())) == sorted(map(tuple, step(few).collect()))
