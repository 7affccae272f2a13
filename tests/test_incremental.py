"""Incremental runs: the state of several runs is that of one, also after a crash or a repeated run."""

import pytest
from pyspark.sql import functions as F

from threatlake.config import Config
from threatlake.operators import adapt, reports
from threatlake.operators.running import HotKeys, micros
from threatlake.plans import incremental
from threatlake.plans.derived import Derived
from threatlake.sources.versions import committed

TIMES = {"stage_events": "detected_at", "threats": "created_at", "actions": "executed_at", "validations": "executed_at", "feedback": "created_at", "shadow": "timestamp"}
PARTS = 3


@pytest.fixture(scope="module")
def feeds(spark, sf_dir, tmp_path_factory):
    """The input tables, each cut into parts of time."""
    d, path = Derived(spark, sf_dir, Config(hot=HotKeys())), tmp_path_factory.mktemp("feeds")
    low, high = d.flows.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    out = {}
    for name, ts in TIMES.items():
        stored = getattr(d, name).withColumn("_part", F.least(F.floor((micros(ts) - low) * PARTS / (high - low)), F.lit(PARTS - 1)))
        stored.write.parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def state(spark, out):
    version = incremental.current(spark, out)
    return {t: {tuple(r) for r in spark.read.parquet(f"{version}/{t}").collect()} for t in incremental.STEPS}


def test_runs_add_up(spark, feeds, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert not incremental.advance(spark, f"{whole}/in", f"{whole}/out")
    for name, rows in feeds.items():
        incremental.commit(rows.drop("_part"), f"{whole}/in/{name}")
    assert incremental.advance(spark, f"{whole}/in", f"{whole}/out") and not incremental.advance(spark, f"{whole}/in", f"{whole}/out")
    for k in range(PARTS):
        for name, rows in feeds.items():
            incremental.commit(rows.where(F.col("_part") == k).drop("_part"), f"{parts}/in/{name}")
            if k == 1 and name == "feedback":  # a run between commits of one part
                assert incremental.advance(spark, f"{parts}/in", f"{parts}/out")
        assert incremental.advance(spark, f"{parts}/in", f"{parts}/out")
    assert state(spark, f"{parts}/out") == state(spark, f"{whole}/out")
    assert len(committed(spark, f"{parts}/out", "v-", "applied/_SUCCESS")) == 2
    tuned = incremental.tuned(spark, f"{parts}/out", Config())
    assert tuned.thresholds["HIGH"] != 0.65 and tuned.thresholds["LOW"] == 0.30
    path = adapt.threshold_path(adapt.feedback_steps(feeds["feedback"], feeds["threats"]))
    assert tuned.thresholds["HIGH"] == path.where("level = 'HIGH'").orderBy(F.desc("created_at"), F.desc("log_id")).first().new_threshold


def test_a_run_that_dies_is_repeated(spark, feeds, tmp_path, monkeypatch):
    base, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = feeds["threats"].drop("_part")
    incremental.commit(rows.where("log_id % 2 = 0"), f"{base}/threats")
    incremental.advance(spark, base, out, ("reputation", "impact_days"))
    incremental.commit(rows.where("log_id % 2 = 1"), f"{base}/threats")
    before = incremental.current(spark, out)
    with monkeypatch.context() as patch:
        patch.setitem(incremental.STEPS, "impact_days", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.advance(spark, base, out, ("reputation", "impact_days"))
    assert incremental.current(spark, out) == before
    assert incremental.advance(spark, base, out, ("reputation", "impact_days"))
    made = spark.read.parquet(f"{incremental.current(spark, out)}/reputation")
    assert made.agg(F.sum("threat_count")).first()[0] == rows.count()


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 14).cast("int")).alias("day"))
    daily = reports.daily_sketches(rows, "day", "v")
    assert daily.count() == 14
    weeks = reports.sketched_counts(daily, F.date_trunc("week", "day").cast("date"), "week").collect()
    for r in weeks:
        exact = rows.where(F.date_trunc("week", "day").cast("date") == F.lit(r.week)).select("v").distinct().count()
        assert r.days == 7 and abs(r.estimate - exact) <= 3 * reports.SKETCH_ERROR * exact
