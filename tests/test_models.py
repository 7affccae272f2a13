"""Detectors: planted outliers are found, results do not depend on partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.operators import features, iforest, ocsvm
from threatlake.plans import training
from threatlake.sources import model_store

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    normal, odd = rng.normal(0, 1, (1900, 3)), rng.uniform(-8, 8, (100, 3))
    rows = [(i, *map(float, v), int(i >= 1900)) for i, v in enumerate(np.vstack([normal, odd]))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, label int").cache()


def auc(rows):
    rows = sorted(rows)
    pos = [i for i, (_, y) in enumerate(rows) if y == 1]
    n1, n0 = len(pos), len(rows) - len(pos)
    return 1 - (sum(pos) - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_forest(planted):
    model = iforest.fit(planted, NAMES, "id", trees=100)
    got = planted.select("id", iforest.raw_score(model).alias("s"), "label").collect()
    assert auc([(r.s, r.label) for r in got]) > 0.9
    assert 0.03 < sum(r.s < 0 for r in got) / len(got) < 0.07
    again = iforest.fit(planted.repartition(7), NAMES, "id", trees=100)
    assert {r.id: r.s for r in planted.select("id", iforest.raw_score(again).alias("s")).collect()} == {r.id: r.s for r in got}


def test_one_class_svm(planted):
    model = ocsvm.fit(planted.where("label = 0"), NAMES, "id")
    got = planted.select(ocsvm.raw_score(model).alias("s"), "label").collect()
    assert auc([(r.s, r.label) for r in got]) > 0.9
    share = sum(r.s < 0 for r in got if r.label == 0) / 1900
    assert 0.02 < share < 0.09


def test_training_report(planted, tmp_path):
    made = training.train(planted, NAMES, "id", trees=50, steps=6)
    report = {(r.detector, r["class"]): r for r in made.report.collect()}
    assert len(report) == 12 and report[("either", "attack")].recall > 0.6
    assert training.save(made, str(tmp_path)) == 1
    model, outcome = training.retrain(planted.withColumn("ts", F.timestamp_seconds("id")), NAMES, "id", "ts", "label", current=made.forest, rows=1000)
    assert outcome.first().status in ("deployed", "rejected")
    assert training.retrain(planted.limit(50).withColumn("ts", F.timestamp_seconds("id")), NAMES, "id", "ts", "label")[1].first().status == "insufficient_data"


def test_scaler(planted):
    scaled = features.apply_scaler(planted, features.fit_scaler(planted, NAMES), NAMES)
    row = scaled.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert abs(row.m) < 1e-9 and abs(row.s - 1) < 1e-9


def test_releases_never_mix(spark, planted, tmp_path, monkeypatch):
    """A run that dies between two models leaves the old release; numbers are taken again; other features are refused."""
    root = str(tmp_path)
    assert model_store.load_release(spark, root) is None
    one, two = (training.train(planted, NAMES, "id", seed=s, trees=10, steps=3) for s in (1, 2))
    assert training.save(one, root) == 1
    first = training.score_release(planted, model_store.load_release(spark, root)).orderBy("id").select("combined_score").collect()
    with monkeypatch.context() as patch:
        save, calls = model_store.save, []

        def dies(spark, model, root, name, version):
            calls.append(name)
            if len(calls) == 2:
                raise OSError("lost")
            save(spark, model, root, name, version)

        patch.setattr(model_store, "save", dies)
        with pytest.raises(OSError):
            training.save(two, root)
    held = model_store.load_release(spark, root)
    assert held.version == 1 and held.forest.offset == one.forest.offset
    assert training.score_release(planted, held).orderBy("id").select("combined_score").collect() == first
    assert training.save(two, root) == 3  # the dead run's forest holds number 2
    now = model_store.load_release(spark, root)
    assert (now.forest.offset, now.svm.rho) == (two.forest.offset, two.svm.rho)
    assert model_store.load_release(spark, root, 1).svm.rho == one.svm.rho
    with pytest.raises(ValueError, match="features"):
        training.score_release(planted.drop("c"), now)
