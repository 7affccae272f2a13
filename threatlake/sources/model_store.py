"""Models as tables: ``<root>/<name>/v=<n>/``; the highest version whose last table is written is current."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from threatlake.operators.iforest import NODES, IsolationForest
from threatlake.operators.ocsvm import OneClassSVM
from threatlake.session import small_table
from threatlake.sources.versions import committed


def save(spark: SparkSession, model: IsolationForest | OneClassSVM, root: str, name: str, version: int) -> None:
    """Write a version, ``meta`` last: readers see the old model until then, and never none or a mix.

    A version is written once; a higher one replaces it.
    """
    path = f"{root}/{name}/v={version:08d}"
    if isinstance(model, IsolationForest):
        nodes = [tuple(row) for row in model.nodes.astype(object).itertuples(index=False)]
        small_table(spark, nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = (list(model.features), model.subsample, model.offset, model.low, model.high)
        small_table(spark, [meta], "features array<string>, subsample int, offset double, low double, high double").write.mode("overwrite").parquet(f"{path}/meta")
    else:
        small_table(spark, [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(model).values())],
                    "features array<string>, gamma double, dimension int, seed int, weights array<double>, rho double, low double, high double"
                    ).write.mode("overwrite").parquet(f"{path}/meta")


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    found = committed(spark, f"{root}/{name}", "v=", "meta/_SUCCESS")
    return int(found[-1][2:]) if found else None


def load(spark: SparkSession, root: str, name: str, version: int | None = None):
    version = current_version(spark, root, name) if version is None else version
    if version is None:
        return None
    path = f"{root}/{name}/v={version:08d}"
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if "subsample" in meta:
        nodes: pd.DataFrame = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return IsolationForest(tuple(meta["features"]), nodes, meta["subsample"], meta["offset"], meta["low"], meta["high"])
    return OneClassSVM(tuple(meta["features"]), meta["gamma"], meta["dimension"], meta["seed"], tuple(meta["weights"]), meta["rho"], meta["low"], meta["high"])


def require_features(model, features: list[str]) -> None:
    """A model trained on one feature list cannot score another."""
    if list(model.features) != list(features):
        raise ValueError(f"model was trained on {list(model.features)}, not {list(features)}")


@dataclass(frozen=True)
class Release:
    """Models that were trained together, and the features they take."""

    version: int
    features: tuple[str, ...]
    scaler: DataFrame
    forest: IsolationForest
    svm: OneClassSVM


def publish(spark: SparkSession, root: str, scaler: DataFrame, forest: IsolationForest, svm: OneClassSVM) -> int:
    """Write scaler, forest and SVM as one release and return its number.

    The manifest that names their versions is written beside and moved to its place in one step, after
    all of them: readers see the old release until then, and a run that dies leaves no trace of its own
    (its number is taken again). One writer at a time.
    """
    require_features(svm, list(forest.features))
    number = 1 + max([current_release(spark, root) or 0, *(current_version(spark, root, n) or 0 for n in ("isolation_forest", "one_class_svm"))])
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{root}/scaler/v={number:08d}")
    save(spark, forest, root, "isolation_forest", number)
    save(spark, svm, root, "one_class_svm", number)
    content = json.dumps({"scaler": number, "isolation_forest": number, "one_class_svm": number, "features": list(forest.features)})
    path = spark._jvm.org.apache.hadoop.fs.Path
    beside, target = path(f"{root}/manifests/_{number:08d}.json"), path(f"{root}/manifests/{number:08d}.json")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    if not store.rename(beside, target):
        raise OSError(f"could not commit release {number}")
    return number


def current_release(spark: SparkSession, root: str) -> int | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_")), default=None)


def load_release(spark: SparkSession, root: str, version: int | None = None) -> Release | None:
    """The models of a release (the current one, if not given): those that its manifest names, never a mix."""
    version = current_release(spark, root) if version is None else version
    if version is None:
        return None
    named = json.loads(spark.read.text(f"{root}/manifests/{version:08d}.json", wholetext=True).first().value)
    scaler = spark.read.parquet(f"{root}/scaler/v={named['scaler']:08d}")
    forest, svm = (load(spark, root, n, named[n]) for n in ("isolation_forest", "one_class_svm"))
    for model in (forest, svm):
        require_features(model, named["features"])
    return Release(version, tuple(named["features"]), scaler, forest, svm)


__all__ = ["save", "load", "current_version", "require_features", "Release", "publish", "current_release", "load_release"]
