"""Versions of a small table: folders that count once they are written whole, the highest being current."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, path: str, prefix: str, mark: str = "_SUCCESS") -> list[str]:
    """Names of the folders ``prefix...`` below ``path`` that hold ``mark``, in their order."""
    store, target = _path(spark, path)
    if not store.exists(target):
        return []
    names = [f.getPath().getName() for f in store.listStatus(target) if f.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix) and store.exists(_path(spark, f"{path}/{n}/{mark}")[1]))


def remove(spark: SparkSession, path: str) -> None:
    store, target = _path(spark, path)
    store.delete(target, True)
