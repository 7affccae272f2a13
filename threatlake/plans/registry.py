"""Registry of named queries over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.config import DEFAULT, Config, SkewConfig
from threatlake.plans.derived import Derived

BUILDS: dict[str, Callable[[Derived], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types any engine shares: times as microseconds, dates as text."""
    columns = []
    for field in df.schema.fields:
        name, kind = field.name, field.dataType
        if isinstance(kind, T.TimestampType):
            columns.append(F.unix_micros(name).alias(name))
        elif isinstance(kind, T.DateType):
            columns.append(F.col(name).cast("string").alias(name))
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            columns.append(F.col(name).cast("bigint").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


#: Cuts every key of the test tables into slots, as a source with a third of all rows is cut at scale.
CUT = replace(DEFAULT, skew=SkewConfig(shares=200, min_rows=20, cell_us=600_000_000))


#: Queries that build on the same scores, threats or validations several times.
REUSE = {
    "a3_threat_stats", "a7_window_metrics", "a9_weekly_health", "l1_threshold_path", "l2_weekly_nudges", "m11_retrain_trigger", "v1_action_validation", "j5_scores_around_action", "j11_similar_cases",
    "k7_score_decision", "k8_action_choice", "t3_ranked_actions", "c5_unblocked", "g4_stream_quality", "g5_stream_validation", "g6_stream_approvals", "g6_stream_rollback", "g9_thresholds", "g9_metrics",
    "g9_impact"}


def cut_twins(*names: str) -> None:
    """Register ``<name>_cut``: the same query on the plan for hot keys."""
    for name in names:
        QUERIES[f"{name}_cut"] = _runner(BUILDS[name], CUT)


def query(build: Callable[[Derived], DataFrame]):
    """Register ``build`` under its own name."""

    BUILDS[build.__name__] = build
    QUERIES[build.__name__] = _runner(build, DEFAULT)
    return build


def _runner(build: Callable[[Derived], DataFrame], cfg: Config) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(build(Derived(spark, sf_dir, cfg, build.__name__ in REUSE)))

    return run
