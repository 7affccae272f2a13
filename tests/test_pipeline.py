"""The whole loop over tables, and the plans it relies on."""

from dataclasses import replace

from pyspark.sql import functions as F

from threatlake.config import Config
from threatlake.operators import features
from threatlake.operators.running import HotKeys
from threatlake.plans import load_queries, pipeline, registry
from threatlake.plans.derived import Derived


def test_loop(spark, sf_dir, tmp_path):
    cfg = Config(shadow_mode=False, hot=HotKeys())
    d = Derived(spark, sf_dir, cfg)
    tables = pipeline.run(d.flows, d.allowlist, str(tmp_path), cfg)
    counts = {name: t.count() for name, t in tables.items()}
    assert counts["scores"] == d.flows.where("source_ip <> '10.0.0.5'").count()
    assert counts["threats"] == counts["decisions"] == tables["scores"].where("combined > 0.65").count()
    assert counts["validations"] == counts["actions"] == tables["decisions"].where("allowed and action <> 'MONITOR'").count()
    assert counts["events"] == counts["threats"] + counts["validations"]
    assert counts["shadow"] == 0
    again = pipeline.run(d.flows, d.allowlist, str(tmp_path / "shadow"), replace(cfg, shadow_mode=True))
    assert again["shadow"].count() == counts["threats"] and again["actions"].count() == 0
    assert tables["decisions"].where(F.col("explanation").contains("Score Breakdown")).count() == counts["threats"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    d = Derived(spark, sf_dir, Config(hot=HotKeys()))
    text = plan(features.behaviour6(d.flows, d.cfg))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("FileScan") == 1  # one scan, two shuffles
    text = plan(d.flows.where("source_ip = '10.0.0.1'").select("log_id"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text  # column pruning reaches the scan
    for df in (d.context, d.validations, d.metrics):
        assert "CartesianProduct" not in plan(df) and "BatchEvalPython" not in plan(df)


def test_reused_tables_are_read_once(spark, sf_dir):
    """Queries that build on scores and threats several times scan events only to store them."""
    for name in ("a3_threat_stats", "a7_window_metrics", "j11_similar_cases", "l1_threshold_path", "v1_action_validation"):
        assert plan(load_queries()[name](spark, sf_dir)).count("events.parquet") == 0
    assert registry.REUSE <= set(load_queries())
