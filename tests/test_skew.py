"""Half of all rows from one source: cut and uncut plans agree on the whole pipeline."""

from functools import cached_property

import pytest
from pyspark.sql import functions as F

from threatlake.config import Config, SkewConfig
from threatlake.operators import decisions, features, memory, response
from threatlake.operators.running import HotKeys
from threatlake.plans.derived import Derived
from threatlake.sources import events_adapter


class Skewed(Derived):
    @cached_property
    def flows(self):
        base = events_adapter.flows(self.spark, self.dir)
        return base.withColumn("source_ip", F.when(F.col("log_id") % 2 == 0, "10.9.9.9").otherwise(F.col("source_ip")))


CUT = Config(skew=SkewConfig(shares=40, min_rows=20, cell_us=600_000_000))
PARTS = {
    "history": lambda d: features.behaviour6(d.flows, d.cfg).select("log_id", "port_entropy", "session_z", "ip_frequency"),
    "share": lambda d: d.scores.select("log_id", "ip_share"),
    "prior": lambda d: d.threats_wide.select("log_id", "prior", "action_taken"),
    "context": lambda d: d.context.select("log_id", "fp_risk", "past_severity", "is_progressing"),
    "choice": lambda d: decisions.choose_action(d.context).select("log_id", "action", "decision_confidence"),
    "validation": lambda d: d.validations.select("action_id", F.round("mean_before", 9).alias("b"), F.round("mean_after", 9).alias("a"), "n_after", "max_after", "success"),
    "rollback": lambda d: response.auto_rollback(d.actions, d.scores, d.as_of(), d.cfg).select("action_id", F.round("recent_mean", 9).alias("m"), "outcome"),
    "reputation": lambda d: response.reputation_path(d.actions, d.cfg).select("action_id", "reputation"),
    "sequence": lambda d: memory.sequence_deviation(d.flows, d.cfg).select("log_id", "predicted_rate", "deviation_score"),
}


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    whole = Skewed(spark, sf_dir, Config(hot=HotKeys()))
    cut = Skewed(spark, sf_dir, CUT)
    assert dict(cut.cfg.hot.keys)["10.9.9.9"] > 1 and cut.cfg.hot.cells
    return whole, cut


@pytest.mark.parametrize("part", PARTS)
def test_cut_equals_whole(both, part):
    whole, cut = ({tuple(r) for r in PARTS[part](d).collect()} for d in both)
    assert whole == cut and whole
