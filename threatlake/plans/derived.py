"""Security tables derived from ``events``: the inputs of the registered queries."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import risk_level
from threatlake.operators import allowlist, decisions, features, killchain, response, scoring, validation
from threatlake.operators.running import measure, micros
from threatlake.session import materialise, shared_dir, small_table
from threatlake.sources import events_adapter, flow_csv

# Attack names of the event kinds.
ATTACK_TYPE = "case event_type when 'view' then 'normal' when 'click' then 'brute_force' when 'signup' then 'zero_day' when 'purchase' then 'ddos' else 'port_scan' end"


class Derived:
    """Lazily built tables; each property is a plan, nothing runs until it is used.

    With ``reuse``, for queries that build on them several times, scores, threats and validations are
    written once to the shared folder when they are first used.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, reuse: bool = False):
        self.spark, self.dir, self._cfg, self._reuse = spark, sf_dir, cfg, reuse

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        return materialise(df, label) if self._reuse else df

    @cached_property
    def cfg(self) -> Config:
        """Settings with the hot sources measured once on the flows; all later tables are subsets of
        these rows, so a source that is not hot here is not hot there."""
        if self._cfg.hot is not None:
            return self._cfg
        return replace(self._cfg, hot=measure(self.flows.select("source_ip", "ts"), "source_ip", micros("ts"), self._cfg))

    @cached_property
    def flows(self) -> DataFrame:
        return events_adapter.flows(self.spark, self.dir)

    @cached_property
    def flows_raw(self) -> DataFrame:
        return events_adapter.flows(self.spark, self.dir, compress=False)

    @cached_property
    def registered(self) -> DataFrame:
        """All flows written as CSV files of three header lines in two layouts, and read back as one."""
        path = f"{shared_dir(self.spark)}/csv-{uuid.uuid4().hex}"
        number = F.expr("case protocol when 'TCP' then 6 when 'UDP' then 17 when 'ICMP' then 1 else 47 end")
        a = {"Source IP": F.col("source_ip"), "Destination Port": F.col("dest_port"), "Source Port": F.col("src_port"), "Protocol": number, "Flow Duration": F.col("duration_seconds"),
             "Total Fwd Packets": F.col("packets"), "Total Backward Packets": F.lit(0), "Label": F.when(F.col("event_type") == "view", "BENIGN").otherwise("Attack")}
        b = {"srcip": F.col("source_ip"), "sport": F.col("src_port"), "dsport": F.col("dest_port"), "proto": F.lower("protocol"), "dur": F.col("duration_seconds"), "sbytes": F.col("bytes_sent"),
             "dbytes": F.lit(0), "spkts": F.col("packets"), "label": F.col("is_attack").cast("int")}
        for kinds, columns in (("'view', 'click'", a), ("'error'", dict(reversed(a.items()))), ("'signup', 'purchase'", b)):
            self.flows.where(f"event_type in ({kinds})").select(*(e.alias(f" {n}") for n, e in columns.items())).write.option("header", True).mode("append").csv(path)
        return materialise(flow_csv.register(self.spark, path), "registered")

    @cached_property
    def _newest(self) -> int | None:
        return self.flows.agg(F.max(micros("ts"))).first()[0]

    def as_of(self, df: DataFrame | None = None, ts: str = "ts") -> Column:
        if df is None and self._reuse:
            return F.timestamp_micros(F.lit(self._newest).cast("bigint"))
        return (self.flows if df is None else df).agg(F.max(ts)).scalar()

    @staticmethod
    def _score(flows: DataFrame, cfg: Config) -> DataFrame:
        return scoring.fallback_scores(features.detect7(flows, cfg))

    @cached_property
    def scores(self) -> DataFrame:
        return self._kept(self._score(self.flows, self.cfg), "scores")

    @cached_property
    def scores_raw(self) -> DataFrame:
        return self._score(self.flows_raw, self.cfg)

    def _threats(self, edge: float) -> DataFrame:
        over = self.scores.where(F.col("combined") > edge).select(
            "log_id", "source_ip", "ts", "combined", "risk_level", "session_deviation", "request_rate", "dest_port", "protocol", "bytes_sent",
            "duration_seconds", "user_agent", "sqli_pattern", "failed_logins", "repeated_beaconing", "is_attack", "event_type")
        counted = decisions.prior_threats(over, self.cfg)
        return self._kept(counted.withColumns({
            "created_at": F.col("ts") + F.expr("interval 1 second"),
            "confidence_score": F.col("combined"),
            "threat_type": F.expr(ATTACK_TYPE),
            "action_taken": decisions.simple_action("combined", "risk_level", F.col("prior") >= 3),
        }), "threats")

    @cached_property
    def threats(self) -> DataFrame:
        return self._threats(0.65)

    @cached_property
    def threats_wide(self) -> DataFrame:
        return self._threats(0.40)

    @cached_property
    def actions(self) -> DataFrame:
        return self.threats.select(
            F.col("log_id").alias("action_id"), "log_id", F.col("action_taken").alias("action_type"), F.col("source_ip").alias("target_ip"),
            (F.col("created_at") + F.expr("interval 2 seconds")).alias("executed_at"),
            (F.col("log_id") % 90 + 10).alias("execution_time_ms"))

    @cached_property
    def feedback(self) -> DataFrame:
        return self._feedback(self.threats)

    @staticmethod
    def _feedback(threats: DataFrame) -> DataFrame:
        return threats.select(
            "log_id", (F.col("log_id") % 2 == 0).alias("was_false_positive"), F.lit("analyst_1").alias("reporter"),
            (F.col("created_at") + F.expr("interval 600 seconds")).alias("created_at"))

    @cached_property
    def shadow(self) -> DataFrame:
        action = F.when(F.col("risk_level") == "CRITICAL", "BLOCK").when(F.col("risk_level") == "HIGH", "RATE_LIMIT").otherwise("ALERT")
        return self.scores.where("combined > 0.4e0").select(
            "log_id", "source_ip", F.col("ts").alias("timestamp"), F.col("combined").alias("anomaly_score"), "risk_level",
            action.alias("would_have_taken_action"),
            F.when(F.col("log_id") % 5 == 0, F.col("log_id") % 10 == 0).alias("was_approved_by_human"))

    @cached_property
    def approvals(self) -> DataFrame:
        return self.threats.where(F.col("action_taken").isin("BLOCK", "RATE_LIMIT")).select(
            "log_id", "source_ip", F.col("action_taken").alias("proposed_action"), "confidence_score", F.lit("PENDING").alias("status"),
            (F.col("created_at") + F.expr("interval 300 seconds")).alias("expires_at"))

    @cached_property
    def reviews(self) -> DataFrame:
        at = F.timestamp_micros(F.unix_micros("created_at") + F.col("log_id") % 9 * 60_000_000)
        return self.threats.where("action_taken in ('BLOCK', 'RATE_LIMIT')").select(
            "log_id", at.alias("reviewed_at"), (F.col("log_id") % 8 == 0).alias("approved"), F.lit("analyst_1").alias("reviewer"))

    @cached_property
    def allowlist(self) -> DataFrame:
        rows = [("IP", "10.0.0.5", True), ("CIDR", "10.0.0.16/28", True), ("CIDR", "10.0.0.200/30", False),
                ("CIDR", "10.0.1.0/24", True), ("IP", "not-an-ip", True)]
        return small_table(self.spark, rows, "entry_type string, value string, is_active boolean")

    @cached_property
    def source_entries(self) -> DataFrame:
        """Every source as an entry, switched on or off by its threats."""
        entry = F.lit("IP").alias("entry_type"), F.col("source_ip").alias("value")
        current = self.flows.select(*entry).distinct().withColumns({"is_active": F.lit(True), "version": F.lit(0).cast("bigint")})
        changes = self.threats.select(*entry, (F.col("log_id") % 2 == 0).alias("is_active"), (F.col("log_id") + 1).alias("version"))
        return allowlist.merge_entries(current, changes)

    @cached_property
    def stage_events(self) -> DataFrame:
        return killchain.stage_events(self.flows)

    @cached_property
    def profiles(self) -> DataFrame:
        return killchain.attacker_profiles(self.stage_events, self.as_of())

    @cached_property
    def validations(self) -> DataFrame:
        return self._kept(validation.validate_actions(self.actions, self.scores, self.cfg), "validations")

    @cached_property
    def metrics(self) -> DataFrame:
        return validation.window_metrics(self.validations, self.feedback, self.shadow, self.actions, cfg=self.cfg)

    @cached_property
    def sim_events(self) -> DataFrame:
        level = risk_level("combined", "rule")
        action = F.when(F.col("risk_level") == "CRITICAL", "BLOCK_IP").when(F.col("risk_level") == "HIGH", "RATE_LIMIT").when(
            F.col("risk_level") == "MEDIUM", "ALERT").otherwise("MONITOR")
        return self.scores.select(
            "log_id", "source_ip", "ts", F.col("combined").alias("anomaly_score"), F.expr(ATTACK_TYPE).alias("attack_type"), "is_attack",
            level.alias("risk_level")).withColumn("action", action)

    @cached_property
    def timeline(self) -> DataFrame:
        return self.scores_raw.select(
            "log_id", "source_ip", "ts", "dest_port", F.round("combined", 4).alias("score"),
            F.when(F.col("event_type") == "error", "ATTACK").otherwise("NORMAL").alias("kind"),
            F.when(F.col("log_id") % 50 == 0, "FALSE_POSITIVE").alias("outcome"))

    @cached_property
    def reputation(self) -> DataFrame:
        """Snapshot before the second half of the stream."""
        return response.upsert_reputation(self._empty_reputation(), self.threats.where("log_id % 2 = 0"))

    def _empty_reputation(self) -> DataFrame:
        return small_table(self.spark, [], "ip_address string, threat_count bigint, last_seen timestamp, is_blocked boolean, reputation_points bigint")

    @cached_property
    def context(self) -> DataFrame:
        """Threats (wide gate) with everything the decision operators need."""
        wide = self.threats_wide
        staged = killchain.classify_stage(wide).drop("signals", "stage_confidence")
        near = decisions.correlation(self.scores.select("log_id", "source_ip", "ts"), self.cfg).select("log_id", "correlated")
        cooled = decisions.cooldown(staged, self.cfg)
        severe = decisions.recent_severity(cooled, self.cfg)
        progress = killchain.progression(self.stage_events, self.cfg).select("log_id", "is_progressing")
        joined = severe.join(near, "log_id").join(progress, "log_id", "left").withColumn("is_progressing", F.coalesce("is_progressing", F.lit(False)))
        return decisions.fp_risk(joined)
