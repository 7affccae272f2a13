"""The registered queries, part 1: scans, filters, joins, windows, features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threatlake.functions import scalars as S
from threatlake.operators import allowlist, approvals, cleaning, decisions, features, killchain, memory, reports, response, scoring, validation
from threatlake.operators.running import as_of, micros
from threatlake.plans.derived import Derived
from threatlake.plans.registry import query
from threatlake.sources import ingest, sinks

r6 = lambda c: F.round(c, 6).alias(c)


# --- scans and sinks -----------------------------------------------------------------------
@query
def s3_log_page(d: Derived):
    return reports.newest(d.flows, "ts", "log_id", 50, skip=100).select("log_id", "ts", "source_ip", "dest_port")


@query
def s4_ingest_batch(d: Derived):
    return ingest.batch_counts(d.flows, d.allowlist, d.cfg)


@query
def s5_agent_ingest(d: Derived):
    raw = d.flows.select(
        "log_id", "source_ip", F.when(F.col("log_id") % 3 == 0, F.col("dest_ip")).alias("dest_ip"), "src_port",
        F.when(F.col("log_id") % 4 == 0, F.col("dest_port")).alias("dest_port"), F.when(F.col("log_id") % 5 == 0, F.col("protocol")).alias("protocol"),
        F.when(F.col("log_id") % 2 == 0, F.col("bytes_sent")).alias("bytes_sent"), F.when(F.col("log_id") % 7 == 0, F.col("packets")).alias("packets"),
        F.when(F.col("log_id") % 2 == 1, F.col("duration_seconds")).alias("duration_seconds"),
        F.when(F.col("log_id") % 6 == 0, F.col("request_rate")).alias("request_rate"))
    return ingest.agent_defaults(raw)


@query
def s6_ingest_records(d: Derived):
    late = F.when(F.col("log_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("duration_seconds"))
    named = d.flows.select("log_id", F.col("source_ip").alias(" Source IP"), F.col("dest_port").cast("string").alias("Destination Port "), "protocol",
                           F.when(F.col("log_id") % 9 == 0, F.lit("abc")).otherwise(F.col("bytes_sent").cast("string")).alias("bytes_sent"), late.alias("duration_seconds"))
    cleaned = cleaning.clean(cleaning.strip_headers(named), ["duration_seconds"])
    return ingest.to_records(cleaning.rename_known(cleaned, {"Source IP": "source_ip", "Destination Port": "dest_port"}), "log_id", 1000)


@query
def s8_attack_scenarios(d: Derived):
    found = as_of(d.threats.select("log_id", "source_ip", "created_at", "action_taken", "confidence_score"),
                  d.flows.withColumnRenamed("log_id", "net_log_id"), "source_ip", "created_at", "ts", "net_log_id",
                  ["net_log_id", "request_rate", "dest_port", "src_port", "bytes_sent", "duration_seconds", "packets", "protocol"], cfg=d.cfg, name="network_log")
    return found.select(F.concat(F.lit("sc_"), F.col("log_id").cast("string")).alias("scenario_id"), "log_id", "source_ip", "created_at",
                        F.col("action_taken").alias("original_action"), F.col("confidence_score").alias("original_confidence"), "network_log.*")


@query
def s9_event_envelopes(d: Derived):
    rows = d.actions.select("executed_at", F.col("target_ip").alias("source_ip"), F.col("action_type").alias("action"), F.lit(True).alias("success"), "execution_time_ms")
    return sinks.envelopes(rows, "action_executed", "executed_at")


@query
def s11_live_feed(d: Derived):
    return reports.newest(d.flows, "ts", "log_id", 50).select("log_id", "ts", "source_ip", "protocol", "bytes_sent")


# --- cleaning and filters -------------------------------------------------------------------
@query
def p2_infinite_to_zero(d: Derived):
    raw = d.flows.select("log_id", F.when(F.col("duration_seconds") == 0, F.lit(float("inf"))).otherwise(F.col("packets") / F.nullif("duration_seconds", F.lit(0.0))).alias("rate"))
    return cleaning.fill_zero(raw, ["rate"])


@query
def p2_clean_rows(d: Derived):
    raw = d.flows.select("source_ip", "dest_port", "protocol", F.when(F.col("duration_seconds") == 0, F.lit(float("inf"))).otherwise(F.floor("duration_seconds").cast("double")).alias("dur"))
    return cleaning.clean(raw, ["dur"])


@query
def p3_distinct_rows(d: Derived):
    return d.flows.select("source_ip", "dest_port", "protocol").dropDuplicates()


@query
def p4_tolerant_numbers(d: Derived):
    text = F.when(F.col("log_id") % 7 == 0, "abc").when(F.col("log_id") % 11 == 0, "inf").when(F.col("log_id") % 13 == 0, "").otherwise(F.col("bytes_sent").cast("string"))
    return d.flows.select("log_id", S.number_or(text).alias("value"))


@query
def p6_binary_label(d: Derived):
    label = F.when(F.col("is_attack"), "DDoS").when(F.col("log_id") % 2 == 0, " Benign ").otherwise("BENIGN")
    return d.flows.select("log_id", S.attack_label(label).alias("label"))


@query
def p7_category_codes(d: Derived):
    return cleaning.encode_categories(d.flows.select("log_id", "protocol", "event_type"), ["protocol", "event_type"])


@query
def p7_grown_codes(d: Derived):
    """Targets of the first hour, coded, and what codes those that come later get."""
    targets = d.flows.select("ts", F.concat("source_ip", F.lit(">"), "dest_ip").alias("route"))
    first = cleaning.category_codes(targets.where(F.col("ts") < F.timestamp_micros(F.lit(1704067200000000 + 3_600_000_000))), "route")
    return cleaning.grown_codes(first, targets, "route")


@query
def p8_derived_rate(d: Derived):
    return d.flows.select("log_id", S.derived_rate("packets", "duration_seconds").alias("rate"))


@query
def p9_trusted_flag(d: Derived):
    return allowlist.flag_trusted(d.flows.select("log_id", "source_ip"), d.allowlist, d.cfg)


@query
def p10_threat_search(d: Derived):
    threats = d.threats_wide
    found = reports.search_threats(threats, contains="10.0.0.1", since=F.timestamp_micros(F.lit(1704067200000000)), risk="HIGH", skip=5, limit=25)
    return found.select("log_id", "created_at", "source_ip", "risk_level", "action_taken")


@query
def p11_unscored_logs(d: Derived):
    return reports.unscored(d.flows, d.scores.where("log_id % 3 <> 0")).select("log_id", "source_ip", "ts")


@query
def p12_anomaly_gate(d: Derived):
    return scoring.gate(d.scores, d.cfg).select("log_id", "source_ip", "combined", "risk_level")


@query
def p13_active_attackers(d: Derived):
    return killchain.active_attackers(d.profiles).select("source_ip", "current_stage", "last_activity")


@query
def p13_active_allowlist(d: Derived):
    return allowlist.active_entries(d.source_entries).select("entry_type", "value", "is_active")


@query
def p13_pending_approvals(d: Derived):
    return approvals.pending(approvals.review(d.approvals, d.reviews)).select("log_id", "proposed_action", "expires_at")


@query
def p13_active_threats(d: Derived):
    now = d.as_of()
    return d.sim_events.where((F.col("risk_level") != "LOW") & (F.unix_micros(now) - micros("ts") < 30_000_000)).select("log_id", "source_ip", "risk_level")


@query
def p14_lookup_sources(d: Derived):
    return reports.lookup(d.profiles, "source_ip", ["10.0.0.7", "10.0.0.42"]).select("source_ip", "first_stage_seen", "current_stage", "is_active")


@query
def p15_recent_metrics(d: Derived):
    return reports.recent_range(d.metrics, "window_start", d.as_of(), 1, F.col("window_start")).select("window_start", "tp", "fp", "fn")


@query
def p15_latest_decisions(d: Derived):
    return reports.newest(d.threats_wide, "created_at", "log_id", 20).select("log_id", "created_at", "source_ip", "action_taken")


# --- joins -----------------------------------------------------------------------------------
@query
def j1_log_with_score(d: Derived):
    some = d.scores.where("log_id % 3 <> 0").select("log_id", F.struct("combined", "risk_level").alias("score"))
    return d.flows.join(some, "log_id", "left").select("log_id", "source_ip", F.col("score.combined").alias("combined"), F.col("score.risk_level").alias("risk_level"))


@query
def j2_score_source(d: Derived):
    return d.scores.select("log_id", "combined").join(d.flows.select("log_id", "source_ip", "ts"), "log_id")


@query
def j3_threat_reputation(d: Derived):
    return response.with_reputation(d.threats.select("log_id", "source_ip", "confidence_score"),
                                    d.reputation.withColumn("reputation_score", F.col("reputation_points") / F.lit(100.0)), d.cfg)


@query
def j4_latest_log_as_of(d: Derived):
    found = as_of(d.threats.select("log_id", "source_ip", "created_at"), d.flows.select(F.col("log_id").alias("net_log_id"), "source_ip", "ts"),
                  "source_ip", "created_at", "ts", "net_log_id", ["net_log_id"], cfg=d.cfg)
    return found.select("log_id", "source_ip", F.col("matched.net_log_id").alias("net_log_id"))


@query
def j5_scores_around_action(d: Derived):
    return d.validations.select("action_id", r6("mean_before"), "n_after", r6("mean_after"), r6("max_after"))


@query
def j6_untrusted_logs(d: Derived):
    return allowlist.drop_trusted(d.flows.select("log_id", "source_ip", "ts"), d.allowlist, d.cfg)


@query
def j7_cidr_trusted(d: Derived):
    return allowlist.trusted_sources(d.flows, d.allowlist, d.cfg)


@query
def j8_feedback_threats(d: Derived):
    from threatlake.operators import adapt

    return adapt.feedback_steps(d.feedback, d.threats).withColumn("step", F.round(F.col("step") * 10_000 / adapt.UNIT).cast("bigint"))


@query
def j9_threats_after_review(d: Derived):
    queue = approvals.expire(approvals.review(d.approvals, d.reviews), d.as_of())
    return approvals.apply_to_threats(d.threats.select("log_id", "source_ip", "action_taken"), queue)


@query
def j10_rollback_records(d: Derived):
    blocks = d.actions.where("action_type = 'BLOCK'")
    return response.rollback(blocks, d.reputation, "HUMAN", "analyst request", d.as_of())


@query
def j11_similar_cases(d: Derived):
    cases = d.threats_wide.withColumn("agent_reasoning", F.when(F.col("log_id") % 4 == 0, "FALSE_POSITIVE by analyst"))
    return memory.similar_cases(d.threats_wide.select("log_id", "created_at", "confidence_score"), cases, cfg=d.cfg).drop("confidence")


@query
def j12_stage_context(d: Derived):
    staged = killchain.classify_stage(d.flows).select("log_id", "source_ip", "stage")
    return killchain.current_context(staged, d.profiles, d.cfg)


# --- windows -----------------------------------------------------------------------------------
@query
def w1_port_entropy(d: Derived):
    return features.behaviour6(d.flows, d.cfg).select("log_id", F.round("port_entropy", 4).alias("port_entropy"))


@query
def w2_session_deviation(d: Derived):
    return features.behaviour6(d.flows, d.cfg).select("log_id", r6("session_z"))


@query
def w3_ip_frequency(d: Derived):
    return features.history(d.flows, d.cfg).select("log_id", "hist_rows", F.round(features.ip_frequency(), 6).alias("ip_frequency"))


@query
def w4_prior_threats(d: Derived):
    return d.threats_wide.select("log_id", "source_ip", "prior", (F.col("prior") >= 3).alias("repeat_offender"))


@query
def w5_past_severity(d: Derived):
    return decisions.recent_severity(d.threats_wide, d.cfg).select("log_id", "past_severity")


@query
def w6_correlated(d: Derived):
    return decisions.correlation(d.scores.select("log_id", "source_ip", "ts"), d.cfg).select("log_id", "recent_events", "correlated")


@query
def w7_cooldown(d: Derived):
    return decisions.cooldown(d.threats_wide, d.cfg).select("log_id", "in_cooldown")


@query
def w8_stage_progression(d: Derived):
    return killchain.progression(d.stage_events, d.cfg).select("log_id", "source_ip", "stage", "is_progressing")


@query
def w9_attacker_profiles(d: Derived):
    return d.profiles.select("source_ip", "first_stage_seen", "current_stage", "last_activity", "stage_events", "is_active")


@query
def w9_stage_history(d: Derived):
    return killchain.stage_history(d.stage_events)


@query
def w10_attack_pattern(d: Derived):
    return memory.attack_pattern(d.timeline)


@query
def w11_sequence_deviation(d: Derived):
    return memory.sequence_deviation(d.flows, d.cfg).drop("ts", "source_ip")


@query
def w12_reputation_path(d: Derived):
    return response.reputation_path(d.actions, d.cfg).select("action_id", "target_ip", "reputation")


@query
def w13_first_block(d: Derived):
    return response.first_blocks(d.actions)


@query
def w14_auto_rollback(d: Derived):
    return response.auto_rollback(d.actions, d.scores, d.as_of(), d.cfg).select("action_id", "check", "due_at", r6("recent_mean"), "outcome")


@query
def w14_first_cool_checks(d: Derived):
    """Blocks of thirty days, ended by a lower mark than usual: most have several checks."""
    blocks = d.scores_raw.where("combined > 0.5e0").select(
        F.col("log_id").alias("action_id"), F.lit("BLOCK").alias("action_type"), F.col("source_ip").alias("target_ip"), (F.col("ts") + F.expr("interval 3 seconds")).alias("executed_at"))
    found = response.first_cool_checks(blocks, d.scores_raw, d.as_of(d.flows_raw), replace(d.cfg, rollback_below=0.5))
    return found.select("action_id", "target_ip", "checks", "ended", F.when(F.col("ended").isNull(), "EXTEND").otherwise("ROLLBACK").alias("outcome"))


@query
def w15_last_per_source(d: Derived):
    return reports.last_per_key(d.flows, "source_ip", "ts", "log_id", 10).select("source_ip", "log_id", "rank")


@query
def w16_latest_scores(d: Derived):
    return reports.newest(d.scores, "ts", "log_id", 1000).select("log_id", "combined")


# --- sort, top-k, set operations ---------------------------------------------------------------
@query
def t1_threat_page(d: Derived):
    return reports.newest(d.threats, "created_at", "log_id", 30, skip=30).select("log_id", "created_at")


@query
def t2_top_shadow_sources(d: Derived):
    return reports.count_by(d.shadow, "source_ip").orderBy(F.desc("n"), "source_ip").limit(10)


@query
def u1_stacked_datasets(d: Derived):
    cols = ["log_id", "source_ip", "packets", "label"]
    first = d.flows.where("event_type <> 'view'").withColumn("label", F.lit(1)).select(*cols)
    second = d.flows.where("event_type = 'view'").withColumn("label", F.lit(0)).select(*reversed(cols))
    return first.unionByName(second).groupBy("label", "source_ip").agg(F.count("*").alias("n"), F.sum("packets").alias("packets"))


@query
def u1_registered_folder(d: Derived):
    """A folder of CSV files with three header lines in one table."""
    return d.registered.groupBy("label", "dst_port").agg(
        F.count("*").alias("n"), F.sum("packets").alias("packets"), F.round(F.sum("duration"), 3).alias("duration"), F.sum("src_bytes").alias("src_bytes"), F.sum("protocol").alias("protocols"))


@query
def u2_merged_feed(d: Derived):
    return reports.newest(reports.merge_feeds(d.sim_events, d.threats), "created_at", "log_id", 500).drop("confidence_score")


@query
def u3_balanced_sample(d: Derived):
    return cleaning.balanced_sample(d.flows.withColumn("label", F.col("is_attack").cast("int")), "label", "log_id", 1000).select("log_id", "label")


@query
def u4_unblocked_sources(d: Derived):
    blocked = d.actions.where("action_type = 'BLOCK'").select(F.col("target_ip").alias("source_ip")).distinct()
    return d.flows.select("source_ip").distinct().join(blocked, "source_ip", "left_anti")


# --- features ------------------------------------------------------------------------------------
@query
def m1_behaviour6(d: Derived):
    return features.behaviour6(d.flows, d.cfg).select(
        "log_id", r6("packet_rate"), F.round("port_entropy", 4).alias("port_entropy"), r6("session_z"), r6("ip_frequency"), "protocol_anomaly", r6("time_of_day"))


@query
def m2_detect7(d: Derived):
    return features.detect7(d.flows, d.cfg).select("log_id", *features.DETECT7)


@query
def m3_standard_scaling(d: Derived):
    names = ["bytes_sent", "packets", "duration_seconds"]
    scaler = features.fit_scaler(d.flows.where("log_id % 5 <> 0"), names)
    return features.apply_scaler(d.flows, scaler, names).select("log_id", *[r6(n) for n in names])


@query
def m7_normalised_scores(d: Derived):
    raw = d.scores.withColumn("raw", F.col("duration_seconds") / 10.0 - F.col("packets") / 100.0)
    return scoring.minmax_batch(raw, "raw", "minmax").select("log_id", r6("minmax"), F.round(scoring.offset_score("raw"), 6).alias("offset_score"))


@query
def m8_ensemble(d: Derived):
    return scoring.ensemble(d.scores).select("log_id", "combined_score", r6("agreement"), r6("confidence"), "is_anomaly", "risk_level")


@query
def m9_fallback_scores(d: Derived):
    return scoring.score_records(d.scores)


@query
def m10_rule_score(d: Derived):
    return scoring.rule_score(d.flows).select("log_id", "tick_rows", r6("anomaly_score"), "risk_level", "action")


@query
def m14_oversampled(d: Derived):
    from threatlake.operators import adapt

    return adapt.oversample(d.feedback, ~F.col("was_false_positive")).select("log_id", "was_false_positive", "copy")


# --- scalar functions ------------------------------------------------------------------------------
@query
def f_ip_numbers(d: Derived):
    return d.flows.select("log_id", S.ipv4_number("source_ip").alias("number"), S.ipv4_network(S.ipv4_number("source_ip"), F.lit(24)).alias("network"))


@query
def f_risk_ladders(d: Derived):
    return d.scores.select("log_id", *[S.risk_level("combined", n).alias(n) for n in S.LADDERS])


@query
def f_text_verdict(d: Derived):
    text = F.concat(F.lit("status "), F.element_at(F.array(*map(F.lit, ["SAFE", "ESCALATE now", "NEUTRALIZE it", "quiet"])), (F.col("log_id") % 4 + 1).cast("int")))
    return d.flows.select("log_id", S.verdict_from_text(text).alias("verdict"), S.pattern_title(F.concat(F.lit("slow_"), F.col("event_type"))).alias("title"))


@query
def f_time_parts(d: Derived):
    as_text = F.when(F.col("log_id") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return d.flows_raw.select("log_id", F.round(S.time_of_day(as_text), 6).alias("tod"), S.off_hours("ts").alias("off_hours"),
                              S.seconds_left("ts", F.timestamp_micros(F.lit(1705276800000000))).alias("seconds_left"))


@query
def f_json_payload(d: Derived):
    payload = F.to_json(F.struct((F.col("packets") / 100.0).alias("port_entropy"), "sqli_pattern", "failed_logins", "repeated_beaconing"))
    parsed = killchain.parse_payload(d.flows.select("log_id", payload.alias("raw_payload")))
    return parsed.select("log_id", r6("port_entropy"), "sqli_pattern", "failed_logins", "repeated_beaconing")
