"""The registered queries, part 2: aggregates, decisions, state changes, feedback, models."""

from __future__ import annotations

from dataclasses import replace as with_settings

from pyspark.sql import functions as F

from threatlake.functions import scalars as S
from threatlake.operators import adapt, allowlist, approvals, decisions, killchain, memory, reports, response, validation
from threatlake.operators.features import behaviour6
from threatlake.operators.running import micros
from threatlake.plans import replay
from threatlake.plans.derived import Derived
from threatlake.plans.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
ten_minutes = lambda ts: F.floor(micros(ts) / F.lit(600_000_000)).cast("bigint")


# --- aggregates --------------------------------------------------------------------------
@query
def a1_action_counts(d: Derived):
    return reports.count_by(d.threats_wide, "action_taken")


@query
def a2_risk_counts(d: Derived):
    return reports.count_by(d.scores, "risk_level")


@query
def a3_threat_stats(d: Derived):
    stats = reports.threat_stats(d.threats_wide, d.scores, d.metrics, d.actions, d.as_of())
    return stats.select(F.to_json("risk_level_counts").alias("risk_level_counts"), F.to_json("action_taken_counts").alias("action_taken_counts"),
                        r6("fp_rate_last_24h"), r6("avg_detection_latency_ms"))


@query
def a4_shadow_summary(d: Derived):
    return adapt.shadow_summary(d.shadow, d.as_of())


@query
def a5_shadow_baseline(d: Derived):
    return adapt.shadow_baseline(d.shadow, d.as_of()).withColumn("fp_rate", F.round("fp_rate", 6))


@query
def a6_feedback_summary(d: Derived):
    return adapt.feedback_summary(d.feedback)


@query
def a7_window_metrics(d: Derived):
    return d.metrics.select("window_start", "tp", "fp", "fn", *[r6(c) for c in ("precision", "recall", "f1_score", "false_positive_rate", "avg_latency_ms")])


@query
def a8_daily_impact(d: Derived):
    return validation.daily_impact(d.actions, d.threats, d.feedback, d.cfg).withColumns(
        {"cost_saved_usd": F.round("cost_saved_usd", 6), "analyst_hours_saved": F.round("analyst_hours_saved", 6)})


@query
def a9_weekly_health(d: Derived):
    return adapt.weekly_health(d.metrics, d.as_of(), d.cfg).select("windows", *[r6(c) for c in ("precision", "recall", "f1_score", "high_threshold", "low_threshold")])


@query
def a10_kill_chain_stats(d: Derived):
    return killchain.stage_stats(d.profiles).withColumn("progression_rate", F.round("progression_rate", 6))


@query
def a11_ip_profiles(d: Derived):
    return memory.ip_profiles(d.timeline, d.as_of(d.timeline)).select(
        "source_ip", "first_seen", "last_seen", "total_events", "attack_events", "false_positives", "reputation_score", "risk_category",
        F.size("attack_timeline").alias("nested_rows"), F.get("attack_timeline", F.lit(0))["log_id"].alias("oldest_nested"))


@query
def a12_ip_reputation(d: Derived):
    return memory.ip_reputation(d.timeline, d.as_of(d.timeline)).select("source_ip", "recent_events", r6("reputation_score"))


@query
def a13_ip_share(d: Derived):
    return d.scores.select("log_id", "ip_share")


@query
def a14_batch_summary(d: Derived):
    return reports.batch_summary(d.sim_events, ten_minutes("ts"))


@query
def a14_batch_sources(d: Derived):
    return reports.batch_sources(d.sim_events, ten_minutes("ts"))


@query
def a15_daily_risk(d: Derived):
    return reports.daily_risk(d.threats_wide)


@query
def a16_confusion(d: Derived):
    return reports.confusion(d.sim_events, ten_minutes("ts"))


@query
def a17_classification_report(d: Derived):
    iso, svm = F.col("iso_score") > 0.3, F.col("svm_score") > 0.9
    parts = None
    for name, flag in (("iso", iso), ("svm", svm), ("either", iso | svm)):
        part = reports.classification_report(d.scores.select("is_attack", flag.alias("flag")), "is_attack", "flag").withColumn("detector", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("detector", "class", r6("precision"), r6("recall"), r6("f1"), "support")


@query
def a18_dataset_statistics(d: Derived):
    return reports.dataset_statistics(d.flows.withColumn("label", F.col("is_attack").cast("int")), "label", 8).withColumn("attack_pct", F.round("attack_pct", 6))


@query
def a19_time_to_detect(d: Derived):
    return reports.time_to_detect(d.flows, d.actions)


@query
def a19_detection_report(d: Derived):
    latencies = reports.time_to_detect(d.flows, d.actions)
    strategy = F.concat(F.lit("group_"), F.split_part("source_ip", F.lit("."), F.lit(4)).cast("int") % 4)
    return reports.detection_report(latencies, strategy).select("strategy", "sources", "detected", "evaded", r6("mean_latency_s"), r6("detection_rate"))


@query
def a20_dashboard_attackers(d: Derived):
    return killchain.dashboard_profiles(d.sim_events)


@query
def a21_ip_cards(d: Derived):
    return reports.ip_cards(d.sim_events)


@query
def a22_overview(d: Derived):
    return reports.overview(d.sim_events, d.as_of()).withColumn("fp_reduction_pct", F.round("fp_reduction_pct", 6))


@query
def a23_queue_counts(d: Derived):
    active = d.allowlist.where("is_active").agg(F.count("*")).scalar()
    return approvals.review(d.approvals, d.reviews).agg(F.count_if(F.col("status") == "PENDING").alias("pending")).withColumn("allowlist_active", active)


@query
def a24_minute_series(d: Derived):
    return reports.minute_series(d.scores, d.as_of())


# --- decisions -----------------------------------------------------------------------------
@query
def k1_threat_types(d: Derived):
    with_entropy = behaviour6(d.flows, d.cfg).select("log_id", "port_entropy")
    joined = d.threats_wide.join(with_entropy, "log_id")
    kind = decisions.threat_type("request_rate", "port_entropy", "session_deviation", F.col("prior") >= 3)
    return joined.select("log_id", kind.alias("threat_type"))


@query
def k2_simple_actions(d: Derived):
    return d.threats_wide.select("log_id", "risk_level", "prior", "action_taken")


@query
def k3_attack_stages(d: Derived):
    return killchain.classify_stage(d.flows).select("log_id", "stage", "stage_confidence", F.array_join("signals", ",").alias("signals"))


@query
def k4_next_stage(d: Derived):
    return d.stage_events.select("log_id", "stage", "predicted_next_stage")


@query
def k5_profile_upkeep(d: Derived):
    return killchain.upkeep(d.profiles.withColumn("is_active", F.lit(True)), d.as_of()).select("source_ip", "is_active")


@query
def k6_fp_risk(d: Derived):
    return d.context.select("log_id", r6("fp_risk"), F.array_join("fp_factors", ", ").alias("factors"), "fp_recommendation", r6("adjusted_confidence"))


@query
def k7_score_decision(d: Derived):
    made = decisions.score_decision(d.context, d.cfg)
    return made.select("log_id", r6("final_score"), "action", "guard_applied",
                       F.round(F.element_at("score_breakdown", "kill_chain_multiplier"), 6).alias("multiplier"))


@query
def k8_action_choice(d: Derived):
    return decisions.choose_action(d.context).select(
        "log_id", "action", "runner_up", r6("margin"), r6("decision_confidence"), r6("risk_reduction"), F.size("reasoning_chain").alias("lines"))


@query
def k9_execution_gate(d: Derived):
    wide = allowlist.flag_trusted(d.threats_wide.withColumn("action", F.col("action_taken")), d.allowlist, d.cfg)
    out = None
    for name, cfg in (("shadow", d.cfg), ("approval", with_settings(d.cfg, shadow_mode=False, human_approval=True)), ("open", with_settings(d.cfg, shadow_mode=False))):
        part = decisions.execution_gate(wide, cfg).select("log_id", F.lit(name).alias("setting"), "allowed", "mode", "reason")
        out = part if out is None else out.unionByName(part)
    return out


@query
def k10_explanations(d: Derived):
    made = decisions.score_decision(d.context, d.cfg)
    text = decisions.explanation(decisions.decision_chain(), F.col("action"), F.col("final_score"), F.col("risk_level"), F.col("source_ip"), F.col("prior"), F.lit("slow_burn"))
    return made.select("log_id", text.alias("explanation"))


@query
def k11_replay(d: Derived):
    return replay.would_catch(d.threats_wide.withColumn("agent_reasoning", F.when(F.col("log_id") % 6 == 0, "Kill Chain stage seen")))


@query
def k11_replay_regression(d: Derived):
    return replay.regression(replay.scenarios(d.threats, d.flows, d.cfg), d.flows, d.cfg).select("log_id", "original_action", "replayed_action", "would_detect", "changed")


# --- state changes ----------------------------------------------------------------------------
@query
def c1_reputation_upsert(d: Derived):
    return response.upsert_reputation(d.reputation, d.threats.where("log_id % 2 = 1"))


@query
def c1_reputation_history(d: Derived):
    return response.attack_history(d.threats)


@query
def c2_responses(d: Derived):
    return response.respond(d.threats_wide)


@query
def c3_reviewed_queue(d: Derived):
    return approvals.review(d.approvals, d.reviews).drop("confidence_score")


@query
def c3_approved_actions(d: Derived):
    return approvals.approved_actions(approvals.review(d.approvals, d.reviews))


@query
def c4_expired_queue(d: Derived):
    edge = F.timestamp_micros(F.lit(1704067200000000 + 5_400_000_000))
    return approvals.expire(approvals.review(d.approvals, d.reviews), edge).select("log_id", "status")


@query
def c5_unblocked(d: Derived):
    failed = d.validations.where("not success").select("action_id")
    records = response.rollback(d.actions.where("action_type = 'BLOCK'").join(failed, "action_id", "left_semi"), d.reputation, "AUTO", "no effect", d.as_of())
    return response.unblock(d.reputation, records).select("ip_address", "is_blocked")


@query
def c6_marked_threats(d: Derived):
    threats = d.threats.select("log_id", "source_ip", F.lit("seen").alias("agent_reasoning"))
    return adapt.mark(threats, d.feedback)


@query
def c7_allowlist_merge(d: Derived):
    return d.source_entries


# --- adaptation ---------------------------------------------------------------------------------
@query
def l1_threshold_path(d: Derived):
    return adapt.threshold_path(adapt.feedback_steps(d._feedback(d.threats_wide), d.threats_wide, d.cfg), d.cfg)


@query
def l2_weekly_nudges(d: Derived):
    return d.metrics.select("window_start", F.round(adapt.nudge_high(F.col("precision"), d.cfg), 6).alias("high_threshold"), F.round(adapt.nudge_low(F.col("recall"), d.cfg), 6).alias("low_threshold"))


@query
def m11_retrain_trigger(d: Derived):
    return adapt.retrain_trigger(d.feedback, d.metrics, d.as_of(), d.cfg).withColumn("latest_fpr", F.round("latest_fpr", 6))


@query
def v1_action_validation(d: Derived):
    return d.validations.select("action_id", "target_ip", r6("mean_before"), r6("mean_after"), r6("delta"), "success", "attack_resumed")


@query
def t3_ranked_actions(d: Derived):
    ranked = decisions.choose_action(d.context)
    return ranked.select("log_id", F.lit(1).alias("rank"), "action").unionByName(
        ranked.select("log_id", F.posexplode("alternatives").alias("p", "o")).select("log_id", (F.col("p") + 2).alias("rank"), F.col("o.action").alias("action")))
