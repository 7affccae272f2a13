"""Oracle SQL of the aggregates, decisions, state changes and feedback."""

from oracles.base import IDX_SQL, MULT_SQL, NEXT_SQL, SEV_SQL, STAGE_SQL  # noqa: F401

_ACTIONS = [("MONITOR", 1, "true", "0e0"), ("ALERT", 2, "true", "0.1e0"), ("RATE_LIMIT", 3, "true", "0.4e0"), ("BLOCK", 4, "false", "0.8e0"), ("PORT_CLOSE", 5, "false", "0.9e0")]
_SPACE = "(values " + ", ".join(f"('{n}', {s}, {r}, {c})" for n, s, r, c in _ACTIONS) + ") a(action, sev, rev, cost)"
MADE = f"""select *, f >= 0.8e0 as is_block, case when f >= 0.8e0 then 'BLOCK' when f >= 0.65e0 then 'RATE_LIMIT' when f >= 0.5e0 then 'ALERT' else 'MONITOR' end as raw_action
from (select *, {MULT_SQL.format('stage')} as mult, least(greatest(confidence_score*{MULT_SQL.format('stage')}*(1e0 - fp_risk), 0e0), 1e0) as f from context)"""
FINAL = """select *, raw_action in ('BLOCK','RATE_LIMIT') and f <= 0.9e0 and prior < 2 as guard from made"""
RANKED = f"""select *, row_number() over (partition by log_id order by u desc, sev) as rank from (select log_id, action, sev, c, u5 as u from (
select *, case when sev >= 4 and past_severity < 3 and risk_level <> 'CRITICAL' then u4 - cost else u4 end as u5 from (
select *, case when rev and c < 0.7e0 then u3 + 0.3e0 else u3 end as u4 from (
select *, case when sev >= 4 and c < 0.5e0 then u2*0.5e0 else u2 end as u3 from (
select *, case when sev >= 3 and hour(created_at) between 2 and 6 then u1*1.2e0 else u1 end as u2 from (
select *, case when sev >= 3 and prior > 0 then u0*(1e0 + 0.15e0*prior) else u0 end as u1 from (
select x.*, a.*, case when confidence_score >= 0.8e0 and sev >= 4 then 1e0 when confidence_score < 0.4e0 and sev <= 2 then 1e0
  else greatest(0e0, 1e0 - abs(sev/5e0 - base)*2e0) end as u0
from (select *, confidence_score*(1e0 - fp_risk) as c, confidence_score*{MULT_SQL.format('stage')} + case when is_progressing then 0.15e0 else 0e0 end as base from context) x, {_SPACE}
)))))))"""
CHOSEN = """select a.log_id, a.action, b.action as runner_up, a.u - b.u as margin, a.sev, a.c, least(1e0, a.c*(1e0 + (a.u - b.u)*0.1e0)) as conf
from ranked a join ranked b on a.log_id = b.log_id and a.rank = 1 and b.rank = 2"""
EXTRA = {"made": MADE, "decided_rows": FINAL, "ranked": RANKED, "chosen": CHOSEN}
_STEPS = """steps as (select f.log_id, f.created_at, case when t.action_taken in ('BLOCK','RATE_LIMIT') then 'HIGH' else 'MEDIUM' end as level, case when f.log_id % 2 = 0 then 20 else -10 end as step"""
EXTRA["wide_steps"] = """select log_id, created_at + interval 600 second as created_at, case when action_taken in ('BLOCK','RATE_LIMIT') then 'HIGH' else 'MEDIUM' end as level,
  case when log_id % 2 = 0 then 20 else -10 end as step from threats_wide"""
EXTRA["numbered_steps"] = "select *, row_number() over (partition by level order by created_at, log_id) as n from wide_steps"
EXTRA["walk_rows"] = """select level, cast(0 as bigint) as n, cast(null as bigint) as log_id, cast(null as timestamp) as created_at, 0 as before, case level when 'HIGH' then 6500 else 5000 end as value from (select distinct level from wide_steps)
union all select s.level, s.n, s.log_id, s.created_at, w.value, least(greatest(w.value + s.step, case s.level when 'HIGH' then 5500 else 0 end), case s.level when 'HIGH' then 9000 else 10000 end)
from walk_rows w join numbered_steps s on s.level = w.level and s.n = w.n + 1"""
_DAY = "cast(cast({0} as date) as varchar)"
_REP = "greatest(100 - cast(sum(case action_taken when 'BLOCK' then 50 when 'RATE_LIMIT' then 25 when 'PORT_CLOSE' then 40 else 0 end) as bigint), 0)"
REPORT = """select '{0}' as detector, cast(is_attack as int) as y, cast({1} as int) as p from scores"""


def _class(name, hit, wrong, missed):
    return f"""select detector, '{name}' as class, case when {hit}+{wrong} = 0 then 0e0 else {hit}/cast({hit}+{wrong} as double) end as precision,
  case when {hit}+{missed} = 0 then 0e0 else {hit}/cast({hit}+{missed} as double) end as recall, {hit}+{missed} as support from cells"""


EXTRA["cells"] = """select detector, count(*) filter (where y=0 and p=0) as c00, count(*) filter (where y=0 and p=1) as c01, count(*) filter (where y=1 and p=0) as c10, count(*) filter (where y=1 and p=1) as c11
from (""" + " union all ".join(REPORT.format(n, e) for n, e in (("iso", "iso_score > 0.3e0"), ("svm", "svm_score > 0.9e0"), ("either", "iso_score > 0.3e0 or svm_score > 0.9e0"))) + ") group by 1"
EXTRA["class_rows"] = "select *, case when precision + recall > 0 then 2e0*precision*recall/(precision+recall) else 0e0 end as f1 from (" + _class("normal", "c00", "c10", "c01") + " union all " + _class("attack", "c11", "c01", "c10") + ")"

SQL = {
    "a1_action_counts": "select action_taken, count(*) as n from threats_wide group by 1",
    "a2_risk_counts": "select risk_level, count(*) as n from scores group by 1",
    "a3_threat_stats": """select (select '{' || string_agg('"' || risk_level || '":' || n, ',' order by risk_level) || '}' from (select risk_level, count(*) n from scores group by 1)) as risk_level_counts,
  (select '{' || string_agg('"' || action_taken || '":' || n, ',' order by action_taken) || '}' from (select action_taken, count(*) n from threats_wide group by 1)) as action_taken_counts,
  coalesce((select round(arg_max(false_positive_rate, window_start), 6) from metrics where window_start >= (select max(ts) from flows) - interval 1 day), 0e0) as fp_rate_last_24h,
  (select round(sum(execution_time_ms)/cast(count(*) as double), 6) from actions) as avg_detection_latency_ms""",
    "a4_shadow_summary": """select source_ip, count(*) as n, (select count(*) from shadow where would_have_taken_action in ('BLOCK','RATE_LIMIT') and "timestamp" >= (select t - interval 7 day from now)) as would_block,
  (select count(*) from shadow where would_have_taken_action = 'ALERT' and "timestamp" >= (select t - interval 7 day from now)) as would_alert from shadow where "timestamp" >= (select t - interval 7 day from now) group by 1 order by n desc, source_ip limit 10""",
    "a5_shadow_baseline": """select total, would_block, would_alert, reviewed, rejected, round(r, 6) as fp_rate,
  case when r > 0.15e0 then concat('Extend shadow period — estimated FP rate ', printf('%.1f', r*100), '%') else 'Ready to enable ALERT actions' end as recommendation, r <= 0.15e0 as ready_to_enable
from (select *, case when reviewed > 0 then rejected/cast(reviewed as double) when total > 0 then 0.05e0 else 0e0 end as r from (select count(*) as total,
  count(*) filter (where would_have_taken_action in ('BLOCK','RATE_LIMIT')) as would_block, count(*) filter (where would_have_taken_action = 'ALERT') as would_alert,
  count(was_approved_by_human) as reviewed, count(*) filter (where not was_approved_by_human) as rejected from shadow where "timestamp" >= (select t - interval 7 day from now)))""",
    "a6_feedback_summary": "select count(*) filter (where was_false_positive) as false_positives, count(*) filter (where not was_false_positive) as true_positives, count(*) as total from feedback",
    "a7_window_metrics": """select epoch_us(window_start) as window_start, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
  round(false_positive_rate, 6) as false_positive_rate, round(avg_latency_ms, 6) as avg_latency_ms from metrics""",
    "a8_daily_impact": f"""select d as day, coalesce(b, 0) as ips_blocked, coalesce(b, 0)*500 as requests_blocked, coalesce(w, 0) as false_blocks, round(coalesce(b, 0)*500*0.001e0, 6) as cost_saved_usd, round(coalesce(t, 0)*0.083e0, 6) as analyst_hours_saved
from (select {_DAY.format('created_at')} as d, count(*) as t from threats group by 1) full join (select {_DAY.format('executed_at')} as d, count(distinct target_ip) as b from actions where action_type = 'BLOCK' group by 1) using (d)
  full join (select {_DAY.format('f.created_at')} as d, count(*) as w from feedback f join threats t using (log_id) where was_false_positive and t.action_taken = 'BLOCK' group by 1) using (d)""",
    "a9_weekly_health": """select n as windows, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2e0*p*r/(p+r) else 0e0 end, 6) as f1_score,
  round(case when p < 0.8e0 then least(0.9e0, 0.65e0 + 0.05e0) else 0.65e0 end, 6) as high_threshold, round(case when r < 0.7e0 then greatest(0.15e0, 0.3e0 - 0.05e0) else 0.3e0 end, 6) as low_threshold
from (select count(*) as n, avg(precision) as p, avg(recall) as r from metrics where window_start >= (select t - interval 7 day from now))""",
    "a10_kill_chain_stats": """select s.stage, count(p.source_ip) as attackers, (select count(*) from profiles where is_active) as total_active,
  coalesce((select round(avg(cast(stage_events > 1 as double)), 6) from profiles where is_active), 0e0) as progression_rate
  from (values ('RECONNAISSANCE'),('ENUMERATION'),('EXPLOITATION'),('PERSISTENCE')) s(stage) left join profiles p on p.current_stage = s.stage and p.is_active group by 1""",
    "a11_ip_profiles": """select source_ip, epoch_us(first_seen) as first_seen, epoch_us(last_seen) as last_seen, total_events, attack_events, false_positives, round(rep, 4) as reputation_score,
  case when rep > 0.8e0 then 'CRITICAL' when rep > 0.6e0 then 'HIGH' when rep > 0.3e0 then 'MEDIUM' else 'LOW' end as risk_category, cast(least(total_events, 20) as bigint) as nested_rows,
  (select log_id from (select t.log_id, t.ts from timeline t where t.source_ip = p.source_ip order by t.ts desc, t.log_id desc limit 20) z order by z.ts, z.log_id limit 1) as oldest_nested from ip_rep p""",
    "a12_ip_reputation": "select source_ip, recent_events, round(rep, 6) as reputation_score from ip_rep",
    "a13_ip_share": "select log_id, ip_share from scores",
    "a14_batch_summary": """select epoch_us(ts)//600000000 as batch, count(*) as total, count(*) filter (where attack_type <> 'normal') as anomalous, count(*) filter (where attack_type = 'normal') as normal,
  coalesce(string_agg(distinct attack_type, ', ' order by attack_type) filter (where attack_type <> 'normal'), 'none') as attack_types, coalesce(string_agg(distinct action, ', ' order by action) filter (where attack_type <> 'normal'), 'none') as actions,
  count(distinct source_ip) filter (where attack_type <> 'normal') as sources, max(anomaly_score) as max_score, count(*) filter (where attack_type <> 'normal' and risk_level = 'CRITICAL') as criticals from sim_events group by 1""",
    "a14_batch_sources": "select distinct epoch_us(ts)//600000000 as batch, source_ip from sim_events where attack_type <> 'normal'",
    "a15_daily_risk": f"""select {_DAY.format('created_at')} as day, count(*) as threats, count(*) filter (where confidence_score > 0.8e0) as high_confidence, count(*) filter (where action_taken = 'MONITOR') as monitor,
  count(*) filter (where action_taken = 'ALERT') as alert, count(*) filter (where action_taken = 'RATE_LIMIT') as rate_limit, count(*) filter (where action_taken = 'BLOCK') as block, count(*) filter (where action_taken = 'PORT_CLOSE') as port_close from threats_wide group by 1""",
    "a16_confusion": """select *, cast(sum(tp) over w as bigint) as cum_tp, cast(sum(fp) over w as bigint) as cum_fp, cast(sum(fn) over w as bigint) as cum_fn from (select epoch_us(ts)//600000000 as batch, count(*) filter (where is_attack and risk_level <> 'LOW') as tp,
  count(*) filter (where not is_attack and risk_level <> 'LOW') as fp, count(*) filter (where is_attack and risk_level = 'LOW') as fn from sim_events group by 1) window w as (order by batch)""",
    "a17_classification_report": """select detector, class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from class_rows
  union all select detector, 'macro', round(sum(precision)/2e0, 6), round(sum(recall)/2e0, 6), round(sum(f1)/2e0, 6), cast(sum(support) as bigint) from class_rows group by 1
  union all select detector, 'weighted', round(sum(precision*support)/sum(support), 6), round(sum(recall*support)/sum(support), 6), round(sum(f1*support)/sum(support), 6), cast(sum(support) as bigint) from class_rows group by 1""",
    "a18_dataset_statistics": "select count(*) as total, count(*) filter (where not is_attack) as normal, count(*) filter (where is_attack) as attack, round(count(*) filter (where is_attack)/cast(count(*) as double)*100e0, 6) as attack_pct, cast(8 as bigint) as features from flows",
    "a19_time_to_detect": """select source_ip, epoch_us(first_activity) as first_activity, epoch_us(first_action) as first_action, epoch_us(first_action) - epoch_us(first_activity) as latency_us from detect_times""",
    "a19_detection_report": """select strategy, sources, detected, evaded, round(case when detected = 0 then 0e0 else us/cast(detected as double)/1e6 end, 6) as mean_latency_s, round(detected/cast(sources as double), 6) as detection_rate
from (select concat('group_', cast(cast(split_part(source_ip, '.', 4) as int) % 4 as varchar)) as strategy, count(*) as sources, count(first_action) as detected, count(*) - count(first_action) as evaded, cast(coalesce(sum(epoch_us(first_action) - epoch_us(first_activity)), 0) as bigint) as us from detect_times group by 1)""",
    "a20_dashboard_attackers": """select source_ip, arg_max(stage, (ts, log_id)) as current_stage, epoch_us(min(ts)) as first_stage_seen, epoch_us(max(ts)) as last_activity, count(*) as history_rows, max(anomaly_score) as max_confidence
from (select *, case when attack_type in ('ransomware','zero_day') then 'PERSISTENCE' when risk_level = 'CRITICAL' then 'EXPLOITATION' when risk_level = 'HIGH' then 'ENUMERATION' else 'RECONNAISSANCE' end as stage from sim_events where attack_type <> 'normal') group by 1""",
    "a21_ip_cards": """select *, case when reputation_score > 0.8e0 then 'CRITICAL' when reputation_score > 0.5e0 then 'HIGH' else 'MEDIUM' end as risk_category from (select source_ip, arg_max(anomaly_score, (ts, log_id)) filter (where attack_type <> 'normal') as reputation_score,
  arg_max(attack_type, (ts, log_id)) filter (where attack_type <> 'normal') as attack_pattern, count(*) as total_events, count(*) filter (where attack_type <> 'normal') as attack_events from sim_events group by 1) where attack_events > 0""",
    "a22_overview": """select count(*) as total_events, count(*) filter (where risk_level = 'CRITICAL') as criticals, count(*) filter (where risk_level = 'HIGH') as highs, count(distinct source_ip) filter (where action = 'BLOCK_IP') as blocked,
  count(*) filter (where risk_level <> 'LOW' and ts > (select t - interval 30 second from now)) as active_threats, count(distinct source_ip) filter (where action = 'BLOCK_IP')*45.5e0 as cost_saved, 96e0 as fp_reduction_pct from sim_events""",
    "a23_queue_counts": "select count(*) filter (where status = 'PENDING') as pending, (select count(*) from allowlist where is_active) as allowlist_active from queue",
    "a24_minute_series": """select m*60000000 as minute, coalesce(max(combined), 0e0) as max_score, count(combined) as n from (select unnest(range((select epoch_us(t)//60000000 - 59 from now), (select epoch_us(t)//60000000 + 1 from now))) as m) left join scores on epoch_us(ts)//60000000 = m group by m""",
    "k1_threat_types": """select t.log_id, case when request_rate > 500 then 'DDoS / Volumetric Flood' when coalesce(e.port_entropy, 0e0) > 0.9e0 then 'Port Scan / Reconnaissance' when session_deviation > 0.8e0 then 'Session Hijack / Anomalous Burst'
  when prior >= 3 then 'Persistent Threat / Repeat Offender' else 'Unknown Anomaly' end as threat_type from threats_wide t left join entropy_rows e using (log_id)""",
    "k2_simple_actions": "select log_id, risk_level, prior, action_taken from threats_wide",
    "k3_attack_stages": """select log_id, stage, case stage when 'PERSISTENCE' then 0.9e0 when 'EXPLOITATION' then 0.85e0 when 'ENUMERATION' then 0.75e0 when 'RECONNAISSANCE' then 0.65e0 else 0e0 end as stage_confidence,
  case stage when 'PERSISTENCE' then concat_ws(',', case when duration_seconds > 3600 and bytes_sent < 1000 then 'long_session_low_rate' end, case when repeated_beaconing then 'repeated_beaconing' end)
  when 'EXPLOITATION' then concat_ws(',', case when sqli_pattern is not null then 'sqli_pattern' end, case when failed_logins > 10 then 'brute_force_login' end)
  when 'ENUMERATION' then concat_ws(',', case when request_rate > 50 then 'endpoint_probing' end, case when lower(user_agent) like '%nmap%' then 'scanner_agent' end)
  when 'RECONNAISSANCE' then concat_ws(',', case when request_rate > 100 then 'high_connection_rate_to_many_ports' end, case when protocol = 'ICMP' then 'ping_sweep' end) else '' end as signals from stage_flows""",
    "k4_next_stage": "select log_id, stage, predicted_next_stage from stage_events",
    "k5_profile_upkeep": "select source_ip, is_active from profiles",
    "k6_fp_risk": """select log_id, round(fp_risk, 6) as fp_risk, factors, case when fp_risk > 0.5e0 then 'High FP risk. Downgrade response to MONITOR or ALERT.' when fp_risk > 0.2e0 then 'Moderate FP risk. Consider ALERT.' else 'Low FP risk. Proceed with autonomous response.' end as fp_recommendation,
  round(confidence_score*(1e0 - fp_risk), 6) as adjusted_confidence from context""",
    "k7_score_decision": """select log_id, round(f, 6) as final_score, case when not guard then raw_action when raw_action = 'BLOCK' then 'RATE_LIMIT' else 'ALERT' end as action, guard as guard_applied, mult as multiplier from decided_rows""",
    "k8_action_choice": """select c.log_id, c.action, runner_up, round(margin, 6) as margin, round(round(conf, 4), 6) as decision_confidence, round(round(sev/5e0*conf, 4), 6) as risk_reduction,
  cast(2 + cast(length(factors) > 0 as int) + cast(stage is not null as int) + cast(is_progressing as int) + 1 + cast(hour(created_at) between 2 and 6 as int) + cast(c.c < 0.5e0 as int) + cast(c.c < 0.7e0 as int) + 1
    + (select count(*) from ranked r where r.log_id = c.log_id and r.sev >= 4 and x.past_severity < 3 and x.risk_level <> 'CRITICAL' and r.u + case r.sev when 4 then 0.8e0 else 0.9e0 end > 1.5e0) as bigint) as lines from chosen c join context x using (log_id)""",
    "k9_execution_gate": """select log_id, setting, not trusted_ip and setting = 'open' and confidence_score >= 0.8e0 or (not trusted_ip and setting = 'approval' and action_taken not in ('BLOCK','RATE_LIMIT') and confidence_score >= 0.8e0) as allowed,
  case when trusted_ip then 'AUTONOMOUS' when setting = 'shadow' then 'SHADOW' when setting = 'approval' and action_taken in ('BLOCK','RATE_LIMIT') then 'HUMAN_APPROVAL' else 'AUTONOMOUS' end as mode,
  case when trusted_ip then 'IP in allowlist' when setting = 'shadow' then 'Shadow mode enabled' when setting = 'approval' and action_taken in ('BLOCK','RATE_LIMIT') then 'Queued for human approval'
    when confidence_score >= 0.8e0 then 'High confidence autonomous action' when confidence_score >= 0.5e0 then 'Medium confidence downgraded to ALERT' else 'Low confidence downgraded to MONITOR' end as reason
  from (select *, source_ip in (select source_ip from trusted) as trusted_ip from threats_wide), (values ('shadow'),('approval'),('open')) s(setting)""",
    "k10_explanations": """select log_id, concat('Detected ', risk_level, ' risk anomaly (score: ', printf('%.2f', f), '). Matches known pattern: Slow Burn. ', case when prior > 0 then concat('IP ', source_ip, ' has a history of ', prior, ' prior threat events. ') else 'First time offense for this IP. ' end,
  'Key factors: Kill Chain Multiplier: ', cast(mult as varchar), 'x; Escalation Guard Applied: ', case when guard then '1.0' else '0.0' end,
  case when lower(factors) like '%time%' then concat('; FP Risk Factors: ', factors) else '' end, '. Automated response executed: ',
  case when not guard then raw_action when raw_action = 'BLOCK' then 'RATE_LIMIT' else 'ALERT' end, '.') as explanation from decided_rows""",
    "k11_replay": "select log_id, log_id % 6 = 0 or confidence_score > 0.7e0 as would_catch, action_taken as simulated_action from threats_wide",
    "c1_reputation_upsert": f"""select source_ip as ip_address, count(*) as threat_count, epoch_us(max(created_at)) as last_seen, max(cast(action_taken = 'BLOCK' as int)) = 1 as is_blocked,
  {_REP} as reputation_points from threats group by 1""",
    "c1_reputation_history": """select source_ip as ip_address, log_id, epoch_us(created_at) as "timestamp", confidence_score as score, action_taken as action,
  case event_type when 'view' then 'normal' when 'click' then 'brute_force' when 'signup' then 'zero_day' when 'purchase' then 'ddos' else 'port_scan' end as threat_type from threats""",
    "c2_responses": """select log_id as action_id, log_id as threat_id, action_taken as action_type, source_ip as target_ip, true as success, epoch_us(created_at + interval 2 second) as executed_at,
  case action_taken when 'BLOCK' then -0.5e0 when 'RATE_LIMIT' then -0.25e0 when 'PORT_CLOSE' then -0.4e0 else 0e0 end as reputation_delta, action_taken = 'BLOCK' as blocks_source,
  case when action_taken = 'BLOCK' then 'Automated block — high-confidence threat' end as block_reason from threats_wide where action_taken <> 'MONITOR'""",
    "c3_reviewed_queue": "select log_id, source_ip, proposed_action, epoch_us(expires_at) as expires_at, status, reviewed_by, epoch_us(reviewed_at) as reviewed_at from queue",
    "c3_approved_actions": "select log_id as action_id, proposed_action as action_type, source_ip as target_ip, epoch_us(reviewed_at) as executed_at from queue where status = 'APPROVED'",
    "c4_expired_queue": "select log_id, case when status = 'PENDING' and expires_at <= timestamp '2024-01-01 01:30:00' then 'EXPIRED' else status end as status from queue",
    "c5_unblocked": "select ip_address, is_blocked and ip_address not in (select target_ip from validations where action_type = 'BLOCK' and not success) as is_blocked from reputation",
    "c6_marked_threats": """select t.log_id, t.source_ip, case when f.log_id is null then 'seen' else concat('seen', chr(10), chr(10), '[ANALYST FEEDBACK] ', case when was_false_positive then 'FALSE_POSITIVE' else 'TRUE_POSITIVE' end, ' by analyst_1') end as agent_reasoning,
  f.log_id is not null as resolved, epoch_us(f.created_at) as resolved_at from threats t left join feedback f using (log_id)""",
    "c7_allowlist_merge": """select 'IP' as entry_type, source_ip as value, arg_max(is_active, version) as is_active, max(version) as version from (select distinct source_ip, true as is_active, cast(0 as bigint) as version from flows
  union all select source_ip, log_id % 2 = 0, log_id + 1 from threats) group by 2""",
    "l1_threshold_path": "select log_id, epoch_us(created_at) as created_at, level, before/10000e0 as old_threshold, value/10000e0 as new_threshold from walk_rows where n > 0",
    "l2_weekly_nudges": """select epoch_us(window_start) as window_start, case when precision < 0.8e0 then 0.7e0 else 0.65e0 end as high_threshold, case when recall < 0.7e0 then 0.25e0 else 0.3e0 end as low_threshold from metrics""",
    "m11_retrain_trigger": """select n as feedback_rows, round(fpr, 6) as latest_fpr, n >= 500 or fpr > 0.15e0 as retrain from (select (select count(*) from feedback) as n,
  coalesce((select arg_max(false_positive_rate, window_start) from metrics where window_start >= (select t - interval 1 day from now)), 0e0) as fpr)""",
    "v1_action_validation": "select action_id, target_ip, round(mean_before, 6) as mean_before, round(mean_after, 6) as mean_after, round(delta, 6) as delta, success, attack_resumed from validations",
    "t3_ranked_actions": "select log_id, rank, action from ranked",
}
EXTRA["ip_rep"] = """select *, least(greatest(least(recent_events/50e0, 1e0)*0.4e0 + case when scored = 0 then 0e0 else cast(units as double)/cast(scored as double)/10000e0 end*0.3e0
  + coalesce(greatest(0e0, 1e0 - ((nowus - latest)//86400000000)/7e0), 0e0)*0.2e0 - least(false_positives/cast(total_events as double), 1e0)*0.1e0, 0e0), 1e0) as rep
from (select source_ip, min(ts) as first_seen, max(ts) as last_seen, count(*) as total_events, count(*) filter (where kind = 'ATTACK' or score > 0.3e0) as attack_events, count(*) filter (where outcome = 'FALSE_POSITIVE') as false_positives,
  count(*) filter (where nowus - epoch_us(ts) <= 604800000000) as recent_events, coalesce(sum(cast(round(score*10000) as bigint)) filter (where nowus - epoch_us(ts) <= 604800000000), 0) as units,
  count(score) filter (where nowus - epoch_us(ts) <= 604800000000) as scored, max(epoch_us(ts)) filter (where nowus - epoch_us(ts) <= 604800000000) as latest, any_value(nowus) as nowus
  from (select *, epoch_us((select max(ts) from flows_raw)) as nowus from timeline) group by 1)"""
EXTRA["detect_times"] = """select source_ip, first_activity, first_action from (select source_ip, min(ts) as first_activity from flows group by 1)
  left join (select target_ip as source_ip, min(executed_at) as first_action from actions where action_type in ('BLOCK','RATE_LIMIT') group by 1) using (source_ip)"""
_ACT = "count(*) as flows, count(*) filter (where risk_level <> 'LOW') as flagged, max(combined) as max_score"
SQL.update({
    "g2_stream_scores": "select s.log_id, s.source_ip, s.combined, s.risk_level, f.stage from scores s join stage_flows f using (log_id)",
    "g4_stream_windows": f"select epoch_us(time_bucket(interval 15 minute, ts)) as window_start, {_ACT} from scores group by 1",
    "g7_activity_spans": """select source_ip, epoch_us(min(ts)) as first_activity, epoch_us(max(ts) + interval 2 hour) as inactive_from, count(*) as events from (
  select *, sum(cast(fresh as int)) over (partition by source_ip order by ts, log_id) as span from (select *, coalesce(ts - lag(ts) over (partition by source_ip order by ts, log_id) >= interval 2 hour, true) as fresh from flows_raw)) group by source_ip, span""",
    "g8_stream_first_blocks": "select source_ip as target_ip, arg_min(log_id, (ts, log_id)) as action_id, epoch_us(min(ts)) as first_blocked_at from scores where risk_level = 'CRITICAL' group by 1",
    "g10_sliding_activity": f"select epoch_us(time_bucket(interval 1 minute, ts)) - k*60000000 as window_start, {_ACT} from scores, (values (0),(1),(2),(3),(4)) o(k) group by 1",
    "k11_replay_regression": """select log_id, original_action, case when hit then action end as replayed_action, hit as would_detect, not coalesce(original_action = case when hit then action end, false) as changed from (
  select *, score > 0.3e0 as hit, row_number() over (partition by log_id order by u desc, sev) as rank from (select *, case when rev and c < 0.7e0 then u2 + 0.3e0 when sev >= 4 and past_level <> 'CRITICAL' then u2 - cost else u2 end as u from (
  select *, case when sev >= 4 and c < 0.5e0 then u1*0.5e0 else u1 end as u2 from (select *, case when sev >= 3 then u0*(1e0 + 0.15e0) else u0 end as u1 from (
  select x.*, a.*, case when score >= 0.8e0 and sev >= 4 then 1e0 when score < 0.4e0 and sev <= 2 then 1e0 else greatest(0e0, 1e0 - abs(sev/5e0 - score)*2e0) end as u0
  from (select *, (1e0 - abs(iso - svm))*score as c, case when score > 0.8e0 then 'CRITICAL' when score > 0.6e0 then 'HIGH' when score > 0.3e0 then 'MEDIUM' else 'LOW' end as past_level from (select *, 0.6e0*iso + 0.4e0*svm as score from (
    select t.log_id, t.action_taken as original_action, f.session_deviation*0.8e0 + 0e0*0.2e0 as iso, f.request_rate/greatest(f.request_rate + 1e0, 1e0) as svm from threats t
    join lateral (select * from scores g where g.source_ip = t.source_ip and g.ts <= t.created_at order by g.ts desc, g.log_id desc limit 1) f on true))) x, """ + _SPACE + """))))) where rank = 1""",
})
EXTRA["rollback_checks"] = """select *, executed_at + k * interval 30 minute as due_at from (select a.action_id, a.target_ip, a.executed_at,
  unnest(generate_series(1, greatest(1, (epoch_us((select max(ts) from flows)) - epoch_us(executed_at)) // 1800000000))) as k from actions a where action_type = 'BLOCK')"""
# What a stream with a watermark of ten minutes has decided once its input is used up, in whole milliseconds.
EXTRA["stream_end"] = "select epoch_ms(max(ts)) - 600000 as ms from scores"
EXTRA["gated"] = f"""select *, row_number() over (partition by source_ip order by ts, log_id) as n from (
  select s.source_ip, s.log_id, s.ts, epoch_us(s.ts) as us, s.combined, {MULT_SQL.format('f.stage')} as mult,
    coalesce(epoch_us(lag(s.ts, 2) over (partition by s.source_ip order by s.ts, s.log_id)) >= epoch_us(s.ts) - 300000000, false) as near
  from scores s join stage_flows f using (log_id)) where combined > 0.65e0"""
_RISK = "least(case when cooling then 0.3e0 else 0e0 end + case when not near then 0.4e0 else 0e0 end + case when threats = 0 then 0.2e0 else 0e0 end, 0.9e0)"
_FIRST = "case when final >= 0.8e0 then 'BLOCK' when final >= 0.65e0 then 'RATE_LIMIT' when final >= 0.5e0 then 'ALERT' else 'MONITOR' end"
_NEXT = f"""select *, case when final <= 0.9e0 and threats < 2 then case first when 'BLOCK' then 'RATE_LIMIT' when 'RATE_LIMIT' then 'ALERT' else first end else first end as action
  from (select *, {_FIRST} as first from (select *, least(greatest(combined*mult*(1e0 - risk), 0e0), 1e0) as final from (select *, {_RISK} as risk
  from (select g.*, m.threats, m.points, m.alert, coalesce(m.alert >= g.us - 600000000 and m.alert < g.us, false) as cooling from memory m join gated g on g.source_ip = m.source_ip and g.n = m.n + 1))))"""
EXTRA["memory"] = f"""select distinct source_ip, cast(0 as bigint) as n, cast(0 as bigint) as threats, cast(100 as bigint) as points, cast(null as bigint) as alert,
  cast(null as bigint) as log_id, cast(null as timestamp) as ts, cast(null as double) as combined, cast(null as boolean) as cooling, cast(null as boolean) as near, cast(null as double) as risk,
  cast(null as double) as final, cast(null as varchar) as action from gated
union all select source_ip, n, threats + 1, greatest(points - case action when 'BLOCK' then 50 when 'RATE_LIMIT' then 25 else 0 end, 0), case when action <> 'MONITOR' then us else alert end,
  log_id, ts, combined, cooling, near, risk, final, action from ({_NEXT})"""
SQL["g3_stream_decisions"] = """select log_id, source_ip, epoch_us(ts) as ts, combined, threats - 1 as prior, cooling as in_cooldown, near as correlated, risk as fp_risk, final as final_score, action,
  points/100e0 as reputation from memory where n > 0 and epoch_us(ts) // 1000 + 1 < (select ms from stream_end)"""
EXTRA["long_checks"] = """select *, executed_at + k * interval 30 minute as due_at from (select *, unnest(generate_series(1, checks)) as k from (
  select log_id as action_id, source_ip as target_ip, ts + interval 3 second as executed_at, greatest(1, (epoch_us((select max(ts) from flows_raw)) - epoch_us(ts + interval 3 second)) // 1800000000) as checks
  from scores_raw where combined > 0.5e0))"""
EXTRA["raw_means"] = "select source_ip, ts, log_id, avg(combined) over (partition by source_ip order by ts, log_id rows between 4 preceding and current row) as m from scores_raw"
SQL["w14_first_cool_checks"] = """select action_id, any_value(target_ip) as target_ip, any_value(checks) as checks, min(case when coalesce(m, 0e0) < 0.5e0 then k end) as ended,
  case when min(case when coalesce(m, 0e0) < 0.5e0 then k end) is null then 'EXTEND' else 'ROLLBACK' end as outcome
  from long_checks c asof left join (select source_ip, ts, arg_max(m, log_id) as m from raw_means group by 1, 2) r on r.source_ip = c.target_ip and r.ts <= c.due_at group by 1"""
_SCORES_END = "(select epoch_ms(max(ts)) from scores)"
SQL["g5_stream_validation"] = f"""select action_id, n_after, round(mean_after, 6) as mean_after, round(max_after, 6) as max_after from around
  where (epoch_us(executed_at) // 60000000 + 2) * 60000 < least({_SCORES_END}, (select epoch_ms(max(executed_at)) from actions)) - 600000"""
SQL["g6_stream_approvals"] = """select q.log_id, case when q.status = 'PENDING' then 'EXPIRED' else q.status end as status, epoch_us(case when q.status = 'PENDING' then q.expires_at else q.reviewed_at end) as decided_at
  from queue q where epoch_ms(q.expires_at) + 1 < least((select epoch_ms(max(created_at)) from threats t join approvals a using (log_id)), (select epoch_ms(max(reviewed_at)) from reviews)) - 600000"""
SQL["g6_stream_rollback"] = f"""select action_id, target_ip, epoch_us(due_at) as checked_at, round(m, 6) as recent_mean, case when m >= 0.65e0 then 'EXTEND' else 'ROLLBACK' end as outcome
  from (select *, min(case when m < 0.65e0 then k end) over (partition by action_id) as ended from (
    select c.*, coalesce((select avg(combined) from (select combined from scores s where s.source_ip = c.target_ip and s.ts <= c.due_at order by s.ts desc, s.log_id desc limit 5)), 0e0) as m from rollback_checks c))
  where (ended is null or k <= ended) and epoch_ms(due_at) + 1 < least({_SCORES_END}, (select epoch_ms(max(executed_at)) from actions)) - 600000"""
SQL["g4_stream_quality"] = SQL["a7_window_metrics"]
EXTRA["arrived"] = "select *, (epoch_us(ts) + cast(round(duration_seconds*1000000) as bigint)) // 1200000000 as period from scores"
SQL["g11_late_rows"] = """select log_id, source_ip, epoch_us(ts) as ts from arrived join (select period, max(max(epoch_ms(ts))) over (order by period rows between unbounded preceding and 1 preceding) - 5000 as mark
  from arrived group by 1) using (period) where epoch_ms(ts) < mark"""
SQL["g11_reconciled_windows"] = SQL["g4_stream_windows"]
SQL["g9_profiles"] = "select source_ip, first_stage_seen, current_stage, epoch_us(last_activity) as last_activity, stage_events, is_active from profiles"
SQL["g9_reputation"] = f"""select source_ip as ip_address, count(*) as threat_count, epoch_us(max(created_at)) as last_seen, max(cast(action_taken = 'BLOCK' as int)) = 1 as is_blocked, {_REP} as reputation_points
  from threats group by 1"""
EXTRA["narrow_steps"] = """select level, step, row_number() over (partition by level order by created_at, log_id) as n from (select log_id, created_at + interval 600 second as created_at,
  case when action_taken in ('BLOCK','RATE_LIMIT') then 'HIGH' else 'MEDIUM' end as level, case when log_id % 2 = 0 then 20 else -10 end as step from threats)"""
EXTRA["narrow_walk"] = """select level, cast(0 as bigint) as n, case level when 'HIGH' then 6500 else 5000 end as value from (select distinct level from narrow_steps)
union all select s.level, s.n, least(greatest(w.value + s.step, case s.level when 'HIGH' then 5500 else 0 end), case s.level when 'HIGH' then 9000 else 10000 end)
from narrow_walk w join narrow_steps s on s.level = w.level and s.n = w.n + 1"""
SQL["g9_thresholds"] = "select level, arg_max(value, n)/10000e0 as value from narrow_walk group by level"
SQL["g9_metrics"] = SQL["a7_window_metrics"]
SQL["g9_impact"] = SQL["a8_daily_impact"]
SQL["a8_weekly_sources"] = """select cast(cast(date_trunc('week', ts) as date) as varchar) as week, count(distinct source_ip) as sources, count(distinct cast(ts as date)) as days, true as within_error
  from scores_raw where combined > 0.4e0 group by 1"""
SQL["g2_stream_releases"] = """select case when epoch_us(ts) < 1704067200000000 + 3600000000 then cast(1 as bigint) else 2 end as release, count(*) as rows, true as alike, true as in_range from flows group by 1"""
EXTRA["routes"] = "select concat(source_ip, '>', dest_ip) as route, min(ts) >= timestamp '2024-01-01 01:00:00' as fresh from flows group by 1"
SQL["p7_grown_codes"] = "select route, row_number() over (order by fresh, route) - 1 as code from routes"
_KIND = "case when event_type in ('signup', 'purchase') then 'b' else 'a' end"
SQL["u1_registered_folder"] = f"""select cast(is_attack as bigint) as label, cast(dest_port as bigint) as dst_port, count(*) as n, cast(sum(packets) as double) as packets, round(sum(duration_seconds), 3) as duration,
  cast(sum(case {_KIND} when 'a' then packets else bytes_sent end) as double) as src_bytes,
  cast(sum(case {_KIND} when 'a' then case protocol when 'TCP' then 6 when 'UDP' then 17 when 'ICMP' then 1 else 47 end else case event_type when 'purchase' then 0 else 1 end end) as double) as protocols from flows group by 1, 2"""
EXTRA["held_rows"] = "select is_attack, count(*) - count(*)*80//100 as n from flows group by 1"
SQL["m13_registered_report"] = """select detector, class, cast(case class when 'normal' then (select n from held_rows where not is_attack) when 'attack' then (select n from held_rows where is_attack)
  else (select sum(n) from held_rows) end as bigint) as support, true as rates_hold
  from (values ('isolation_forest'), ('one_class_svm'), ('either')) d(detector), (values ('normal'), ('attack'), ('macro'), ('weighted')) c(class)"""
