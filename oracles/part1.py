"""Oracle SQL of the scans, filters, joins, windows and features."""

from oracles.base import IDX_SQL, SEV_SQL, STAGE_SQL  # noqa: F401

_ATT = "is_attack"
_HIST = "partition by source_ip order by epoch_us(ts) range between 300000000 preceding and 1 preceding"
_ENTROPY = """entropy as (select log_id, case when n >= 2 and d >= 2 then (log2(n) - g/n)/log2(d) else 0e0 end as port_entropy
from (select log_id, cast(sum(c) as double) as n, count(c) as d, sum(c*log2(c)) as g
  from (select f.log_id, h.dest_port, count(h.log_id) as c from flows f left join flows h on h.source_ip = f.source_ip
    and h.ts >= f.ts - interval 300 second and h.ts < f.ts group by 1, 2 having count(h.log_id) > 0) group by 1))"""
_Z = f"""select log_id, n, case when n < 2 or cast(n::hugeint*s2 - s1*s1 as double) <= 0 then 0e0
  else least(greatest(cast(n::hugeint*bytes_sent - s1 as double)/sqrt(cast(n::hugeint*s2 - s1*s1 as double)), -5e0), 5e0) end as z
from (select log_id, bytes_sent, count(*) over w as n, coalesce(sum(bytes_sent) over w, 0) as s1, coalesce(sum(bytes_sent::hugeint*bytes_sent) over w, 0) as s2
from flows window w as ({_HIST}))"""
ENTROPY_CTE = {"entropy_rows": _ENTROPY.split(" as (", 1)[1][:-1], "zrows": _Z}

SQL = {
    "s3_log_page": "select log_id, epoch_us(ts) as ts, source_ip, cast(dest_port as bigint) as dest_port from flows f order by f.ts desc, log_id desc limit 50 offset 100",
    "s4_ingest_batch": "select count(*) filter (where source_ip not in (select source_ip from trusted)) as enqueued, count(*) filter (where source_ip in (select source_ip from trusted)) as skipped_trusted from flows",
    "s5_agent_ingest": """select log_id, source_ip, case when log_id % 3 = 0 then dest_ip else 'server' end as dest_ip, cast(src_port as bigint) as src_port,
  cast(case when log_id % 4 = 0 then dest_port else 80 end as bigint) as dest_port, case when log_id % 5 = 0 then protocol else 'HTTP' end as protocol,
  case when log_id % 2 = 0 then bytes_sent else 0 end as bytes_sent, case when log_id % 7 = 0 then packets else 1 end as packets,
  case when log_id % 2 = 1 then duration_seconds else 0e0 end as duration_seconds, case when log_id % 6 = 0 then request_rate else 1e0 end as request_rate from flows""",
    "s6_ingest_records": """select log_id, source_ip, '10.0.0.1' as dest_ip, cast(dest_port as bigint) as dest_port, protocol,
  case when log_id % 9 = 0 then 0 else bytes_sent end as bytes_sent, cast(0 as bigint) as bytes_received, duration_seconds from flows where log_id % 11 <> 0 order by log_id limit 1000""",
    "s8_attack_scenarios": """select concat('sc_', cast(t.log_id as varchar)) as scenario_id, t.log_id, t.source_ip, epoch_us(t.created_at) as created_at, t.action_taken as original_action,
  t.confidence_score as original_confidence, f.log_id as net_log_id, f.request_rate, cast(f.dest_port as bigint) as dest_port, cast(f.src_port as bigint) as src_port, f.bytes_sent,
  f.duration_seconds, f.packets, f.protocol from threats t left join lateral (select * from flows g where g.source_ip = t.source_ip and g.ts <= t.created_at order by g.ts desc, g.log_id desc limit 1) f on true""",
    "s9_event_envelopes": """select 'action_executed' as event_type, epoch_us(executed_at) as "timestamp",
  concat('{"source_ip":"', target_ip, '","action":"', action_type, '","success":true,"execution_time_ms":', cast(execution_time_ms as varchar), '}') as payload from actions""",
    "s11_live_feed": "select log_id, epoch_us(ts) as ts, source_ip, protocol, bytes_sent from flows f order by f.ts desc, log_id desc limit 50",
    "p2_infinite_to_zero": "select log_id, case when duration_seconds = 0 then 0e0 else packets/duration_seconds end as rate from flows",
    "p2_clean_rows": "select distinct source_ip, cast(dest_port as bigint) as dest_port, protocol, floor(duration_seconds) as dur from flows where duration_seconds <> 0",
    "p3_distinct_rows": "select distinct source_ip, cast(dest_port as bigint) as dest_port, protocol from flows",
    "p4_tolerant_numbers": "select log_id, case when log_id % 7 = 0 or log_id % 11 = 0 or log_id % 13 = 0 then 0e0 else cast(bytes_sent as double) end as value from flows",
    "p6_binary_label": "select log_id, cast(is_attack as bigint) as label from flows",
    "p7_category_codes": """select log_id, (select count(distinct p.protocol) from flows p where p.protocol < f.protocol) as protocol,
  (select count(distinct p.event_type) from flows p where p.event_type < f.event_type) as event_type from flows f""",
    "p8_derived_rate": "select log_id, cast(packets as double)/case when duration_seconds = 0 then 0.001e0 else duration_seconds end as rate from flows",
    "p9_trusted_flag": "select log_id, source_ip, source_ip in (select source_ip from trusted) as is_trusted from flows",
    "p10_threat_search": """select log_id, epoch_us(created_at) as created_at, source_ip, risk_level, action_taken from threats_wide t
  where contains(source_ip, '10.0.0.1') and risk_level = 'HIGH' order by t.created_at desc, log_id desc limit 25 offset 5""",
    "p11_unscored_logs": "select log_id, source_ip, epoch_us(ts) as ts from flows where log_id % 3 = 0",
    "p12_anomaly_gate": "select log_id, source_ip, combined, risk_level from scores where combined > 0.65e0",
    "p13_active_attackers": "select source_ip, current_stage, epoch_us(last_activity) as last_activity from profiles where is_active",
    "p13_active_allowlist": """select 'IP' as entry_type, source_ip as value, true as is_active from (select source_ip, arg_max(is_active, version) as is_active
  from (select source_ip, true as is_active, cast(0 as bigint) as version from flows union all select source_ip, log_id % 2 = 0, log_id + 1 from threats) group by 1) where is_active""",
    "p13_pending_approvals": "select log_id, proposed_action, epoch_us(expires_at) as expires_at from queue where status = 'PENDING'",
    "p13_active_threats": "select log_id, source_ip, risk_level from sim_events where risk_level <> 'LOW' and ts > (select max(ts) from flows) - interval 30 second",
    "p14_lookup_sources": "select source_ip, first_stage_seen, current_stage, is_active from profiles where source_ip in ('10.0.0.7','10.0.0.42')",
    "p15_recent_metrics": "select epoch_us(window_start) as window_start, tp, fp, fn from metrics where window_start >= (select max(ts) from flows) - interval 1 day",
    "p15_latest_decisions": "select log_id, epoch_us(created_at) as created_at, source_ip, action_taken from threats_wide t order by t.created_at desc, log_id desc limit 20",
    "j1_log_with_score": "select f.log_id, f.source_ip, s.combined, s.risk_level from flows f left join (select * from scores where log_id % 3 <> 0) s using (log_id)",
    "j2_score_source": "select log_id, combined, source_ip, epoch_us(ts) as ts from scores",
    "j3_threat_reputation": """select t.source_ip, t.log_id, t.confidence_score, coalesce(r.threat_count, 0) as threat_count, coalesce(r.is_blocked, false) as is_blocked,
  coalesce(r.reputation_points/100e0, 1e0) as reputation_score from threats t left join reputation r on r.ip_address = t.source_ip""",
    "j4_latest_log_as_of": """select t.log_id, t.source_ip, (select f.log_id from flows f where f.source_ip = t.source_ip and f.ts <= t.created_at order by f.ts desc, f.log_id desc limit 1) as net_log_id from threats t""",
    "j5_scores_around_action": "select action_id, round(mean_before, 6) as mean_before, n_after, round(mean_after, 6) as mean_after, round(max_after, 6) as max_after from around",
    "j6_untrusted_logs": "select source_ip, log_id, epoch_us(ts) as ts from flows where source_ip not in (select source_ip from trusted)",
    "j7_cidr_trusted": "select source_ip from trusted",
    "j8_feedback_threats": """select f.log_id, epoch_us(f.created_at) as created_at, case when t.action_taken in ('BLOCK','RATE_LIMIT') then 'HIGH' else 'MEDIUM' end as level,
  cast(case when was_false_positive then 20 else -10 end as bigint) as step from feedback f join threats t using (log_id)""",
    "j9_threats_after_review": """select t.log_id, t.source_ip, case when q.status = 'PENDING' and q.expires_at <= (select max(ts) from flows) then 'ALERT' else t.action_taken end as action_taken,
  coalesce(q.status = 'REJECTED', false) as resolved, case when q.status = 'PENDING' and q.expires_at <= (select max(ts) from flows) then 'EXPIRED' else q.status end as approval_status
  from threats t left join queue q using (log_id)""",
    "j10_rollback_records": """select action_id, target_ip, (select epoch_us(max(ts)) from flows) as rolled_back_at, 'HUMAN' as rolled_back_by, 'analyst request' as rollback_reason,
  coalesce(r.is_blocked, false) as was_successful from actions a left join reputation r on r.ip_address = a.target_ip where action_type = 'BLOCK'""",
    "j11_similar_cases": """select p.log_id, cast(c.rank as bigint) as rank, c.case_id, c.action_taken, c.case_id % 4 = 0 as was_false_positive
  from threats_wide p join lateral (
    select x.log_id as case_id, x.action_taken, row_number() over (order by x.created_at desc, x.log_id desc) as rank from threats_wide x
    where x.created_at < p.created_at and abs(round(x.confidence_score*10000) - round(p.confidence_score*10000)) <= 500) c on c.rank <= 5""",
    "j12_stage_context": """select f.log_id, f.source_ip, f.stage, coalesce(f.stage, p.current_stage) as context_stage from stage_flows f
  left join profiles p on p.source_ip = f.source_ip and p.is_active""",
    "w1_port_entropy": "select log_id, round(port_entropy, 4) as port_entropy from (select f.log_id, coalesce(e.port_entropy, 0e0) as port_entropy from flows f left join entropy_rows e using (log_id))",
    "w2_session_deviation": "select log_id, round(z, 6) as session_z from zrows",
    "w3_ip_frequency": "select log_id, n as hist_rows, round(ln(cast(n as double) + 1), 6) as ip_frequency from zrows",
    "w4_prior_threats": "select log_id, source_ip, prior, prior >= 3 as repeat_offender from threats_wide",
    "w5_past_severity": f"""select log_id, cast(coalesce(max({SEV_SQL.format('action_taken')}) over (partition by source_ip order by created_at, log_id rows between 10 preceding and 1 preceding), 0) as bigint) as past_severity from threats_wide""",
    "w6_correlated": """select log_id, recent_events, recent_events >= 3 as correlated from (select log_id, count(*) over (partition by source_ip order by epoch_us(ts) range between 300000000 preceding and current row) as recent_events from scores)""",
    "w7_cooldown": """select log_id, exists (select 1 from threats_wide p where p.source_ip = t.source_ip and p.created_at >= t.created_at - interval 600 second and p.created_at < t.created_at) as in_cooldown from threats_wide t""",
    "w8_stage_progression": "select log_id, source_ip, stage, is_progressing from progress",
    "w9_attacker_profiles": "select source_ip, first_stage_seen, current_stage, epoch_us(last_activity) as last_activity, stage_events, is_active from profiles",
    "w9_stage_history": """select source_ip, log_id as threat_event_id, epoch_us(detected_at) as "timestamp", stage, confidence from stage_events""",
    "m4_train_split": """select log_id, cast(is_attack as bigint) as label, r <= n*80//100 as is_train from (select log_id, is_attack, count(*) over (partition by is_attack) as n,
  row_number() over (partition by is_attack order by md5(concat('42:', cast(log_id as varchar))), log_id) as r from flows)""",
    "w10_attack_pattern": """select source_ip, n as events, case when n < 5 then null when ports > 10 and n >= 10 then 'port_scan'
  when n >= 20 and top < 0.4e0 and t1 - t20 > 3600000000 then 'slow_burn' when n >= 10 and t1 - t5 > 0 and t6 - t10 > 0 and t6 - t10 > (t1 - t5)*3 then 'ddos_buildup' end as pattern
from (select source_ip, count(*) as n, count(distinct dest_port) as ports, max(case when r <= 20 then score end) as top, max(case when r = 1 then epoch_us(ts) end) as t1,
  max(case when r = 5 then epoch_us(ts) end) as t5, max(case when r = 6 then epoch_us(ts) end) as t6, max(case when r = 10 then epoch_us(ts) end) as t10, max(case when r = 20 then epoch_us(ts) end) as t20
  from (select *, row_number() over (partition by source_ip order by ts desc, log_id desc) as r from timeline) group by 1)""",
    "w11_sequence_deviation": """select log_id, case when n >= 2 then round(expected, 4) else 0e0 end as predicted_rate, case when n >= 2 then round(least(dev/5e0, 1e0), 4) else 0e0 end as deviation_score, n >= 2 and dev > 2.5e0 as is_anomalous
from (select log_id, n, expected, abs(last - expected)/greatest(sqrt(list_sum(list_transform(past, lambda v: (v - mean)*(v - mean)))/19e0), 0.001e0) as dev
from (select log_id, n, past, last, list_sum(past)/19e0 as mean, list_reduce(past, lambda a, v: 0.3e0*v + 0.7e0*a) as expected
from (select log_id, len(seq) as n, ful[1:19] as past, ful[20] as last from (select log_id, seq, list_concat(list_transform(range(20 - len(seq)), lambda i: seq[1]), seq) as ful
from (select log_id, list(request_rate) over (partition by source_ip order by ts, log_id rows between 19 preceding and current row) as seq from flows)))))""",
    "w12_reputation_path": """select action_id, target_ip, greatest(0, 100 - cast(sum(case action_type when 'BLOCK' then 50 when 'RATE_LIMIT' then 25 when 'PORT_CLOSE' then 40 else 0 end)
  over (partition by target_ip order by executed_at, action_id) as bigint))/100e0 as reputation from actions""",
    "w13_first_block": "select target_ip, arg_min(action_id, (executed_at, action_id)) as action_id, epoch_us(min(executed_at)) as first_blocked_at from actions where action_type = 'BLOCK' group by 1",
    "w14_auto_rollback": """select action_id, k as "check", epoch_us(due_at) as due_at, round(m, 6) as recent_mean, case when m >= 0.65e0 then 'EXTEND' else 'ROLLBACK' end as outcome
from (select *, min(case when m < 0.65e0 then k end) over (partition by action_id) as ended
from (select c.*, coalesce((select avg(combined) from (select combined from scores s where s.source_ip = c.target_ip and s.ts <= c.due_at order by s.ts desc, s.log_id desc limit 5)), 0e0) as m
from rollback_checks c)) where ended is null or k <= ended""",
    "w15_last_per_source": "select source_ip, log_id, r as rank from (select *, row_number() over (partition by source_ip order by ts desc, log_id desc) as r from flows) where r <= 10",
    "w16_latest_scores": "select log_id, combined from scores order by ts desc, log_id desc limit 1000",
    "t1_threat_page": "select log_id, epoch_us(created_at) as created_at from threats t order by t.created_at desc, log_id desc limit 30 offset 30",
    "t2_top_shadow_sources": "select source_ip, count(*) as n from shadow group by 1 order by n desc, source_ip limit 10",
    "u1_stacked_datasets": "select cast(is_attack as bigint) as label, source_ip, count(*) as n, cast(sum(packets) as bigint) as packets from flows group by 1, 2",
    "u2_merged_feed": """select * from (select log_id, epoch_us(ts) as created_at, source_ip, risk_level, case when action = 'BLOCK_IP' then 'BLOCK' else action end as action_taken,
  case risk_level when 'CRITICAL' then 'EXPLOITATION' when 'HIGH' then 'ENUMERATION' else 'RECONNAISSANCE' end as kill_chain_stage, true as is_scored_event from sim_events where attack_type <> 'normal'
  union all select log_id, epoch_us(created_at), source_ip, risk_level, action_taken, null, false from threats) order by created_at desc, log_id desc limit 500""",
    "u3_balanced_sample": "select log_id, label from (select log_id, cast(is_attack as bigint) as label, row_number() over (partition by is_attack order by md5(concat('42:', cast(log_id as varchar))), log_id) as r from flows) where r <= 500",
    "u4_unblocked_sources": "select distinct source_ip from flows where source_ip not in (select target_ip from actions where action_type = 'BLOCK')",
    "m1_behaviour6": """select f.log_id, round(case when duration_seconds <= 0 then cast(packets as double) else packets/duration_seconds end, 6) as packet_rate, round(coalesce(e.port_entropy, 0e0), 4) as port_entropy,
  round(z, 6) as session_z, round(ln(cast(n as double) + 1), 6) as ip_frequency, case when protocol in ('TCP','UDP','ICMP','tcp','udp','icmp','6','17','1') then 0e0 else 1e0 end as protocol_anomaly,
  round(hour(ts)/23e0, 6) as time_of_day from flows f left join entropy_rows e using (log_id) join zrows using (log_id)""",
    "m2_detect7": """select log_id, request_rate, case when dest_port <> src_port then 1e0 else 0e0 end as pair_entropy, session_deviation, ip_share, bytes_sent, packets, duration_seconds from scores""",
    "m3_standard_scaling": """select log_id, round((bytes_sent - bm)/bs, 6) as bytes_sent, round((packets - pm)/ps, 6) as packets, round((duration_seconds - dm)/ds, 6) as duration_seconds from flows,
  (select avg(bytes_sent) bm, stddev_pop(bytes_sent) bs, avg(packets) pm, stddev_pop(packets) ps, avg(duration_seconds) dm, stddev_pop(duration_seconds) ds from flows where log_id % 5 <> 0)""",
    "m7_normalised_scores": """select log_id, round(1e0 - (raw - lo)/(hi - lo), 6) as minmax, round(least(greatest(0.5e0 - raw, 0e0), 1e0), 6) as offset_score
from (select log_id, raw, min(raw) over () as lo, max(raw) over () as hi from (select log_id, duration_seconds/10e0 - packets/100e0 as raw from flows))""",
    "m8_ensemble": """select log_id, combined as combined_score, round(1e0 - abs(iso_score - svm_score), 6) as agreement, round((1e0 - abs(iso_score - svm_score))*combined, 6) as confidence, combined > 0.3e0 as is_anomaly,
  case when combined > 0.8e0 then 'CRITICAL' when combined > 0.6e0 then 'HIGH' when combined > 0.3e0 then 'MEDIUM' else 'LOW' end as risk_level from scores""",
    "m9_fallback_scores": """select log_id, source_ip, epoch_us(ts) as created_at, round(iso_score, 4) as isolation_forest_score, round(svm_score, 4) as svm_score, round(combined, 4) as combined_score,
  round(session_deviation, 4) as behavioral_deviation, risk_level from scores""",
    "m10_rule_score": """select log_id, tick_rows, round(s, 6) as anomaly_score, lv as risk_level, case lv when 'CRITICAL' then 'BLOCK_IP' when 'HIGH' then 'RATE_LIMIT' when 'MEDIUM' then 'ALERT' else 'MONITOR' end as action
from (select *, case when s >= 0.8e0 then 'CRITICAL' when s >= 0.6e0 then 'HIGH' when s >= 0.35e0 then 'MEDIUM' else 'LOW' end as lv
from (select *, least(case when bytes_sent < 60 then 0.25e0 else 0e0 end + case when duration_seconds < 0.05e0 then 0.2e0 else 0e0 end + case when dest_port in (80,443,53,123) then 0e0 else 0.15e0 end + least(tick_rows/100e0, 0.4e0), 1e0) as s
from (select *, count(*) over (partition by source_ip, epoch_us(ts) // 60000000) as tick_rows from flows)))""",
    "m14_oversampled": "select log_id, was_false_positive, cast(copy as bigint) as copy from feedback, (values (1), (2)) c(copy) where copy = 1 or not was_false_positive",
    "f_ip_numbers": """select log_id, num as number, (num >> 8) << 8 as network from flows join flow_ips using (source_ip)""",
    "f_risk_ladders": """select log_id, case when combined > 0.8e0 then 'CRITICAL' when combined > 0.6e0 then 'HIGH' when combined > 0.3e0 then 'MEDIUM' else 'LOW' end as ensemble, risk_level as detect,
  case when combined >= 0.8e0 then 'CRITICAL' when combined >= 0.6e0 then 'HIGH' when combined >= 0.35e0 then 'MEDIUM' else 'LOW' end as rule,
  case when combined > 0.8e0 then 'CRITICAL' when combined > 0.5e0 then 'HIGH' else 'MEDIUM' end as profile from scores""",
    "f_text_verdict": """select log_id, ['SAFE','ESCALATE','NEUTRALIZE','MONITOR'][log_id % 4 + 1] as verdict, concat('Slow ', upper(event_type[1]), event_type[2:]) as title from flows""",
    "f_time_parts": """select log_id, case when log_id % 10 = 0 then 0.5e0 else round(hour(ts)/23e0, 6) end as tod, hour(ts) between 2 and 6 as off_hours,
  greatest(0, cast(floor(epoch_us(ts)/1000000) as bigint) - 1705276800) as seconds_left from flows_raw""",
    "f_json_payload": "select log_id, round(packets/100e0, 6) as port_entropy, sqli_pattern, cast(failed_logins as bigint) as failed_logins, repeated_beaconing from flows",
}
