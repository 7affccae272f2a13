"""Common table expressions of the DuckDB oracle: the derived tables, written as plain SQL."""

from __future__ import annotations

import re

# The columns of a flow and the attack names, as the queries' description gives them.
ATTACK_TYPE = """case event_type when 'view' then 'normal' when 'click' then 'brute_force' when 'signup' then 'zero_day'
  when 'purchase' then 'ddos' else 'port_scan' end"""
SHARED_COLUMNS = [
    "cast(1024 + event_id % 50000 as int) as src_port",
    "case event_type when 'view' then 'TCP' when 'click' then 'TCP' when 'signup' then 'UDP' "
    "when 'purchase' then 'ICMP' else 'GRE' end as protocol",
    "cast(floor(value*1000) as bigint) as bytes_sent",
    "cast(k + 1 as bigint) as packets",
    "cast(event_id % 200 as double) / 10 as duration_seconds",
    "case when event_type in ('click','error') then value*2 else value/50 end as request_rate",
    "case when k % 17 = 0 then 'Nmap Scripting Engine' else 'Mozilla/5.0' end as user_agent",
    "case when k % 13 = 0 then '1=1' end as sqli_pattern",
    "cast(k % 20 as int) as failed_logins",
    "k % 29 = 0 as repeated_beaconing",
    "event_type <> 'view' as is_attack",
    "event_type",
]

_SHARED = ",\n  ".join(SHARED_COLUMNS)


def _flows(ts: str) -> str:
    return f"""select event_id as log_id, {ts} as ts,
  concat('10.0.', cast(user_id // 256 as varchar), '.', cast(user_id % 256 as varchar)) as source_ip,
  concat('192.168.0.', cast(event_id % 20 as varchar)) as dest_ip,
  [22,53,80,443,3306,8080][k % 6 + 1] as dest_port,
  {_SHARED}
from (select *, cast(json_extract_string(props,'$.k') as int) k from events)"""


def _scores(flows: str) -> str:
    return f"""select *, case when combined >= 0.85e0 then 'CRITICAL' when combined >= 0.65e0 then 'HIGH' when combined >= 0.40e0 then 'MEDIUM' else 'LOW' end as risk_level
from (select *, 0.6e0*iso_score + 0.4e0*svm_score as combined
from (select *, session_deviation*0.8e0 + ip_share*0.2e0 as iso_score, request_rate/greatest(request_rate+1e0,1e0) as svm_score
from (select f.*,
  case when duration_seconds < 1.0 and bytes_sent > 50000 then 0.95e0 when duration_seconds < 5.0 and bytes_sent > 20000 then 0.70e0 else 0.15e0 end as session_deviation,
  cast(count(*) over (partition by source_ip) as double) / cast(count(*) over () as double) as ip_share
from {flows} f)))"""


def _threats(edge: str) -> str:
    return f"""select *, combined as confidence_score, ts + interval 1 second as created_at,
  case when risk_level = 'CRITICAL' or (prior >= 3 and combined > 0.75e0) then 'BLOCK'
       when risk_level = 'HIGH' then case when prior >= 3 then 'BLOCK' else 'RATE_LIMIT' end
       when risk_level = 'MEDIUM' then 'ALERT' else 'MONITOR' end as action_taken
from (select s.*, count(*) over (partition by source_ip order by ts, log_id rows between unbounded preceding and 1 preceding) as prior
from scores s where combined > {edge})"""


STAGE_SQL = """case when (duration_seconds > 3600 and coalesce(bytes_sent,0) < 1000) or repeated_beaconing then 'PERSISTENCE'
  when length(sqli_pattern) > 0 or failed_logins > 10 then 'EXPLOITATION'
  when dest_port in (80,443) and (request_rate > 50 or lower(user_agent) like '%dirbuster%' or lower(user_agent) like '%nmap%') then 'ENUMERATION'
  when request_rate > 100 or protocol = 'ICMP' then 'RECONNAISSANCE' end"""
NEXT_SQL = "case {0} when 'RECONNAISSANCE' then 'ENUMERATION' when 'ENUMERATION' then 'EXPLOITATION' when 'EXPLOITATION' then 'PERSISTENCE' end"
MULT_SQL = "case {0} when 'RECONNAISSANCE' then 1.1e0 when 'ENUMERATION' then 1.3e0 when 'EXPLOITATION' then 1.6e0 when 'PERSISTENCE' then 1.8e0 else 1e0 end"
IDX_SQL = "case {0} when 'RECONNAISSANCE' then 0 when 'ENUMERATION' then 1 when 'EXPLOITATION' then 2 when 'PERSISTENCE' then 3 end"
SEV_SQL = "case {0} when 'MONITOR' then 1 when 'ALERT' then 2 when 'RATE_LIMIT' then 3 when 'BLOCK' then 4 when 'PORT_CLOSE' then 5 else 0 end"

CTES: dict[str, str] = {
    "flows": _flows("make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 300)"),
    "flows_raw": _flows("ts"),
    "scores": _scores("flows"),
    "scores_raw": _scores("flows_raw"),
    "threats": _threats("0.65e0"),
    "threats_wide": _threats("0.40e0"),
    "actions": """select log_id as action_id, log_id, action_taken as action_type, source_ip as target_ip,
  created_at + interval 2 second as executed_at, log_id % 90 + 10 as execution_time_ms from threats""",
    "feedback": """select log_id, log_id % 2 = 0 as was_false_positive, 'analyst_1' as reporter, created_at + interval 600 second as created_at
from threats""",
    "shadow": """select log_id, source_ip, ts as "timestamp", combined as anomaly_score, risk_level,
  case risk_level when 'CRITICAL' then 'BLOCK' when 'HIGH' then 'RATE_LIMIT' else 'ALERT' end as would_have_taken_action,
  case when log_id % 5 = 0 then log_id % 10 = 0 end as was_approved_by_human
from scores where combined > 0.4e0""",
    "approvals": """select log_id, source_ip, action_taken as proposed_action, confidence_score, 'PENDING' as status,
  created_at + interval 300 second as expires_at from threats where action_taken in ('BLOCK','RATE_LIMIT')""",
    "reviews": """select log_id, make_timestamp(epoch_us(created_at) + log_id % 9 * 60000000) as reviewed_at, log_id % 8 = 0 as approved, 'analyst_1' as reviewer
from threats where action_taken in ('BLOCK','RATE_LIMIT')""",
    "queue": """select a.log_id, a.source_ip, a.proposed_action, a.confidence_score, a.expires_at,
  case when r.reviewed_at < a.expires_at then case when r.approved then 'APPROVED' else 'REJECTED' end else 'PENDING' end as status,
  case when r.reviewed_at < a.expires_at then r.reviewer end as reviewed_by,
  case when r.reviewed_at < a.expires_at then r.reviewed_at end as reviewed_at
from approvals a left join reviews r using (log_id)""",
    "allowlist": """select * from (values ('IP','10.0.0.5',true), ('CIDR','10.0.0.16/28',true), ('CIDR','10.0.0.200/30',false),
  ('CIDR','10.0.1.0/24',true), ('IP','not-an-ip',true)) t(entry_type, value, is_active)""",
    "nets": """select net, 1::bigint << (32 - len) as size from (select cast(split_part(value,'/',2) as int) as len,
  cast(split_part(split_part(value,'/',1),'.',1) as bigint)*16777216 + cast(split_part(split_part(value,'/',1),'.',2) as bigint)*65536
  + cast(split_part(split_part(value,'/',1),'.',3) as bigint)*256 + cast(split_part(split_part(value,'/',1),'.',4) as bigint) as net
from allowlist where entry_type = 'CIDR' and is_active)""",
    "flow_ips": """select distinct source_ip, cast(split_part(source_ip,'.',1) as bigint)*16777216 + cast(split_part(source_ip,'.',2) as bigint)*65536
  + cast(split_part(source_ip,'.',3) as bigint)*256 + cast(split_part(source_ip,'.',4) as bigint) as num from flows""",
    "trusted": """select source_ip from flow_ips where exists (select 1 from nets where num >= net and num < net + size)
  or source_ip in (select value from allowlist where entry_type = 'IP' and is_active)""",
    "stage_flows": f"select *, {STAGE_SQL} as stage from flows",
    "stage_events": f"""select log_id, source_ip, ts as detected_at, stage,
  case stage when 'PERSISTENCE' then 0.9e0 when 'EXPLOITATION' then 0.85e0 when 'ENUMERATION' then 0.75e0 else 0.65e0 end as confidence,
  {NEXT_SQL.format('stage')} as predicted_next_stage from stage_flows where stage is not null""",
    "now": "select max(ts) as t from flows",
    "profiles": f"""select source_ip, arg_min(stage, (detected_at, log_id)) as first_stage_seen, arg_max(stage, (detected_at, log_id)) as current_stage,
  max(detected_at) as last_activity, count(*) as stage_events,
  max(detected_at) >= (select t from now) - interval 2 hour as is_active from stage_events group by source_ip""",
    "progress": f"""select log_id, source_ip, detected_at, stage,
  coalesce({IDX_SQL.format('stage')} > {IDX_SQL.format('prev_stage')} and detected_at - prev_at <= interval 1 hour, false) as is_progressing
from (select *, lag(stage) over w as prev_stage, lag(detected_at) over w as prev_at from stage_events window w as (partition by source_ip order by detected_at, log_id))""",
    "around": """select a.action_id, a.target_ip, a.action_type, a.executed_at,
  coalesce((select avg(combined) from (select combined from scores s where s.source_ip = a.target_ip and s.ts <= a.executed_at order by ts desc, log_id desc limit 5)), 0e0) as mean_before,
  b.n_after, b.mean_after, b.max_after
from actions a join (select a2.action_id, count(s.log_id) as n_after, coalesce(avg(s.combined), 0e0) as mean_after, max(s.combined) as max_after
  from actions a2 left join scores s on s.source_ip = a2.target_ip and s.ts > a2.executed_at and s.ts <= a2.executed_at + interval 60 second group by 1) b using (action_id)""",
    "validations": """select *, mean_before - mean_after as delta, mean_before - mean_after > 0.15e0 as success,
  n_after > 0 and coalesce(max_after > mean_before - 0.1e0, false) as attack_resumed from around""",
    "metric_rows": """select time_bucket(interval 15 minute, executed_at) as window_start, cast(success as int) as tp, 0 as fp, 0 as fn, 0 as ls, 0 as ln from validations
union all select time_bucket(interval 15 minute, created_at), 0, cast(was_false_positive as int), 0, 0, 0 from feedback
union all select time_bucket(interval 15 minute, "timestamp"), 0, 0, cast(would_have_taken_action in ('BLOCK','RATE_LIMIT') as int), 0, 0 from shadow
union all select time_bucket(interval 15 minute, executed_at), 0, 0, 0, execution_time_ms, 1 from actions""",
    "metric_sums": "select window_start, cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn, cast(sum(ls) as bigint) ls, cast(sum(ln) as bigint) ln from metric_rows group by 1",
    "metrics": """select *, case when precision + recall > 0 then 2e0*precision*recall/(precision + recall) else 0e0 end as f1_score from (select window_start, tp, fp, fn,
  case when tp + fp = 0 then 0e0 else cast(tp as double)/cast(tp + fp as double) end as precision,
  case when tp + fn = 0 then 0e0 else cast(tp as double)/cast(tp + fn as double) end as recall,
  cast(fp as double)/cast(fp + 1000 as double) as false_positive_rate,
  case when ln = 0 then 0e0 else cast(ls as double)/cast(ln as double) end as avg_latency_ms from metric_sums)""",
    "sim_events": f"""select log_id, source_ip, ts, combined as anomaly_score, {ATTACK_TYPE} as attack_type, is_attack, rl as risk_level,
  case rl when 'CRITICAL' then 'BLOCK_IP' when 'HIGH' then 'RATE_LIMIT' when 'MEDIUM' then 'ALERT' else 'MONITOR' end as action
from (select *, case when combined >= 0.8e0 then 'CRITICAL' when combined >= 0.6e0 then 'HIGH' when combined >= 0.35e0 then 'MEDIUM' else 'LOW' end as rl from scores)""",
    "timeline": """select log_id, source_ip, ts, dest_port, round(combined, 4) as score, case when event_type = 'error' then 'ATTACK' else 'NORMAL' end as kind,
  case when log_id % 50 = 0 then 'FALSE_POSITIVE' end as outcome from scores_raw""",
    "reputation": """select source_ip as ip_address, count(*) as threat_count, max(created_at) as last_seen, max(cast(action_taken = 'BLOCK' as int)) = 1 as is_blocked,
  greatest(100 - cast(sum(case action_taken when 'BLOCK' then 50 when 'RATE_LIMIT' then 25 when 'PORT_CLOSE' then 40 else 0 end) as bigint), 0) as reputation_points
from threats where log_id % 2 = 0 group by 1""",
    "context0": f"""select t.*, {STAGE_SQL} as stage,
  (select count(*) from scores s where s.source_ip = t.source_ip and s.ts >= t.ts - interval 300 second and s.ts <= t.ts) >= 3 as correlated,
  exists (select 1 from threats_wide p where p.source_ip = t.source_ip and p.created_at >= t.created_at - interval 600 second and p.created_at < t.created_at) as in_cooldown,
  coalesce(max({SEV_SQL.format('action_taken')}) over (partition by source_ip order by created_at, log_id rows between 10 preceding and 1 preceding), 0) as past_severity,
  coalesce(p.is_progressing, false) as is_progressing
from threats_wide t left join (select log_id, is_progressing from progress) p using (log_id)""",
    "context": """select *, least(case when in_cooldown then 0.3e0 else 0e0 end + case when not correlated then 0.4e0 else 0e0 end + case when prior = 0 then 0.2e0 else 0e0 end, 0.9e0) as fp_risk,
  concat_ws(', ', case when in_cooldown then 'IP in cooldown (recently alerted)' end, case when not correlated then 'Single isolated event (no emerging pattern)' end,
    case when prior = 0 then 'Zero prior incidents (first time seen)' end) as factors from context0""",
}

_WORD = re.compile(r"[a-z_0-9]+")


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the tables it uses, dependencies first."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for word in _WORD.findall(text):
            if word in known and word not in order:
                need_of = known[word]
                if word not in seen:
                    seen.add(word)
                    need(need_of)
                    order.append(word)

    seen: set[str] = set()
    need(body)
    if not order:
        return body
    return "with recursive " + ",\n".join(f"{n} as ({known[n]})" for n in order) + "\n" + body
