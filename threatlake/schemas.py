"""Table schemas and allowed values of the security data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ["MONITOR", "ALERT", "RATE_LIMIT", "BLOCK", "PORT_CLOSE"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
STAGES = ["RECONNAISSANCE", "ENUMERATION", "EXPLOITATION", "PERSISTENCE"]
APPROVAL_STATES = ["PENDING", "APPROVED", "REJECTED", "EXPIRED"]
ROLLBACK_ACTORS = ["HUMAN", "AUTO_TIMER", "SYSTEM"]
ALLOWLIST_TYPES = ["IP", "CIDR", "ASN"]

NETWORK_LOGS = (
    "id string, timestamp timestamp, source_ip string, dest_ip string, src_port int, dest_port int, protocol string, "
    "bytes_sent bigint, packets bigint, duration_seconds double, request_rate double, session_id string, "
    "user_agent string, raw_payload string"
)
PAYLOAD = "port_entropy double, sqli_pattern string, failed_logins int, repeated_beaconing boolean"
ANOMALY_SCORES = (
    "id string, log_id string, isolation_forest_score double, svm_score double, combined_score double, "
    "behavioral_deviation double, risk_level string, created_at timestamp"
)
THREAT_EVENTS = (
    "id string, source_ip string, threat_type string, confidence_score double, action_taken string, "
    "agent_reasoning string, resolved boolean, fp_risk_score double, created_at timestamp, resolved_at timestamp"
)
IP_REPUTATION = (
    "ip_address string, threat_count int, last_seen timestamp, is_blocked boolean, block_reason string, "
    "reputation_score double, attack_history array<struct<timestamp:timestamp,score:double,action:string,threat_type:string>>"
)
ACTION_LOGS = (
    "id string, threat_event_id string, action_type string, target_ip string, success boolean, error_message string, "
    "executed_at timestamp, execution_time_ms double"
)
SHADOW_DECISIONS = (
    "id string, timestamp timestamp, source_ip string, anomaly_score double, risk_level string, "
    "would_have_taken_action string, reasoning_summary string, was_approved_by_human boolean"
)
ROLLBACK_RECORDS = (
    "id string, action_log_id string, rolled_back_at timestamp, rolled_back_by string, rollback_reason string, "
    "was_successful boolean"
)
ALLOWLIST_ENTRIES = (
    "id string, entry_type string, value string, label string, added_by string, created_at timestamp, is_active boolean"
)
HUMAN_APPROVAL_QUEUE = (
    "id string, threat_event_id string, proposed_action string, confidence_score double, reasoning_summary string, "
    "status string, reviewed_by string, reviewed_at timestamp, expires_at timestamp"
)
FALSE_POSITIVE_FEEDBACK = (
    "id string, threat_event_id string, reporter string, was_false_positive boolean, notes string, created_at timestamp"
)
KILL_CHAIN_EVENTS = (
    "id string, source_ip string, stage string, detected_at timestamp, evidence map<string,string>, "
    "predicted_next_stage string, confidence double, linked_threat_events array<string>"
)
ATTACKER_PROFILES = (
    "source_ip string, first_stage_seen string, current_stage string, "
    "stage_history array<struct<stage:string,confidence:double,threat_event_id:string,timestamp:timestamp>>, "
    "predicted_next_action string, is_active boolean, last_activity timestamp"
)
DETECTION_METRICS = (
    "id string, measured_at timestamp, true_positives int, false_positives int, false_negatives int, precision double, "
    "recall double, f1_score double, false_positive_rate double, avg_detection_latency_ms double, time_window_minutes int"
)
BUSINESS_IMPACT = (
    "id string, date date, total_ips_blocked int, total_requests_blocked int, false_blocks_count int, "
    "estimated_cost_saved_usd double, analyst_hours_saved double"
)

ALLOWED = {
    "action_taken": ACTIONS,
    "proposed_action": ACTIONS,
    "would_have_taken_action": ACTIONS,
    "risk_level": RISK_LEVELS,
    "stage": STAGES,
    "status": APPROVAL_STATES,
    "rolled_back_by": ROLLBACK_ACTORS,
    "entry_type": ALLOWLIST_TYPES,
}


def violations(df: DataFrame) -> DataFrame:
    """Rows whose enumerated columns hold a value outside the allowed set."""
    checks = [F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in ALLOWED.items() if c in df.columns]
    bad = F.lit(False)
    for check in checks:
        bad = bad | check
    return df.where(bad)


def row_key(*columns: str) -> "F.Column":
    """Deterministic string id of a natural key, so that re-runs produce the same ids."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns]), 256)
