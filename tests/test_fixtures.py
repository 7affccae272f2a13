"""Value fixtures of single operators."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatlake.config import Config, SkewConfig
from threatlake.functions import scalars as S
from threatlake.operators.running import cells_of, range_cells
from threatlake.operators import adapt, allowlist, approvals, cleaning, decisions, killchain, memory, response, validation

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
FLOW = "log_id bigint, source_ip string, ts timestamp, dest_port int, protocol string, bytes_sent bigint, duration_seconds double, request_rate double, user_agent string, sqli_pattern string, failed_logins int, port_entropy double, repeated_beaconing boolean"


def flow(i=1, ip="1.2.3.4", at=0, port=22, rate=1.0, agent=None, sqli=None, logins=None, entropy=None, beacon=None, dur=1.0):
    return (i, ip, T0 + timedelta(seconds=at), port, "TCP", 10, dur, rate, agent, sqli, logins, entropy, beacon)


def test_stages(spark):
    rows = [flow(1, rate=150.0, entropy=0.9), flow(2, logins=15, sqli="1=1"), flow(3, port=80, agent="Nmap"), flow(4, dur=4000.0, beacon=True), flow(5)]
    got = {r.log_id: (r.stage, r.stage_confidence, r.signals) for r in killchain.classify_stage(spark.createDataFrame(rows, FLOW)).collect()}
    assert got[1] == ("RECONNAISSANCE", 0.65, ["high_connection_rate_to_many_ports"])
    assert got[2] == ("EXPLOITATION", 0.85, ["sqli_pattern", "brute_force_login"])
    assert got[3] == ("ENUMERATION", 0.75, ["scanner_agent"])
    assert got[4] == ("PERSISTENCE", 0.9, ["long_session_low_rate", "repeated_beaconing"])
    assert got[5] == (None, 0.0, [])


def test_progression(spark):
    rows = [flow(1, rate=150.0), flow(2, at=1800, port=80, rate=60.0), flow(3, at=9000, logins=15), flow(4, ip="5.5.5.5", logins=15)]
    got = {r.log_id: r.is_progressing for r in killchain.progression(killchain.stage_events(spark.createDataFrame(rows, FLOW))).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}  # 3 comes after more than an hour


def test_score_decision_multiplier_and_guard(spark):
    rows = [(1, 0.5, None, 0.1, 5), (2, 0.5, "EXPLOITATION", 0.1, 5), (3, 0.85, None, 0.0, 0), (4, 0.95, None, 0.0, 0), (5, 0.7, None, 0.0, 1)]
    df = spark.createDataFrame(rows, "log_id int, confidence_score double, stage string, fp_risk double, prior int")
    got = {r.log_id: (round(r.final_score, 6), r.action) for r in decisions.score_decision(df).collect()}
    assert got == {1: (0.45, "MONITOR"), 2: (0.72, "RATE_LIMIT"), 3: (0.85, "RATE_LIMIT"), 4: (0.95, "BLOCK"), 5: (0.7, "ALERT")}


def test_gate(spark):
    rows = [(0.9, False), (0.6, False), (0.3, False), (0.9, True)]
    df = spark.createDataFrame(rows, "confidence_score double, is_trusted boolean").withColumn("action", F.lit("BLOCK"))
    run = lambda **k: [(r.allowed, r["mode"], r.reason) for r in decisions.execution_gate(df, Config(**k)).orderBy(F.desc("confidence_score"), "is_trusted").collect()]
    got = run(shadow_mode=False)
    assert got[0][0] and not got[1][0] and "allowlist" in got[1][2] and "ALERT" in got[2][2] and "MONITOR" in got[3][2]
    assert run()[0][1] == "SHADOW" and run(shadow_mode=False, human_approval=True)[0][1] == "HUMAN_APPROVAL"


def test_fp_risk(spark):
    rows = [(1, False, False, 1), (2, False, False, 0), (3, False, True, 3), (4, True, False, 0)]
    df = spark.createDataFrame(rows, "log_id int, in_cooldown boolean, correlated boolean, prior int").withColumn("confidence_score", F.lit(1.0))
    got = {r.log_id: round(r.fp_risk, 6) for r in decisions.fp_risk(df).collect()}
    assert got == {1: 0.4, 2: 0.6, 3: 0.0, 4: 0.9}


def test_validation(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    scores = spark.createDataFrame([("a", at(-10), 1, 0.8), ("a", at(30), 2, 0.2), ("b", at(-10), 3, 0.8), ("b", at(60), 4, 0.75), ("b", at(61), 5, 0.0), ("c", at(0), 6, 0.9)], "source_ip string, ts timestamp, log_id bigint, combined double")
    actions = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(0)), (3, "c", at(0)), (4, "none", at(0))], "action_id bigint, target_ip string, executed_at timestamp")
    got = {r.action_id: (round(r.delta, 6), r.success, r.attack_resumed) for r in validation.validate_actions(actions, scores).collect()}
    assert got == {1: (0.6, True, False), 2: (0.05, False, True), 3: (0.9, True, False), 4: (0.0, False, False)}


def test_window_metrics_and_impact(spark):
    at = T0
    v = spark.createDataFrame([(at, True)] * 8, "executed_at timestamp, success boolean")
    fb = spark.createDataFrame([(1, at, True), (2, at, True)], "log_id bigint, created_at timestamp, was_false_positive boolean")
    sh = spark.createDataFrame([(at, "BLOCK")], "timestamp timestamp, would_have_taken_action string")
    ac = spark.createDataFrame([(at, "BLOCK", "x", 10), (at, "BLOCK", "y", 10)], "executed_at timestamp, action_type string, target_ip string, execution_time_ms int")
    row = validation.window_metrics(v, fb, sh, ac).first()
    assert row.precision == 0.8 and abs(row.recall - 8 / 9) < 1e-12 and row.avg_latency_ms == 10
    threats = spark.createDataFrame([(i, at, "BLOCK") for i in range(10)], "log_id bigint, created_at timestamp, action_taken string")
    day = validation.daily_impact(ac, threats, fb.where("false")).first()
    assert (day.requests_blocked, day.cost_saved_usd, round(day.analyst_hours_saved, 6)) == (1000, 1.0, 0.83)


def test_retrain_on_false_positive_rate(spark):
    fb = spark.createDataFrame([], "log_id bigint, created_at timestamp")
    metrics = spark.createDataFrame([(T0, 0.2)], "window_start timestamp, false_positive_rate double")
    assert adapt.retrain_trigger(fb, metrics, F.lit(T0)).first().retrain


def test_approval_and_rollback(spark):
    queue = spark.createDataFrame([(1, "a", "BLOCK", "PENDING", T0 + timedelta(minutes=5)), (2, "b", "BLOCK", "PENDING", T0 + timedelta(minutes=5))],
                                  "log_id bigint, source_ip string, proposed_action string, status string, expires_at timestamp")
    seen = spark.createDataFrame([(1, "analyst_1", T0 + timedelta(minutes=1), True), (2, "analyst_1", T0 + timedelta(minutes=6), True)], "log_id bigint, reviewer string, reviewed_at timestamp, approved boolean")
    done = approvals.expire(approvals.review(queue, seen), F.lit(T0 + timedelta(minutes=10)))
    assert {r.log_id: (r.status, r.reviewed_by) for r in done.collect()} == {1: ("APPROVED", "analyst_1"), 2: ("EXPIRED", None)}
    assert approvals.approved_actions(done).first().target_ip == "a"
    rep = spark.createDataFrame([("a", True), ("b", True)], "ip_address string, is_blocked boolean")
    act = spark.createDataFrame([(1, "a")], "action_id bigint, target_ip string")
    records = response.rollback(act, rep, "HUMAN", "test", F.lit(T0))
    assert records.first().was_successful
    assert {r.ip_address: r.is_blocked for r in response.unblock(rep, records).collect()} == {"a": False, "b": True}


def test_allowlist(spark):
    entries = spark.createDataFrame([("CIDR", "10.1.0.99/24", True), ("CIDR", "10.2.0.0/31", True), ("CIDR", "10.3.0.7/32", True), ("CIDR", "2001:db8::/33", True),
                                     ("CIDR", "bad/8", True), ("IP", "nope", True), ("IP", "1.1.1.1", True), ("CIDR", "9.0.0.0/8", False)], "entry_type string, value string, is_active boolean")
    ips = ["10.1.0.200", "10.1.1.0", "10.2.0.1", "10.2.0.2", "10.3.0.7", "10.3.0.8", "2001:db8:7fff::1", "2001:db8:8000::1", "nope", "1.1.1.1", "9.1.1.1", "256.1.1.1", "8.8.8.8"]
    got = {r[0] for r in allowlist.trusted_sources(spark.createDataFrame([(i,) for i in ips], "source_ip string"), entries, Config(trusted_ips=("8.8.8.8",))).collect()}
    assert got == {"10.1.0.200", "10.2.0.1", "10.3.0.7", "2001:db8:7fff::1", "1.1.1.1", "8.8.8.8"}
    every = spark.createDataFrame([("CIDR", "0.0.0.0/0", True)], "entry_type string, value string, is_active boolean")
    assert allowlist.trusted_sources(spark.createDataFrame([("1.2.3.4",), ("::1",)], "source_ip string"), every).count() == 1


def test_threshold_path_hits_both_bounds(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(900):
        up = (i // 200) % 2 == 0
        rows.append((i, T0 + timedelta(seconds=at), rng.choice(["HIGH", "MEDIUM"]), 20 if up or rng.random() < 0.1 else -10))
        at += rng.randrange(60)
    part = adapt.UNIT // 10_000
    steps = spark.createDataFrame([(i, t, level, step * part) for i, t, level, step in rows], "log_id bigint, created_at timestamp, level string, step bigint")
    narrow = {"HIGH": (0.60, 0.70), "MEDIUM": (0.45, 0.55)}
    for skew in (SkewConfig(), SkewConfig(shares=30, min_rows=10, cell_us=1_800_000_000)):
        got = {r.log_id: (r.old_threshold, r.new_threshold) for r in adapt.threshold_path(steps, Config(bounds=narrow, skew=skew)).collect()}
        value, seen = {"HIGH": 6500, "MEDIUM": 5000}, set()
        for i, _, level, step in sorted(rows, key=lambda r: (r[1], r[0])):
            low, high = (round(b * 10000) for b in narrow[level])
            old, value[level] = value[level], min(max(value[level] + step, low), high)
            seen.add(value[level] in (low, high) and value[level])
            assert got[i] == (old / 10000, value[level] / 10000)
        assert {6000, 7000} & seen


def test_small_learning_rates_move_thresholds(spark):
    threats = spark.createDataFrame([(i, "BLOCK") for i in range(1000)], "log_id bigint, action_taken string")
    feedback = spark.createDataFrame([(i, True, T0 + timedelta(seconds=i)) for i in range(1000)], "log_id bigint, was_false_positive boolean, created_at timestamp")
    cfg = Config(ema_alpha=1e-7)
    last = adapt.threshold_path(adapt.feedback_steps(feedback, threats, cfg), cfg).orderBy(F.desc("created_at")).first()
    assert last.new_threshold == 0.65 + 2e-6


def test_composed_steps():
    rng = random.Random(9)
    for n in (1, 2, 7, 64, 100):
        shift = np.array([rng.randrange(-40, 40) for _ in range(n)])
        low = np.array([rng.randrange(0, 30) for _ in range(n)])
        high = low + np.array([rng.randrange(0, 60) for _ in range(n)])
        s, lo, hi = adapt.compose_steps(shift, low, high)
        for x in (-100, 0, 17, 100):
            value = x
            for k in range(n):
                value = min(max(value + shift[k], low[k]), high[k])
                assert min(max(x + s[k], lo[k]), hi[k]) == value


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(shares=20, min_rows=5, cell_us=60_000_000)])
def test_similar_cases_brute_force(spark, skew):
    """Every probe's own time, ties in time, scores at both ends, and (second run) cells cut into time slots."""
    rng = random.Random(5)
    rows = [(i, rng.choice([round(rng.random(), 4), 0.0, 1.0, 0.5]), T0 + timedelta(seconds=rng.randrange(500)), "BLOCK", None) for i in range(400)]
    cases = spark.createDataFrame(rows, "log_id bigint, confidence_score double, created_at timestamp, action_taken string, agent_reasoning string")
    got = {}
    for r in memory.similar_cases(cases.select("log_id", "created_at", "confidence_score"), cases, cfg=Config(skew=skew)).orderBy("log_id", "rank").collect():
        got.setdefault(r.log_id, []).append(r.case_id)
    for i, s, at, _, _ in rows:
        near = sorted(((t, j) for j, s2, t, _, _ in rows if t < at and abs(round(s * 10000) - round(s2 * 10000)) <= 500), reverse=True)[:5]
        assert got.get(i, []) == [j for _, j in near]


def test_similar_cases_of_a_slot():
    """Scores that are rare among thousands of others: the newest of them are far back, or there are none."""
    rng = np.random.default_rng(3)
    unit = np.where(rng.random(3000) < 0.01, rng.integers(0, 10_001, 3000), rng.integers(4000, 4100, 3000)).tolist()
    at = (np.arange(3000) // 3).tolist()
    cases = [{"ask": False, "at": t, "id": i, "unit": u, "action": "BLOCK", "confidence": u / 10_000, "was_false_positive": False} for i, (t, u) in enumerate(zip(at, unit))]
    probes = [{"ask": True, "at": t, "id": i, "unit": u} for i, (t, u) in enumerate(zip(at, unit))]
    kind = pa.schema([("ask", pa.bool_()), ("at", pa.int64()), ("id", pa.int64()), ("unit", pa.int32()), ("action", pa.string()), ("confidence", pa.float64()), ("was_false_positive", pa.bool_())])
    for reach in (0, 500, 10_000):
        got = {}
        for r in memory._newest_in_reach(5, reach)(pa.Table.from_pylist(cases + probes, kind)).to_pylist():
            got.setdefault(r["log_id"], []).append((r["rank"], r["case_id"]))
        for i, (t, u) in enumerate(zip(at, unit)):
            near = [j for j in range(at.index(t) - 1, -1, -1) if abs(unit[j] - u) <= reach][:5] if u < 4000 or u >= 4100 or i % 50 == 0 else None
            assert near is None or got.get(i, []) == list(enumerate(near, 1))


@pytest.mark.parametrize("sizes", [memory.CELLS, response.PHASES])
def test_cells_cover_each_range_once(spark, sizes):
    ranges = [(0, 10_000), (0, 0), (9_500, 10_000), (1, 1_001), (255, 256), (1_023, 2_047), (3, 900)]
    df = spark.createDataFrame(ranges, "a bigint, b bigint").withColumns({"cells": range_cells(F.col("a"), F.col("b"), sizes), "own": cells_of(F.col("b"), sizes)})
    for r in df.collect():
        units = [u for size, at in (map(int, c.split(":")) for c in r.cells) for u in range(size * at, size * (at + 1))]
        assert sorted(units) == list(range(r.a, r.b + 1)) and len(r.cells) < 60
        assert len(set(r.own) & set(r.cells)) == 1


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(shares=20, min_rows=5, cell_us=600_000_000)])
def test_first_cool_checks_brute_force(spark, skew):
    """Cool runs shorter than the time between checks, which a block's checks may miss, ties in time, sources without scores."""
    rng, every = random.Random(11), 600
    scores = [(i, rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(20_000)), rng.choice([0.1, 0.9, 0.9])) for i in range(160)]
    scores += [(300 + i, "d", T0 + timedelta(seconds=i), 0.9) for i in range(3)]
    scores += [(200 + i, "c", T0 + timedelta(seconds=100), 0.9 - 0.8 * (i % 2)) for i in range(6)]
    actions = [(i, rng.choice("abbcdz"), rng.choice(["BLOCK", "BLOCK", "ALERT"]), T0 + timedelta(seconds=rng.randrange(20_000), microseconds=rng.randrange(3))) for i in range(120)]
    now = T0 + timedelta(seconds=22_000)
    found = response.first_cool_checks(
        spark.createDataFrame(actions, "action_id bigint, target_ip string, action_type string, executed_at timestamp"),
        spark.createDataFrame(scores, "log_id bigint, source_ip string, ts timestamp, combined double"), F.lit(now), Config(skew=skew, auto_rollback_minutes=10))
    wanted = {}
    for i, ip, kind, at in actions:
        if kind == "BLOCK":
            checks = max(1, (now - at) // timedelta(seconds=every))
            for k in range(1, checks + 1):
                last = sorted((t, j, s) for j, source, t, s in scores if source == ip and t <= at + timedelta(seconds=k * every))[-5:]
                if not last or sum(s for _, _, s in last) / len(last) < 0.65:
                    wanted[i] = (checks, k)
                    break
            else:
                wanted[i] = (checks, None)
    assert {r.action_id: (r.checks, r.ended) for r in found.collect()} == wanted
    assert any(k is None for _, k in wanted.values()) and any((k or 0) > 2 for _, k in wanted.values())


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.85, 0.0, "inf", None), (0.8, 2.0, "abc", "x")], "s double, d double, t string, p string")
    a, b = df.select(S.risk_level("s").alias("detect"), S.risk_level("s", "ensemble").alias("ens"), S.packet_rate(F.lit(4), "d").alias("rate"),
                     S.number_or("t").alias("n"), S.protocol_anomaly("p").alias("p"), S.time_of_day(F.lit("junk")).alias("tod")).collect()
    assert tuple(a) == ("CRITICAL", "CRITICAL", 4.0, 0.0, 0.0, 0.5)
    assert tuple(b) == ("HIGH", "HIGH", 2.0, 0.0, 1.0, 0.5)
    S.register(spark)
    assert spark.sql("select risk_level(0.4e0, 'detect'), packet_rate(4, 0e0), ipv4_number('1.0.0.1')").first()[:] == ("MEDIUM", 4.0, 16777217)


def test_attack_patterns(spark):
    rows, n = [], 0
    def add(ip, gaps, score, ports):
        nonlocal n
        at = T0
        for i, g in enumerate(gaps):
            at += timedelta(seconds=g)
            rows.append((n, ip, at, score, ports[i % len(ports)]))
            n += 1
    add("scan", [1] * 12, 0.9, list(range(1, 13)))
    add("slow", [300] * 20, 0.2, [80])
    add("ddos", [100] * 5 + [10] * 5, 0.9, [80])
    add("few", [1] * 4, 0.9, [80])
    add("plain", [10] * 10, 0.9, [80])
    df = spark.createDataFrame(rows, "log_id bigint, source_ip string, ts timestamp, score double, dest_port int")
    assert {r.source_ip: r.pattern for r in memory.attack_pattern(df).collect()} == {"scan": "port_scan", "slow": "slow_burn", "ddos": "ddos_buildup", "few": None, "plain": None}


def test_rollback_checks_again(spark):
    """Hot at thirty minutes: extended; cool at sixty: rolled back, and not checked any more."""
    from datetime import datetime, timedelta

    from threatlake.operators.response import auto_rollback

    t0 = datetime(2024, 1, 1)
    actions = spark.createDataFrame([(1, "a", "BLOCK", t0), (2, "a", "RATE_LIMIT", t0), (3, "b", "BLOCK", t0)], "action_id bigint, target_ip string, action_type string, executed_at timestamp")
    scores = spark.createDataFrame(
        [(k, "a", t0 + timedelta(minutes=k), 0.9) for k in range(10)] + [(20 + k, "a", t0 + timedelta(minutes=40 + k), 0.1) for k in range(5)] + [(40, "b", t0 + timedelta(minutes=5), 0.2)],
        "log_id bigint, source_ip string, ts timestamp, combined double")
    found = auto_rollback(actions, scores, F.lit(t0 + timedelta(hours=3))).orderBy("action_id", "check").collect()
    assert [(r.action_id, r.check, r.outcome) for r in found] == [(1, 1, "EXTEND"), (1, 2, "ROLLBACK"), (3, 1, "ROLLBACK")]


def test_codes_of_many_values_with_one_prefix(spark):
    """A hundred thousand values that begin alike are spread over tasks; codes stay when values arrive."""
    values = spark.range(100_000).select(F.format_string("http://host/%06d", F.col("id") * 7 % 100_000).alias("v"))
    some = cleaning.category_codes(values.where("v < 'http://host/050000' or v is null"), "v")
    codes = {r.v: r.code for r in some.collect()}
    assert codes == {f"http://host/{k:06d}": k for k in range(50_000)}
    ranked = cleaning._ranked(values, "v")
    assert ranked.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count")).first()[0] < 50_000
    grown = {r.v: r.code for r in cleaning.grown_codes(some, values.unionByName(spark.createDataFrame([(None,), ("a",)], "v string")), "v").collect()}
    assert {v: grown[v] for v in codes} == codes
    assert grown["a"] == 50_000 and grown["http://host/050000"] == 50_001 and grown["nan"] == len(grown) - 1 == 100_001
    assert cleaning.grown_codes(some, values.limit(0), "v").count() == 50_000


def test_balanced_sample_shuffles_few_rows(spark):
    rows = spark.range(50_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit("payload").alias("x"))
    sample = cleaning.balanced_sample(rows, "label", "id", 200)
    assert sorted(r["count"] for r in sample.groupBy("label").count().collect()) == [100, 100]
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    drawn = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(0, 50_000, 10))[:100]
    assert {r.id for r in sample.where("label = 1").collect()} == {i for _, i in drawn}
