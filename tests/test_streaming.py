"""Streams give the same rows as the batch operators on the same input."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threatlake.operators import validation
from threatlake.operators.features import ip_share
from threatlake.operators.running import HotKeys, micros
from threatlake.config import Config
from threatlake.plans import load_queries
from threatlake.plans.derived import Derived
from threatlake.streaming import late, pipeline, sources

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def d(spark, sf_dir):
    return Derived(spark, sf_dir, Config(hot=HotKeys()))


def as_stream(spark, df, path, ts="ts", files=3):
    """Write ``df`` as a few files in time order and read them as a stream, one per micro-batch."""
    cuts = df.select(F.percentile_approx(micros(ts), [i / files for i in range(1, files)]).alias("c")).first().c if files > 1 else []
    edges = [-(2**62), *cuts, 2**62]
    for i in range(files):
        part = df.where((micros(ts) > edges[i]) & (micros(ts) <= edges[i + 1])).coalesce(1)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp, name, mode="append"):
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/{name}-ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name), query


def late_marker(df, **values):
    """One far-future row that moves the watermark past everything else."""
    marker = df.limit(1).withColumns({"ts": F.lit(T0 + timedelta(days=60)), **{k: F.lit(v) for k, v in values.items()}})
    return df.unionByName(marker)


def test_scoring_and_windows(spark, d, tmp_path):
    shares = ip_share(d.flows, d.cfg).select("source_ip", "ip_share").distinct()
    got, _ = run(pipeline.score(as_stream(spark, d.flows, f"{tmp_path}/flows"), shares).select("log_id", "combined", "risk_level"), tmp_path, "scored")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in d.scores.select("log_id", "combined", "risk_level").collect()}

    slim = d.scores.select("log_id", "source_ip", "ts", "combined", "risk_level")
    stream = as_stream(spark, late_marker(slim, risk_level="LOW"), f"{tmp_path}/scores")
    got, _ = run(pipeline.window_activity(stream), tmp_path, "windows")
    want = slim.groupBy(F.window("ts", "15 minutes").start.alias("w")).agg(F.count("*"), F.count_if(F.col("risk_level") != "LOW"), F.max("combined"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    sliding, _ = run(pipeline.window_activity(spark.readStream.schema(slim.schema).parquet(f"{tmp_path}/scores"), "5 minutes", "1 minute"), tmp_path, "sliding")
    assert sliding.agg(F.sum("flows")).first()[0] == 5 * slim.count()


def test_spans_and_first_blocks(spark, d, tmp_path):
    base = d.flows_raw.select("source_ip", "ts")
    got, _ = run(pipeline.activity_spans(as_stream(spark, late_marker(base), f"{tmp_path}/raw")), tmp_path, "spans")
    want = base.groupBy("source_ip", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("source_ip", F.col("w.start"), F.col("w.end"), "n")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}

    rows = [(1, "a", "BLOCK", T0), (2, "a", "BLOCK", T0 + timedelta(minutes=1)), (3, "b", "ALERT", T0), (4, "b", "BLOCK", T0 + timedelta(minutes=2))]
    actions = spark.createDataFrame(rows, "action_id bigint, target_ip string, action_type string, ts timestamp")
    actions.coalesce(1).write.parquet(f"{tmp_path}/acts")
    got, _ = run(pipeline.first_blocks(spark.readStream.schema(actions.schema).parquet(f"{tmp_path}/acts")), tmp_path, "blocks")
    assert sorted((r.target_ip, r.action_id) for r in got.collect()) == [("a", 1), ("b", 4)]


def test_open_spans_are_listed(spark, d, sf_dir):
    """Every flow is in a span, those of spans that are open when the input ends too."""
    found = load_queries()["g7_activity_spans"](spark, sf_dir)
    assert found.agg(F.sum("events")).first()[0] == d.flows_raw.count()
    assert found.agg(F.max("inactive_from")).first()[0] == d.flows_raw.agg(F.max(micros("ts"))).first()[0] + 7_200_000_000


def test_first_blocks_last(spark, tmp_path):
    """Half an hour between micro-batches, far past the watermark: a target is blocked once."""
    for k in range(4):
        rows = [(10 + k, "a", "BLOCK", T0 + timedelta(minutes=30 * k)), (20 + k, f"t{k}", "BLOCK", T0 + timedelta(minutes=30 * k))]
        spark.createDataFrame(rows, "action_id bigint, target_ip string, action_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/acts")
    schema = spark.read.parquet(f"{tmp_path}/acts").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/acts")
    got, _ = run(pipeline.first_blocks(stream), tmp_path, "once")
    assert sorted((r.target_ip, r.action_id) for r in got.collect()) == [("a", 10), ("t0", 20), ("t1", 21), ("t2", 22), ("t3", 23)]


@pytest.mark.parametrize("files", [1, 3, 10])
def test_decisions_follow_own_memory(spark, d, tmp_path, files):
    """The same decisions however the rows are dealt to micro-batches."""
    slim = d.scores.withColumn("stage", F.lit(None).cast("string")).select("log_id", "source_ip", "ts", "combined", "stage")
    got, _ = run(pipeline.decide(as_stream(spark, late_marker(slim, source_ip="marker", combined=0.0), f"{tmp_path}/s", files=files)), tmp_path, f"decisions{files}")
    rows, memory, want = sorted(slim.collect(), key=lambda r: (r.ts, r.log_id)), {}, {}
    for r in rows:  # sequential restatement
        m = memory.setdefault(r.source_ip, {"seen": [], "alert": None, "n": 0, "rep": 100})
        m["seen"].append(r.ts)
        if r.combined <= 0.65:
            continue
        correlated = sum(t >= r.ts - timedelta(seconds=300) for t in m["seen"]) >= 3
        cooling = m["alert"] is not None and r.ts - timedelta(seconds=600) <= m["alert"] < r.ts
        risk = min(0.3 * cooling + 0.4 * (not correlated) + 0.2 * (m["n"] == 0), 0.9)
        f = min(max(r.combined * (1 - risk), 0), 1)
        action = "BLOCK" if f >= 0.8 else "RATE_LIMIT" if f >= 0.65 else "ALERT" if f >= 0.5 else "MONITOR"
        if action in ("BLOCK", "RATE_LIMIT") and f <= 0.9 and m["n"] < 2:
            action = {"BLOCK": "RATE_LIMIT", "RATE_LIMIT": "ALERT"}[action]
        m["rep"] = max(m["rep"] - {"BLOCK": 50, "RATE_LIMIT": 25}.get(action, 0), 0)
        want[r.log_id] = (m["n"], cooling, correlated, action, m["rep"] / 100)
        m["n"] += 1
        if action != "MONITOR":
            m["alert"] = r.ts
    assert {r.log_id: (r.prior, r.in_cooldown, r.correlated, r.action, r.reputation) for r in got.collect()} == want


def test_rows_wait_for_earlier_ones(spark, tmp_path):
    """A row that arrives in a later micro-batch than a later row of its source is still taken first."""
    at = lambda k: T0 + timedelta(seconds=k)
    files = [[(1, "a", at(100), 0.9, None), (2, "a", at(30), 0.9, None)], [(3, "a", at(20), 0.9, None), (4, "a", at(400), 0.9, None)], [(5, "a", at(250), 0.9, None), (9, "x", at(5000), 0.0, None)]]
    schema = "log_id bigint, source_ip string, ts timestamp, combined double, stage string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got, _ = run(pipeline.decide(stream, Config(watermark_seconds=500)), tmp_path, "waiting")
    assert [(r.log_id, r.prior, r.correlated) for r in got.orderBy("ts").collect()] == [(3, 0, False), (2, 1, False), (1, 2, True), (5, 3, True), (4, 4, True)]


def test_validation_parts(spark, d, tmp_path):
    scores = d.scores.select("log_id", "source_ip", "ts", "combined")
    actions = d.actions.select("action_id", "target_ip", F.col("executed_at").alias("ts"))
    s = as_stream(spark, late_marker(scores, source_ip="marker"), f"{tmp_path}/s")
    a = as_stream(spark, late_marker(actions, target_ip="marker"), f"{tmp_path}/a")
    got, _ = run(pipeline.scores_after(a, s), tmp_path, "parts")
    got = pipeline.combine_parts(got.where(F.col("action_id").isin([r[0] for r in actions.select("action_id").collect()])))
    want = validation.scores_after(d.actions, d.scores, cfg=d.cfg).select("action_id", "n_after", "units_after", F.round("max_after", 9))
    extra = actions.limit(1).first().action_id  # the marker carries this id to a source of its own
    a_rows = {tuple(r) for r in got.select("action_id", "n_after", "units_after", F.round("max_after", 9)).collect() if r.action_id != extra}
    assert a_rows == {tuple(r) for r in want.collect() if r.action_id != extra}


def test_validation_blocks_by_hand(spark, tmp_path):
    """Parts by the engine's own aggregation (no Python call for each block), against pairs formed by hand."""
    at = lambda k: T0 + timedelta(seconds=k)
    facts = [(k, f"s{k * k % 7}", at(k * 11 % 3000), k % 97 / 97) for k in range(900)]
    asks = [(k, f"s{k % 8}", at(k * 37 % 2900)) for k in range(200)] + [(500, "s1", at(60)), (501, "nobody", at(119))]
    scores = spark.createDataFrame([*facts, (9999, "end", at(90_000), 0.1)], "log_id bigint, source_ip string, ts timestamp, combined double")
    actions = spark.createDataFrame([*asks, (9999, "end", at(90_000))], "action_id bigint, target_ip string, ts timestamp")
    got, query = run(pipeline.scores_after(as_stream(spark, actions, f"{tmp_path}/a"), as_stream(spark, scores, f"{tmp_path}/s")), tmp_path, "by_hand")
    assert query.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"
    found = {r.action_id: (r.n_after, r.units_after, r.max_after) for r in pipeline.combine_parts(got).collect()}
    want = {}
    for k, source, t in asks:
        own = [v for _, s, x, v in facts if s == source and t < x <= t + timedelta(seconds=60)]
        want[k] = (len(own), sum(round(v * 1e12) for v in own), max((round(v * 1e12) / 1e12 for v in own), default=None))
    assert found == want


def test_approval_timers(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    queue = spark.createDataFrame([(1, m(0), m(5)), (2, m(0), m(5)), (3, m(1), m(6)), (9, m(9000), m(9005))], "log_id bigint, ts timestamp, expires_at timestamp")
    reviews = spark.createDataFrame([(1, m(3), True), (2, m(7), True), (3, m(4), False), (8, m(9000), True)], "log_id bigint, ts timestamp, approved boolean")
    got, _ = run(pipeline.approval_outcomes(as_stream(spark, queue, f"{tmp_path}/q", files=2), as_stream(spark, reviews, f"{tmp_path}/r", files=2)), tmp_path, "outcomes")
    assert {r.log_id: r.status for r in got.collect() if r.log_id < 8} == {1: "APPROVED", 2: "EXPIRED", 3: "REJECTED"}


def test_approvals_share_states(spark, tmp_path, monkeypatch):
    """Many approvals are a few states, with the outcome of each by hand: in time, late, in a later micro-batch, none."""
    monkeypatch.setattr(pipeline, "_APPROVAL_PARTS", 8, raising=False)
    at = lambda k: T0 + timedelta(seconds=k)
    queue = [(k, at(k), at(k + 300)) for k in range(400)]
    reviews = [(k, at(k + k % 5 * 100), k % 3 == 0) for k in range(400) if k % 7] + [(k, at(k + 290), True) for k in range(0, 400, 2)]
    q = spark.createDataFrame([*queue, (9999, at(90_000), at(90_300))], "log_id bigint, ts timestamp, expires_at timestamp")
    r = spark.createDataFrame([*reviews, (9998, at(90_000), True)], "log_id bigint, ts timestamp, approved boolean")
    got, query = run(pipeline.approval_outcomes(as_stream(spark, q, f"{tmp_path}/q"), as_stream(spark, r, f"{tmp_path}/r")), tmp_path, "shared")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
    want = {}
    for k, _, end in queue:
        own = min(((t, yes) for i, t, yes in reviews if i == k and t < end), default=None)
        want[k] = (("APPROVED" if own[1] else "REJECTED"), own[0]) if own else ("EXPIRED", end)
    assert {x.log_id: (x.status, x.decided_at.replace(tzinfo=timezone.utc)) for x in got.collect()} == want


def test_auto_rollback_rearms(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    scores = spark.createDataFrame([(i, "hot", m(i), 0.9) for i in range(0, 32)] + [(100 + i, "hot", m(31 + i), 0.1) for i in range(1, 20)] + [(200, "cool", m(0), 0.1), (999, "x", m(9000), 0.1)],
                                   "log_id bigint, source_ip string, ts timestamp, combined double")
    actions = spark.createDataFrame([(1, "hot", "BLOCK", m(0)), (2, "cool", "BLOCK", m(0)), (3, "x", "ALERT", m(9000))], "action_id bigint, target_ip string, action_type string, ts timestamp")
    got, _ = run(pipeline.auto_rollback(as_stream(spark, actions, f"{tmp_path}/a", files=2), as_stream(spark, scores, f"{tmp_path}/s", files=2)), tmp_path, "rollback")
    assert sorted((r.action_id, round((r.checked_at.replace(tzinfo=timezone.utc) - T0).total_seconds() / 60), r.outcome) for r in got.collect()) == [(1, 30, "EXTEND"), (1, 60, "ROLLBACK"), (2, 30, "ROLLBACK")]


def test_late_rows_are_counted(spark, tmp_path):
    rows = [("a", T0 + timedelta(hours=5), "HIGH", 0.7), ("a", T0 + timedelta(hours=6), "HIGH", 0.7), ("a", T0, "HIGH", 0.7)]
    schema = "source_ip string, ts timestamp, risk_level string, combined double"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late")
    _, query = run(pipeline.window_activity(stream), tmp_path, "late")
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_feed_and_event_log(spark, d, tmp_path):
    stream = as_stream(spark, d.flows.select("log_id", "ts", "source_ip"), f"{tmp_path}/f")
    sources.live_feed(stream, f"{tmp_path}/feed", f"{tmp_path}/feed-ck").awaitTermination(300)
    want = [r.log_id for r in d.flows.orderBy(F.desc("ts"), F.desc("log_id")).limit(50).collect()]
    assert [r.log_id for r in sources.read_feed(spark, f"{tmp_path}/feed").orderBy(F.desc("ts"), F.desc("log_id")).collect()] == want
    from threatlake.sources.sinks import envelopes

    events = envelopes(stream.withColumn("ip", F.col("source_ip")).withColumn("reason", F.lit("test")), "ip_blocked", "ts")
    sources.event_log(events, f"{tmp_path}/log", f"{tmp_path}/log-ck").awaitTermination(300)
    assert spark.read.json(f"{tmp_path}/log").count() == d.flows.count()


def test_update_sink_replaces_windows(spark, d, tmp_path):
    """Late changes of a window replace its row, a repeated micro-batch adds nothing, old windows leave the state."""
    slim = d.scores.select("log_id", "source_ip", "ts", "combined", "risk_level")
    stream = pipeline.window_activity(as_stream(spark, slim, f"{tmp_path}/s", files=5))
    query = sources.changed_rows(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(300)
    want = {tuple(r) for r in slim.groupBy(F.window("ts", "15 minutes").start).agg(F.count("*"), F.count_if(F.col("risk_level") != "LOW"), F.max("combined")).collect()}
    read = lambda: {tuple(r) for r in sources.read_changed(spark, f"{tmp_path}/out", stream.schema, ["window_start"]).collect()}
    assert read() == want
    changed = spark.read.parquet(f"{tmp_path}/out")
    assert len(want) < changed.count() < 3 * len(want)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    last = changed.agg(F.max("batch")).first()[0]
    kept = changed.where(F.col("batch") == last).drop("batch")
    spark.createDataFrame(kept.collect(), kept.schema).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={last}")
    assert read() == want


def test_replayed_tables_are_made_once(spark, tmp_path):
    """Each period is one file of its own rows; the rows are computed once and not again for each period, nor all in one task."""
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda k: made.add(1) or k, "bigint").asNondeterministic()
    minutes = [k for k in range(240) if not 100 <= k < 140]
    rows = spark.createDataFrame([(k, T0 + timedelta(minutes=k), T0 + timedelta(minutes=k + k % 3)) for k in minutes], "log_id bigint, ts timestamp, ended timestamp")
    stream = sources.replay_periods(rows.repartition(6).withColumn("log_id", count("log_id")), f"{tmp_path}/p", "ended", 20)
    assert stream.columns == ["log_id", "ts"] and made.value <= 2 * len(minutes)
    sizes = []
    stream.writeStream.foreachBatch(lambda b, _: sizes.append(sorted(r.log_id for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(300)
    want = [[k for k in minutes if (k + k % 3) // 20 == p] for p in range(13)]
    assert [s for s in sizes if s] == [w for w in want if w]


def test_late_rows_are_kept(spark, tmp_path):
    """Rows behind the watermark are split off, and the stream plus them is the batch."""
    rows = [[(1, "a", T0, "HIGH", 0.7), (2, "a", T0 + timedelta(hours=5), "HIGH", 0.8)], [(3, "a", T0 + timedelta(hours=4, minutes=55), "LOW", 0.1), (4, "b", T0 + timedelta(hours=2), "HIGH", 0.9)],
            [(5, "b", T0 + timedelta(hours=6), "LOW", 0.2), (6, "b", None, "LOW", 0.2)], [(7, "b", T0 + timedelta(hours=5, minutes=49), "LOW", 0.3), (8, "b", T0 + timedelta(hours=5, minutes=50), "LOW", 0.3)]]
    schema = "log_id bigint, source_ip string, ts timestamp, risk_level string, combined double"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late.split_late(stream, f"{tmp_path}/split", f"{tmp_path}/ck1").awaitTermination(300)
    missed = late.late_rows(spark, f"{tmp_path}/split", stream.schema)
    assert sorted(r.log_id for r in missed.collect()) == [4, 7]
    made = pipeline.window_activity(late.in_time(spark, f"{tmp_path}/split", stream.schema))
    query = sources.changed_rows(made, f"{tmp_path}/out", f"{tmp_path}/ck2")
    query.awaitTermination(300)
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 0
    found = late.reconcile(sources.read_changed(spark, f"{tmp_path}/out", made.schema, ["window_start"]), missed)
    every = spark.createDataFrame([r for part in rows for r in part], schema).where("ts is not null")
    want = every.groupBy(F.window("ts", "15 minutes").start).agg(F.count("*"), F.count_if(F.col("risk_level") != "LOW"), F.max("combined"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_block_rollback_only(spark, tmp_path):
    """As in the batch form, only blocks are checked."""
    m = lambda k: T0 + timedelta(minutes=k)
    scores = spark.createDataFrame([(1, "a", m(0), 0.1), (2, "b", m(0), 0.1), (9, "x", m(9000), 0.1)], "log_id bigint, source_ip string, ts timestamp, combined double")
    actions = spark.createDataFrame([(1, "a", "RATE_LIMIT", m(0)), (2, "b", "BLOCK", m(0)), (3, "x", "ALERT", m(9000))], "action_id bigint, target_ip string, action_type string, ts timestamp")
    got, _ = run(pipeline.auto_rollback(as_stream(spark, actions, f"{tmp_path}/a", files=2), as_stream(spark, scores, f"{tmp_path}/s", files=2)), tmp_path, "only")
    assert [r.action_id for r in got.collect()] == [2]


def test_rollback_shares_states(spark, tmp_path, monkeypatch):
    """Many sources are a few states, with the checks of each block by hand."""
    monkeypatch.setattr(pipeline, "_SOURCE_PARTS", 8, raising=False)
    us = lambda t: (t - T0) // timedelta(microseconds=1)
    at = lambda k: T0 + timedelta(seconds=k, microseconds=k % 3)
    facts = [(k, f"s{k * k % 61}" if k % 50 else None, at(k * 17 % 9000), (k * 7 % 100) / 100 if k % 61 % 3 else 0.9) for k in range(3000)]
    asks = [(k, f"s{k % 62}" if k % 40 else None, "ALERT" if k % 4 == 1 else "BLOCK", at(k * 29 % 8000)) for k in range(300)]
    scores = spark.createDataFrame([*facts, (9999, "end", at(8000), None), (9998, "end", at(9000), 0.1)], "log_id bigint, source_ip string, ts timestamp, combined double")
    actions = spark.createDataFrame([*asks, (9999, "end", "ALERT", at(9000))], "action_id bigint, target_ip string, action_type string, ts timestamp")
    got, query = run(pipeline.auto_rollback(as_stream(spark, actions, f"{tmp_path}/a"), as_stream(spark, scores, f"{tmp_path}/s")), tmp_path, "parts")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
    end, want = us(min(max(t for _, _, t, _ in [*facts, (0, "", at(9000), 0)]), at(9000))) // 1000 - 600_000, {}
    for k, source, kind, t in asks:
        when = us(t) + 1_800_000_000
        while kind == "BLOCK" and when // 1000 + 1 < end:
            own = [v for _, _, v in sorted((x, i, v) for i, s, x, v in facts if s == source and us(x) <= when)][-5:]
            mean = sum(own) / len(own) if own else 0.0
            want[k, when] = round(mean, 9), "EXTEND" if mean >= 0.65 else "ROLLBACK"
            when = when + 1_800_000_000 if mean >= 0.65 else 2**62
    assert {(r.action_id, us(r.checked_at.replace(tzinfo=timezone.utc))): (round(r.recent_mean, 9), r.outcome) for r in got.collect()} == want
    assert {o for _, o in want.values()} == {"EXTEND", "ROLLBACK"} and any(k % 40 == 0 for k, _ in want)


def test_decisions_share_states(spark, d, tmp_path, monkeypatch):
    """Many sources are a few states; how many doesn't change a decision. Rows without a source are one, rows without a time are left out."""
    slim = d.scores.select("log_id", F.expr("nullif(source_ip, '10.0.0.3')").alias("source_ip"), "ts", "combined", F.lit(None).cast("string").alias("stage"))
    rows = late_marker(slim, source_ip="marker", combined=0.0).unionByName(slim.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    found = []
    for parts in (8, 500):
        monkeypatch.setattr(pipeline, "_SOURCE_PARTS", parts, raising=False)
        stream = as_stream(spark, rows.withColumn("at", F.coalesce("ts", F.lit(T0))), f"{tmp_path}/s{parts}", "at")
        got, query = run(pipeline.decide(stream), tmp_path, f"parts{parts}")
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= parts
        found.append({tuple(r) for r in got.collect()})
    assert found[0] == found[1] and len(found[0]) == slim.where("combined > 0.65").count()
    assert any(r[1] is None for r in found[0])


def test_silent_sources_are_forgotten(spark, tmp_path):
    """After ``memory_days`` of silence a source starts anew, while another of its part goes on."""
    at = lambda h: T0 + timedelta(hours=h)
    files = [[(1, "a", at(0), 0.9), (2, "b", at(0), 0.9)], [(3, "b", at(20), 0.9)], [(4, "b", at(40), 0.9)], [(5, "b", at(41), 0.9)], [(6, "a", at(42), 0.9), (7, "b", at(43), 0.9)], [(9, "x", at(50), 0.0)]]
    schema = "log_id bigint, source_ip string, ts timestamp, combined double"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("stage", F.lit(None).cast("string"))
    got, _ = run(pipeline.decide(stream, Config(memory_days=1)), tmp_path, "silent")
    assert [(r.log_id, r.prior) for r in got.orderBy("log_id").collect()] == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, 0), (7, 4)]
