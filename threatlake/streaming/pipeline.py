"""Streaming forms of the detection loop.

Event time is ``ts``; rows more than ``Config.watermark_seconds`` late are dropped by the engine and
counted in the query progress (``numRowsDroppedByWatermark``); :mod:`threatlake.streaming.late` splits
them off beforehand and keeps them. The stateless operators of the batch side are used unchanged;
only memory per source needs keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threatlake.config import DEFAULT, Config
from threatlake.functions.scalars import ratio, session_heuristic
from threatlake.operators.killchain import classify_stage, stage_multiplier
from threatlake.operators.response import REPUTATION_STEP
from threatlake.operators.scoring import fallback_scores
from threatlake.operators.validation import detection_quality



def marked(stream: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return stream.withWatermark("ts", f"{cfg.watermark_seconds} seconds")


def lists_in_state(stream: DataFrame) -> None:
    """Large state is held in the engine's embedded store, on disk."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def wake_at(us: np.ndarray) -> np.ndarray:
    """The first millisecond after each time; what has woken is past when the watermark is beyond it."""
    return us // 1000 + 1


# --- stateless scoring -----------------------------------------------------------------------
def score(stream: DataFrame, shares: DataFrame) -> DataFrame:
    """Score and stage every arriving flow.

    ``shares`` is the traffic share per source from the last batch run (a table, re-read by each
    micro-batch); a source it does not know has share 0.
    """
    joined = stream.join(shares.select("source_ip", "ip_share"), "source_ip", "left")
    ready = joined.withColumns({
        "ip_share": F.coalesce("ip_share", F.lit(0.0)),
        "session_deviation": session_heuristic("duration_seconds", "bytes_sent"),
        "request_rate": F.coalesce("request_rate", F.lit(0.0)),
    })
    return classify_stage(fallback_scores(ready))


# --- windows ------------------------------------------------------------------------------------
def window_activity(scored: DataFrame, width: str = "15 minutes", slide: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Counts, flagged flows and the top score per tumbling or sliding window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        marked(scored, cfg).groupBy(window.alias("w"))
        .agg(F.count("*").alias("flows"), F.count_if(F.col("risk_level") != "LOW").alias("flagged"), F.max("combined").alias("max_score"))
        .select(F.col("w.start").alias("window_start"), "flows", "flagged", "max_score")
    )


def quality_events(validations: DataFrame, feedback: DataFrame, shadow: DataFrame, actions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Four streams as one of ``(ts, tp, fp, fn, lat_sum, lat_n)``, each with its own watermark; the slowest counts."""
    def rows(df: DataFrame, ts: str, **values) -> DataFrame:
        amounts = {c: F.lit(0).cast("bigint") for c in ("tp", "fp", "fn", "lat_sum", "lat_n")} | {n: e.cast("bigint") for n, e in values.items()}
        return marked(df.withColumn("ts", F.col(ts)), cfg).select("ts", *(e.alias(n) for n, e in amounts.items()))

    parts = [
        rows(validations, "executed_at", tp=F.col("success")), rows(feedback, "created_at", fp=F.col("was_false_positive")),
        rows(shadow, "timestamp", fn=F.col("would_have_taken_action").isin("BLOCK", "RATE_LIMIT")), rows(actions, "executed_at", lat_sum=F.col("execution_time_ms"), lat_n=F.lit(1))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def window_quality(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Detection metrics per 15 minutes from :func:`quality_events`."""
    sums = events.groupBy(F.window("ts", "15 minutes").alias("w")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "lat_sum", "lat_n")])
    quality = detection_quality(F.col("tp"), F.col("fp"), F.col("fn"), cfg.true_negatives)
    return sums.select(F.col("w.start").alias("window_start"), "tp", "fp", "fn", *[e.alias(n) for n, e in quality.items()], ratio("lat_sum", "lat_n").alias("avg_latency_ms"))


def activity_spans(events: DataFrame, gap: str = "2 hours", cfg: Config = DEFAULT) -> DataFrame:
    """Spans of activity per source; a span closes after two silent hours (the source is inactive)."""
    return (
        marked(events, cfg).groupBy(F.session_window("ts", gap).alias("w"), "source_ip").agg(F.count("*").alias("events"))
        .select("source_ip", F.col("w.start").alias("first_activity"), F.col("w.end").alias("inactive_from"), "events")
    )


def first_blocks(actions: DataFrame) -> DataFrame:
    """The first block of every target, for good: ``target_ip, action_id, first_blocked_at``.

    State is one mark for each target ever blocked. Of a micro-batch the earliest block counts; a
    block that arrives after another micro-batch's doesn't replace it.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            for _ in frames:
                pass
            return
        best = None
        for frame in frames:
            own = frame.sort_values(["us", "action_id"]).iloc[0]
            found = (int(own["us"]), int(own["action_id"]))
            best = found if best is None else min(best, found)
        if best:
            state.update((True,))
            yield pd.DataFrame({"target_ip": [key[0]], "action_id": [best[1]], "first_blocked_at": pd.to_datetime([best[0]], unit="us", utc=True)})

    slim = actions.where("action_type = 'BLOCK'").select("target_ip", "action_id", F.unix_micros("ts").alias("us"))
    return slim.groupBy("target_ip").applyInPandasWithState(
        step, "target_ip string, action_id bigint, first_blocked_at timestamp", "blocked boolean", "append", GroupStateTimeout.NoTimeout)


# --- memory per source -----------------------------------------------------------------------------
DECISIONS = (
    "log_id bigint, source_ip string, ts timestamp, combined double, prior bigint, in_cooldown boolean, correlated boolean, "
    "fp_risk double, final_score double, action string, reputation double"
)
#: Parts of the sources: each is one state, whose sources are taken together.
_SOURCE_PARTS = 2048
_NEVER = 2**62
_DAY_MS = 86_400_000


def _by_source(rows: DataFrame):
    """Rows in parts by source. A Python call and a state for each source would cost more than its rows."""
    return rows.withColumn("part", F.pmod(F.xxhash64("source_ip"), F.lit(_SOURCE_PARTS))).groupBy("part")


def _numbered(held: list[str], frames: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """All sources, those held first, and for each row of ``frames`` the number of its source."""
    whose = [f["source_ip"].to_numpy(object) for f in frames]
    numbers, names = pd.factorize(np.concatenate([np.array(held, object), *whose]), use_na_sentinel=False)
    return np.array([n if isinstance(n, str) else None for n in names], object), numbers[len(held):]


def _table(kind: np.dtype, who: np.ndarray, frames: list[pd.DataFrame]) -> np.ndarray:
    """Rows of ``frames`` as records; ``who`` is the number of each row's source."""
    out = np.empty(len(who), kind)
    out["who"] = who
    for c in kind.names[1:]:
        out[c] = np.concatenate([f[c].astype(kind[c]).to_numpy() for f in frames]) if frames else 0
    return out


def _held(state: GroupState, *kinds: np.dtype) -> list:
    """A part's state: its sources and tables of records."""
    names, *tables = state.get if state.exists else ([], *[b""] * len(kinds))
    return [list(names), *(np.frombuffer(t, k) for t, k in zip(tables, kinds))]


def _release(state: GroupState, names: np.ndarray, kept: np.ndarray, per_source: np.ndarray, *tables: np.ndarray) -> None:
    """Keep the sources ``kept``, numbered anew, with their rows of ``tables``; no row of ``tables`` is of another."""
    if not kept.any():
        if state.exists:
            state.remove()
        return
    number, out = np.cumsum(kept) - 1, []
    for t in tables:
        moved = t.copy()
        moved["who"] = number[t["who"]]
        out.append(moved.tobytes())
    state.update((names[kept].tolist(), per_source[kept].tobytes(), *out))


_WAITING = np.dtype([("who", "i8"), ("us", "i8"), ("log_id", "i8"), ("combined", "f8"), ("multiplier", "f8")])
_SEEN = np.dtype([("who", "i8"), ("us", "i8")])
_MEMORY = np.dtype([("last_alert", "i8"), ("threats", "i8"), ("points", "i8"), ("end", "i8")])


def _correlated(seen: np.ndarray, due: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """For each of the due rows whether enough rows of its source came shortly before, and the last rows of each source."""
    need, window = cfg.correlation_min_events, cfg.lookback_seconds * 1_000_000
    rows = np.concatenate([seen, due[["who", "us"]].astype(_SEEN)])
    own = np.concatenate([np.full(len(seen), -1), np.arange(len(due))])
    order = np.lexsort((own, rows["us"], rows["who"]))
    rows, own = rows[order], own[order]
    who, us, at = rows["who"], rows["us"], np.arange(len(rows))
    back = at - max(need - 1, 0)
    first = np.maximum(back, 0)
    near = (need <= 1) | ((back >= 0) & (who[first] == who) & (us[first] >= us - window))
    found = np.empty(len(due), bool)
    found[own[own >= 0]] = near[own >= 0]
    return found, rows[np.searchsorted(who, who, side="right") - at <= max(need - 1, 1)]


def decide(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Decisions for gated flows with each source's own past decisions feeding back, in event-time order.

    A row is decided when the watermark has passed it, after all earlier rows of its source, so the
    decisions don't depend on how rows are dealt to micro-batches. State, in parts by source: the rows that
    wait (no longer than the watermark's delay), and a memory of constant size for each source: the last event times
    (enough to know whether three fall within five minutes), the last alert, a counter and the
    reputation. A source that is silent for ``memory_days`` is forgotten.
    """
    lists_in_state(scored)
    calm = cfg.cooldown_seconds * 1_000_000
    timed = marked(scored, cfg).where("ts is not null")  # a row without a time has no place among the others
    slim = timed.select("log_id", "source_ip", "ts", F.unix_micros("ts").alias("us"), "combined", stage_multiplier("stage").alias("multiplier"))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [f for f in frames if len(f)]
        held, memory, waiting, seen = _held(state, _MEMORY, _WAITING, _SEEN)
        names, who = _numbered(held, new)
        memory = np.concatenate([memory, np.array([(-_NEVER, 0, 100, 0)] * (len(names) - len(held)), _MEMORY)])
        waiting = np.concatenate([waiting, _table(_WAITING, who, new)])
        mark = state.getCurrentWatermarkMs()
        late = wake_at(waiting["us"]) < mark
        due, rest = waiting[late], waiting[~late]
        due = due[np.lexsort([due[c] for c in reversed(_WAITING.names)])]
        correlated, seen = _correlated(seen, due, cfg)
        np.maximum.at(memory["end"], due["who"], wake_at(due["us"]) + cfg.memory_days * _DAY_MS)
        last_alert, threats, points = (memory[c].tolist() for c in ("last_alert", "threats", "points"))
        gated, out = due["combined"] > cfg.anomaly_gate, []
        for (k, at, log_id, score_, mult), near in zip(due[gated].tolist(), correlated[gated].tolist()):
            n = threats[k]
            cooling = at - calm <= last_alert[k] < at
            risk = min(0.3 * cooling + 0.4 * (not near) + 0.2 * (n == 0), 0.9)
            final = min(max(score_ * mult * (1.0 - risk), 0.0), 1.0)
            action = "BLOCK" if final >= cfg.high_confidence else "RATE_LIMIT" if final >= 0.65 else "ALERT" if final >= cfg.medium_confidence else "MONITOR"
            if action in ("BLOCK", "RATE_LIMIT") and final <= 0.9 and n < 2:
                action = "RATE_LIMIT" if action == "BLOCK" else "ALERT"
            points[k] = max(points[k] - REPUTATION_STEP.get(action, 0), 0)
            out.append((log_id, names[k], at, score_, n, cooling, near, risk, final, action, points[k] / 100.0))
            threats[k] = n + 1
            if action != "MONITOR":
                last_alert[k] = at
        memory["last_alert"], memory["threats"], memory["points"] = last_alert, threats, points
        idle = np.ones(len(names), bool)
        idle[rest["who"]] = False
        kept = ~idle | (memory["end"] >= mark)
        kept[due["who"]] = True
        _release(state, names, kept, memory, rest, seen[kept[seen["who"]]])
        if kept.any():
            ends = [wake_at(rest["us"]), memory["end"][kept & idle]]
            state.setTimeoutTimestamp(max(min(int(e.min()) for e in ends if len(e)), mark + 1))
        if out:
            made = pd.DataFrame(out, columns=["log_id", "source_ip", "ts", "combined", "prior", "in_cooldown", "correlated", "fp_risk", "final_score", "action", "reputation"])
            made["ts"] = pd.to_datetime(made["ts"], unit="us", utc=True)
            yield made

    memory = "sources array<string>, memory binary, waiting binary, seen binary"
    return _by_source(slim).applyInPandasWithState(step, DECISIONS, memory, "append", GroupStateTimeout.EventTimeTimeout)


# --- validation after sixty seconds ---------------------------------------------------------------------
PARTS = "action_id bigint, n bigint, units bigint, max_after double"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one source as lists of facts (time, amount) and asks (time, kind, action) to the parts of the actions."""
    names = [f.name for f in _PARTS_ARROW]
    for batch in batches:
        facts, asks = (batch.column(k) for k in (0, 1))
        whose = lambda x: np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False))
        field = lambda x, c: x.flatten().field(c).to_numpy(zero_copy_only=False)
        own, times, amounts = whose(facts), field(facts, "at"), field(facts, "units")
        order = np.lexsort((times, own))
        own, times, amounts = own[order], times[order], amounts[order]
        asker, at, kind = whose(asks), field(asks, "at"), field(asks, "kind")
        first, last = np.searchsorted(own, np.arange(len(batch)), side="left"), np.searchsorted(own, np.arange(len(batch)), side="right")
        out = []
        for k in np.unique(asker):
            lo, hi, mine = first[k], last[k], np.arange(*np.searchsorted(asker, [k, k + 1]))
            t, u = times[lo:hi], amounts[lo:hi]
            sums = np.concatenate([[0], np.cumsum(u)])
            from_left = np.concatenate([[-1], np.maximum.accumulate(u)])
            from_right = np.concatenate([np.maximum.accumulate(u[::-1])[::-1], [-1]])
            cut, rest = np.searchsorted(t, at[mine], side="right"), kind[mine] == 1
            top = np.where(rest, from_right[cut], from_left[cut])
            out.append((mine, np.where(rest, len(t) - cut, cut), np.where(rest, sums[-1] - sums[cut], sums[cut]), np.where(top < 0, np.nan, top / 1e12)))
        if out:
            mine, n, units, top = (np.concatenate([x[k] for x in out]) for k in range(4))
            yield pa.record_batch(dict(zip(names, (field(asks, "action_id")[mine].astype(np.int64), n.astype(np.int64), units.astype(np.int64), top))), schema=_PARTS_ARROW)


_PARTS_ARROW = pa.schema([("action_id", pa.int64()), ("n", pa.int64()), ("units", pa.int64()), ("max_after", pa.float64())])


def scores_after(actions: DataFrame, scores: DataFrame, seconds: int = 60, cfg: Config = DEFAULT) -> DataFrame:
    """Parts of the score summary in ``(t, t + seconds]`` after each action, see :func:`combine_parts`.

    Rows are grouped by (source, block of ``seconds``): the engine's state is the lists of one block's
    rows and is released when the watermark passes the block. An action asks its own block for what
    follows it and the next block for what precedes ``t + seconds``; no pair of action and score is formed.
    """
    width = F.expr(f"interval {seconds} seconds")
    units = F.round(F.col("combined") * F.lit(1e12)).cast("bigint")
    fact = F.struct(F.unix_micros("ts").alias("at"), units.alias("units"))
    no_fact = F.lit(None).cast("struct<at: bigint, units: bigint>").alias("fact")
    facts = marked(scores, cfg).select("source_ip", "ts", fact.alias("fact"), F.lit(None).cast("struct<at: bigint, action_id: bigint, kind: int>").alias("ask"))

    def asked(kind: int) -> DataFrame:
        # what an action asks of the next block is due later, its mark stays that of the action
        late = actions.withColumn("ts", F.col("ts") + width) if kind == 2 else actions
        own = late.withWatermark("ts", f"{cfg.watermark_seconds + (seconds if kind == 2 else 0)} seconds")
        ask = F.struct(F.unix_micros("ts").alias("at"), "action_id", F.lit(kind).alias("kind"))
        return own.select(F.col("target_ip").alias("source_ip"), "ts", no_fact, ask.alias("ask"))

    lists_in_state(scores)
    blocks = facts.unionByName(asked(1)).unionByName(asked(2)).groupBy("source_ip", F.window("ts", f"{seconds} seconds")).agg(
        F.collect_list("fact").alias("facts"), F.collect_list("ask").alias("asks"))
    return blocks.where(F.size("asks") > 0).select("facts", "asks").mapInArrow(_parts, PARTS)


def combine_parts(parts: DataFrame) -> DataFrame:
    """Both parts of every action as one row (run on the table the stream appends to)."""
    top = F.max(F.when(~F.isnan("max_after"), F.col("max_after")))
    return parts.groupBy("action_id").agg(F.sum("n").alias("n_after"), F.sum("units").alias("units_after"), top.alias("max_after"))


# --- approvals that expire --------------------------------------------------------------------------------
OUTCOMES = "log_id bigint, status string, decided_at timestamp"
_OPEN = ("log_id", "deadline", "reviewed", "approved")
#: Parts of the open approvals: each is one state, whose approvals are closed together.
_APPROVAL_PARTS = 2048


def approval_outcomes(queue: DataFrame, reviews: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """APPROVED, REJECTED or, when the deadline passes first, EXPIRED for every queued approval.

    ``queue`` has ``log_id, ts, expires_at``; ``reviews`` has ``log_id, ts, approved``. The state is the open
    approvals, in parts by id; the watermark passing the deadline closes an approval.
    """
    q = marked(queue, cfg).select("log_id", "ts", F.unix_micros("expires_at").alias("deadline"), F.lit(None).cast("bigint").alias("reviewed"), F.lit(None).cast("bigint").alias("approved"))
    r = marked(reviews, cfg).select("log_id", "ts", F.lit(None).cast("bigint").alias("deadline"), F.unix_micros("ts").alias("reviewed"), F.col("approved").cast("bigint"))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = list(state.get) if state.exists else [[], [], [], []]
        held = pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(_OPEN, columns)})
        for f in frames:
            own = pd.DataFrame({"log_id": f["log_id"], "deadline": f["deadline"].fillna(_NEVER), "reviewed": f["reviewed"].fillna(_NEVER), "approved": f["approved"].fillna(0)}).astype("int64")
            held = pd.concat([held, own], ignore_index=True)
        # one row for each approval: its deadline, and the first of its reviews
        held = held.sort_values(["log_id", "reviewed"], kind="stable")
        deadline = held.groupby("log_id", sort=True)["deadline"].min()
        held = held.drop_duplicates("log_id").assign(deadline=deadline.to_numpy())
        wake = np.where(held["deadline"] < _NEVER, held["deadline"], held["reviewed"]) // 1000 + 1
        mark = state.getCurrentWatermarkMs()
        due = wake < mark
        rest, wake = held[~due], wake[~due]
        if len(rest):
            state.update(tuple(rest[c].tolist() for c in _OPEN))
            state.setTimeoutTimestamp(max(int(wake.min()), mark + 1))
        elif state.exists:
            state.remove()
        done = held[due & (held["deadline"] < _NEVER)]
        if len(done):
            in_time = (done["reviewed"] < done["deadline"]).to_numpy()
            status = np.where(in_time, np.where(done["approved"] == 1, "APPROVED", "REJECTED"), "EXPIRED")
            yield pd.DataFrame({"log_id": done["log_id"].to_numpy(), "status": status, "decided_at": pd.to_datetime(np.where(in_time, done["reviewed"], done["deadline"]), unit="us", utc=True)})

    state = "log_id array<bigint>, deadline array<bigint>, reviewed array<bigint>, approved array<bigint>"
    both = q.unionByName(r).withColumn("part", F.pmod(F.xxhash64("log_id"), F.lit(_APPROVAL_PARTS)))
    return both.groupBy("part").applyInPandasWithState(step, OUTCOMES, state, "append", GroupStateTimeout.EventTimeTimeout)


# --- automatic rollback -----------------------------------------------------------------------------------
CHECKS = "action_id bigint, target_ip string, checked_at timestamp, recent_mean double, outcome string"


_SCORES = np.dtype([("who", "i8"), ("at", "i8"), ("id", "i8"), ("value", "f8")])
_OPEN_CHECKS = np.dtype([("who", "i8"), ("at", "i8"), ("id", "i8")])
_UNTIL = np.dtype("i8")


def _behind(times: np.ndarray, when: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each ``when`` the end of the times up to it, searched for between ``first`` and ``last``, where times are sorted."""
    lo, hi = first.copy(), last.copy()
    while (lo < hi).any():
        active = lo < hi
        mid = (lo + hi) // 2
        left = active & (times[np.minimum(mid, len(times) - 1)] <= when)
        lo, hi = np.where(left, mid + 1, lo), np.where(active & ~left, mid, hi)
    return lo


def auto_rollback(actions: DataFrame, scores: DataFrame, cfg: Config = DEFAULT, depth: int = 5) -> DataFrame:
    """Thirty minutes after a block, and again every thirty minutes while its source stays hot, compare
    the mean of the source's latest scores with 0.65.

    State, in parts by source: open checks, the ``depth`` newest scores of each source behind the watermark and those ahead of it.
    """
    wait = cfg.auto_rollback_minutes * 60_000_000
    at = F.unix_micros("ts").alias("at")

    def rows(df: DataFrame, source: str, row_id: str, kind, value) -> DataFrame:
        return marked(df, cfg).where("ts is not null").select(F.col(source).alias("source_ip"), "ts", at, F.coalesce(row_id, F.lit(0)).cast("bigint").alias("id"), kind.alias("kind"), value.cast("double").alias("value"))

    # rows of no use (kind 0) are kept: filtered out, they would not move the watermark
    s = rows(scores, "source_ip", "log_id", F.when(F.col("combined").isNotNull() & ~F.isnan("combined"), 1).otherwise(0), F.coalesce("combined", F.lit(0.0)))
    a = rows(actions, "target_ip", "action_id", F.when((F.col("action_type") == "BLOCK") & F.col("action_id").isNotNull(), 2).otherwise(0), F.lit(0.0))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [f for f in frames if len(f)]
        held, until, facts, checks = _held(state, _UNTIL, _SCORES, _OPEN_CHECKS)
        names, who = _numbered(held, new)
        kind = np.concatenate([f["kind"].to_numpy() for f in new]) if new else np.empty(0, int)
        made = _table(_SCORES, who, new)
        facts = np.concatenate([facts, made[kind == 1]])
        facts = facts[np.lexsort((facts["id"], facts["at"], facts["who"]))]
        asked = made[kind == 2][["who", "at", "id"]].astype(_OPEN_CHECKS)
        asked["at"] += wait
        checks = np.concatenate([checks, asked])
        first, last = (np.searchsorted(facts["who"], np.arange(len(names)), side=e) for e in ("left", "right"))
        mark = state.getCurrentWatermarkMs()
        due = wake_at(checks["at"]) < mark
        rest, turn, out = [checks[~due]], checks[due], []
        touched = np.zeros(len(names), bool)
        touched[who], touched[turn["who"]] = True, True
        while len(turn):  # a check of every open block, then the next of those that stay hot
            k = turn["who"]
            behind = _behind(facts["at"], turn["at"], first[k], last[k])
            n, total = np.minimum(behind - first[k], depth), np.zeros(len(turn))
            for back in range(depth, 0, -1):
                has = n >= back
                total[has] += facts["value"][behind[has] - back]
            mean = total / np.maximum(n, 1)
            hot = mean >= 0.65
            out.append(pd.DataFrame({"action_id": turn["id"], "target_ip": names[k], "checked_at": pd.to_datetime(turn["at"], unit="us", utc=True), "recent_mean": mean, "outcome": np.where(hot, "EXTEND", "ROLLBACK")}))
            turn = turn[hot]
            turn["at"] += wait
            due = wake_at(turn["at"]) < mark
            rest.append(turn[~due])
            turn = turn[due]
        rest = np.concatenate(rest)
        horizon = np.full(len(names), mark * 1000)
        np.minimum.at(horizon, rest["who"], rest["at"])
        cut = np.maximum(_behind(facts["at"], horizon, first, last) - depth, first)
        facts = facts[np.arange(len(facts)) >= cut[facts["who"]]]
        # a source without open checks is forgotten after a silent month
        newest = np.zeros(len(names), "i8")
        np.maximum.at(newest, facts["who"], facts["at"] // 1000)
        until = np.where(touched, np.maximum(newest, mark) + 30 * _DAY_MS, np.concatenate([until, np.zeros(len(names) - len(held), "i8")]))
        asks, has = np.zeros(len(names), bool), np.zeros(len(names), bool)
        asks[rest["who"]], has[facts["who"]] = True, True
        kept = asks | (has & (touched | (until + 1 >= mark)))
        _release(state, names, kept, until, facts[kept[facts["who"]]], rest)
        if kept.any():
            ends = [wake_at(rest["at"]), until[kept & ~asks] + 1]
            state.setTimeoutTimestamp(max(min(int(e.min()) for e in ends if len(e)), mark + 1))
        if out:
            yield pd.concat(out, ignore_index=True)

    memory = "sources array<string>, until binary, scores binary, checks binary"
    return _by_source(s.unionByName(a)).applyInPandasWithState(step, CHECKS, memory, "append", GroupStateTimeout.EventTimeTimeout)
