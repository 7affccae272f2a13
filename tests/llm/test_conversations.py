"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from threatlake.llm import conversations
from threatlake.llm.common import table
from threatlake.llm.conversations import damage, repair_conversations
from threatlake.llm.queries import op13_conversations

WHITE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = " " if conv is None else str(conv), " " if turn is None else str(turn)
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(":".join(one).encode()) % 20
        if h:
            row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            out += [row] * (2 if h == 3 else 1)
    return out


def _repaired(rows):
    """What one conversation's rows become: the least (cost, audit) from every row and state on."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        own = text.strip(WHITE)
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def search(k, state, memo):
        """The least (cost, audit, lines) from here on; inserting more than three times in a row only leads back."""
        if (k, state) not in memo:
            options, inserted, now = bare(k, state, memo), [], state
            for n in (1, 2, 3):
                now = step[now]
                inserted.append(f"{names[now]}:")
                options += [(cost + 2 * n, "I" * n + audit, (*inserted, *lines)) for cost, audit, lines in bare(k, now, memo)]
            memo[k, state] = min(options, key=lambda o: o[:2])
        return memo[k, state]

    def bare(k, state, memo):
        """Ways on from here that don't begin with an insertion."""
        if k == len(rows):
            return [(0, "", ())] if state in ("", "a") else []
        _, _, role, text = rows[k]
        cost, audit, lines = search(k + 1, state, memo)
        out = [(cost + 3, "D" + audit, lines)]
        if faults[k] not in ("blank", "duplicate"):
            more = faults[k] == "truncated"
            if initials[k] == step[state] or (initials[k] == "s" and state == ""):
                cost, audit, lines = search(k + 1, initials[k], memo)
                out.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
            cost, audit, lines = search(k + 1, step[state], memo)
            out.append((cost + more + 2, "R" + audit, (f"{names[step[state]]}:{text}", *lines)))
        return out

    memo = {}
    for k in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            search(k, state, memo)
    cost, audit, lines = memo[0, ""]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _wanted(rows):
    by = {r[0]: [] for r in rows}
    for row in _damaged(rows):
        by[row[0]].append(row)
    return {conv: _repaired(own) for conv, own in by.items()}


def _found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def _random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "Why? ", "A. b", None, "É!", "x\ny."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "s", "u", "a"]
    return [(None if c == 0 else c, rng.choice([k, k, k, k + 1, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"text {k} of {c}.")
            for c in range(conversations_) for k in range(rng.randint(1, most))]


@pytest.mark.parametrize("segment", [4096, 3])
def test_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(conversations, "BATCH_ROWS", 40)
    rows = [*_random_rows(1, 60, 9), *_random_rows(2, 1, 300), *[(1000, 1, "user", "the same.")] * 7]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, who string, code int").repartition(3)
    found = _found(repair_conversations(damage(df), df.select("conv_id")))
    assert found == _wanted(rows)
    assert {x for f in found.values() for x in f[6]} == set("DIKR")


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert _found(op13_conversations(spark, sf_dir)) == _wanted(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair_conversations(none).count() == 0
    ids = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    empty = hashlib.sha256(b"").hexdigest()
    assert _found(repair_conversations(none, ids)) == dict.fromkeys(("a", None), (0, 0, 0, 0, 0, 0, "", empty))
    one = spark.createDataFrame([("a", 3, "user", "x" * 300_000 + "."), ("a", None, "system", "Be."), (None, 1, "assistant", "")], none.schema)
    found = _found(repair_conversations(one))
    assert found["a"][5:7] == (2, "KKI") and found[None][:7] == (0, 1, 0, 0, 0, 3, "D")


def test_segments_join(monkeypatch):
    """Costs through tables of segments are those of the whole."""
    rng = np.random.default_rng(0)
    codes = (rng.integers(0, 4, 50) + rng.choice([0, 0, 4, 8, 16], 50)).astype(np.uint8)
    whole = conversations.costs(codes, np.array([0]), np.array([50]), conversations.AT_END[None, None])
    first, size = np.array([0, 20, 21]), np.array([20, 1, 29])
    units = np.tile(np.where(np.eye(4, dtype=bool), 0, conversations.NEVER), (3, 1, 1))
    tables = conversations.costs(codes, first, size, units)[first]
    ahead = conversations.AT_END
    for table_, at in zip(tables[::-1], first[::-1]):
        ahead = (table_ + ahead[:, None]).min(axis=0)
        assert (ahead == whole[at, 0]).all()
