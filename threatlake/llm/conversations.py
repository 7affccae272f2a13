"""Repair of the turns of conversations by the cheapest edits, of several the least in text order.

A conversation's roles must read ``(s?(ua)+)?``. Four states say where a reading stands: nothing
read, after the system turn, after a user turn, after an assistant turn. An edit (keep, rerole,
delete, insert) is an arc between nodes (row, state); its cost and its initial are its weight and
its label. A cost DP gives each node its cost to the end, and the arcs that lose nothing of it are
the optimal ones. Which path of them spells the least audit is found by prefix doubling: nodes are
ranked by the audit's first letter from them, then by the first 2, 4, 8, ... letters as pairs of
ranks, over pointers that double with them; the final ranks select each node's arc, and doubled
pointers of these arcs give every letter of a path its node at once.

Long conversations are cut into segments of some thousand rows. A segment's DP is a 4 x 4 table
of costs from state to state, so costs to go are carried from segment to segment, and each
segment finds its least path from each of the four states by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.llm.common import SPACES, heavy_lookup, range_parts, width
from threatlake.session import materialise

#: Rows of one segment, rows of segments handled together.
SEGMENT_ROWS, BATCH_ROWS = 4_096, 100_000
#: Code points of a text that order rows of one turn and role, before a hash does.
BRIEF = 64
#: States, and the state that the one legal next user or assistant turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Cost of each state at the end: turns to insert until it is legal.
AT_END = np.array([0, 4, 2, 0], np.int64)
RANK, DELETE, INSERT, REROLE, TRUNCATED = 1 << 40, 3, 2, 2, 1
NEVER = np.int64(1 << 50)
#: Audit letters in text order; 0 ends a path.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
#: A row's code: the kind of its role, then bits.
KINDS, BLANK, DUPLICATE, CUT = "sua", 4, 8, 16


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults of five kinds, by a checksum of id and turn; nulls are one space."""
    h = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn"))).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = df.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(h == 0, F.array().cast("array<int>")).when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def _name(column: str) -> Column:
    """A value among others of a text without ambiguity."""
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _code(duplicate: Column) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = F.translate("text", SPACES, "") == ""
    ended = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    return (kind + F.when(blank, BLANK).when(duplicate, DUPLICATE).when(~ended, CUT).otherwise(0)).cast("int")


def costs(codes: np.ndarray, first: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost to go (rows x k x 4) before each row, edits there included, given that behind each segment (segments x k x 4)."""
    out = np.empty((len(codes), *end.shape[1:]), np.int64)
    order = np.argsort(-size, kind="stable")
    first, size, ahead = first[order], size[order], end[order].copy()
    live = len(size)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))  # segments of more than t rows
        at = first[:live] + t
        code, v = codes[at].astype(np.int64)[:, None], ahead[:live]
        kind, fixed, more = code & 3, (code & (BLANK | DUPLICATE)) > 0, np.where(code & CUT, TRUNCATED, 0)
        user = more + np.where(kind == 1, 0, REROLE)
        assistant = more + np.where(kind == 2, 0, REROLE)
        user, assistant = np.where(fixed, NEVER, user), np.where(fixed, NEVER, assistant)
        w = v + DELETE
        for s in (START, SYSTEM, ASSISTANT):
            w[..., s] = np.minimum(w[..., s], v[..., USER] + user)
        w[..., USER] = np.minimum(w[..., USER], v[..., ASSISTANT] + assistant)
        w[..., START] = np.minimum(w[..., START], v[..., SYSTEM] + np.where(fixed | (kind != 0), NEVER, more))
        w[..., USER], w[..., ASSISTANT] = np.minimum(w[..., USER], w[..., ASSISTANT] + INSERT), np.minimum(w[..., ASSISTANT], w[..., USER] + INSERT)
        for s in (START, SYSTEM):
            w[..., s] = np.minimum(w[..., s], w[..., USER] + INSERT)
        ahead[:live] = out[at] = np.minimum(w, NEVER)
    return out


def _arcs(codes: np.ndarray, first: np.ndarray, size: np.ndarray, end: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs to go of all nodes, and for each the target (or -1) of its optimal arc with each letter.

    Nodes are numbered row by row, four a row; behind all rows come four for each segment's end.
    """
    rows = len(codes)
    to_go = np.concatenate([costs(codes, first, size, end[:, None])[:, 0], end])
    after = np.arange(1, rows + 1)
    after[first + size - 1] = rows + np.arange(len(size))
    target = np.full((len(to_go), 4, len(LETTERS)), -1, np.int64)
    every, fixed, more = np.arange(rows), (codes & (BLANK | DUPLICATE)) > 0, np.where(codes & CUT, TRUNCATED, 0)

    def arc(letter: int, state: int, to_state: int | np.ndarray, cost: np.ndarray | int, allowed: np.ndarray) -> None:
        good = allowed & (to_go[every, state] == cost + to_go[after, to_state])
        target[:rows, state, letter] = np.where(good, after * 4 + to_state, -1)

    for s in range(4):
        arc(1, s, s, DELETE, np.ones(rows, bool))
        keeps = (codes & 3) == (2 if s == USER else 1)
        to = np.where((codes & 3) == 0, SYSTEM, USER) if s == START else int(NEXT[s])
        arc(3, s, to, more, ~fixed & (keeps | ((codes & 3) == 0) if s == START else keeps))
        arc(4, s, int(NEXT[s]), more + REROLE, ~fixed)
        # Turns are inserted before a row, and behind the last one of a conversation.
        good = to_go[:, s] == INSERT + to_go[:, NEXT[s]]
        good[rows:] &= final
        target[:, s, 2] = np.where(good, np.arange(len(to_go)) * 4 + NEXT[s], -1)
    return to_go, target.reshape(-1, len(LETTERS))


def least_paths(codes: np.ndarray, first: np.ndarray, size: np.ndarray, end: np.ndarray, final: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each segment and state before it: the least audit, the state behind it and the cost."""
    to_go, target = _arcs(codes, first, size, end, final)
    nodes = np.arange(len(target))

    def pointers(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's least arc, by letter and by the rank of where it leads."""
        key = np.where(target >= 0, np.arange(len(LETTERS)) * RANK + rank[target], NEVER * 2)
        letter = key.argmin(axis=1)
        done = (target < 0).all(axis=1)
        return np.where(done, 0, letter), np.where(done, nodes, target[nodes, letter])

    letter, to = pointers(np.zeros(len(nodes), np.int64))
    rank = letter.astype(np.int64)
    while True:  # of paths of 1, 2, 4, ... letters; a path that has ended stays where it is
        rank = np.unique(rank * (len(nodes) + 1) + rank[to], return_inverse=True)[1]
        if (to[to] == to).all():
            break
        to = to[to]
    letter, to = pointers(rank)
    doubled, length = [to], (letter > 0).astype(np.int64)
    while (doubled[-1][doubled[-1]] != doubled[-1]).any():
        length = length + length[doubled[-1]]
        doubled.append(doubled[-1][doubled[-1]])
    begin = (first[:, None] * 4 + np.arange(4)).ravel()
    n = length[begin]
    ends = np.cumsum(n)
    at, step = np.repeat(begin, n), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    for k, hop in enumerate(doubled):
        at = np.where(step >> k & 1, hop[at], at)
    audits = LETTERS[letter[at]].tobytes()
    last = doubled[-1][begin]
    spent = to_go.ravel()[begin] - to_go.ravel()[last]
    return [audits[b - m:b] for b, m in zip(ends.tolist(), n.tolist())], (last % 4).reshape(-1, 4), spent.reshape(-1, 4)


def _ragged(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


def _segments(out: pa.Schema):
    """Segments of a range of rows in order, with their tables of costs from state to state."""

    def tables(held: list[tuple]) -> pa.RecordBatch:
        codes, first, size = _ragged([bytes(x[3]) for x in held])
        units = np.tile(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(held), 1, 1))
        table = costs(codes, first, size, units)[first]
        return pa.record_batch([pa.array([x[0] for x in held], out.field(0).type), pa.array([x[1] for x in held], pa.int32()), pa.array([x[2] for x in held], pa.int32()),
                                pa.array([bytes(x[3]) for x in held], pa.binary()), pa.array([t.tobytes() for t in table], pa.binary())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for batch in batches:
            for name, part, code in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or held[-1][0] != name or held[-1][1] != part or len(held[-1][3]) >= SEGMENT_ROWS:
                    if rows >= BATCH_ROWS:
                        yield tables(held)
                        held, rows = [], 0
                    number += 1
                    held.append((name, part, number, bytearray()))
                held[-1][3].append(code)
                rows += 1
        if held:
            yield tables(held)

    return run


def _backwards(out: pa.Schema):
    """Costs to go behind each segment; the segments of a conversation come last first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ahead = None, AT_END
        for batch in batches:
            behind, final = [], []
            for name, table in zip(batch.column(0).to_pylist(), batch.column(4)):
                final.append((name,) != at)
                ahead = AT_END if final[-1] else ahead
                at = (name,)
                behind.append(ahead.tobytes())
                # The table has the state behind in its rows, the state before in its columns.
                ahead = (np.frombuffer(table.as_py(), np.int64).reshape(4, 4) + ahead[:, None]).min(axis=0)
            yield pa.record_batch([*batch.columns[:4], pa.array(behind, pa.binary()), pa.array(final)], schema=out)

    return run


def _paths(out: pa.Schema):
    """Each segment's least audit from each state, with the state and cost that it leads to, and its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.cumsum([len(x.as_buffer()) for x in whole.column(3)])
            cuts = np.flatnonzero(np.diff(lengths // BATCH_ROWS, prepend=-1)) if len(lengths) else []
            for a, b in zip(cuts, [*cuts[1:], whole.num_rows]):
                batch = whole.slice(a, b - a)
                codes, first, size = _ragged([x.as_py() for x in batch.column(3)])
                end = np.stack([np.frombuffer(x.as_py(), np.int64) for x in batch.column(4)])
                audits, exits, spent = least_paths(codes, first, size, end, batch.column(5).to_numpy(zero_copy_only=False))
                kind = codes & 3
                legal = (kind[:-1] != 3) & (NEXT[np.minimum(kind[:-1] + 1, 3)] == kind[1:] + 1)
                legal = np.append(legal, True)
                legal[first + size - 1] = True
                sums = [np.add.reduceat(x.astype(np.int64), first) for x in (codes & BLANK > 0, codes & DUPLICATE > 0, codes & CUT > 0, ~legal)]
                arrays = [*batch.columns[:3], pa.array([audits[k:k + 4] for k in range(0, len(audits), 4)], pa.list_(pa.binary())), pa.array(exits.tolist(), pa.list_(pa.int64())),
                          pa.array(spent.tolist(), pa.list_(pa.int64())), *(pa.array(x) for x in sums), pa.array(kind[first].astype(np.int32)), pa.array(kind[first + size - 1].astype(np.int32))]
                yield pa.record_batch(arrays, schema=out)

    return run


class _Repair:
    """One conversation as it passes: first its segments, then its rows."""

    def __init__(self, name):
        self.name, self.state, self.audits, self.sums, self.last = name, START, [], np.zeros(5, np.int64), None
        self.low = self.high = None
        self.turns = 0

    def segment(self, audits, exits, spent, blank, duplicate, truncated, illegal, kind, last) -> None:
        if self.last is not None:
            illegal += not (self.last != 3 and NEXT[min(self.last + 1, 3)] == kind + 1)
        self.audits.append(audits[self.state])
        self.sums += (blank, duplicate, truncated, illegal, spent[self.state])
        self.state, self.last = exits[self.state], last

    def start(self) -> None:
        self.audit, self.place, self.state, self.hash, self.any = b"".join(self.audits), 0, START, hashlib.sha256(), False
        self.audits = [self.audit]

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _expected(self) -> str:
        self.state = int(NEXT[self.state])
        return "user" if self.state == USER else "assistant"

    def _inserts(self) -> None:
        while self.place < len(self.audit) and self.audit[self.place] == ord("I"):
            self._say(self._expected(), "")
            self.place += 1

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and (self.high is None or turn != self.high):
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self._inserts()
        letter = chr(self.audit[self.place])
        self.place += 1
        if letter == "K":
            self.state = SYSTEM if role[0] == "s" else int(NEXT[self.state])
            self._say(role, text)
        elif letter == "R":
            self._say(self._expected(), text)

    def done(self) -> tuple:
        self._inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.name, gaps, *self.sums.tolist(), self.audit.decode(), self.hash.hexdigest()


def _repairs(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def rows() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held), out)], schema=out)
            held.clear()
            return batch

        for batch in batches:
            for name, is_row, turn, role, text, *segment in zip(*(c if k == 4 else c.to_pylist() for k, c in enumerate(batch.columns))):
                if at is None or at.name != name:
                    if at is not None:
                        held.append(at.done())
                        if len(held) >= 5_000:
                            yield rows()
                    at, rows_seen = _Repair(name), False
                if is_row:
                    if not rows_seen:
                        at.start()
                        rows_seen = True
                    at.row(turn, role, text.as_py())
                else:
                    at.segment(*segment)
        if at is not None:
            held.append(at.done())
        if held:
            yield rows()

    return run


def repair_conversations(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row for each ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text``, role and text not null. Rows are taken by turn, nulls first; rows of
    one turn by role, then by their text's first BRIEF code points, then by a hash of it, so rows that are the same
    stand together. A row's first fault counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text as
    in a row before), truncated (its last other character is none of ``.!?``). ``illegal`` counts neighbours whose
    role initials are none of su, ua, au. A row may be kept (cost 0; a role without an initial never may), be given
    the role user or assistant (2) or be deleted (3; blank and duplicate rows must), empty user or assistant turns may
    be inserted (2), and a truncated row that stays costs 1 more. ``audit`` has the initials of the cheapest edits
    that make the roles read ``(s?(ua)+)?``, of several the least in ASCII order. ``gaps`` are the turns that are
    missing between the least and the greatest. Ids in the one column of ``every`` that have no rows (all of an empty
    table) have zeros, an empty audit and an empty text's hash. A null id is an id like others; other columns are
    not read.
    """
    kind = rows.schema["conv_id"].dataType
    who = F.sha2(F.concat(_name("conv_id"), _name("role"), F.col("text")), 256)
    kept = rows.select("conv_id", "turn", "role", "text", F.substring("text", 1, BRIEF).alias("brief"), who.alias("who"), F.monotonically_increasing_id().alias("uid"))
    kept = materialise(kept, "turns")
    again = kept.groupBy("who").agg(F.min(F.struct("turn", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    slim = kept.select("conv_id", "turn", "role", "brief", "who", "uid", _code(F.lit(False)).alias("code"))
    marked = heavy_lookup(slim, materialise(again.select("who", F.col("first.uid").alias("first"), "n"), "turns-again"), "who", kept.count(), how="left")
    repeats = F.coalesce(F.col("first") != F.col("uid"), F.lit(False)) & (F.col("code").bitwiseAND(BLANK) == 0)
    marked = marked.withColumn("code", F.when(repeats, F.col("code").bitwiseAND(3) + DUPLICATE).otherwise(F.col("code")))
    order = ["conv_id", "turn", "role", "brief", "who", "uid"]
    parts = range_parts(marked.select(*order, "code"), [F.col(c).asc_nulls_first() for c in order], "turn-order")

    def schema(columns: str) -> tuple[T.StructType, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        full = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(columns)])
        return full, to_arrow_schema(full)

    n = width(rows.sparkSession)
    columns, out = schema("_part int, number int, codes binary, costs binary")
    segments = parts.repartition(n, "_part").sortWithinPartitions("_part", *(F.col(c).asc_nulls_first() for c in order)).select("conv_id", "_part", "code").mapInArrow(_segments(out), columns)
    columns, out = schema("_part int, number int, codes binary, behind binary, final boolean")
    backwards = segments.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("_part"), F.desc("number")).mapInArrow(_backwards(out), columns)
    counts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    columns, out = schema(f"_part int, number int, audits array<binary>, exits array<bigint>, spent array<bigint>, {counts}, kind int, last int")
    paths = backwards.repartition(n).mapInArrow(_paths(out), columns)
    stream = paths.withColumn("is_row", F.lit(False)).unionByName(kept.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    stream = stream.repartition(n, "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "is_row", "_part", "number", *(F.col(c).asc_nulls_first() for c in order[1:]))
    columns, out = schema(f"gaps bigint, {counts}, cost bigint, audit string, repaired_sha256 string")
    repaired = stream.select("conv_id", "is_row", "turn", "role", "text", "audits", "exits", "spent", "blank", "duplicate", "truncated", "illegal", "kind", "last").mapInArrow(_repairs(out), columns)
    if every is None:
        return repaired
    names = [f.name for f in columns[1:]]
    ids = every.toDF("_conv_id").distinct()
    whole = ids.join(repaired, F.col("_conv_id").eqNullSafe(F.col("conv_id")), "left")
    none = {c: F.lit("") if c == "audit" else F.sha2(F.lit(""), 256) if c == "repaired_sha256" else F.lit(0).cast("long") for c in names}
    return whole.select(F.col("_conv_id").alias("conv_id"), *(F.coalesce(c, none[c]).alias(c) for c in names))
