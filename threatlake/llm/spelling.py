"""Spelling variants: words one edit apart, found in a trie of their letter-group counts.

Letters are dealt to groups, and a word's vector says how many letters it has of each. Words are
arranged in a trie by these counts, one group a level. One inserted letter raises one count by
one, one deleted letter lowers one, a replaced letter does both or changes none, so a search goes
down the trie with a budget of one surplus and one deficit; the words of the leaves that it
reaches are verified.

The trie is dealt to tasks by its nodes of some depth. A word searches below its own node and the
few others that its budget leads to. The depth follows the words, so that no node has too many.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.common import width
from threatlake.session import materialise

LETTERS = "[a-zÀ-ÿ]"
#: One in so many runs of a document, by a checksum of the document's id and the run, loses a letter.
DAMAGED = 31
#: Code points of a text that are split at a time; a run isn't cut.
PIECE_POINTS = 1 << 20
#: Distinct words that a task counts before it passes them on.
PENDING = 400_000
#: Levels of the trie: groups of letters, by the code point's remainder.
LEVELS = 12
#: Words below a node, searching words of one block, pairs verified at a time.
NODE_WORDS, BLOCK_WORDS, PAIRS = 20_000, 10_000, 200_000
#: Points of a word's end.
END = 3
#: Below this many vectors a node's are compared at once; longer words are verified one by one.
FEW, LONG = 16, 64


def _pieces(text: str) -> Iterator[str]:
    at, outside = 0, re.compile("[^A-Za-zÀ-ÿ]")
    while at < len(text):
        cut = outside.search(text, at + PIECE_POINTS) if len(text) - at > PIECE_POINTS else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _count(least: int):
    """Words of a task's documents after their damage, and how often."""
    runs = re.compile(f"{LETTERS}{{{least},}}").findall  # a shorter run only gets shorter

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                salt = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    lowered = piece.encode().lower().decode()  # of bytes, only A-Z have a lower case
                    for word, n in Counter(runs(lowered)).items():
                        h = zlib.crc32(word.encode(), salt)
                        if h % DAMAGED == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) >= PENDING:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    return run


def count_words(df: DataFrame, least: int = 7, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, some of which lose a letter, of ``least`` code points or more."""
    narrow = df.select(F.col(id_col).cast("string"), F.col(text_col))
    counted = narrow.mapInArrow(_count(least), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


class Coded:
    """Words as code points (all below 256), one after the other, and their vectors."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        word = np.repeat(np.arange(len(words)), self.size)
        self.vectors = np.bincount(word * LEVELS + self.points % LEVELS, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last points of each word: one edit leaves one end as it is. Of words shorter
        than two ends nothing is said, by zeros."""
        near = np.arange(END)
        whole = self.size >= 2 * END + 1
        head = np.where(whole[:, None], self.points[np.minimum(self.first[:, None] + near, len(self.points) - 1)], 0)
        tail = np.where(whole[:, None], self.points[np.maximum((self.first + self.size)[:, None] - 1 - near, 0)], 0)
        scale = np.array([1, 1 << 8, 1 << 16], np.uint32)
        return head @ scale, tail @ scale

    def matrix(self, which: np.ndarray, columns: int) -> np.ndarray:
        at = np.arange(columns)
        inside = at < self.size[which][:, None]
        return np.where(inside, self.points[np.minimum(self.first[which][:, None] + at, len(self.points) - 1)], 0)


def _node(vectors: np.ndarray) -> np.ndarray:
    """A number for each row of leading counts. Nodes that share one are searched together."""
    with np.errstate(over="ignore"):
        x = np.full(len(vectors), vectors.shape[1], np.uint64)
        for column in vectors.T:
            x = (x ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
    return x.view(np.int64)


def _budget(depth: int) -> np.ndarray:
    """Changes of the first ``depth`` counts that one surplus and one deficit allow."""
    out = [np.zeros(depth, np.int32)]
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up != down:
                change = np.zeros(depth, np.int32)
                if up >= 0:
                    change[up] += 1
                if down >= 0:
                    change[down] -= 1
                out.append(change)
    return np.array(out)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = Coded(batch.column(0).to_pylist()).vectors
        nodes = np.stack([_node(vectors[:, :d]) for d in range(1, LEVELS + 1)], axis=1)
        yield pa.record_batch({"depth": pa.array(np.tile(np.arange(1, LEVELS + 1, dtype=np.int32), len(vectors))), "node": pa.array(nodes.ravel())})


def _depth(words: DataFrame) -> tuple[int, int]:
    """The depth at which no node has more than NODE_WORDS words, else the last, and its most words."""
    sizes = words.select("word").mapInArrow(_prefixes, "depth int, node bigint").groupBy("depth", "node").agg(F.count(F.lit(1)).alias("n"))
    most = {r.depth: r.n for r in sizes.groupBy("depth").agg(F.max("n").alias("n")).collect()}
    fits = [d for d in sorted(most) if most[d] <= NODE_WORDS]
    depth = fits[0] if fits else LEVELS
    return depth, most.get(depth, 0)


def _deal(depth: int, salts: int):
    """Each word at its own node, and as a searching word at all nodes that its budget leads to."""
    changes = _budget(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK_WORDS):
                batch = whole.slice(k, BLOCK_WORDS)
                own = Coded(batch.column(0).to_pylist()).vectors[:, :depth]
                part = np.array([zlib.crc32(w.encode()) % salts for w in batch.column(0).to_pylist()], np.int32)
                yield pa.record_batch({"node": pa.array(_node(own)), "part": pa.array(part), "searches": pa.array(np.zeros(len(own), bool)), "word": batch.column(0), "n": batch.column(1)})
                for change in changes:
                    to = own + change
                    able = np.flatnonzero((to >= 0).all(axis=1))
                    for salt in range(salts):
                        yield pa.record_batch({
                            "node": pa.array(_node(to[able])), "part": pa.array(np.full(len(able), salt, np.int32)), "searches": pa.array(np.ones(len(able), bool)),
                            "word": batch.column(0).take(pa.array(able)), "n": pa.nulls(len(able), pa.int64())})

    return run


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def _verified(some: Coded, others: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of words are one edit apart."""
    swap = some.size[i] > others.size[j]
    short, long = np.where(swap, others.size[j], some.size[i]), np.where(swap, some.size[i], others.size[j])
    out = np.zeros(len(i), bool)
    tall = long > LONG
    for k in np.flatnonzero(tall).tolist():
        out[k] = one_edit(some.words[i[k]], others.words[j[k]])
    rest = np.flatnonzero(~tall & (long - short <= 1))
    if not len(rest):
        return out
    i, j, swap, short, long = i[rest], j[rest], swap[rest][:, None], short[rest], long[rest]
    columns = int(long.max()) + 1
    x, y = some.matrix(i, columns), others.matrix(j, columns)
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    differs = a != b
    shifted = a[:, :-1] != b[:, 1:]  # behind an insertion
    # Behind the first difference the rest is the same, at the same place or one further.
    seen = np.maximum.accumulate(differs, axis=1)[:, :-1]
    out[rest] = np.where(long == short, differs.sum(axis=1) == 1, ~(shifted & seen).any(axis=1))
    return out


class Trie:
    """Words arranged by their vectors: a node is a range of the sorted rows."""

    def __init__(self, words: list[str], n: np.ndarray):
        coded = Coded(words)
        order = np.lexsort(coded.vectors.T[::-1])
        self.coded, self.n = Coded([words[k] for k in order]), n[order]
        self.ends = self.coded.ends()

    def candidates(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (searching row, word), depth first. A stack entry is a node and who is still
        searching there, with what is left of each one's surplus and deficit."""
        own = self.coded.vectors
        every = np.arange(len(vectors))
        full = np.ones(len(vectors), bool)
        stack = [(0, len(own), 0, every, full, full)]
        while stack:
            a, b, level, who, up, down = stack.pop()
            if level == LEVELS:
                for k in range(0, len(who), step := max(1, PAIRS // (b - a))):
                    part = who[k:k + step]
                    yield np.repeat(part, b - a), np.tile(np.arange(a, b), len(part))
                continue
            if b - a <= FEW:
                for k in range(0, len(who), step := max(1, PAIRS // (b - a))):
                    part = who[k:k + step]
                    change = own[None, a:b, level:] - vectors[part][:, None, level:]
                    surplus, deficit = np.maximum(change, 0).sum(axis=2), np.maximum(-change, 0).sum(axis=2)
                    i, j = np.nonzero((surplus <= up[k:k + step, None]) & (deficit <= down[k:k + step, None]))
                    yield part[i], j + a
                continue
            column = own[a:b, level]
            cuts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), b - a]):
                change = int(column[low]) - vectors[who, level]
                on = np.flatnonzero((change == 0) | ((change == 1) & up) | ((change == -1) & down))
                if len(on):
                    stack.append((a + low, a + high, level + 1, who[on], up[on] & (change[on] != 1), down[on] & (change[on] != -1)))

    def near(self, words: list[str]) -> pa.RecordBatch:
        """Of each searching word that has any: how many words are near, and the best of them."""
        some = Coded(words)
        (head, tail), (heads, tails) = some.ends(), self.ends
        brief, briefs = head == 0, heads == 0
        held, found = [], []

        def verify() -> None:
            i, j = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for k in range(0, len(i), PAIRS):
                good = _verified(some, self.coded, i[k:k + PAIRS], j[k:k + PAIRS])
                found.append((i[k:k + PAIRS][good], j[k:k + PAIRS][good]))

        size = 0
        for i, j in self.candidates(some.vectors):
            may = np.flatnonzero((head[i] == heads[j]) | (tail[i] == tails[j]) | brief[i] | briefs[j])
            held.append((i[may], j[may]))
            size += len(may)
            if size >= PAIRS:
                verify()
                size = 0
        if held:
            verify()
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        counts = np.bincount(i, minlength=len(words))
        best: dict[int, tuple[int, str]] = {}
        for x, n, near in zip(i.tolist(), self.n[j].tolist(), (self.coded.words[k] for k in j.tolist())):
            if x not in best or (-n, near) < best[x]:
                best[x] = -n, near
        at = sorted(best)
        return pa.record_batch({"word": pa.array([words[k] for k in at], pa.string()), "n_near": pa.array(counts[at] if at else [], pa.int64()),
                                "best_n": pa.array([-best[k][0] for k in at], pa.int64()), "best": pa.array([best[k][1] for k in at], pa.string())})


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by node, a node's own words before those that search below it."""
    at, words, counts, trie, searching = None, [], [], None, []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal trie
        if searching and words:
            trie = trie or Trie(words, np.array(counts, np.int64))
            yield trie.near(searching)
        searching.clear()

    for batch in batches:
        for node, part, searches, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, part) != at:
                yield from flush()
                at, words, counts, trie = (node, part), [], [], None
            if searches:
                searching.append(word)
                if len(searching) >= BLOCK_WORDS:
                    yield from flush()
            else:
                words.append(word)
                counts.append(n)
    yield from flush()


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of each word of ``word, n`` (distinct) that has a word one edit away."""
    depth, most = _depth(words)
    # Words of one whole vector that are still too many are dealt to parts, and searched in each.
    salts = max(1, -(-most // NODE_WORDS))
    dealt = words.select("word", "n").mapInArrow(_deal(depth, salts), "node bigint, part int, searches boolean, word string, n bigint")
    sorted_ = dealt.repartition(width(words.sparkSession), "node", "part").sortWithinPartitions("node", "part", "searches")
    found = sorted_.mapInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best", "best_n")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "x.best_n", "x.best")


def spelling_groups(df: DataFrame, least: int = 7, min_count: int = 2, factor: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: ``word, n, n_near, form, form_n, root``.

    Words are counted as in :func:`count_words`. ``n_near`` is the number of words exactly one
    inserted, deleted or replaced code point away. ``form`` is the one of these found most often
    (of ties the first in code-point order) if that is ``factor`` times as often as the word or
    more, else null; ``root`` is where forms of forms end, the word itself if it has none. Null
    texts have no words; a null id counts as an empty one; rows that share an id are damaged
    alike. Texts without words and an empty table give no rows; other columns are not read.
    """
    words = materialise(count_words(df, least, min_count, id_col, text_col), "words")
    usual = F.col("best_n") >= factor * F.col("n")
    forms = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n"))
    forms = materialise(forms, "forms")
    # Pointers double: counts grow by ``factor`` with each step, so there are few.
    roots = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "form-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "form-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
