"""Byte-pair encoding with a lexicon of frequent words in a minimal acyclic transducer.

A word is looked up in the transducer, whose arcs are bytes and whose outputs sum to the
number of the word, and so to its ids; a word that isn't in it is merged exactly. Both work on
many words at once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threatlake.llm.common import shared_path
from threatlake.llm.files import map_shared, pack_arrays, unpack_arrays, write_shared
from threatlake.llm.pretokens import Splitter, Words, batched, pieces, release

#: Words of the lexicon: a bound on its size, not on what is encoded.
LEXICON_WORDS = 60_000
#: Words of more bytes are merged with a heap, the others many at a time.
LONG_WORD = 192
_NONE = np.int32(1 << 30)


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a byte-pair model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.final = np.array([vocab[c + suffix] for c in byte_letters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        order = order[np.append(True, np.diff(keys[order]) != 0)]
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def encode(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and the places where each word's begin and the last ends."""
        size = words.last[which] - words.first[which]
        counts = np.zeros(len(which), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # places in ``which``, ids in rows padded with -1
        low = 0
        for high in (4, 8, 12, 16, 24, 48, 96, LONG_WORD):
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            # A bounded matrix at a time.
            for k in range(0, len(own), step := max(1, 1_000_000 // high)):
                part = own[k:k + step]
                rows = self._merge(words, words.first[which[part]], size[part], high)
                counts[part] = (rows >= 0).sum(axis=1)
                parts.append((part, rows))
        for k in np.flatnonzero(size > LONG_WORD):
            row = self._merge_long(words.bytes_of(which[k]))
            counts[k] = len(row)
            parts.append((np.array([k]), row[None]))
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begins[-1], np.int32)
        for part, rows in parts:
            held = rows >= 0
            out[(begins[part][:, None] + np.arange(rows.shape[1]))[held]] = rows[held]
        return out, begins

    def _merge(self, words: Words, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        cols = np.arange(width)
        inside = cols < size[:, None]
        at = np.minimum(first[:, None] + cols, len(words.data) - 1)
        rows = np.where(inside, self.inner[words.data[at]], -1).astype(np.int32)
        ends = np.arange(len(rows)), size - 1
        rows[ends] = self.final[words.data[first + size - 1]]
        done = np.full_like(rows, -1)
        ranks = np.full(rows.shape, _NONE, np.int32)
        ranks[:, :-1] = self._rank(rows[:, :-1], rows[:, 1:])
        names = np.arange(len(rows))
        while len(rows):
            j = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, j]
            live = best < _NONE
            if not live.all():
                done[names[~live]] = rows[~live]
                rows, ranks, names, j, best = rows[live], ranks[live], names[live], j[live], best[live]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            rows = np.take_along_axis(rows, take, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= j[:, None]), width - 1), axis=1)
            rows[:, -1], ranks[:, -1] = -1, _NONE
            rows[every, j] = self.made[best]
            right = np.minimum(j + 1, width - 1)
            ranks[every, j] = np.where(j + 1 < width, self._rank(rows[every, j], rows[every, right]), _NONE)
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._rank(rows[left, j[left] - 1], rows[left, j[left]])
        return done

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of pairs by rank and place over a linked list."""
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        table = self._table()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(table[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in table]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] < 0 or after[k] < 0 or table.get((ids[k], ids[after[k]])) != rank:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = int(self.made[rank]), -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (r := table.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x))
        return np.array([x for x in ids if x >= 0], np.int32)

    @cache
    def _table(self) -> dict[tuple[int, int], int]:
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist())}


def build_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, numbering them in order.

    States with the same arcs and finality are one (shared suffixes), found as words arrive in
    order. An arc's output is the number of words that its state accepts before those through
    it, so outputs along a word sum to its number.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of finished states
    final: list[bool] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # the last word's states

    def finish(depth: int, labels: bytes) -> None:
        while len(path) > depth + 1:
            ends, own = path.pop()
            k = register.setdefault(key := (ends, tuple(own)), len(arcs))
            if k == len(arcs):
                arcs.append(own)
                final.append(ends)
            path[-1][1].append((labels[len(path) - 1], k))
            del key

    last = b""
    for word in words:
        shared = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        finish(shared, last)
        path.extend((False, []) for _ in range(len(word) - shared))
        path[-1] = (True, path[-1][1])
        last = word
    finish(0, last)
    arcs.append(path[0][1])
    final.append(path[0][0])
    accepted = [0] * len(arcs)  # a state comes after those that its arcs lead to
    keys, to, out = [], [], []
    for k, own in enumerate(arcs):
        n = int(final[k])
        for label, target in own:
            keys.append(k << 8 | label)
            to.append(target)
            out.append(n)
            n += accepted[target]
        accepted[k] = n
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    pick = lambda x: np.array(x, np.int64)[order] if len(order) else np.zeros(0, np.int64)
    return {"keys": pick(keys), "to": pick(to).astype(np.int32), "out": pick(out).astype(np.int32), "final": np.array(final, np.uint8), "root": np.array([len(arcs) - 1])}


class Lexicon:
    """Frequent words and their ids in one memory-mapped file."""

    def __init__(self, uri: str):
        self.t = unpack_arrays(map_shared(uri))

    @staticmethod
    def write(uri: str, words: list[bytes], merges: Merges) -> None:
        words = sorted(set(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        first = np.concatenate([[0], last[:-1]]) if words else last
        ids, begins = merges.encode(Words(last, first, last, last, data), np.arange(len(words)))
        write_shared(uri, pack_arrays({**build_transducer(words), "ids": ids, "begins": begins}))

    def numbers(self, words: Words, which: np.ndarray) -> np.ndarray:
        """The number of each word, or -1: all words take one arc at a time."""
        t = self.t
        out = np.full(len(which), -1, np.int64)
        if not len(t["keys"]):
            return out
        first, size = words.first[which], words.last[which] - words.first[which]
        live, state, total = np.arange(len(which)), np.full(len(which), t["root"][0], np.int64), np.zeros(len(which), np.int64)
        step = 0
        while len(live):
            over = size[live] == step
            here = live[over]
            out[here] = np.where(t["final"][state[here]] == 1, total[here], -1)
            live = live[~over]
            wanted = state[live] << 8 | words.data[first[live] + step]
            at = np.minimum(np.searchsorted(t["keys"], wanted), len(t["keys"]) - 1)
            hit = t["keys"][at] == wanted
            live, at = live[hit], at[hit]
            state[live] = t["to"][at]
            total[live] += t["out"][at]
            step += 1
        return out


def lowered(text: str) -> str:
    """NFC, then each letter's own lower case (a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _ragged(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows ``which`` of a ragged array, one after the other."""
    counts = begins[which + 1] - begins[which]
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - ends + counts, counts)]


class Encoder:
    """Texts to ids by lexicon and merges."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon, self.splitter = merges, lexicon, Splitter(spaced=False)
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(merges.special, key=len, reverse=True)) + ")") if merges.special else None

    def segments(self, text: str) -> list[str | int]:
        """Ordinary texts and ids of special tokens, which are found before anything else is done."""
        if not self._cut or not any(t in text for t in self.merges.special):
            return [lowered(text)]
        return [self.merges.special[x] if k % 2 else lowered(x) for k, x in enumerate(self._cut.split(text))]

    def word_ids(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lexicon is None:
            return self.merges.encode(words, which)
        number = self.lexicon.numbers(words, which)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        old_ids, old_begins = self.lexicon.t["ids"], self.lexicon.t["begins"]
        new_ids, new_begins = self.merges.encode(words, which[new])
        counts = np.empty(len(which), np.int64)
        counts[known] = old_begins[number[known] + 1] - old_begins[number[known]]
        counts[new] = np.diff(new_begins)
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begins[-1], np.int32)
        for own, ids in ((known, _ragged(old_ids, old_begins, number[known])), (new, new_ids)):
            n = counts[own]
            ends = np.cumsum(n)
            out[np.arange(len(ids)) + np.repeat(begins[own] - ends + n, n)] = ids
        return out, begins

    def _spelled(self, texts: list[str], decode: bool) -> list[tuple[int, str, str]]:
        """Number of ids, the ids in decimal and (if wanted) their tokens, each joined by spaces, of ordinary texts."""
        words = self.splitter.split(texts)
        _, which, place = words.distinct()
        ids, begins = self.word_ids(words, which)
        totals = np.concatenate([[0], np.cumsum(np.diff(begins)[place] if len(place) else np.zeros(0, np.int64))])
        edges = np.searchsorted(words.text, np.arange(len(texts) + 1))
        totals = np.diff(totals[edges]).tolist()
        ids, begins, place, edges = ids.tolist(), begins.tolist(), place.tolist(), edges.tolist()

        def joined(names: list[str]) -> list[str]:
            of_word = [" ".join(names[a:b]) for a, b in zip(begins, begins[1:])]
            return [" ".join(map(of_word.__getitem__, place[a:b])) for a, b in zip(edges, edges[1:])]

        tokens = self.merges.tokens
        return list(zip(totals, joined(list(map(str, ids))), joined([tokens[k] for k in ids]) if decode else [""] * len(texts)))

    def encode(self, texts: list[str], decode: bool = True) -> list[tuple[int, str, str]]:
        """Number of ids, the ids in decimal and (if wanted) their tokens, each joined by spaces, of each text."""
        cut = [[p for x in self.segments(t) for p in ([x] if isinstance(x, int) else pieces(x))] for t in texts]
        coded = (x for some in batched(((p,) for own in cut for p in own if isinstance(p, str)), lambda x: len(x[0])) for x in self._spelled([p for p, in some], decode))
        out = []
        for own in cut:
            parts = [(1, str(p), self.merges.tokens[p]) if isinstance(p, int) else next(coded) for p in own]
            out.append(parts[0] if len(parts) == 1 else (sum(n for n, _, _ in parts), *(" ".join(x[k] for x in parts if x[0]) for k in (1, 2))))
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that a task meets twice within a batch of texts, and how often."""
    splitter = Splitter(spaced=False)
    for texts in batched(((p,) for b in batches for t in b.column(0) for p in pieces(lowered(t.as_py() or ""))), lambda x: len(x[0])):
        words = splitter.split([t for t, in texts])
        _, which, place = words.distinct()
        counts = np.bincount(place, minlength=len(which))
        often = np.flatnonzero(counts > 1)
        yield pa.record_batch({"word": pa.array([words.bytes_of(k) for k in which[often].tolist()], pa.binary()), "n": pa.array(counts[often], pa.int64())})
    release()


def frequent_words(df: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` most frequent words of all texts (that a batch has twice), ties by their bytes."""
    counted = df.select(F.col(text_col)).mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(limit).select("word").collect()]


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, keep: Sequence[str] = (), decode: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, decoded`` (unless ``decode`` is false), then the columns named in ``keep``.

    ``ids`` are the decimal ids and ``decoded`` their tokens, each joined by one space: what the
    public library gives for this model without added special tokens, and what it decodes.
    Special tokens written in a text are found as such. Null texts are empty; an empty text has
    no ids and decodes to an empty text. Repeated rows and null ids are rows like others; an
    empty table gives no rows; columns that are not in ``keep`` are not read.

    Words are counted over all texts for the lexicon (bounded by ``lexicon_words``), which is
    compiled once and mapped from the shared folder by every task; texts are not shuffled. Words
    that it lacks are merged where they are met, so the result doesn't depend on it.
    """
    spark = df.sparkSession
    merges = Merges(tokenizer)
    uri = f"{shared_path(spark, 'lexicon')}/words.fst"
    Lexicon.write(uri, frequent_words(df, text_col, lexicon_words), merges)
    held = spark.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, Lexicon(uri))
        rows = ((i, t.as_py() or "", *own) for b in batches for i, t, *own in zip(b.column(0).to_pylist(), b.column(1), *(c.to_pylist() for c in b.columns[2:])))
        for part in batched(rows, lambda x: len(x[1])):
            encoded = encoder.encode([x[1] for x in part], decode)
            yield pa.record_batch({"doc_id": pa.array([x[0] for x in part], pa.int64()), "n_tokens": pa.array([n for n, _, _ in encoded], pa.int64()),
                                   "ids": pa.array([d for _, d, _ in encoded], pa.string()), **({"decoded": pa.array([t for _, _, t in encoded], pa.string())} if decode else {}),
                                   **{f.name: pa.array([x[2 + k] for x in part], f.type) for k, f in enumerate(kept)}})
        release()

    own = df.select(*(F.col(f"`{c}`") for c in keep)).schema
    kept = list(to_arrow_schema(own))
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`") for c in keep))
    return narrow.mapInArrow(run, StructType([*StructType.fromDDL("doc_id bigint, n_tokens bigint, ids string" + ", decoded string" * decode), *own]))
