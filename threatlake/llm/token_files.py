"""Token ids of all documents in files of Simple-8b words, in order of the document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm import simple8b
from threatlake.llm.bpe import byte_letters
from threatlake.llm.common import shared_path, text_or_empty, width, with_offsets
from threatlake.llm.files import map_shared, pack_arrays, unpack_arrays, write_shared
from threatlake.llm.pretokens import Splitter, Words, batched, pieces, release
from threatlake.session import materialise

#: A file ends with the document that brings it to so many ids.
FILE_IDS = 1 << 22
#: Words whose ids a worker remembers.
KNOWN_WORDS = 400_000
#: Words given to the library in one call, whose results are larger than the words.
WORDS_AT_ONCE = 2_000
#: Code points of texts encoded at a time.
ENCODE_POINTS = 2_000_000
#: A byte that no text has in UTF-8.
_BETWEEN = 0xFF


class _Memory:
    """Words and their ids, sorted by the words' hashes, as arrays."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.words, self.begins, self.ids, self.used, self.turn = Words(np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint8)), np.zeros(1, np.int64), np.zeros(0, np.uint32), none, 0

    def find(self, words: Words, hashes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        self.turn += 1
        if not len(self.used):
            return np.full(len(which), -1)
        at = np.minimum(np.searchsorted(self.words.hashes, hashes), len(self.used) - 1)
        own = np.flatnonzero(self.words.hashes[at] == hashes)
        own = own[words.same(which[own], at[own], self.words)]
        out = np.full(len(which), -1)
        out[own] = at[own]
        self.used[at[own]] = self.turn
        return out

    def add(self, words: Words, which: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> None:
        """Remember words; beyond KNOWN_WORDS those not met for longest are forgotten."""
        old = np.arange(len(self.used))
        if len(old) + len(which) > KNOWN_WORDS:
            old = np.sort(np.argsort(-self.used, kind="stable")[:KNOWN_WORDS // 2])
        size = np.concatenate([(self.words.last - self.words.first)[old], words.last[which] - words.first[which]])
        data = np.concatenate([ragged(self.words.data, self.words.first[old], size[:len(old)]), ragged(words.data, words.first[which], size[len(old):])])
        n = np.concatenate([np.diff(self.begins)[old], np.diff(begins)])
        flat = np.concatenate([ragged(self.ids, self.begins[:-1][old], n[:len(old)]), ids])
        hashes, used = np.concatenate([self.words.hashes[old], words.hashes[which]]), np.concatenate([self.used[old], np.full(len(which), self.turn)])
        order = np.argsort(hashes, kind="stable")
        order = order[np.append(True, hashes[order][1:] != hashes[order][:-1])[:len(order)]]  # of words with one hash the first
        first, begin = (np.cumsum(size) - size)[order], (np.cumsum(n) - n)[order]
        self.words = Words(hashes[order], first, first + size[order], np.zeros(0, np.int64), data)
        self.ids, self.used = ragged(flat, begin, n[order]), used[order]
        self.begins = np.concatenate([[0], np.cumsum(n[order])])


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]


class LibraryEncoder:
    """The tokenizers library behind a memory of words: it sees a word again only when that was forgotten.

    Splitting comes before merging in this model, so a text's ids are its words' ids in order.
    """

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library, self.end_id = Tokenizer.from_file(tokenizer), end_id
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.splitter, self.memory = Splitter(spaced=True), _Memory()
        # Words are given to the library spelled in the letters of bytes, so that it need not split
        # them again: one text of many, with a line break (as a word) between two.
        letters = byte_letters()
        self.words = Tokenizer.from_file(tokenizer)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.spelling = {**dict(enumerate(letters)), _BETWEEN: f" {letters[10]} "}
        self.line_break = self.words.token_to_id(letters[10])

    def _coded(self, words: Words, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: where each word's begin and how many they are in the ids of all."""
        place = self.memory.find(words, hashes, which)
        new = np.flatnonzero(place < 0)
        begins, ids = self._new(words, which[new])
        begin, count = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        old = np.flatnonzero(place >= 0)
        begin[old], count[old] = self.memory.begins[place[old]], np.diff(self.memory.begins)[place[old]]
        begin[new], count[new] = len(self.memory.ids) + begins[:-1], np.diff(begins)
        flat = np.concatenate([self.memory.ids, ids])
        if len(new):
            self.memory.add(words, which[new], begins, ids)
        return flat, begin, count

    def _new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the library has to see, and the places where each word's begin and the last ends."""
        size = words.last[which] - words.first[which]
        ends = np.cumsum(size)
        data = ragged(words.data, words.first[which], size)
        breaks = np.zeros(len(which), bool)
        breaks[np.searchsorted(ends, np.flatnonzero(data == 10), side="right")] = True
        counts = np.zeros(len(which), np.int64)
        parts, plain = [], np.flatnonzero(~breaks)
        for k in range(0, len(plain), WORDS_AT_ONCE):
            own = plain[k:k + WORDS_AT_ONCE]
            spelled = np.full(int(size[own].sum()) + len(own) - 1, _BETWEEN, np.uint8)
            to = np.cumsum(size[own] + 1) - size[own] - 1
            spelled[ragged(np.arange(len(spelled)), to, size[own])] = ragged(data, ends[own] - size[own], size[own])
            text = spelled.tobytes().decode("latin-1").translate(self.spelling)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.append(np.flatnonzero(ids == self.line_break), len(ids))
            counts[own] = np.diff(last, prepend=-1) - 1
            parts.append((own, ids[ids != self.line_break]))
        for k in np.flatnonzero(breaks).tolist():
            ids = self.library.encode(words.bytes_of(which[k]).decode(), add_special_tokens=False).ids
            counts[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.uint32)))
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begins[-1], np.uint32)
        for own, ids in parts:
            out[ragged(np.arange(len(out)), begins[own], counts[own])] = ids
        return begins, out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, none of which spells a special token."""
        words = self.splitter.split(texts)
        hashes, which, place = words.distinct()
        flat, begin, count = self._coded(words, hashes, which)
        n = count[place]
        every = ragged(flat, begin[place], n)
        edges = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(words.text, np.arange(len(texts) + 1))].tolist()
        return [every[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id included. A text that spells a special token is encoded whole."""
        cut = [None if any(s in t for s in self.special) else pieces(t) for t in texts]
        coded = (x for some in batched(((p,) for own in cut if own for p in own), lambda x: len(x[0]), ENCODE_POINTS) for x in self._ids([p for p, in some]))
        end = np.array([self.end_id], np.uint32)
        return [np.concatenate([*([np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)] if own is None else islice(coded, len(own))), end])
                for text, own in zip(texts, cut)]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, end_id: int) -> LibraryEncoder:
    """A worker's encoder, whose memory outlives a task."""
    return LibraryEncoder(tokenizer, end_id)


def _writer(path: str, tokenizer: str, end_id: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer, end_id)
        names, coded, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, coded, held, number
            uri = f"{path}/{part:08d}-{number:06d}.s8b"
            counts = np.array([len(x) for x in coded], np.int64)
            write_shared(uri, pack_arrays({
                "doc_ids": np.array([0 if x is None else x for x in names], np.int64), "nulls": np.array([x is None for x in names], np.uint8),
                "counts": counts, **simple8b.encode(np.concatenate(coded))}))
            row = pa.record_batch({"_part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "uri": pa.array([uri], pa.string()),
                                   "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([int(counts.sum())], pa.int64())})
            names, coded, held, number = [], [], 0, number + 1
            return row

        rows = ((i, t.as_py()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        for some in batched(rows, lambda x: len(x[1]), ENCODE_POINTS):
            for (name, _), ids in zip(some, encoder.encode([t for _, t in some])):
                names.append(name)
                coded.append(ids)
                held += len(ids)
                if held >= file_ids:
                    yield close()
        if names:
            yield close()
        release()

    return write


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all documents; return the manifest ``_part, number, uri, n_docs, n_ids``.

    Documents are dealt to ranges of ids and each task writes its range in order, so files in
    order of (range, number) hold documents in ascending id: null ids first, rows that share an
    id by a hash of the text. ``end_id`` follows every document. Null texts are empty. An empty
    table makes no file. A task that is repeated writes the same files again.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = narrow.repartitionByRange(width(df.sparkSession), "doc_id").withColumn("_tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "_tie").drop("_tie")
    manifest = dealt.mapInArrow(_writer(path, tokenizer, end_id, file_ids), "_part int, number int, uri string, n_docs bigint, n_ids bigint")
    return materialise(manifest, "token-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
            file = unpack_arrays(map_shared(uri))
            ids, counts = simple8b.decode(file).astype("<u4"), file["counts"]
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.record_batch({
                "doc_id": pa.array(np.array(file["doc_ids"]), mask=np.array(file["nulls"]).astype(bool)), "start": pa.array(start + ends - counts),
                "n_tokens": pa.array(np.array(counts)), "ids_crc32": pa.array(crcs, pa.int64())})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold: ``doc_id, start, n_tokens, ids_crc32`` of each document.

    ``start`` counts the ids of all documents before it: totals of the ranges are summed in
    order, then those of the files of a range.
    """
    placed = with_offsets(manifest, [F.col("number")], {"start": F.col("n_ids")})
    return placed.select("uri", "start").repartition(width(manifest.sparkSession), "uri").mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenize_to_files(df: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write the files to a fresh shared folder and read them back."""
    path = shared_path(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, path, tokenizer, end_id, **options))
