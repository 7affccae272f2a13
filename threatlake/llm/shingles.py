"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from threatlake.llm.pretokens import mixed

#: Bytes of text hashed at a time. Longer texts are cut at white space.
BATCH_BYTES = 750_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[ \t-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of distinct ``words``-word shingles: A-Z lower-cased, words between white space of
    ``[\\x20\\x09-\\x0D]``. A text of fewer words is one shingle; one without words has none."""

    def __init__(self, words: int = 5):
        self.words = words
        rng = np.random.default_rng(words)
        self._places = rng.integers(1, 1 << 62, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _words(self, coded: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Hashes of the words of all texts, and the places where each text's begin and the last ends."""
        data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        blank = _SPACE[data]
        starts = ~blank & np.concatenate([[True], blank[:-1]])
        first = np.flatnonzero(starts)
        last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        places = np.arange(len(data), dtype=np.uint32)
        places -= np.maximum.accumulate(np.where(starts, places, 0))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed(data, places), out=total[1:])
        ends = np.cumsum([len(c) + 1 for c in coded])
        return _mix(total[last] - total[first] + np.uint64(1)), np.concatenate([[0], np.searchsorted(first, ends)]).tolist()

    def _shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = max(0, len(hashes) - self.words + 1)
        shingles = np.zeros(n, np.uint64)
        for k, m in enumerate(self._places):
            shingles += hashes[k:k + n] * m
        return _mix(shingles)

    def _whole(self, hashes: np.ndarray) -> np.ndarray:
        """Of fewer words than a shingle has."""
        if not len(hashes):
            return np.zeros(0, np.uint64)
        return _mix(np.array([(hashes * self._places[:len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))]))

    def _long(self, data: bytes) -> np.ndarray:
        held, found, at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        while at < len(data):
            cut = _BLANK.search(data, at + BATCH_BYTES)
            end = cut.start() if cut else len(data)
            held, at = np.concatenate([held, self._words([data[at:end]])[0]]), end
            if len(held) >= self.words:
                found = np.union1d(found, self._shingles(held))
                held = held[len(held) - self.words + 1:]
        return found if len(found) else self._whole(held)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        coded = [t.encode().lower() for t in texts]  # of bytes, only A-Z have a lower case
        with np.errstate(over="ignore"):
            hashes, edges = self._words([c if len(c) <= BATCH_BYTES else b"" for c in coded])
            shingles, out = self._shingles(hashes), []
            for a, b, c in zip(edges, edges[1:], coded):
                if len(c) > BATCH_BYTES:
                    out.append(self._long(c))
                elif b - a >= self.words:
                    out.append(np.unique(shingles[a:b - self.words + 1]))
                else:
                    out.append(self._whole(hashes[a:b]))
        return out


def batches_of(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of (..., text) of at least BATCH_BYTES characters together, or the rest."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held
