"""Splitting many texts into words at once, on arrays of code points.

The split rules are those of public byte-pair tokenizers: contractions, then runs of letters,
digits and other characters, with or without the space before them. Classes of characters are
computed for a whole batch of texts, so a word costs no Python call; equal words are found by a
64-bit hash and compared byte by byte.
"""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
#: Code points handled at a time. Longer texts are cut between two words.
BATCH_POINTS = 1_000_000
_SEPARATOR = 0x110000
#: A space between two characters that aren't white space: words don't reach across it.
_GAP = re.compile(r"(?<=\S) (?=\S)")


@cache
def _classes() -> np.ndarray:
    out = np.full(_SEPARATOR + 1, OTHER, np.uint8)
    major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(_SEPARATOR)], np.uint8)
    out[:_SEPARATOR][major == ord("L")] = LETTER
    out[:_SEPARATOR][major == ord("N")] = DIGIT
    # Unicode's White_Space.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[_SEPARATOR] = BREAK
    return out


@dataclass
class Words:
    """Words of several texts, in order: hash, place of the bytes in ``data``, number of the text."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    data: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, a word with each, and for each word its place among them. Words of one
        hash but other bytes are distinct, and stand behind the others with the same hash."""
        hashes, which, place = np.unique(self.hashes, return_index=True, return_inverse=True)
        other = np.flatnonzero(~self.same(np.arange(len(place)), which[place]))
        if not len(other):
            return hashes, which, place
        known: dict[bytes, int] = {}
        new = []
        for k in other.tolist():
            if (at := known.setdefault(self.bytes_of(k), len(hashes) + len(new))) == len(hashes) + len(new):
                new.append(k)
            place[k] = at
        return np.concatenate([hashes, self.hashes[new]]), np.concatenate([which, new]), place

    def same(self, i: np.ndarray, j: np.ndarray, others: Words | None = None) -> np.ndarray:
        """Whether words ``i`` have the bytes of words ``j`` (of ``others``)."""
        others = others or self
        size = self.last[i] - self.first[i]
        out = size == others.last[j] - others.first[j]
        for k in range(0, len(i), step := 100_000):
            own = np.flatnonzero(out[k:k + step] & ((i[k:k + step] != j[k:k + step]) | (others is not self))) + k
            n = size[own]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0)
            differ = self.data[at + np.repeat(self.first[i[own]] - ends + n, n)] != others.data[at + np.repeat(others.first[j[own]] - ends + n, n)]
            if differ.any():
                out[own[np.searchsorted(ends, np.flatnonzero(differ), side="right")]] = False
        return out

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.first[k]:self.last[k]].tobytes()


def mixed(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each code point at its place in a word; a word's hash is their sum."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += places.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


class Splitter:
    """``spaced``: words take the space before them and other white space forms words of its own;
    otherwise white space is dropped and every digit is a word."""

    def __init__(self, spaced: bool):
        self.spaced = spaced

    def split(self, texts: Sequence[str]) -> Words:
        points = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32).copy() if texts else np.zeros(0, np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        points[ends[:-1]] = _SEPARATOR
        n = len(points)
        kinds = _classes()[points]
        starts = np.empty(n, bool)
        starts[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        run = np.flatnonzero(starts)
        if not self.spaced:
            starts |= kinds == DIGIT
        self._contractions(points, kinds, starts, run)
        if self.spaced:
            self._attach_spaces(points, kinds, starts, run)
            drop = kinds == BREAK
        else:
            drop = (kinds == BREAK) | (kinds == SPACE)
        first = np.flatnonzero(starts)
        last = np.append(first[1:], n)
        keep = ~drop[first]
        first, last = first[keep], last[keep]
        # Bytes of UTF-8 before each point; a separator takes none.
        size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        size[kinds == BREAK] = 0
        offset = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        places = np.arange(n, dtype=np.uint32)
        places -= np.maximum.accumulate(np.where(starts, places, 0))
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mixed(points, places), out=total[1:])
            hashes = total[last] - total[first]
        return Words(hashes, offset[first], offset[last], np.searchsorted(ends, first, side="left"), np.frombuffer("".join(texts).encode(), np.uint8))

    def _contractions(self, points, kinds, starts, run) -> None:
        """'s 't 're 've 'm 'll 'd at the start of a word end there; what letters follow is a new word."""
        at = run[(points[run] == ord("'"))]
        at = at[at + 1 < len(points)]
        at = at[kinds[at + 1] == LETTER]
        if self.spaced:  # a space before the quote is part of its word, which then doesn't start with the quote
            at = at[(at == 0) | (points[at - 1] != 32)]
        if not len(at):
            return
        a, b = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        b = np.where(at + 2 < len(points), b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, length in ((one, 2), (two & ~one, 3)):
            starts[at[hit] + 1] = False
            after = at[hit] + length
            starts[after[after < len(points)]] = True

    def _attach_spaces(self, points, kinds, starts, run) -> None:
        """The last space before a word belongs to it; other white space is a word, split before that last character."""
        last = np.append(run[1:], len(points)) - 1
        blank = kinds[run] == SPACE
        end = last[blank]
        followed = (end + 1 < len(points)) & (kinds[np.minimum(end + 1, len(points) - 1)] != BREAK)
        end = end[followed]
        starts[end] = True
        joins = end[points[end] == 32]
        starts[joins + 1] = False


def pieces(text: str) -> list[str]:
    """A text cut between words into pieces of about BATCH_POINTS; a run without a gap stays whole."""
    out, at = [], 0
    while len(text) - at > BATCH_POINTS and (gap := _GAP.search(text, at + BATCH_POINTS)):
        out.append(text[at:gap.start()])
        at = gap.start()
    return [*out, text[at:]]


def release() -> None:
    """Give the memory that Arrow and the C library hold free back, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batched(items: Iterator[tuple], size_of, least: int | None = None) -> Iterator[list[tuple]]:
    """Lists of items of at least ``least`` (else BATCH_POINTS) together, or the rest."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size_of(item)
        if total >= (least or BATCH_POINTS):
            yield held
            held, total = [], 0
    if held:
        yield held
