"""Simple-8b: integers packed into 64-bit words, coded and decoded many at a time.

A word's top four bits name how many values it holds and their width; the other sixty hold
them, lowest first. Values of more than 60 bits stand in a table of their own and their word
holds the place in it. Values are coded in blocks, so that a block can be read without the
words before it.
"""

from __future__ import annotations

import numpy as np

#: Values and bits by selector; selector 1 escapes to the table.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
BLOCK = 256
_TAG = np.uint64(60)
_PAYLOAD = np.uint64((1 << 60) - 1)


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _choices(width: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that takes most values from there; past a block's end all fits."""
    out = np.full(width.shape, ESCAPE, np.uint8)
    most, reach = width.copy(), 1  # the widest of the next ``reach`` values
    for selector in range(15, -1, -1):
        if selector == ESCAPE:
            continue
        while reach < COUNTS[selector]:
            step = min(reach, int(COUNTS[selector]) - reach)
            most[:, :-step] = np.maximum(most[:, :-step], most[:, step:]) if step < width.shape[1] else most[:, :-step]
            reach += step
        out[most <= WIDTHS[selector]] = selector
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """``n``, ``words``, ``offsets`` (words before each block and in all) and ``escapes``."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.ravel()[:len(values)] = values
    choice = _choices(_width(grid))
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = len(values) - (blocks - 1) * BLOCK
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    of, place, nth = [], [], []
    while len(live):  # the next word of every block that isn't done
        of.append(live)
        place.append(at)
        nth.append(np.full(len(live), len(nth)))
        at = at + COUNTS[choice[live, at]]
        more = at < ends[live]
        live, at = live[more], at[more]
    of, place, nth = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, place, nth))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=blocks))]).astype(np.int64) if blocks else np.zeros(1, np.int64)
    to = offsets[of] + nth
    of[to], place[to] = of.copy(), place.copy()
    selector = choice[of, place].astype(np.int64)
    words = selector.astype(np.uint64) << _TAG
    for s in range(2, 16):
        own = np.flatnonzero(selector == s)
        for k in range(COUNTS[s] if len(own) else 0):
            to = place[own] + k
            part = np.where(to < BLOCK, grid[of[own], np.minimum(to, BLOCK - 1)], np.uint64(0))
            words[own] |= part << np.uint64(k * WIDTHS[s])
    large = np.flatnonzero(selector == ESCAPE)
    words[large] |= np.arange(len(large), dtype=np.uint64)
    return {"n": np.array([len(values)]), "words": words, "offsets": offsets, "escapes": grid[of[large], place[large]]}


def decode(coded: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (all, if not given), which is not read itself."""
    offsets, n = coded["offsets"], int(coded["n"][0])
    last = len(offsets) - 1 if last is None else last
    words = coded["words"][offsets[first]:offsets[last]]
    selector = (words >> _TAG).astype(np.int64)
    counts = COUNTS[selector]
    # Where a word's values go: behind those of its block before it.
    before = np.concatenate([[0], np.cumsum(counts)])
    heads = offsets[first:last] - offsets[first]
    block = np.repeat(np.arange(last - first), np.diff(offsets[first:last + 1]))
    to = block * BLOCK + before[:-1] - before[heads][block]
    out = np.zeros((last - first) * BLOCK, np.uint64)
    end = (block + 1) * BLOCK
    payload = words & _PAYLOAD
    for s in range(2, 16):
        own = np.flatnonzero(selector == s)
        for k in range(COUNTS[s] if len(own) else 0):
            value = payload[own] >> np.uint64(k * WIDTHS[s]) & np.uint64((1 << int(WIDTHS[s])) - 1)
            inside = to[own] + k < end[own]
            out[to[own][inside] + k] = value[inside]
    large = selector == ESCAPE
    out[to[large]] = coded["escapes"][payload[large].astype(np.int64)]
    return out[:max(0, min(last * BLOCK, n) - first * BLOCK)]
