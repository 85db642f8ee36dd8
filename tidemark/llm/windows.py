"""Content-defined anchors for finding repeated windows of symbol sequences.

A window is ``w`` consecutive symbols of one document. Its anchor is the run of ``k`` symbols
within it whose name (a 64-bit hash) is smallest, the last such one if several are. The anchor
depends on the window's content alone, so equal windows have equal anchors at equal places
(winnowing, Schleimer, Wilkerson and Aiken 2003). Neighbouring windows mostly share their anchor:
a *segment* is a maximal run of windows of one document with one anchor, about one for every
(w - k + 2) / 2 symbols. Segments with equal first window, last window and length hold the same
windows.
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(31), np.uint64(27)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> _S1)
    x *= _B
    x ^= x >> _S2
    x *= _A
    return x ^ (x >> _S1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of names ``(a, b)``."""
    x = a * _A
    x += b
    x ^= x >> _S1
    x *= _B
    return x


def grown(names: np.ndarray, have: int, length: int) -> np.ndarray:
    """Names of runs of ``length`` symbols from names of runs of ``have``, by pairing at doubling
    offsets; the last pair overlaps where it must."""
    while have < length:
        step = min(have, length - have)
        names = pair(names[:-step], names[step:]) if len(names) > step else names[:0]
        have += step
    return names


def width(length: int) -> int:
    """Bytes of the words by which runs of ``length`` bytes are read."""
    return next(n for n in (8, 4, 2, 1) if n <= length)


def words(data: np.ndarray, n: int) -> np.ndarray:
    """The number of ``n`` bytes (1, 2, 4 or 8) at every place of ``data``."""
    count = max(0, len(data) - n + 1)
    at_all = np.ndarray(count, f"<u{n}", np.ascontiguousarray(data), strides=(1,)) if count else np.zeros(0, f"<u{n}")
    return at_all.astype(np.uint64)


#: Places whose names are computed at once.
NAMED_AT_ONCE = 1 << 15


def named(numbers: np.ndarray, n: int, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Names of the runs of ``length`` bytes that start at ``at``, from the ``numbers`` of ``n`` bytes at every place; the last one
    overlaps where it must. Each ``seed`` gives names of its own."""
    out = np.empty(len(at), np.uint64)
    steps = [*range(0, length - n + 1, n), *([length - n] if length % n else [])]
    for a in range(0, len(at), NAMED_AT_ONCE):
        places = at[a : a + NAMED_AT_ONCE]
        name = np.full(len(places), mix(np.array([seed + 1], np.uint64))[0])
        for step in steps:
            name = pair(name, numbers[places + step])
        out[a : a + NAMED_AT_ONCE] = mix(name)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = 1
    while n < w:
        step = min(n, w - n)
        h = np.minimum(h[:-step], h[step:])
        n += step
    return h


#: Bits of a run's place within what ``segments`` gets at once, below the bits of its name.
PLACE = np.uint64(24)


def segments(names: np.ndarray, ends: np.ndarray, k: int, w: int, have: int = 1) -> dict[str, np.ndarray]:
    """Segments of the documents that end at ``ends`` in ``names`` of runs of ``have`` symbols (at most 2**24 symbols).

    Returns for each segment ``anchor`` (its name), ``place`` (where the anchor starts), ``first``
    and ``last`` (windows by their start), and the names ``runs`` of all runs of ``k`` symbols.
    Windows that would cross documents are left out.
    """
    m, none = w - k + 1, np.zeros(0, np.int64)
    runs = grown(names, have, k)
    if len(runs) < m:
        return {"anchor": np.zeros(0, np.uint64), "place": none, "first": none, "last": none, "runs": runs}
    later = np.arange(len(runs) - 1, -1, -1, dtype=np.uint64)  # of equal names the last is least
    least = sliding_min((runs >> PLACE << PLACE) | later, m)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    begins = np.concatenate([[0], ends[:-1]])
    beyond = np.maximum(begins, ends - w + 1)  # first place of each document without a window
    first = np.unique(np.concatenate([[0], cut, begins, beyond]))
    first = first[first < len(least)]
    last = np.append(first[1:] - 1, len(least) - 1)
    doc = np.searchsorted(ends, first, side="right")
    inside = first < beyond[np.minimum(doc, len(ends) - 1)]
    first, last = first[inside], last[inside]
    place = len(runs) - 1 - (least[first] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    return {"anchor": runs[place], "place": place, "first": first, "last": last, "runs": runs}
