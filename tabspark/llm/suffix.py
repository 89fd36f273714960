"""Difference-cover suffix sorting and the anchors that spread it over tasks."""

from __future__ import annotations

import numpy as np

from tabspark.llm.common import HASH_MIX
from tabspark.llm.tokens import _powers

_POWERS = [_powers(1 << 12)]


def sort_suffixes(s: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of ``s`` (symbols from 1), ordered by their first ``depth`` symbols.

    Suffixes that agree that far come next to each other in any order. The
    triples at positions 1 and 2 modulo 3 are sorted and named; equal names
    make a shorter string, mod 1 before mod 2, that is sorted in the same way;
    the positions 0 modulo 3 are ordered by their symbol and the rank behind it
    and merged in.
    """
    length = len(s)
    n = -(-(length + 2) // 3) * 3
    t = np.zeros(n + 3, np.uint64)
    t[:length] = s
    wide = np.uint64(max(int(t.max()), 1).bit_length())
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triple = _pack((t[sampled], t[sampled + 1], t[sampled + 2]), (wide, wide, wide))
    distinct, rank = np.unique(triple, return_inverse=True)
    if depth > 3 and len(distinct) < len(sampled):
        order = sort_suffixes(rank + 1, -(-(depth + 2) // 3))
        rank = np.empty(len(sampled), np.int64)
        rank[order] = np.arange(len(sampled))
    else:
        order = np.argsort(rank, kind="stable")
    behind = np.zeros(n + 3, np.uint64)
    behind[sampled] = rank + 1
    high = np.uint64(max(len(sampled), 1).bit_length())
    zero = np.arange(0, n, 3)
    by_one = _pack((t[zero], behind[zero + 1]), (wide, high))
    by_two = _pack((t[zero], t[zero + 1], behind[zero + 2]), (wide, wide, high))
    first = np.argsort(by_one, kind="stable")
    less = np.searchsorted(np.sort(_pack((t[one], behind[one + 1]), (wide, high))), by_one[first])
    less += np.searchsorted(np.sort(_pack((t[two], t[two + 1], behind[two + 2]), (wide, wide, high))), by_two[first])
    less = np.maximum.accumulate(less)
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + less] = zero[first]
    out[np.arange(len(sampled)) + np.searchsorted(less, np.arange(len(sampled)), "right")] = sampled[order]
    return out[out < length]


def _pack(parts, widths) -> np.ndarray:
    """One 64-bit key for several small numbers; wider ones are ranked on the way."""
    key, width = parts[0], int(widths[0])
    for part, w in zip(parts[1:], widths[1:]):
        if width + int(w) > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            width = max(len(key), 1).bit_length()
        key, width = (key << w) | part, width + int(w)
    return key


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start in ``data``: does its string of ``length`` bytes also begin at another start?

    All suffixes are sorted; among the starts, neighbours are compared byte by byte.
    """
    is_start = np.zeros(len(data) + 1, bool)
    is_start[starts] = True
    order = sort_suffixes(data.astype(np.int64) + 1, length)
    order = order[is_start[order]]
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    eight = padded[:-7].copy()
    for k in range(1, 8):
        eight |= padded[k:len(padded) - 7 + k] << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[eight[a[same] + k] == eight[b[same] + k]]
    twin = np.zeros(len(data) + 1, bool)
    twin[a[same]] = twin[b[same]] = True
    return twin[starts]


def prefix_hash(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any part follows, and the scale of each place."""
    n = len(text)
    if n >= len(_POWERS[0][0]):
        _POWERS[0] = _powers(2 * n)
    power, inverse = _POWERS[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums, inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(HASH_MIX)
    return h ^ (h >> np.uint64(29))


def anchor_runs(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes with the same anchor: (first, windows, anchor, content, again).

    A window's anchor is the least hash of the ``gram``-byte strings inside, so
    equal windows have equal anchors wherever they are. ``content`` hashes all
    bytes of a run's windows; ``again`` says that the anchor's string occurs more
    than once in them, without which no two windows of the run are equal.
    """
    n = len(text)
    if n < length:
        none = np.empty(0, np.uint64)
        return np.empty(0, np.int64), np.empty(0, np.int64), none, none, np.empty(0, bool)
    sums, inverse = prefix_hash(text)
    grams = least = _mix((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    if span > width:
        rest = span - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    stop = np.append(first[1:], len(least))
    end = stop - 1 + length
    content = _mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    inner = stop - first + span - 1
    before = np.cumsum(inner) - inner
    equal = grams[np.arange(inner.sum()) + np.repeat(first - before, inner)] == np.repeat(least[first], inner)
    again = np.add.reduceat(equal, before, dtype=np.int64) > 1
    return first, stop - first, least[first], content, again


def window_hashes(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    sums, inverse = prefix_hash(text)
    n = len(text) - length + 1
    one = (sums[length:] - sums[:-length]) * inverse[:n]
    other = np.zeros(len(text) + 1, np.uint64)
    step = np.uint64(6364136223846793005)
    power, back = np.full(len(text), step, np.uint64), np.full(len(text), pow(int(step), -1, 2**64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    square = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    np.cumsum(square * square * power, out=other[1:])
    return _mix(one), _mix((other[length:] - other[:-length]) * back[:n])
