"""Word shingles as 64-bit hashes, and set-overlap search inside one task."""

from __future__ import annotations

import numpy as np

from tabspark.llm.common import HASH_MIX
from tabspark.llm.suffix import _mix, prefix_hash

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: ``size`` words, or all of them where there are fewer.

    A-Z are lower-cased; words are runs of anything but 0x20 and 0x09-0x0D. A
    text without words has none.
    """
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= 1_000_000:
            out += _sets(block, size)
            block, held = [], 0
    return out + (_sets(block, size) if block else [])


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    joined = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    sums, scale = prefix_hash(joined)
    solid = ~_GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid])))
    start, stop = edge[0::2], edge[1::2]
    word = _mix((sums[stop] - sums[start]) * scale[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    base = np.uint64(HASH_MIX | 1)
    run = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        run = run * base + word[k:len(word) - size + 1 + k]
    run = _mix(run + np.uint64(size))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(run[a:b - size + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * base + w
                out.append(_mix(np.array([h + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    if not len(s):
        return 0
    h = _mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(s)], np.uint64))
    with np.errstate(over="ignore"):
        return int((h[0] * np.uint64(31) + h[1]).astype(np.int64))


def least_overlap(n, percent: int):
    """Shared elements that a set of n needs to reach the similarity with any other."""
    return -(-percent * n // 100)


class Links:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        r = self.root
        while True:
            up = r[r]
            if (up == r).all():
                return r
            r = up


#: Cost of looking a token up in a candidate by binary search or in a bitmap, beside that of reading an entry of a list.
SEARCH_COST, BITMAP_COST = 40.0, 0.2
#: Bytes of the bitmaps of a cluster's longest lists.
BITMAP_BYTES = 1 << 25


def _split(length: np.ndarray, probe: np.ndarray, t: int, others: int) -> int:
    """How many of a set's lists (by rising length) to probe instead of reading, the least cost being expected.

    With L lists set aside, a set must be met t - L times in the others to stay a
    candidate, which at most their entries over t - L sets can be.
    """
    read, asked = np.cumsum(length), np.cumsum(probe[::-1])
    aside = np.unique(np.minimum(t - 1, (np.array([0.0, 0.25, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0]) * t).astype(np.int64)))
    short = read[len(length) - aside - 1]
    candidates = np.minimum(others, short // (t - aside))
    return int(aside[np.argmin(short + candidates * np.where(aside > 0, asked[aside - 1], 0.0))])


def linked_sets(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None, must: np.ndarray | None = None) -> np.ndarray:
    """Component of each set under the links 100 * |A & B| >= percent * |A | B|.

    T-occurrence search by DivideSkip: of a set's inverted lists the longest are
    set aside; the short ones are merged, and who appears often enough there is
    looked up in the long ones, by one binary search for all or, in the longest,
    by their bitmaps, which gives the exact overlap.
    Sets with equal ``group`` count as linked already; with ``must``, only links
    with at least one such set are needed. Links inside a component that is
    known already are not looked for.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    links = Links(m)
    if group is not None:
        seen: dict[int, int] = {}
        for i, g in enumerate(group.tolist()):
            links.union(i, seen.setdefault(g, i))
    if m < 2:
        return links.roots()
    order = np.argsort(size, kind="stable")
    sizes = size[order]
    needed = None if must is None else must[order]
    # (token, set) as one number, in order: the inverted lists, and what long ones are searched in
    token, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    of = np.concatenate([[0], np.cumsum(sizes)])
    postings = inverse * m
    postings += np.repeat(np.arange(m), sizes)
    postings.sort()
    inverse = inverse.astype(np.int32)
    cut = np.searchsorted(postings, np.arange(len(token) + 1) * m)
    # the longest lists as bitmaps, one row per set
    length = np.diff(cut)
    wide = np.argsort(-length, kind="stable")[:BITMAP_BYTES // m]
    wide = wide[length[wide] > m // 16]
    column = np.full(len(token), -1, np.int32)
    column[wide] = np.arange(len(wide))
    bitmap = np.zeros((m, len(wide)), np.uint8)
    for c, k in enumerate(wide.tolist()):
        bitmap[postings[cut[k]:cut[k + 1]] - k * m, c] = 1
    seen = np.zeros(len(token), np.int32)  # entries of each list that belong to earlier sets
    del token, length, wide
    for r in range(m):
        n = int(sizes[r])
        if r:
            seen[inverse[of[r - 1]:of[r]]] += 1
        if n == 0:
            continue
        low = int(np.searchsorted(sizes[:r], least_overlap(n, percent)))
        if low == r:
            continue
        roots = links.roots()  # in the numbering of the input
        earlier = roots[order[low:r]]
        other = earlier != roots[order[r]]
        if needed is not None and not needed[r]:
            other &= needed[low:r]
        if not other.any():
            continue
        # most of a cluster is usually one component: try its latest set first
        values = np.unique(earlier[other])
        if len(values) == 1 and (needed is None or needed[r]):
            s = low + int(np.flatnonzero(other)[-1])
            both = len(np.intersect1d(sets[order[r]], sets[order[s]], assume_unique=True))
            if 100 * both >= percent * (n + int(sizes[s]) - both):
                links.union(int(order[r]), int(order[s]))
                continue
        lists = inverse[of[r]:of[r + 1]].astype(np.int64)
        length = seen[lists].astype(np.int64)
        by = np.argsort(length, kind="stable")
        lists, length = lists[by], length[by]
        t = least_overlap(n, percent)
        far = _split(length, np.where(column[lists] >= 0, BITMAP_COST, SEARCH_COST), t, int(other.sum()))
        short, long = lists[:n - far], lists[n - far:]
        # the entries of the short lists, one after the other
        count = length[:n - far]
        place = np.repeat(cut[short] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        merged = postings[place] - np.repeat(short * m, count)
        met = np.bincount(merged, minlength=r)[low:r]
        found = np.flatnonzero((met >= t - far) & other)
        if not len(found):
            continue
        overlap = met[found]
        direct = column[long]
        if (direct >= 0).any():
            overlap = overlap + bitmap[np.ix_(found + low, direct[direct >= 0])].sum(1, dtype=np.int64)
        searched = long[direct < 0]
        if len(searched):
            asked = (searched[:, None] * m + (found + low)[None, :]).ravel()
            at = np.minimum(np.searchsorted(postings, asked), len(postings) - 1)
            overlap = overlap + (postings[at] == asked).reshape(len(searched), len(found)).sum(0)
        good = found[100 * overlap >= percent * (n + sizes[found + low] - overlap)] + low
        for s in good.tolist():
            links.union(int(order[r]), int(order[s]))
    return links.roots()
