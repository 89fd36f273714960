"""Stretches of equal words at a fixed distance, found per tile and octave of the distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tabspark.llm.shingles import _GAP
from tabspark.llm.suffix import _mix, prefix_hash
from tabspark.llm.tokens import _powers

#: Words of a run at least (and two periods).
SHORTEST = 12
#: Words of a tile's own part, up to the octave from which a tile must grow with its periods.
CORE = 1 << 16
#: Periods up to which each is compared by itself; longer ones are compared as rows of a matrix of CELLS.
NARROW, CELLS = 32, 1 << 21

_POWERS = [_powers(1 << 12)]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit names of each text's words, runs of anything but 0x20 and 0x09-0x0D."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    sums, scale = prefix_hash(joined)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_GAP[data]])))
    start, stop = edge[0::2], edge[1::2]
    word = _mix((sums[stop] - sums[start]) * scale[start] + (stop - start).astype(np.uint64))
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(word, cut[:-1])


def least_matches(octave: int, shortest: int = SHORTEST) -> int:
    """Words equal to those a period later that a run has at least, for periods from 2^octave to below its double."""
    low = 1 << octave
    return min(max(p, shortest - p) for p in range(low, max(low + 1, min(2 * low, shortest))))


def octaves(words: int) -> int:
    """Octaves of periods that fit twice into so many words."""
    return max(0, (words // 2).bit_length())


def tiles(words: int, shortest: int = SHORTEST, core: int = CORE) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, last octave, start, stop) of the overlapping tiles of a text.

    A tile's own part is ``core`` words, or eight of its longest octave's least
    periods; octaves with equal parts share tiles. It reaches so far to the left
    and right that every run with a match in the own part has enough matches
    inside the tile to be found, and touches its fragment in the next tile.
    """
    count, octave = octaves(words), 0
    while octave < count:
        last = octave
        while last + 1 < count and 8 << (last + 1) <= core:
            last += 1
        own = max(core, 8 << last)
        reach = max(least_matches(k, shortest) for k in (octave, last))
        for start in range(0, words, own):
            yield octave, last, max(0, start - reach), min(words, start + own + (2 << last) + reach)
            if start + own + (2 << last) + reach >= words:
                break  # what is left lies inside
        octave = last + 1


def _running(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(word)
    if n >= len(_POWERS[0][0]):
        _POWERS[0] = _powers(2 * n)
    power, inverse = _POWERS[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word * power[:n], out=sums[1:])
    return sums, inverse


def stretches(word: np.ndarray, octave: int, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, stop) of all stretches with word[i] == word[i + period], long enough for a run of this octave.

    Boundaries lie so densely that a long enough stretch holds a boundary with its
    next ``width`` words. At each boundary the Z-values (words in common with the
    text a period later) that reach ``width`` are found by comparing hashes for
    all periods at once; equal neighbours make one stretch, whose ends are found
    by halving. Every stretch is compared word by word in the end.
    """
    low, n = 1 << octave, len(word)
    least = least_matches(octave, shortest)
    step = max(1, least // 2)
    width = least - step + 1
    none = np.empty(0, np.int64)
    if n < low + width:
        return none, none, none
    sums, inverse = _running(word)
    block = (sums[width:] - sums[:-width]) * inverse[:n - width + 1]
    if low <= NARROW:
        found = []
        for p in range(low, 2 * low):
            ahead = block[p::step]
            at = np.flatnonzero(block[::step][:len(ahead)] == ahead)
            found.append((at * step, np.full(len(at), p)))
        at, period = (np.concatenate(x) for x in zip(*found))
    else:
        here = block[::step]
        here = here[:-(-(len(block) - low) // step)]
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([block, np.zeros(low, np.uint64)]), low)[low::step][:len(here)]
        tall = max(1, CELLS // low)
        hits = []
        for r in range(0, len(here), tall):
            hit = np.flatnonzero(rows[r:r + tall] == here[r:r + tall, None])
            hits.append(hit + r * low)
        hit = np.concatenate(hits) if hits else none
        at, period = hit // low * step, hit % low + low
        inside = at + period < len(block)
        at, period = at[inside], period[inside]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
    if not len(at):
        return none, none, none
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + step)])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
    period = period[first]
    start = at[first] - _common(sums, inverse, at[first], period, np.minimum(at[first], step), -1)
    stop = at[last] + width
    stop = stop + _common(sums, inverse, stop, period, np.minimum(n - period - stop, step), 1)
    return _primitive(word, period, start, stop)


def _common(sums, inverse, at, period, most, side) -> np.ndarray:
    """Words in common to the left (side -1) or right of ``at`` and ``at + period``, ``most`` at most."""
    low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        a = at - mid if side < 0 else at
        b = a + period
        same = (sums[a + mid] - sums[a]) * inverse[a] == (sums[b + mid] - sums[b]) * inverse[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _primitive(word, period, start, stop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without stretches whose words have a shorter period of the same octave over both periods' sum, which makes theirs a multiple."""
    order = np.lexsort((period, stop + period, start))
    period, start, stop = period[order], start[order], stop[order]
    end = stop + period
    same = np.concatenate([[False], (start[1:] == start[:-1]) & (end[1:] == end[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    keep = ~same | (end - start < period + period[head])
    out = []
    for p, a, b in zip(period[keep].tolist(), start[keep].tolist(), stop[keep].tolist()):
        equal = word[a:b] == word[a + p:b + p]
        if equal.all():
            out.append((p, a, b))
        else:  # hashes of different words were equal
            edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]))) + a
            out += [(p, x, y) for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def solve(parts: list[tuple[np.ndarray, int, int]], first: int, last: int, shortest: int = SHORTEST) -> list[tuple[int, np.ndarray]]:
    """Fragments of runs in tiles (words, place of the first in the text, words of the text), for the octaves first to last.

    Gives (number of the tile, rows of period, start and stop of the matches, in
    places of the text). A fragment that ends inside its tile is long enough for a
    run; one that the tile cuts off may be part of one.
    """
    out = []
    for octave in range(first, last + 1):
        fit = [i for i, (w, _, n) in enumerate(parts) if n >= max(shortest, 2 << octave) and len(w) > 1 << octave]
        if not fit:
            continue
        # a word of its own after each tile, so that nothing matches across
        sizes = np.array([len(parts[i][0]) for i in fit])
        marks = _mix(np.arange(1, len(fit) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        words = np.concatenate([x for k, i in enumerate(fit) for x in (parts[i][0], marks[k:k + 1])])
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        period, start, stop = stretches(words, octave, shortest)
        tile = np.searchsorted(base, start, "right") - 1
        offset = np.array([parts[i][1] for i in fit])
        whole = np.array([parts[i][2] for i in fit])
        cut_left = (start == base[tile]) & (offset[tile] > 0)
        cut_right = (stop + period == base[tile] + sizes[tile]) & (offset[tile] + sizes[tile] < whole[tile])
        keep = cut_left | cut_right | (stop - start >= np.maximum(period, shortest - period))
        move = (offset - base[:-1])[tile]
        rows = np.stack([period, start + move, stop + move], axis=1)[keep]
        order = np.argsort(tile[keep], kind="stable")
        which, rows = tile[keep][order], rows[order]
        for k, block in zip(*_split(which, rows)):
            out.append((fit[k], block))
    return out


def _split(which: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    values, at = np.unique(which, return_index=True)
    return values.tolist(), np.split(rows, at[1:])


def collapsed(text: bytes, runs) -> bytes:
    """The words of ``text`` joined by spaces, without those that some run (start, length, period) holds after its first period."""
    words = text.split()
    if len(runs):
        runs = np.asarray(runs, np.int64)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)
