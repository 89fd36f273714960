"""Prediction by partial matching, compiled to a table of states.

The trie holds byte contexts of up to ``order`` symbols with the counts of what
follows. A symbol is a byte or the boundary (256) that ends a text and pads its
beginning. A symbol that a context has not seen costs an escape (method D: half
a count of every distinct symbol goes to it) to the next shorter context, where
the symbols of the longer one are excluded. Because the trained trie is fixed, the
resulting probability of every symbol after every context, and the context that
follows, are tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOUNDARY = 256
SYMBOLS = 257
BITS = 9  # of a symbol inside a packed context
ESCAPE = 0.5  # of a count, given up by each distinct symbol of a context


def mask(symbols: int) -> int:
    return (1 << (BITS * symbols)) - 1


def pad_texts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each with ``order`` boundaries before and one after; and where each starts."""
    sizes = np.array([len(t) for t in texts], np.int64) + order + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(starts[-1], BOUNDARY, np.int64)
    keep = np.ones(len(out), bool)
    for k in range(order):
        keep[starts[:-1] + k] = False
    keep[starts[1:] - 1] = False
    out[keep] = np.frombuffer(b"".join(texts), np.uint8)
    return out, starts


def count_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) packs of ``order`` + 1 symbols and their counts."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    z, starts = pad_texts(texts, order)
    event = np.ones(len(z), bool)
    for k in range(order):
        event[starts[:-1] + k] = False
    return np.unique(_grams(z, order)[event], return_counts=True)


def _grams(z: np.ndarray, order: int) -> np.ndarray:
    """The pack of ``order`` + 1 symbols that ends at each place."""
    gram = np.zeros(len(z), np.int64)
    for back in range(order, -1, -1):
        gram <<= BITS
        gram[back:] |= z[:len(z) - back]
    return gram


@dataclass
class Automaton:
    order: int
    column: np.ndarray  # of each symbol in the tables; unseen ones share the last
    follow: np.ndarray  # state * columns + column -> next state
    log10: np.ndarray   # state * columns + column -> log10 probability
    columns: int
    complete: int  # states from this one on are contexts of the full order; what follows them is exact

    def score(self, texts: list[bytes], lane: int = 512) -> np.ndarray:
        """log10 probability of each whole text with its end.

        The state depends on the last ``order`` symbols only, so a block is cut
        into lanes that are walked side by side, each warmed up on the symbols
        before it.
        """
        if not texts:
            return np.empty(0)
        z, starts = pad_texts(texts, self.order)
        value, _ = self._walk(z, lane)
        for k in range(self.order):
            value[starts[:-1] + k] = 0.0
        return np.add.reduceat(value, starts[:-1])

    def split(self, texts: list[bytes], lane: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of what follows complete contexts in each text; (text, gram) of all other symbols."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        z, starts = pad_texts(texts, self.order)
        value, sure = self._walk(z, lane)
        value[~sure] = 0.0
        rest = ~sure
        for k in range(self.order):
            value[starts[:-1] + k] = 0.0
            rest[starts[:-1] + k] = False
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        return np.add.reduceat(value, starts[:-1]), text[rest], _grams(z, self.order)[rest]

    def _walk(self, z: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol, and whether a complete context is before it."""
        lanes = -(-len(z) // lane)
        col = np.full(self.order + lanes * lane, self.column[BOUNDARY], np.int32)
        col[self.order:self.order + len(z)] = self.column[z]
        steps = np.lib.stride_tricks.as_strided(
            col, (lane + self.order, lanes), (col.itemsize, col.itemsize * lane))
        state = np.zeros(lanes, np.int32)
        found = np.zeros((lane, lanes), np.float32)
        sure = np.zeros((lane, lanes), bool)
        least = self.complete * self.columns
        for t in range(lane + self.order):
            at = state * np.int32(self.columns) + steps[t]
            if t >= self.order:
                np.take(self.log10, at, out=found[t - self.order])
                np.greater_equal(at, least, out=sure[t - self.order])
            state = np.take(self.follow, at)
        return found.T.reshape(-1)[:len(z)].astype(np.float64), sure.T.reshape(-1)[:len(z)]


def compile_trie(order: int, entries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Automaton:
    """Tables from the kept entries of each order: packs of (context, symbol) and counts.

    Contexts must be closed under dropping their first symbol, and kept with
    all their symbols. Without any entries every symbol is equally likely.
    """
    if not len(entries.get(0, (np.empty(0),))[0]):
        column = np.zeros(SYMBOLS, np.int32)
        return Automaton(order, column, np.zeros(1, np.int32), np.full(1, -np.log10(SYMBOLS), np.float32), 1, 1)
    alphabet = np.unique(entries[0][0] & mask(1))
    a = len(alphabet)
    column = np.full(SYMBOLS, a, np.int32)
    column[alphabet] = np.arange(a)
    contexts, first, n = [], [], 0
    for k in range(order + 1):
        grams = entries.get(k, (np.empty(0, np.int64),))[0]
        contexts.append(np.unique(grams >> BITS))
        first.append(n)
        n += len(contexts[-1])
    log = np.zeros((n, a + 1), np.float32)
    counts = np.zeros((n, a), np.float32)
    escape = np.zeros(n)  # log of a context's own escape
    for k in range(order + 1):
        if not len(contexts[k]):
            continue
        grams, c = entries[k]
        gives = ESCAPE if k > 0 or a < SYMBOLS else 0.0  # no escape once every symbol is seen
        counts[first[k] + np.searchsorted(contexts[k], grams >> BITS), column[grams & mask(1)]] = c - gives
        for start in range(0, len(contexts[k]), 4096):  # a part at a time, for the sake of memory
            part = contexts[k][start:start + 4096]
            rows = slice(first[k] + start, first[k] + start + len(part))
            parent = first[k - 1] + np.searchsorted(contexts[k - 1], part & mask(k - 1)) if k else None
            log[rows], escape[rows] = _distribution(
                counts[rows].astype(np.float64), gives, a, None if k == 0 else (
                    counts[parent].astype(np.float64), ESCAPE if k > 1 or a < SYMBOLS else 0.0, log[parent], escape[parent]))
    del counts
    follow = np.zeros((n, a + 1), np.int32)
    for k in range(order + 1):
        if not len(contexts[k]):
            continue
        for start in range(0, len(contexts[k]), 4096):
            part = contexts[k][start:start + 4096]
            joined = (part[:, None] << BITS) | alphabet[None, :]
            longest = np.zeros(joined.shape, np.int32)
            for size in range(1, min(k + 1, order) + 1):
                if not len(contexts[size]):
                    break
                key = joined & mask(size)
                at = np.minimum(np.searchsorted(contexts[size], key), len(contexts[size]) - 1)
                longest = np.where(contexts[size][at] == key, first[size] + at, longest)
            follow[first[k] + start:first[k] + start + len(part), :a] = longest
    log /= np.float32(np.log(10))
    return Automaton(order, column, follow.ravel(), log.ravel(), a + 1, first[order])


def _distribution(own: np.ndarray, gives: float, a: int, parent) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of all symbols (unseen ones last) in some contexts of one order, and of their escapes.

    ``parent``: counts, what each symbol gives to the escape, log probabilities
    and escapes of the next shorter contexts; None for the empty context.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = own > 0
        away = gives * seen.sum(1)
        whole = own.sum(1) + away
        escape = np.log(away / whole)
        if parent is None:
            rest = np.full((len(own), a + 1), -np.log(max(SYMBOLS - a, 1)))
        else:
            below, below_gives, below_log, below_escape = parent
            left = np.where(seen, 0.0, below)  # symbols seen here are excluded there
            fresh = below_gives * (left > 0).sum(1)
            all_left = left.sum(1) + fresh
            onward = np.where(all_left > 0, np.log(fresh / all_left), 0.0)
            rest = (onward - below_escape)[:, None] + below_log
            rest[:, :a] = np.where(left > 0, np.log(left / all_left[:, None]), rest[:, :a])
        log = escape[:, None] + rest
        log[:, :a] = np.where(seen, np.log(own / whole[:, None]), log[:, :a])
    return log.astype(np.float32), escape


class Counts:
    """All contexts that end in some ``shared`` symbols or more, for grams that the compiled trie leaves open.

    ``grams`` and ``n`` are every trained gram of the full order whose context
    ends in these symbols, sorted; ``low`` holds all (grams, counts) of each
    order below ``shared``, and from there on those of the contexts of which
    ``grams`` has only some.
    """

    def __init__(self, order: int, shared: int, grams: np.ndarray, n: np.ndarray, low: dict):
        self.order = order
        self.gram, self.n, self.context, self.of, self.total, self.distinct = ({} for _ in range(6))
        for k in range(order, -1, -1):
            if k < shared:
                grams, n = low[k]
            elif k < order:
                grams, back = np.unique(grams & mask(k + 1), return_inverse=True)
                n = np.bincount(back, n, len(grams))
            self.gram[k], self.n[k] = grams, n.astype(np.float64)
            if shared <= k < order and k in low:
                some = np.isin(grams >> BITS, low[k][0] >> BITS)
                own = np.concatenate([grams[~some], low[k][0]])
                by = np.argsort(own)
                self.gram[k], self.n[k] = own[by], np.concatenate([n[~some], low[k][1]]).astype(np.float64)[by]
            self.context[k], at, size = np.unique(self.gram[k] >> BITS, return_index=True, return_counts=True)
            self.of[k] = np.repeat(np.arange(len(size)), size)
            self.total[k] = np.add.reduceat(self.n[k], at) if len(at) else np.empty(0)
            self.distinct[k] = size
        self.symbols = len(self.gram[0])
        # what a shorter context has left when the symbols of a longer one are excluded
        self.left, self.fresh = {}, {}
        for k in range(1, order + 1):
            parent = np.searchsorted(self.context[k - 1], self.context[k] & mask(k - 1))
            below = self.n[k - 1][np.searchsorted(self.gram[k - 1], self.gram[k] & mask(k))]
            self.left[k] = self.total[k - 1][parent] - np.bincount(self.of[k], below, len(parent))
            self.fresh[k] = self.distinct[k - 1][parent] - self.distinct[k]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after the others."""
        out = np.zeros(len(grams))
        todo, longer = np.arange(len(grams)), np.full(len(grams), -1)
        for k in range(self.order, -1, -1):
            if not len(self.gram[k]) or not len(todo):
                continue
            gives = ESCAPE if k > 0 or self.symbols < SYMBOLS else 0.0
            g = grams[todo] & mask(k + 1)
            i = np.minimum(np.searchsorted(self.gram[k], g), len(self.gram[k]) - 1)
            hit = self.gram[k][i] == g
            at = np.where(hit, self.of[k][i], -1)
            c = g[~hit] >> BITS
            j = np.minimum(np.searchsorted(self.context[k], c), len(self.context[k]) - 1)
            at[~hit] = np.where(self.context[k][j] == c, j, -1)
            whole, kinds = self.total[k][at], self.distinct[k][at]
            if k < self.order and len(self.context[k + 1]):
                whole = np.where(longer < 0, whole, self.left[k + 1][longer])
                kinds = np.where(longer < 0, kinds, self.fresh[k + 1][longer])
            out[todo[hit]] += np.log10((self.n[k][i[hit]] - gives) / whole[hit])
            escapes = ~hit & (at >= 0) & (kinds > 0)
            out[todo[escapes]] += np.log10(gives * kinds[escapes] / whole[escapes])
            todo, longer = todo[~hit], at[~hit]
        out[todo] -= np.log10(max(SYMBOLS - self.symbols, 1))
        return out
