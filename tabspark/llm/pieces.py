"""Parts of texts within a share of edits of an item, all of them: shared grams of item pieces by diagonal, then distances."""

from __future__ import annotations

import numpy as np

#: Longest piece of an item (one machine word), pieces of one table, bits of a gram's hash.
PIECE, GROUP, TABLE_BITS = 64, 4096, 16
#: Grams of a piece that are sure to stay, at least, when frequent ones are left out.
ENOUGH = 7
#: Places of a text, and shared grams as a rule, that are looked at together; places whose grams are looked up at a time.
CHUNK, ENTRIES, BLOCK = 1 << 13, 1 << 20, 1 << 20
#: Bits of a place in a chunk; diagonals that are verified together; windows that are.
PLACE_BITS, NEAR, LANES = 15, 8, 4096


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from every place."""
    n = max(len(data) - q + 1, 0)
    code = np.zeros(n, np.uint32)
    for i in range(q):
        code |= data[i:i + n].astype(np.uint32) << np.uint32(8 * i)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


class PieceIndex:
    """Finds every window that may hold an item within its edits; none is left out.

    An item of k allowed edits is cut into pieces whose own allowances, one more
    each, add up to k + 1, so a part that holds the item holds a piece within the
    piece's allowance e. Of the n - q + 1 grams of a piece, q * e at most are lost
    then, and the others lie on diagonals (place in the text less place in the
    piece) at most e apart.
    """

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float):
        rows = []
        for i, text in items:
            k, parts = int(max_edits * len(text)), -(-len(text) // PIECE)
            cut = [len(text) * j // parts for j in range(parts + 1)]
            share = [(k + 1) * j // parts for j in range(parts + 1)]
            for a, b, x, y in zip(cut, cut[1:], share, share[1:]):
                e = y - x - 1
                if e < 0:
                    continue  # more pieces than edits: an untouched one is among the others
                left = {q: b - a - q + 1 - q * e for q in (4, 3, 2, 1)}
                q = next((q for q in (4, 3) if left[q] >= 4), None) or max(left, key=left.get)
                if left[q] < 1:
                    raise ValueError(f"{k} edits leave nothing of {len(text)} bytes")
                rows.append((i, a, b - a, e, q, left[q], len(text), k))
        self.item, self.offset, self.length, self.edits, self.q, self.need, self.size, self.most = \
            np.array(rows, np.int64).reshape(-1, 8).T
        of = dict(items)
        pieces = [np.frombuffer(of[i], np.uint8)[a:a + n] for i, a, n, *_ in rows]
        use = self._rare(pieces)
        # grams of each group of pieces by hash: first entry of a hash, and entries as (piece, PIECE - place)
        self.tables: list[list] = []
        for g in range(0, len(rows), GROUP):
            tables = []
            for q in sorted(set(self.q[g:g + GROUP].tolist())):
                hashes, entries = [], []
                for j in range(g, min(g + GROUP, len(rows))):
                    if self.q[j] == q:
                        at = np.flatnonzero(use[j])
                        hashes.append(_grams(pieces[j], q)[at])
                        entries.append(((j - g) << PLACE_BITS) + PIECE - at)
                hashes, entries = np.concatenate(hashes), np.concatenate(entries)
                order = np.argsort(hashes, kind="stable")
                start = np.searchsorted(hashes[order], np.arange((1 << TABLE_BITS) + 1))
                tables.append((q, start.astype(np.int32), entries[order].astype(np.int32)))
            self.tables.append(tables)
        # a piece takes the highest bits of its word, and what lies below them matches anything
        self.free = (64 - self.length).astype(np.uint64)
        self.masks = np.zeros((len(rows), 257), np.uint64)
        for j, p in enumerate(pieces):
            np.bitwise_or.at(self.masks[j], p, np.uint64(1) << np.arange(64 - len(p), 64, dtype=np.uint64))
            self.masks[j] |= np.uint64((1 << (64 - len(p))) - 1)

    def _rare(self, pieces: list[np.ndarray]) -> np.ndarray:
        """(piece, place): the grams to look for, ``need`` of which any part within the edits keeps.

        The most frequent grams are left out as long as ENOUGH of the others are
        sure to stay, however the edits fall: what they can spoil is the most
        that so many stretches of q places hold.
        """
        often = np.full((len(pieces), PIECE), -1)
        for q in set(self.q.tolist()):
            of = np.flatnonzero(self.q == q)
            hashes = [_grams(pieces[j], q) for j in of]
            number = np.bincount(np.concatenate(hashes), minlength=1 << TABLE_BITS)
            for j, h in zip(of, hashes):
                often[j, :len(h)] = number[h]
        rank = np.argsort(np.argsort(-often, axis=1, kind="stable"), axis=1, kind="stable")
        use, edits = often >= 0, np.arange(int(self.edits.max(initial=0)) + 1)
        for left_out in range(2, PIECE, 2):
            fewer = (often >= 0) & (rank >= left_out)
            held = np.cumsum(np.pad(fewer, ((0, 0), (1, 0))), axis=1)  # used grams before a place
            spoiled = np.zeros((PIECE + 1, len(pieces), len(edits)), np.int64)
            for p in range(1, PIECE + 1):
                back = np.maximum(p - self.q, 0)
                hit = spoiled[back, np.arange(len(pieces)), :-1] + (held[:, p] - held[np.arange(len(pieces)), back])[:, None]
                spoiled[p] = spoiled[p - 1]
                spoiled[p, :, 1:] = np.maximum(spoiled[p, :, 1:], hit)
            sure = held[:, -1] - spoiled[PIECE, np.arange(len(pieces)), self.edits]
            better = sure >= ENOUGH
            if not better.any():
                break
            use[better], self.need[better] = fewer[better], sure[better]
        return use

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, end) of windows that hold, together, every part of ``data`` within the edits of an item."""
        out = [np.empty((0, 3), np.int64)]
        span = PIECE + int(self.edits.max(initial=0)) + 1  # places of all grams of one piece's part
        for begin, (g, tables) in ((b, t) for b in range(0, len(data), BLOCK) for t in enumerate(self.tables)):
            near = self._near(data[begin:begin + BLOCK + span], g * GROUP, tables) + [0, begin]
            for a in range(0, len(near), LANES):
                j, low = near[a:a + LANES].T
                close = self._close(data, j, low)
                j, low = j[close], low[close]
                start = low - self.offset[j] - self.most[j]
                end = low + NEAR - self.offset[j] + self.size[j] + self.most[j]
                out.append(np.stack([self.item[j], np.maximum(start, 0), np.minimum(end, len(data))], 1))
        return tuple(np.concatenate(out).T)

    def _near(self, data: np.ndarray, g: int, tables: list) -> np.ndarray:
        """(piece, diagonal): enough grams of the piece lie on the NEAR diagonals from this one and the next few."""
        need, edits = self.need[g:g + GROUP], self.edits[g:g + GROUP]
        least, widest = int(need.min()), int(edits.max())
        span = PIECE + widest + 1  # places of all grams of one piece's part
        found = [np.empty((0, 2), np.int64)]
        looked = []
        for q, start, entries in tables:
            h = _grams(data, q)
            first = start[h]
            looked.append((first, start[h + 1] - first, entries))
        total = np.zeros(len(data) + 1, np.int64)
        for _, count, _ in looked:
            total[1:len(count) + 1] += count
        total = np.cumsum(total)
        a = 0
        while a < len(data):
            b = min(int(np.searchsorted(total, total[a] + ENTRIES)), a + CHUNK, len(data))
            b = min(max(b, a + 2 * span), len(data))
            keys = []
            for first, count, entries in looked:
                f, c = first[a:b], count[a:b]
                at = np.repeat(f - np.cumsum(c, dtype=np.int32) + c, c)
                at += np.arange(len(at), dtype=np.int32)
                key = entries.take(at, mode="clip")  # all are in range
                key += np.repeat(np.arange(len(c), dtype=np.int32), c)
                keys.append(key)
            key = np.concatenate(keys) if len(keys) > 1 else keys[0]
            key.sort()
            i = np.flatnonzero(key[least - 1:] - key[:len(key) - least + 1] <= widest) if len(key) >= least else np.empty(0, np.int64)
            j = key[i] >> PLACE_BITS
            last = i + need[j] - 1
            i, j, last = i[last < len(key)], j[last < len(key)], last[last < len(key)]
            good = key[last] - key[i] <= edits[j]
            low = (key[i[good]] & ((1 << PLACE_BITS) - 1)) - PIECE + a
            found.append(np.stack([j[good] + g, low // NEAR * NEAR], 1).astype(np.int64))
            if b == len(data):
                break
            a = b - span
        near = np.concatenate(found)
        code = np.unique((near[:, 0] << 40) + near[:, 1] + (1 << 20))
        return np.stack([code >> 40, (code & ((1 << 40) - 1)) - (1 << 20)], 1)

    def _close(self, data: np.ndarray, j: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether piece j is within its edits of a part on these diagonals: bit-parallel dynamic programming side by side."""
        steps = int((self.length[j] + 2 * self.edits[j]).max(initial=0)) + NEAR
        place = (low - self.edits[j])[None] + np.arange(steps)[:, None]
        symbol = np.where((place < 0) | (place >= len(data)), 256, data[np.clip(place, 0, len(data) - 1)])
        same = self.masks.ravel()[symbol + 257 * j[None]]
        plus = ~np.uint64(0) << self.free[j]
        minus = np.zeros(len(j), np.uint64)
        score = self.length[j].astype(np.int32)
        best, one, top = score.copy(), np.uint64(1), np.uint64(63)
        for eq in same:
            x = eq | minus
            d = eq & plus
            d += plus
            d ^= plus
            d |= x
            hp = ~(d | plus)
            hp |= minus
            hm = plus & d
            score += (hp >> top).astype(np.int32)
            score -= (hm >> top).astype(np.int32)
            hp <<= one
            hm <<= one
            minus = hp & x
            plus = ~(x | hp)
            plus |= hm
            np.minimum(best, score, out=best)
        return best <= self.edits[j]
