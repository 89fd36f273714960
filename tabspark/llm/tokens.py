"""Fast exact use of a public tokenizer inside a task.

A block of texts is cut, by byte classes, at places where these vocabularies
always cut. Equal pieces are found by hash, and each distinct piece is encoded
once by the library. The cache of pieces is bounded and compact.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np

from tabspark.llm.common import HASH_BASE, HASH_MIX

# Byte classes. ODD bytes (not ASCII, not a Latin-1 letter) allow no cut beside them.
ODD, LETTER, DIGIT, BLANK, SPACE, MARK = 0, 1, 2, 3, 4, 5
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[:128] = MARK
for _range, _kind in ((range(65, 91), LETTER), (range(97, 123), LETTER), (range(48, 58), DIGIT),
                      (range(9, 14), SPACE), (range(32, 33), BLANK)):
    _CLASS[list(_range)] = _kind
_END = 0xFF  # between texts; never part of UTF-8


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (HASH_BASE, pow(HASH_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Offsets in ``data`` (texts with an end byte after each) at which a piece begins."""
    c = _CLASS[data]
    # both bytes of C3 80..C3 BF count as letters, but for the two signs among them
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    c[lead] = c[lead + 1] = LETTER
    before, here = c[:-1], c[1:]
    after = np.append(c[2:], ODD)
    solid = lambda x: (x == LETTER) | (x == DIGIT) | (x == MARK)
    white = lambda x: (x == BLANK) | (x == SPACE)
    cut = ((before == LETTER) & (here != LETTER)) | ((before == DIGIT) & (here != DIGIT))
    cut |= (before == MARK) & (here != MARK) & ((data[:-1] != 39) | ~solid(here))
    cut |= (before == SPACE) & solid(here)
    cut |= white(before) & white(here) & solid(after)
    cut &= (before != ODD) & (here != ODD)
    ends = data == _END
    cut |= ends[:-1] | ends[1:]
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


class PieceEncoder:
    """Exact ids of whole texts; texts with a special string go through the library whole."""

    def __init__(self, file: str, cache_pieces: int = 1_500_000, block_bytes: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            self._special = [t["content"].encode() for t in json.load(f).get("added_tokens", [])]
        self._limit, self._block_bytes = cache_pieces, block_bytes
        self._power = _powers(4096)
        self._forget()

    def _forget(self) -> None:
        self._hash = np.empty(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int32)
        self._pool = np.empty(1 << 16, np.uint32)
        self._used = 0

    def whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def blocks(self, texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids, offsets): text i of the block has ids[offsets[i]:offsets[i + 1]]."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= self._block_bytes):
                size += len(texts[last])
                last += 1
            yield (first, *self._block(texts[first:last]))
            first = last

    def _block(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        special = {i: self.whole(t) for i, t in enumerate(texts) if any(s in t for s in self._special)}
        end = bytes([_END])
        data = np.frombuffer(end.join([b"" if i in special else t for i, t in enumerate(texts)]) + end, np.uint8)
        starts = piece_starts(data)
        stops = np.append(starts[1:], len(data))
        real = data[starts] != _END
        text_of = np.cumsum(~real)[real]
        starts, stops = starts[real], stops[real]
        entry = self._entries(data, starts, stops)
        lens = self._len[entry].astype(np.int64)
        total = int(lens.sum())
        shift = np.cumsum(lens) - lens
        ids = self._pool[np.repeat(self._at[entry] - shift, lens) + np.arange(total)]
        sizes = np.bincount(text_of, weights=lens, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if special:
            parts = [special.get(i, ids[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def _entries(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Position of each piece in the cache, filling in those not seen before."""
        if not len(starts):
            return np.zeros(0, np.int64)
        if len(data) > len(self._power[0]):
            self._power = _powers(len(data) + len(data) // 4)
        power, inverse = self._power
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(HASH_MIX)
        distinct, index, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self._hash) + len(distinct) > self._limit:
            self._forget()
        at = np.searchsorted(self._hash, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self._hash):
            known = self._hash[np.minimum(at, len(self._hash) - 1)] == distinct
        if not known.all():
            self._learn(data, distinct[~known], starts[index[~known]], stops[index[~known]])
            at = np.searchsorted(self._hash, distinct)
        return at[back]

    def _learn(self, data, hashes, starts, stops) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist())]
        lens, parts = [], []
        for k in range(0, len(pieces), 10_000):
            for e in self._tokenizer.encode_batch_fast(pieces[k:k + 10_000], add_special_tokens=False):
                ids = e.ids
                lens.append(len(ids))
                parts += ids
        new = np.asarray(parts, np.uint32)
        if self._used + len(new) > len(self._pool):
            self._pool = np.concatenate([self._pool[:self._used], np.empty(self._used // 2 + 2 * len(new), np.uint32)])
        self._pool[self._used:self._used + len(new)] = new
        lens = np.asarray(lens, np.int32)
        at = self._used + np.cumsum(lens, dtype=np.int64) - lens
        self._used += len(new)
        merged = np.concatenate([self._hash, hashes])
        order = np.argsort(merged, kind="stable")
        self._hash = merged[order]
        self._at = np.concatenate([self._at, at])[order]
        self._len = np.concatenate([self._len, lens])[order]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = PieceEncoder(file)
    return _ENCODERS[file]
