"""Token files of directly addressable codes.

An id is cut into 8-bit chunks. Level 0 holds the low chunk of every id; a
bitmap tells which ids go on, and level k + 1 holds the next chunk of those
only. A rank directory over each bitmap gives the place of an id's chunk in the
next level, so any id is read without decoding its neighbours.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the file format.
MAGIC = b"DACT0001"
CHUNK_BITS = 8
RANK_BITS = 512
_HEAD = struct.Struct("<8sqqqqi")  # magic, bytes in all, part, number in part, documents, levels
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _pad(block: bytes) -> bytes:
    return block + b"\0" * (-len(block) % 8)


def encode_segment(part: int, number: int, doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """One self-delimiting segment with whole documents; ``offsets`` has one entry more than ``doc_ids``."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = [_pad(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), _pad(known.tobytes()),
            np.asarray(offsets, "<i8").tobytes()]
    rest = np.asarray(ids, np.uint32)
    levels = 0
    while levels == 0 or len(rest):
        goes_on = rest >= (1 << CHUNK_BITS)
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8)])
        ones = _POPCOUNT[bitmap].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(ones)])
        body += [struct.pack("<q", len(rest)), _pad((rest & 0xFF).astype(np.uint8).tobytes()),
                 bitmap.tobytes(), rank.astype("<i8").tobytes()]
        rest = rest[goes_on] >> CHUNK_BITS
        levels += 1
    payload = b"".join(body)
    return _HEAD.pack(MAGIC, _HEAD.size + len(payload), part, number, len(doc_ids), levels) + payload


class Segment:
    """A view on one segment; nothing is decoded until asked for."""

    def __init__(self, data, at: int = 0):
        magic, self.size, self.part, self.number, n, levels = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no token segment at byte {at}")
        self._data, self._at = data, at + _HEAD.size
        ids, known = self._take("<i8", n), self._take(np.uint8, n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.offsets = self._take("<i8", n + 1)
        self._levels = []
        for _ in range(levels):
            count = int(self._take("<i8", 1)[0])
            chunks = self._take(np.uint8, count)
            blocks = -(-count // RANK_BITS)
            bitmap = self._take(np.uint8, blocks * RANK_BITS // 8)
            self._levels.append((chunks, bitmap, self._take("<i8", blocks + 1)))

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes + (-out.nbytes % 8)
        return out

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def token(self, i: int) -> int:
        """The id at place i, through the rank directories alone."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, rank) in enumerate(self._levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            inside = int(_POPCOUNT[bitmap[first:i >> 3]].sum()) + int(_POPCOUNT[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(rank[block]) + inside
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self._levels):
            here = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, bitorder="little")[:len(chunks)].astype(bool)
            here[goes_on] |= out << np.uint32(CHUNK_BITS)
            out = here
        return out


def segments(data):
    """The segments of one file, each followed by one line end."""
    at = 0
    while at < len(data):
        s = Segment(data, at)
        yield s
        at += s.size + 1
