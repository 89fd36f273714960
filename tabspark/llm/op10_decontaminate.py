"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH and exact verification.

The LSH finds near copies cheaply but may miss some; what it misses is found by
shared grams of the items' pieces (``pieces``), so no match is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.llm.common import HASH_BASE, HASH_MIX, table, text_bytes
from tabspark.llm.pieces import PieceIndex
from tabspark.llm.registry import query

#: Length in bytes of the exact matches that place an item-sized window; shorter items are looked up as words.
SEED = 14
#: A window holds an item when its edit distance is at most this share of the item's bytes.
MAX_EDITS = 0.2
#: Bytes of item text indexed at a time; more items are handled in further passes.
BLOCK_BYTES = 4 << 20
END = 256  # symbol after the end of a string


def normal(text: bytes) -> bytes:
    """ASCII letters in lower case, white-space runs as one space."""
    return b" ".join(text.lower().split())


class Walk:
    """The CGK random walk: at step j it writes the current symbol and moves on if the random bit of (j, symbol) says so."""

    def __init__(self, steps: int, seed: int):
        self.moves = np.random.default_rng(seed).integers(0, 2, (steps, END + 1), dtype=np.int64)
        self.moves[:, END] = 0

    def embed(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """Embeddings of data[start:start + length], one row each; lanes walk side by side."""
        out = np.empty((steps, len(starts)), np.int16)
        at, stop = starts.copy(), starts + lengths
        padded = np.append(data, 0)
        for j in range(steps):
            symbol = np.where(at < stop, padded[np.minimum(at, len(data))], END)
            out[j] = symbol
            at += self.moves[j, symbol]
        return out.T


def edit_search(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of ``pattern`` with any substring of ``text``, if at most ``most``.

    Bit-parallel dynamic programming; the first of equally good ends counts.
    """
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (most + 1, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | (~(d | plus) & full), plus & d
        score += bool(hp & high) - bool(hm & high)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (~(x | hp) & full), hp & x
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= most else None


class ItemIndex:
    """Seeds, embeddings, sampled positions and pieces of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float = MAX_EDITS, recall: float = 0.99,
                 sampled: int = 5, agree: float = 0.4, seed: int = 42):
        self.items = [(k, t) for k, t in items if t]
        self.max_edits = max_edits
        self.repeats = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled)))
        self.short = [(i, t) for i, (_, t) in enumerate(self.items) if len(t) < SEED]
        data = b"".join(t for _, t in self.items)
        self.data = np.frombuffer(data, np.uint8)
        self.length = np.array([len(t) for _, t in self.items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        hashes, places = gram_hashes(self.data), np.arange(max(len(self.data) - SEED + 1, 0))
        owner = np.repeat(np.arange(len(self.items)), self.length)[:len(places)]
        inside = places + SEED <= (self.start + self.length)[owner] if len(places) else np.zeros(0, bool)
        order = np.argsort(hashes[inside], kind="stable")
        self.hash, self.item = hashes[inside][order], owner[inside][order]
        self.offset = (places[inside] - self.start[owner[inside]])[order]
        bits = max(16, int(np.ceil(np.log2(max(len(self.hash), 1)))) + 6)
        self.shift = np.uint64(64 - min(bits, 26))
        self.filter = np.zeros(1 << min(bits, 26), bool)
        self.filter[(self.hash >> self.shift).astype(np.int64)] = True
        longest = int(self.length.max(initial=0))
        self.walk = Walk(3 * longest, seed)
        rng = np.random.default_rng(seed + 1)
        # positions in units of the item's embedding, which is three times as long as the item
        self.positions = rng.random((self.repeats, sampled))
        every = np.arange(len(self.items))
        self.codes = np.concatenate([self._code(self.data, self.start[a:a + 256], every[a:a + 256])
                                     for a in range(0, len(every), 256)] or [np.empty((0, *self.positions.shape), np.int16)])
        self.pieces = PieceIndex([(i, t) for i, (_, t) in enumerate(self.items) if len(t) >= SEED], max_edits)

    def _code(self, data: np.ndarray, starts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(windows, repeats, sampled) symbols at the sampled places of the embedding of item-sized windows."""
        steps = 3 * self.length[item]
        size = np.minimum(self.length[item], len(data) - starts)
        e = self.walk.embed(data, starts, size, int(steps.max()))
        place = (self.positions[None] * steps[:, None, None]).astype(np.int64)
        return np.take_along_axis(e, place.reshape(len(starts), -1), 1).reshape(place.shape)

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of the windows of ``data`` that share an aligned seed with an item."""
        h = gram_hashes(data)
        at = np.flatnonzero(self.filter[(h >> self.shift).astype(np.int64)])
        h = h[at]
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        count = high - low
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count) - self.offset[which], self.item[which]

    def matches(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each normalised text the items it holds: (item id, start, length, distance) of the best window."""
        gap = b"\x00" * SEED
        sizes = np.array([len(t) for t in texts], np.int64) + SEED
        first = np.cumsum(sizes) - sizes
        joined = gap.join(texts) + gap
        data = np.frombuffer(joined, np.uint8)
        found: list[dict] = [{} for _ in texts]
        searched: dict = {}
        for t, text in enumerate(texts):
            for i, word in self.short:
                at = (b" " + text + b" ").find(b" " + word + b" ")
                if at >= 0:
                    found[t][i] = (0, at, len(word))
        start, item = self.windows(data)
        if len(start):
            text_of = np.searchsorted(first, start + self.length[item] // 2, "right") - 1
            text_of = np.clip(text_of, 0, len(texts) - 1)
            start = np.maximum(start, first[text_of])
            keys = np.unique(np.stack([item, text_of, start], 1), axis=0)
            for a in range(0, len(keys), 1024):
                part = keys[a:a + 1024]
                codes = self._code(data, part[:, 2], part[:, 0])
                hit = (codes == self.codes[part[:, 0]]).all(2).any(1)
                self._verify(part[hit], first, texts, found, searched)
        self._complete(data, first, texts, found, searched)
        for f in found:
            yield [(self.items[i][0], at, n, d) for i, (d, at, n) in sorted(f.items())]

    def _verify(self, windows: np.ndarray, first: np.ndarray, texts: list[bytes], found: list[dict], searched: dict) -> None:
        done: dict[tuple[int, int], int] = {}
        for i, t, start in windows.tolist():
            pattern = self.items[i][1]
            most = int(self.max_edits * len(pattern))
            at = start - int(first[t])
            if at < done.get((i, t), -1):
                continue  # what was searched for this item holds this window's matches already
            low, high = max(0, at - 2 * most), at + len(pattern) + 2 * most
            best = edit_search(pattern, texts[t][low:high], most)
            done[i, t] = at + most
            searched.setdefault((i, t), []).append((low, high))
            if best is not None and (i not in found[t] or best[0] < found[t][i][0]):
                end = low + best[1]
                back = edit_search(pattern[::-1], texts[t][max(0, end - len(pattern) - most):end][::-1], most)
                n = back[1] if back and back[0] == best[0] else len(pattern)
                found[t][i] = (best[0], end - n, n)


    def _complete(self, data: np.ndarray, first: np.ndarray, texts: list[bytes], found: list[dict], searched: dict) -> None:
        """Searches all windows that may hold an item, so that the best part is known whatever the LSH has found."""
        item, start, end = self.pieces.windows(data)
        order = np.lexsort((start, item))
        text, last = np.searchsorted(first, start, "right") - 1, np.searchsorted(first, end, "left")
        spans: list[list[int]] = []  # overlapping windows of an item in a text are one
        for w in order.tolist():
            i = int(item[w])
            for t in range(max(int(text[w]), 0), int(last[w])):
                a, b = max(0, int(start[w] - first[t])), min(len(texts[t]), int(end[w] - first[t]))
                if b - a < len(self.items[i][1]) - int(self.max_edits * len(self.items[i][1])):
                    continue
                if any(low <= a and b <= high for low, high in searched.get((i, t), ())):
                    continue
                if spans and spans[-1][:2] == [i, t] and a <= spans[-1][3]:
                    spans[-1][3] = max(b, spans[-1][3])
                else:
                    spans.append([i, t, a, b])
        for i, t, a, b in spans:
            pattern = self.items[i][1]
            most = int(self.max_edits * len(pattern)) if i not in found[t] else found[t][i][0] - 1
            best = edit_search(pattern, texts[t][a:b], most) if most >= 0 else None
            if best is not None:
                stop = a + best[1]
                back = edit_search(pattern[::-1], texts[t][max(0, stop - len(pattern) - best[0]):stop][::-1], best[0])
                found[t][i] = (best[0], stop - back[1], back[1])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from every place; none for shorter data."""
    n = len(data) - SEED + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    h = eight[:n] * np.uint64(HASH_MIX)
    h ^= h >> np.uint64(29)
    h += eight[SEED - 8:][:n] * np.uint64(HASH_BASE)
    h *= np.uint64(HASH_MIX)
    return h


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """Indexes of the items (item_id, text), each over a bounded amount of text."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("data")).where("item_id IS NOT NULL")
    for r in rows.distinct().orderBy("item_id", "data").toLocalIterator():
        block.append((r["item_id"], normal(bytes(r["data"]))))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield ItemIndex(block)
            block, size = [], 0
    if block:
        yield ItemIndex(block)


HITS = "array<struct<item_id:bigint,start:bigint,length:bigint,distance:bigint>>"


def hits_column(spark: SparkSession, index: ItemIndex, text: Column) -> Column:
    """The items of one block that a text holds."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def hits(data: pd.Series) -> pd.Series:
        out: list = []
        block: list = []
        size = 0
        for t in data:
            block.append(normal(t))
            size += len(block[-1])
            if size >= 1_000_000:
                out += shared.value.matches(block)
                block, size = [], 0
        if block:
            out += shared.value.matches(block)
        return pd.Series([[dict(zip(("item_id", "start", "length", "distance"), h)) for h in row] for row in out])

    return hits(text)


def find_leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, length, distance): every benchmark item that a row of ``docs`` holds.

    A text holds an item when some part of it is within ``MAX_EDITS`` of the
    item's length in edits, both normalised; start and length (bytes of the
    normalised text) and distance are of the best such part. Null and empty
    texts hold nothing and null or empty items are held by nothing; items under
    ``SEED`` bytes must appear as whole words. Repeated documents give a row
    each, repeated items one row per item_id; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    for index in item_blocks(items, block_bytes):
        rows = docs.select("doc_id", F.explode(hits_column(spark, index, text_bytes())).alias("hit")).select("doc_id", "hit.*")
        out = rows if out is None else out.union(rows)
    if out is None:
        return docs.select("doc_id").limit(0).selectExpr(
            "doc_id", *[f"CAST(NULL AS BIGINT) AS {c}" for c in ("item_id", "start", "length", "distance")])
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns are kept."""
    for index in item_blocks(items, block_bytes):
        docs = docs.where(F.size(hits_column(docs.sparkSession, index, text_bytes())) == 0)
    return docs


@query("op10_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
