"""Cost-balanced packing of documents into sequences of a fixed length."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.llm.common import table, text_bytes
from tabspark.llm.registry import query
from tabspark.llm.tokens import encoder, vocabulary

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost double")


def piece_cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated work of a piece: a part by token, a part by pair of tokens that attend to each other."""
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 512):
    """Packs documents of these lengths; returns (document, start, length, sequence, offset) rows and costs.

    Whole multiples of the capacity become full sequences. The remainders fill
    the fewest sequences that can hold them: in descending length each goes to
    the sequence of lowest cost that has room for all of it; where none has,
    the one of lowest cost with any room takes what fits and the rest is placed
    likewise. What does not fill a sequence at the end is cut to powers of two,
    so nothing is padded.
    """
    rows, costs, rest = [], [], []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            rows.append((doc, k * capacity, capacity, len(costs), 0))
            costs.append(piece_cost(capacity, linear, quadratic))
        if n % capacity:
            rest.append((n % capacity, doc))
    total = sum(n for n, _ in rest)
    rooms = [capacity] * (total // capacity)
    left = total % capacity
    while left:  # the last ones: powers of two, largest first
        rooms.append(1 << (left.bit_length() - 1))
        left -= rooms[-1]
    first = len(costs)
    costs += [0.0] * len(rooms)
    # one heap of (cost, sequence) for each remaining room, and the cost on its top
    heaps: list[list] = [[] for _ in range(capacity + 1)]
    top = np.full(capacity + 1, np.inf)

    def put(s: int) -> None:
        room = rooms[s - first]
        if room:
            heapq.heappush(heaps[room], (costs[s], s))
            top[room] = heaps[room][0][0]

    def take(room: int) -> int:
        s = heapq.heappop(heaps[room])[1]
        top[room] = heaps[room][0][0] if heaps[room] else np.inf
        return s

    for s in range(first, len(costs)):
        put(s)
    for n, doc in sorted(rest, key=lambda x: (-x[0], x[1])):
        start, todo = lengths[doc] - n, n
        while todo:
            room = todo + int(np.argmin(top[todo:]))
            if top[room] == np.inf:
                room = 1 + int(np.argmin(top[1:]))
            s = take(room)
            size = min(todo, room)
            # its offset is what the sequence holds already
            rows.append((doc, start, size, s, -room))
            costs[s] += piece_cost(size, linear, quadratic)
            rooms[s - first] -= size
            put(s)
            start, todo = start + size, todo - size
    held = [0] * len(costs)
    out = []
    for doc, start, size, s, _ in rows:
        out.append((doc, start, size, s, held[s]))
        held[s] += size
    return out, costs


def pack(docs: DataFrame, vocabulary_file: str, end_id: int = 0, capacity: int = 1024,
         group_tokens: int = 4_000_000, linear: float = 1.0, quadratic: float = 1.0 / 512) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): see ``PIECES``.

    The rows of an input split are packed among themselves, in groups of about
    ``group_tokens`` ids, which bounds memory; nothing is shuffled, and the
    padding is nil in every group because the last sequences are powers of two.
    A null or empty text is the end id alone; null and repeated doc_ids are kept
    as they are; other columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        own = encoder(vocabulary_file)
        base = TaskContext.get().partitionId() << 32
        keys: list = []
        parts: list = []
        size = 0

        def flush():
            nonlocal keys, parts, size, base
            lengths = [len(p) for p in parts]
            rows, costs = assign(lengths, capacity, linear, quadratic)
            out = pd.DataFrame({
                "doc_id": pd.array([keys[r[0]] for r in rows], "Int64"), "start": [r[1] for r in rows],
                "length": [r[2] for r in rows],
                "ids_crc32": [zlib.crc32(parts[d][a:a + n].tobytes()) for d, a, n, _, _ in rows],
                "doc_tokens": [lengths[r[0]] for r in rows], "sequence_id": [base + r[3] for r in rows],
                "offset": [r[4] for r in rows], "sequence_cost": [costs[r[3]] for r in rows]})
            base += len(costs)
            keys, parts, size = [], [], 0
            return out

        for batch in batches:
            ids_of = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for first, ids, offsets in own.blocks(list(batch["data"])):
                for i in range(len(offsets) - 1):
                    parts.append(np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4"))
                    keys.append(ids_of[first + i])
                    size += len(parts[-1])
                    if size >= group_tokens:
                        yield flush()
        if parts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInPandas(run, PIECES)


@query("op5_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
