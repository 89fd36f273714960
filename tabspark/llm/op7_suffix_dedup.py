"""Exact removal of repeated byte strings by difference-cover suffix sorting.

Suffixes of one string need comparing only with suffixes that begin with an
equal string, and equal strings have equal anchors (the least hash of their
inner substrings). So the windows of all texts are dealt out by anchor; what
occurs only once, or only in identical surroundings, is settled by counting, and
the rest is sorted by difference cover where its anchor's windows have met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.llm.common import join_by_count, one_of_hot_texts, stored, table, text_bytes
from tabspark.llm.registry import query
from tabspark.llm.suffix import anchor_runs, repeated_starts, window_hashes

#: A text or an anchor that one row in so many has is hot; there are at most so many, and they are broadcast.
HOT = 1_000
#: Bytes sorted at a time, and the most distinct contents an anchor may have for that; the windows of
#: anchors with more are counted one by one, pre-aggregated by every task.
SORT_BYTES, SORT_CONTENTS = 1_500_000, 4_096
GRAM = 64
RUNS = "k1 long, k2 long, first int, windows int, anchor long, content long, again boolean"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            parts, rows = [], []
            for i, t in enumerate(b["data"]):
                found = anchor_runs(t, length, gram)
                if len(found[0]):
                    parts.append(found)
                    rows.append(np.full(len(found[0]), i))
            if parts:
                row = np.concatenate(rows)
                first, windows, anchor, content, again = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"k1": b["k1"].to_numpy()[row], "k2": b["k2"].to_numpy()[row], "first": first.astype(np.int32),
                                    "windows": windows.astype(np.int32), "anchor": _signed(anchor), "content": _signed(content), "again": again})

    return texts.select("k1", "k2", "data").mapInPandas(run, RUNS)


def _sorted_repeats(length: int, sort_bytes: int):
    """Flags the windows of single contents that occur elsewhere among the contents of their anchor."""
    def flag(keys, texts, windows, single):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), windows)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        twin = repeated_starts(data, base[owner] + inner, length) & np.array(single)[owner]
        owner, inner = owner[twin], inner[twin]
        if not len(owner):
            return None
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)]))
        last = np.append(new[1:], len(owner)) - 1
        k1, k2, first = (np.array(x) for x in zip(*keys))
        own = owner[new]
        start = first[own] + inner[new]
        return pd.DataFrame({"k1": k1[own], "k2": k2[own], "start": start, "stop": start + inner[last] - inner[new] + length})

    def run(batches):
        keys, texts, windows, single, size, anchor = [], [], [], [], 0, None
        for b in batches:
            for row in zip(*(b[c] for c in ("k1", "k2", "first", "windows", "single", "anchor", "bytes"))):
                if row[5] != anchor and size >= sort_bytes:
                    out = flag(keys, texts, windows, single)
                    keys, texts, windows, single, size = [], [], [], [], 0
                    if out is not None:
                        yield out
                anchor = row[5]
                keys.append(row[:3])
                windows.append(row[3])
                single.append(row[4])
                texts.append(row[6])
                size += len(row[6])
        if texts:
            out = flag(keys, texts, windows, single)
            if out is not None:
                yield out

    return run


def _counted_windows(length: int):
    def run(batches):
        for b in batches:
            for k1, k2, first, single, data in zip(*(b[c] for c in ("k1", "k2", "first", "single", "bytes"))):
                one, two = window_hashes(data, length)
                yield pd.DataFrame({"k1": k1, "k2": k2, "start": np.arange(len(one)) + first, "single": single,
                                    "h1": _signed(one), "h2": _signed(two)})
    return run


def repeated_parts(docs: DataFrame, length: int = 200, gram: int = GRAM, sort_bytes: int = SORT_BYTES,
                   sort_contents: int = SORT_CONTENTS, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the texts of ``docs`` (data, k1, k2, key): the copied texts, the hot ones among them, and repeated parts.

    The last has (k1, k2, parts): all [start, stop) of a text that windows repeated elsewhere cover.
    """
    rows = docs.count()
    copies = stored(docs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("key").alias("keep")).where("n > 1"), "copies")
    hot_copies = copies.where(F.col("n") * hot >= rows).select("k1", "k2", F.col("keep").alias("hot_keep"))
    # of a hot text one row takes part; that it has copies is known
    texts = one_of_hot_texts(docs, copies, rows, hot).where(F.octet_length("data") >= length)
    runs = _runs(texts, length, gram)
    seen = (runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"),
                                     F.bool_or("again").alias("again"))
            .where("n > 1 OR again").select("anchor", "n", ((F.col("low") != F.col("high")) | (F.col("n") == 1)).alias("mixed")))
    seen = stored(seen, "anchors")
    total = seen.agg(F.sum("n")).first()[0] or 0
    marked = stored(join_by_count(runs, seen, ["anchor"], total, hot), "runs")

    covered = [F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("stop")]
    settled = marked.where("NOT mixed").select("k1", "k2", *covered)
    mixed = marked.where("mixed").drop("mixed", "again")
    contents = stored(mixed.groupBy("anchor", "content").agg(
        F.min(F.struct("k1", "k2", "first", "windows")).alias("r"), F.count("*").alias("n")).select(
        "anchor", "content", "r.*", "n", (F.col("n") == 1).alias("single")), "contents")
    # every window of a content that occurs twice is repeated
    copied = join_by_count(mixed, contents.select("anchor", "content", "n").where("n > 1"), ["anchor", "content"],
                           mixed.count(), hot).select("k1", "k2", *covered)

    large = contents.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > sort_contents).select("anchor")
    wanted = (contents.join(large.withColumn("large", F.lit(True)), "anchor", "left")
              .groupBy("k1", "k2").agg(F.collect_list(F.struct(
                  "anchor", "first", "windows", "single", F.coalesce("large", F.lit(False)).alias("large"))).alias("cuts")))
    pieces = (texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "data", F.explode("cuts").alias("c"))
              .select("k1", "k2", "c.*", F.substring("data", F.col("c.first") + 1, F.col("c.windows") - 1 + length).alias("bytes")))
    pieces = stored(pieces, "contents")
    found = (pieces.where("NOT large").repartition("anchor").sortWithinPartitions("anchor")
             .mapInPandas(_sorted_repeats(length, sort_bytes), "k1 long, k2 long, start int, stop int"))
    parts = settled.union(copied).union(found)
    if pieces.where("large").limit(1).count():
        windows = pieces.where("large").mapInPandas(
            _counted_windows(length), "k1 long, k2 long, start int, single boolean, h1 long, h2 long")
        windows = stored(windows, "windows")
        counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
        twins = join_by_count(windows.where("single"), stored(counted, "windows"), ["h1", "h2"], windows.count(), hot)
        parts = parts.union(twins.select("k1", "k2", "start", (F.col("start") + length).alias("stop")))
    merged = parts.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("parts"))
    return copies, hot_copies, stored(merged, "parts")


def cut(data: bytes, parts: list, whole_characters: bool) -> tuple[bytes, int, int]:
    """(what is kept, bytes removed, maximal removed runs); optionally characters go only if all their bytes do."""
    change = np.zeros(len(data) + 1, np.int32)
    for p in parts:
        change[p["start"]] += 1
        change[p["stop"]] -= 1
    gone = np.cumsum(change[:-1]) > 0
    raw = np.frombuffer(data, np.uint8)
    if whole_characters:
        character = np.cumsum((raw & 0xC0) != 0x80)
        kept = np.bincount(character, ~gone) > 0
        gone &= ~kept[character]
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return raw[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False, **limits) -> DataFrame:
    """Removes from every text each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Adds n_bytes, n_removed, n_spans and kept (binary) to the rows of ``docs``
    (text; other columns stay). Strings are judged on the input. Null and empty
    texts keep nothing and lose nothing; a text of which ``docs`` holds a copy
    is removed whole, unless it is shorter than ``length``. Rows with equal
    text, also repeated rows, are copies of each other.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    base = docs.toDF(*named).withColumn("data", text_bytes(named[docs.columns.index("text")]))
    base = base.withColumn("k1", F.xxhash64("data")).withColumn("k2", F.xxhash64(F.lit(7), "data"))
    # any fixed order among copies will do; equal keys mean that both rows take part
    base = base.withColumn("key", F.xxhash64(*[c for c, f in zip(named, docs.schema) if f.dataType.typeName() in _PLAIN] or ["k1"]))
    copies, hot, parts = repeated_parts(base.select("data", "k1", "k2", "key"), length, **limits)

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def shorten(data: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = [(None, None, None) if d is None else cut(d, c, whole_characters) for d, c in zip(data, cuts)]
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    size = F.octet_length("data").cast("long")
    marked = base.join(F.broadcast(hot), ["k1", "k2"], "left")
    # rows of hot texts are decided already and are dealt out by themselves
    marked = (marked.withColumn("g1", F.when(F.col("hot_keep").isNull(), F.col("k1")).otherwise(F.col("key")))
              .withColumn("g2", F.when(F.col("hot_keep").isNull(), F.col("k2")).otherwise(F.lit(0))))
    known = (parts.join(copies.select("k1", "k2", F.lit(True).alias("copied")), ["k1", "k2"], "full")
             .select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "parts", "copied"))
    joined = marked.join(known, ["g1", "g2"], "left")
    whole = (F.col("hot_keep").isNotNull() | F.col("copied")) & (size >= length)
    partly = F.col("parts").isNotNull() & ~F.coalesce(whole, F.lit(False))
    joined = joined.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("s", shorten(F.when(partly, F.col("data")), F.col("parts")))
    names = [F.col(n).alias(o) for n, o in zip(named, docs.columns)]
    return joined.select(
        *names, size.alias("n_bytes"),
        F.when(F.col("whole"), size).otherwise(F.coalesce("s.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("s.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.coalesce("s.kept", "data")).alias("kept"))


_PLAIN = ("long", "integer", "short", "byte", "string", "double", "float", "boolean", "date", "timestamp", "binary")


@query("op7_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
