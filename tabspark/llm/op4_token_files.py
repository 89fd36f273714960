"""Token-id output in directly addressable codes, and reading it back."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabspark.llm import dac
from tabspark.llm.common import stored, table, text_bytes
from tabspark.llm.registry import query
from tabspark.llm.tokens import encoder, vocabulary
from tabspark.session import scratch_path


def write_token_files(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = 1,
                      segment_tokens: int = 1_000_000, segments_per_file: int = 8) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order.

    Each document is followed by ``end_id``. A null text counts as empty, a null
    doc_id comes first, rows with equal ids are ordered by their text; other
    columns are ignored. Every task writes a run of whole segments, so memory is
    bounded by a segment or one document. An empty table gives no segment.
    """
    def encode(batches):
        own = encoder(vocabulary_file)
        part, number, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list = []

        def segment():
            nonlocal number, doc_ids, parts, size
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            out = dac.encode_segment(part, number, doc_ids, offsets, np.concatenate(parts))
            number, doc_ids, parts, size = number + 1, [], [], 0
            return pd.DataFrame({"segment": [out]})

        for batch in batches:
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for first, ids, offsets in own.blocks(list(batch["data"])):
                for i in range(len(offsets) - 1):
                    parts.append(np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)))
                    doc_ids.append(keys[first + i])
                    size += len(parts[-1])
                    if size >= segment_tokens:
                        yield segment()
        if doc_ids:
            yield segment()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "data"))
    # Spark's text writer puts the bytes of a string unchanged, then one line end.
    (ordered.mapInPandas(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", segments_per_file).option("lineSep", "\n").text(path))


def read_token_files(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """One row per document of the files at ``path``, in file order of (part, number, place).

    With ``digest`` the crc32 of the ids as little-endian uint32; else the ids.
    """
    def read(batches):
        for batch in batches:
            for data in batch["content"]:
                for s in dac.segments(data):
                    ids, cuts = s.tokens().astype("<u4"), s.offsets.tolist()
                    pieces = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                    out = {"part": s.part, "number": s.number, "place": range(len(pieces)),
                           "doc_id": pd.array(s.doc_ids, "Int64"), "n_tokens": [len(p) for p in pieces]}
                    if digest:
                        out["ids_crc32"] = [zlib.crc32(p.tobytes()) for p in pieces]
                    else:
                        out["ids"] = [p.astype(np.int64) for p in pieces]
                    yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    last = "ids_crc32 long" if digest else "ids array<long>"
    return files.mapInPandas(read, f"part long, number long, place long, doc_id long, n_tokens long, {last}")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the ids before each document.

    Totals of the written parts (one row per task) are summed up by the driver;
    inside a part a window adds the rest.
    """
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    sums = np.cumsum([0] + [n for _, n in totals]).tolist()
    spark = rows.sparkSession
    base = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, sums)], "part long, base long")
    inside = (Window.partitionBy("part").orderBy("number", "place")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(F.broadcast(base), "part")
            .withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).drop("base"))


@query("op4_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    rows = stored(read_token_files(spark, path), "token-digests")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
