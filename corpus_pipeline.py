"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. Rows with null or
repeated ids, null or empty texts, empty tables and further columns pass through
each stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.llm.common import fold, stored, table
from tabspark.llm.op1_quality import fit_quality, score_quality
from tabspark.llm.op3_ngram_join import link_documents
from tabspark.llm.op5_packing import pack
from tabspark.llm.op7_suffix_dedup import remove_repeats
from tabspark.llm.op10_decontaminate import drop_leaks
from tabspark.llm.tokens import vocabulary

#: A document scored below this is rejected.
LEAST_QUALITY = 0.3


def _guarded(docs: DataFrame) -> tuple[DataFrame, list]:
    """doc_id, text and the other columns under names no operator uses; and how to get the old names back."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_other_{i}" for i, c in enumerate(others)}
    out = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return out, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones outside the held-out fold."""
    guarded, back = _guarded(docs)
    trees = fit_quality(guarded, table(spark, sf_dir, "labels"), keep=fold() != 0)
    return score_quality(guarded, trees, "_score").where(F.col("_score") >= LEAST_QUALITY).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect (five words, similarity of 0.8): one with the group's smallest doc_id.

    Of several rows with that id any one stays. Texts without words are in no group.
    """
    guarded, back = _guarded(docs)
    linked = link_documents(guarded, size=5, percent=80)
    alone = F.col("n_shingles") == 0
    key = F.when(alone, F.monotonically_increasing_id()).otherwise(F.col("component"))
    return (linked.withColumn("_alone", alone).withColumn("_group", key)
            .where(F.col("_alone") | F.col("doc_id").eqNullSafe(F.col("component_id")))
            .dropDuplicates(["_alone", "_group"]).select(*back))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; n_chars follows the text, cut texts stay whole characters."""
    guarded, back = _guarded(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    out = remove_repeats(guarded, whole_characters=True).withColumn("text", text).select(*back)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing),
]

#: SQL can express none of the stages but the last's sums; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
