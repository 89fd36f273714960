"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.llm.common import fold, hashed_sample, table, text_bytes
from tabspark.llm.registry import query

#: Statistics of a text, in the order of the feature columns.
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "blank", "newline", "mark", "high", "control",
    "exclaim", "entropy", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "log_lines", "mean_line",
    "ended_lines", "capital_words", "upper_words", "marked_words", "digit_words", "bracket", "longest_run", "sentence",
)
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
_CONTROL = np.array([i for i in range(32) if i not in (9, 10, 13)] + [127])


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    share = counts / n
    present = share[share > 0]
    words = text.split()
    m = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    first = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    capital = int(((first >= 65) & (first <= 90)).sum())
    upper = sum(map(bytes.isupper, words))
    marked = int(np.isin(last, _MARKS).sum())
    stops = int(np.isin(last, (33, 46, 63)).sum())
    change = np.flatnonzero(data[1:] != data[:-1])
    run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max())
    return [
        math.log1p(n), math.log1p(len(words)), (n - share[32] * n) / m, share[_UPPER].sum(), share[_LOWER].sum(),
        share[_DIGIT].sum(), share[32], share[10], share[_MARKS].sum(), share[128:].sum(), share[_CONTROL].sum(),
        share[33], float(-(present * np.log2(present)).sum()), len(seen) / m, max(seen.values(), default=0) / m,
        1.0 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0, 1.0 - len(set(lines)) / k, math.log1p(len(lines)),
        math.log1p(n / k), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / k, capital / m, upper / m,
        marked / m, sum(not w.isalpha() and any(48 <= c <= 57 for c in w) for w in words) / m,
        share[[60, 62, 91, 93, 123, 125]].sum(), math.log1p(run), m / (stops + 1),
    ]


class Trees:
    """Boosted trees flattened into arrays: node t * nodes + i, children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.value = feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees go down one level at a time, for all rows together."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(self.feature.shape[0])[None, :]
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a:a + 4096]
            at = np.zeros((len(part), self.feature.shape[0]), np.int32)
            r = rows[:len(part)]
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[r, self.feature[trees, at]] > self.threshold[trees, at])
            out[a:a + 4096] = self.base + self.value[trees, at].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64,
              rate: float = 0.15, l2: float = 1.0, min_weight: float = 1.0) -> Trees:
    """Logistic boosting on histograms of binned features; missing splits send every row left."""
    n, d = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    inner, nodes = 2**depth - 1, 2**(depth + 1) - 1
    feature = np.zeros((rounds, nodes), np.int16)
    threshold = np.full((rounds, nodes), np.inf)
    value = np.zeros((rounds, nodes))
    if n == 0 or y.min() == y.max():
        return Trees(base, depth, feature, threshold, value)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin = np.full(n, base)
    columns = np.arange(d)
    for t in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * d + columns) * bins + binned
            size = width * d * bins
            G = np.bincount(cell.ravel(), np.repeat(g, d), size).reshape(width, d, bins)
            H = np.bincount(cell.ravel(), np.repeat(h, d), size).reshape(width, d, bins)
            gl, hl = G.cumsum(2), H.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl)**2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < min_weight) | (ht - hl < min_weight)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        G, H = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t, inner:] = (-rate * G / (H + l2))[inner:]
        margin += value[t, at]
    return Trees(base, depth, feature, threshold, value)


def _features(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, max_rows: int) -> DataFrame:
    """Features and label of at most ``max_rows`` labelled ids, chosen by their hash.

    An id gives one row, however many documents have it: the one whose text has the least hash.
    """
    labels = labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = (hashed_sample(labels, ["doc_id"], labels.count(), max_rows).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", text_bytes().alias("_data")).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("_hash", F.xxhash64("_data"))

    def run(batches):
        best: dict = {}  # one row of each id, so no more than ``max_rows``
        for batch in batches:
            for k, text, y, h in zip(batch["doc_id"], batch["_data"], batch["_label"], batch["_hash"]):
                if k not in best or h < best[k][0]:
                    best[k] = (h, statistics(text), y)
        if best:
            yield pd.DataFrame([(k, *row) for k, row in best.items()], columns=["k", "h", "x", "y"])

    return (rows.mapInPandas(run, "k long, h long, x array<double>, y int")
            .groupBy("k").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("r.x", "r.y", "k"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, max_rows: int = 20_000, **grow) -> Trees:
    """Fits on a bounded sample of labelled rows (``max_rows``) for which ``keep`` holds."""
    keep = F.lit(True) if keep is None else keep
    rows = training_rows(docs, labels, label, keep, max_rows).toPandas().sort_values(["k", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["y"].to_numpy(np.float64), **grow)


def score_quality(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """Adds the score of every whole text to ``docs``; a null text counts as empty.

    ``docs`` may not have the column already (the caller picks a free name).
    """
    names = docs.columns
    data = "_quality_text"
    while data in names:
        data += "_"
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_features(texts)))

    return docs.withColumn(column, score(text_bytes()))


def quality_model(spark: SparkSession, sf_dir: str) -> Trees:
    return fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=fold() != 0)


@query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
