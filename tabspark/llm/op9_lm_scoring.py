"""Language-model scoring: PPM code length and a unigram base, learned from the corpus.

Every context seen in training counts. The most frequent ones are broadcast as a
compiled trie, which scores what follows its complete contexts where it stands;
the grams of all other symbols go to the task that holds all trained contexts
with the same last symbols, and only sums by text come back. Words are told apart
by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.llm import ppm
from tabspark.llm.common import HASH_MIX, fold, stored, table, text_bytes
from tabspark.llm.periods import word_hashes
from tabspark.llm.registry import query

#: The most frequent words, so many at most, are kept with every task. A context may enter the trie if it holds at
#: least one training symbol in so many; and of those the most frequent ``TRIE`` do. These bound what is broadcast,
#: whatever the corpus; the other words and contexts are looked up by shuffle.
COMMON_WORDS = 400_000
CONTEXTS = 1 << 18
TRIE = 60_000
ORDER = 5
#: Last symbols of a context by which grams are dealt out; contexts with fewer are few and broadcast. Those that hold
#: one training symbol in ``HOT_CONTEXTS`` are dealt by one more symbol, up to ``DEEPEST``, and are broadcast too.
SHARED, DEEPEST, HOT_CONTEXTS = 2, 4, 2_000
#: Distinct trained grams that a task holds, more or less; texts and symbols that are asked for together.
PART_GRAMS, BLOCK_TEXTS, BLOCK_SYMBOLS = 1_000_000, 1024, 1_000_000
#: Bytes of text whose words are counted together.
WORD_BLOCK = 1_000_000


def _count_words(texts: DataFrame) -> DataFrame:
    """(word, n) partial counts by block of text; a word is its 64-bit hash."""
    def run(batches):
        block: list = []
        size = 0

        def out():
            word, n = np.unique(np.concatenate(word_hashes(block)), return_counts=True)
            return pd.DataFrame({"word": word.view(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for t in batch["data"]:
                block.append(t.lower())
                size += len(t)
                if size >= WORD_BLOCK:
                    yield out()
                    block, size = [], 0
        if block:
            yield out()

    return texts.mapInPandas(run, "word long, n long")


def _size_class(n: Column) -> Column:
    """Sixteen classes of counts for each doubling."""
    return F.floor(F.log2(n) * 16).cast("int")


def _common_from(words: DataFrame, most: int) -> int:
    """The least class of counts from which on there are ``most`` words at most."""
    held, least = 0, 1 << 30
    for r in words.groupBy(_size_class(F.col("n")).alias("c")).count().orderBy(F.desc("c")).collect():  # a thousand classes
        held += r["count"]
        if held > most:
            break
        least = r["c"]
    return least


def _count_grams(texts: DataFrame, order: int, block: int = 2_000_000) -> DataFrame:
    """(gram, n) partial counts of ``order`` + 1 symbols by block of text."""
    def run(batches):
        block_texts: list = []
        size = 0

        def out():
            grams, n = ppm.count_grams(block_texts, order)
            return pd.DataFrame({"gram": grams, "n": n.astype(np.int64)})

        for batch in batches:
            for t in batch["data"]:
                block_texts.append(t)
                size += len(t)
                if size >= block:
                    yield out()
                    block_texts, size = [], 0
        yield out()

    return texts.mapInPandas(run, "gram long, n long")


def _pack(values: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending values and their counts; bytes of equal weight lie together, so that they compress."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    coder = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_RLE)
    return b"".join([*[coder.compress(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()) for a in (step, n)],
                     coder.flush()])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, 8, -1)
    return (np.cumsum(np.ascontiguousarray(step.T).view(np.uint64).ravel(), dtype=np.uint64),
            np.ascontiguousarray(n.T).view(np.int64).ravel())


def _dealt(grams: np.ndarray, parts: int, hot: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(part, places) of the grams by the last symbols of their contexts; places ascend.

    ``hot`` has the contexts of 2, 3 ... symbols that are dealt by one symbol more.
    """
    context = grams >> ppm.BITS
    key = context & ppm.mask(SHARED)
    for k in range(SHARED, DEEPEST):
        often = hot.get(k, np.empty(0, np.int64))
        if len(often):
            own = context & ppm.mask(k)
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            # a longer key can't be mistaken for a shorter one
            key = np.where(often[at] == own, (context & ppm.mask(k + 1)) | (np.int64(k) << 58), key)
    part = (((key.astype(np.uint64) + np.uint64(1)) * np.uint64(HASH_MIX)) >> np.uint64(33)) % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    by = np.argsort(part, kind="stable")
    own, first = np.unique(part[by], return_index=True)
    return list(zip(own.tolist(), np.split(by, first[1:]))) if len(by) else []


def _packed_grams(grams: DataFrame, parts: int, hot: dict) -> DataFrame:
    """(part, key, packed) of all trained grams; key is null."""
    def run(batches):
        held, size = [], 0

        def out():
            gram, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            by = np.argsort(gram)
            gram, n = gram[by], n[by]
            rows = [(p, None, _pack(gram[at], n[at])) for p, at in _dealt(gram, parts, hot)]
            return pd.DataFrame(rows, columns=["part", "key", "packed"])

        for batch in batches:
            held.append((batch["gram"].to_numpy(), batch["n"].to_numpy()))
            size += len(batch)
            if size >= 500_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return grams.mapInPandas(run, "part long, key long, packed binary")


def _open_scores(asked: DataFrame, grams: DataFrame, low: dict, hot: dict, order: int, parts: int) -> DataFrame:
    """(key, open) partial log10 probabilities by text of the grams in ``asked`` (part, key, packed).

    A value in ``asked`` is a gram and the text's place after the block's ``key``.
    """
    shared = asked.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        now, held, model = None, [], None
        for batch in batches:
            keys, sums = [], []
            for part, key, packed in zip(batch["part"], batch["key"], batch["packed"]):
                if part != now:
                    now, held, model = part, [], None
                values, n = _unpack(packed)
                if pd.isna(key):
                    held.append((values.astype(np.int64), n))
                    continue
                if model is None:
                    gram, m = (np.concatenate([h[i] for h in held] or [np.empty(0, np.int64)]) for i in (0, 1))
                    held, by = [], np.argsort(gram)
                    model = ppm.Counts(order, SHARED, gram[by], m[by], shared.value)
                text = (values & np.uint64(BLOCK_TEXTS - 1)).astype(np.int64)
                value = np.bincount(text, model.log10((values // np.uint64(BLOCK_TEXTS)).astype(np.int64)) * n)
                own = np.unique(text)
                keys.append(int(key) + own)
                sums.append(value[own])
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "open": np.concatenate(sums)})

    rows = _packed_grams(grams, parts, hot).union(asked.select("part", "key", "packed"))
    return (rows.repartition(parts, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first())
            .mapInPandas(run, "key long, open double"))


def train_ppm(texts: DataFrame, order: int = ORDER, contexts: int = CONTEXTS, trie: int = TRIE, hot_contexts: int = HOT_CONTEXTS
              ) -> tuple[ppm.Automaton, DataFrame, dict, dict]:
    """Counts all of ``texts`` (data binary): the trie of the most frequent contexts, all grams, the shortest and the hot ones.

    Shorter contexts follow from the longest ones, as every symbol has ``order``
    symbols before it. All contexts above one count are kept, with all their
    symbols, so a kept context's shorter forms are kept too.
    """
    grams = stored(_count_grams(texts, order).groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    context = F.shiftright("gram", ppm.BITS)
    levels, found = {}, []
    level = grams
    for k in range(order, -1, -1):
        if k < order:
            level = stored(level.select(F.col("gram").bitwiseAND(F.lit(ppm.mask(k + 1))).alias("gram"), "n")
                           .groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        levels[k] = level
        found.append(level.groupBy(context.alias("context")).agg(F.sum("n").alias("m"))
                     .where(F.col("m") * contexts >= total).withColumn("k", F.lit(k)))
    kept = reduce(DataFrame.union, found).toArrow()  # at most ``contexts`` rows for each order
    context_of, m, k_of = (kept[c].to_numpy() for c in ("context", "m", "k"))
    chosen = np.ones(len(m), bool)
    if len(m) > trie:
        chosen = (m > np.partition(m, len(m) - trie - 1)[len(m) - trie - 1]) | (k_of == 0)
    entries = {}
    for k in range(order + 1):
        own = texts.sparkSession.createDataFrame(pa.table({"context": context_of[chosen & (k_of == k)].astype(np.int64)}))
        rows = levels[k].withColumn("context", context).join(F.broadcast(own), "context").select("gram", "n").toArrow()
        gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        by = np.argsort(gram)
        entries[k] = (gram[by].astype(np.int64), n[by].astype(np.float64))
    low, hot = {}, {}
    for k in range(min(DEEPEST, order)):
        rows = levels[k]
        if k >= SHARED:
            hot[k] = np.sort(context_of[(k_of == k) & (m * hot_contexts >= total)].astype(np.int64))
            if not len(hot[k]):
                continue  # then no longer one is hot either
            own = texts.sparkSession.createDataFrame(pa.table({"context": hot[k]}))
            rows = rows.withColumn("context", context).join(F.broadcast(own), "context").select("gram", "n")
        rows = rows.toArrow().sort_by("gram")
        low[k] = rows["gram"].to_numpy(), rows["n"].to_numpy()
    return ppm.compile_trie(order, entries), grams, low, hot


ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                  ("part", pa.float64()), ("score", pa.float64()), ("word", pa.int64()), ("part_no", pa.int64()), ("packed", pa.binary())])


def _rows(**columns) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROWS], schema=ROWS)


def score_corpus(docs: DataFrame, trained: Column, order: int = ORDER, contexts: int = CONTEXTS, trie: int = TRIE,
                 common_words: int = COMMON_WORDS, part_grams: int = PART_GRAMS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text); learns from those where ``trained`` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Null texts count as empty: one end token. Rows with a null doc_id are
    held out unless ``trained`` says otherwise; repeated rows are scored one by
    one; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"),
                         text_bytes().alias("data"))
    texts = source.where("trained").select("data")
    spark = docs.sparkSession
    words = stored(_count_words(texts).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = texts.count()
    found = words.agg(F.count("*"), F.sum("n")).first()
    n, v = (found[1] or 0) + ends, found[0] + (1 if ends else 0)
    cells = n + 0.5 * (v + 1)
    least = _common_from(words, common_words)
    often = words.where(_size_class(F.col("n")) >= least).toArrow()  # ``common_words`` rows at most
    common = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy()
    by = np.argsort(common[0])
    common = common[0][by], common[1][by]
    model, grams, low, hot = train_ppm(texts, order, contexts, trie, hot_contexts)
    parts = max(12, -(-grams.count() // part_grams))
    shared = spark.sparkContext.broadcast((model, common))
    del model

    def ask(held, key):
        text, gram = (np.concatenate([h[i] for h in held]).astype(np.uint64) for i in (0, 1))
        asked, times = np.unique(gram * np.uint64(BLOCK_TEXTS) + text, return_counts=True)
        dealt = _dealt((asked // np.uint64(BLOCK_TEXTS)).astype(np.int64), parts, hot)
        if dealt:
            yield _rows(key=[key] * len(dealt), part_no=[p for p, _ in dealt], packed=[_pack(asked[at], times[at]) for _, at in dealt])

    def base(block):
        """Tokens, known ones and the score of each text by the common words; (text, word, times) of the others."""
        names, counts = shared.value[1]
        each = word_hashes([t.lower() for t in block])
        sizes = np.array([len(x) for x in each])
        word, back = np.unique(np.concatenate(each), return_inverse=True)
        c = np.zeros(len(word), np.int64)
        if len(names):
            at = np.minimum(np.searchsorted(names, word), len(names) - 1)
            c = np.where(names[at] == word, counts[at], 0)
        owner, there = np.repeat(np.arange(len(block)), sizes), (c > 0)[back]
        value = np.where(c > 0, np.log10((c + 0.5) / cells), 0.0)[back]
        part = np.bincount(owner, value, len(block)) + np.log10((ends + 0.5) / cells)
        known = np.bincount(owner, there, len(block)).astype(np.int64) + (1 if ends else 0)
        pair, times = np.unique(owner[~there] * len(word) + back[~there], return_counts=True)
        return sizes + 1, known, part, pair // max(len(word), 1), word[pair % max(len(word), 1)], times

    def run(batches):
        model = shared.value[0]
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            first, count = 0, batch.num_rows
            held, since = [], 0
            data = batch.column("data").to_pylist()
            while first < count:
                last, size = first, 0
                while last < count and last - first < BLOCK_TEXTS and (last == first or size + len(data[last]) <= 1_000_000):
                    size += len(data[last])
                    last += 1
                scores, text, gram = model.split(data[first:last])
                if held and (last - since > BLOCK_TEXTS or sum(len(g) for _, g in held) > BLOCK_SYMBOLS):
                    yield from ask(held, key + since)
                    held = []
                if not held:
                    since = first
                held.append((text + (first - since), gram))
                del text, gram
                n_tokens, known, part, rare_text, rare_word, times = base(data[first:last])
                yield _rows(key=np.arange(key + first, key + last), doc_id=batch.column("doc_id").slice(first, last - first),
                            trained=batch.column("trained").slice(first, last - first), n_tokens=n_tokens, known=known, part=part, score=scores)
                if len(times):
                    yield _rows(key=key + first + rare_text, word=rare_word.view(np.int64), n_tokens=times)
                first = last
            if held:
                yield from ask(held, key + since)
            key += count

    rows = stored(source.mapInArrow(
        run, "key long, doc_id long, trained boolean, n_tokens long, known long, part double, score double, word long, part_no long, packed binary"),
        "scored")
    shared.destroy()  # the rows are stored: no task needs the model any more
    rare = (rows.where(F.col("word").isNotNull()).select("key", "word", F.col("n_tokens").alias("m"))
            .join(words.where(_size_class(F.col("n")) < least), "word", "left")
            .groupBy("key").agg(
                F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("rare_known"),
                F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(cells))).alias("rare_part")))
    asked = rows.where(F.col("part_no").isNotNull()).select(F.col("part_no").alias("part"), "key", "packed")
    opened = _open_scores(asked, grams, low, hot, order, parts).groupBy("key").agg(F.sum("open").alias("open"))
    main = rows.where(F.col("word").isNull() & F.col("part_no").isNull()).drop("word", "part_no", "packed")
    return main.join(rare, "key", "left").join(opened, "key", "left").select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare_part", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("open", F.lit(0.0))).alias("score"))


@query("op9_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), fold() != 1)
