"""Phrase collocation mining over a prefix-free parsing.

A document's words, with a mark between pieces, are cut into chunks wherever the
hash of the next OVERLAP tokens says so, so equal passages are cut alike. A chunk
runs OVERLAP tokens into its successor. Distinct chunks and their frequencies are
the dictionary; phrases are counted in each distinct chunk once, times its
frequency, and only those that start before the overlap, which assigns each
occurrence to one chunk. A phrase is counted only if its parts may be frequent:
words are counted first, then pairs of frequent words by hash, then whatever
consists of such pairs, with its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabspark.llm.common import HASH_MIX, empty_if_missing, stored, table
from tabspark.llm.registry import query
from tabspark.llm.suffix import _mix, prefix_hash

#: Words of a phrase, occurrences of a candidate, share in percent by which a longer one replaces it, rows per language.
LONGEST, LEAST, ABSORBED, TOP = 5, 100, 100, 2_000
#: Tokens that neighbouring chunks share; one cut in so many tokens; tokens of a chunk at most.
OVERLAP, CUT, CHUNK = LONGEST - 1, 32, 4_096
#: Bits of the filter of frequent phrases: 2 ** 26 bits are 8 MB, however many phrases there are.
FILTER_BITS = 26
#: Bytes of chunks that a task counts together.
BLOCK = 4_000_000
#: Languages whose word counts are broadcast; with more of them they are joined by shuffle.
LANGS = 10_000
#: The mark between pieces; no word can hold it.
MARK = b"."

# What separates pieces.
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_MARK = bytes.maketrans(_SEPARATORS + b"\t", MARK * len(_SEPARATORS) + b" ")
_MARKS = re.compile(rb" *\.[ .]*")
_SPACES = re.compile(rb"  +")
_SPACE, _MARK = 32, MARK[0]
_BASE = np.uint64(HASH_MIX | 1)


def canonical(text: bytes) -> bytes:
    """Lower-case words with single spaces between them and a mark between pieces; it starts with a mark, OVERLAP marks end it."""
    body = _SPACES.sub(b" ", _MARKS.sub(b" . ", b"." + text.lower().translate(_TO_MARK) + b".")).strip(b" ")
    return body + b" ." * (OVERLAP - 1)


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and hash of each token of ``data`` (ends in a gap; gaps are spaces and line feeds), and which are marks."""
    raw = np.frombuffer(data, np.uint8)
    solid = (raw != _SPACE) & (raw != 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid])))
    start, stop = edge[0::2], edge[1::2]
    sums, scale = prefix_hash(data)
    name = _mix((sums[stop] - sums[start]) * scale[start] + (stop - start).astype(np.uint64))
    return start, stop, name, (raw[start] == _MARK) & (stop - start == 1)


def gram_hash(name: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each place where as many are left."""
    out = np.zeros(max(len(name) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * _BASE + name[k:len(name) - size + 1 + k]
    return _mix(out + np.uint64(size))


def chunks(texts: list[bytes], cut: int = CUT, longest: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(number of the text, chunk) for all chunks of the texts."""
    data = b"\n".join(map(canonical, texts)) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    start, stop, name, _ = tokens(data)
    ends = np.searchsorted(start, np.flatnonzero(raw == 10))
    trigger = gram_hash(name, OVERLAP) % np.uint64(cut) == 0
    places = np.flatnonzero(trigger)
    first = 0
    for i, end in enumerate(ends.tolist()):
        last = end - OVERLAP  # the final marks are overlap only
        inner = places[np.searchsorted(places, first + 1):np.searchsorted(places, last)].tolist()
        at = first
        for to in [*inner, last]:
            while to - at > longest:
                yield i, data[start[at]:stop[at + longest + OVERLAP - 1]]
                at += longest
            if to > at:
                yield i, data[start[at]:stop[to + OVERLAP - 1]]
            at = to
        first = end


def dictionary(docs: DataFrame, cut: int = CUT, longest: int = CHUNK) -> DataFrame:
    """(lang, chunk, freq): the distinct chunks of each language and how often the parse has them."""
    def run(batches):
        for b in batches:
            lang, texts = b["lang"].to_numpy(), [empty_if_missing(t) for t in b["data"]]
            block, held = [], 0
            for i, t in enumerate(texts):
                block.append(i)
                held += len(t)
                if held >= 1_000_000 or i == len(texts) - 1:
                    found = list(chunks([texts[j] for j in block], cut, longest))
                    if found:
                        who = np.array([block[j] for j, _ in found])
                        yield pd.DataFrame({"lang": lang[who], "chunk": [c for _, c in found]})
                    block, held = [], 0

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("data"))
    return rows.mapInPandas(run, "lang string, chunk binary").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("freq"))


def _keyed(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return _mix(gram + lang * _BASE)


def _lang_hashes(langs: np.ndarray) -> np.ndarray:
    distinct, which = np.unique(langs.astype(object), return_inverse=True)
    data = " ".join(f"_{x.encode().hex()}" for x in distinct).encode() + b" "
    return tokens(data)[2][which]


class _Block:
    """Chunks of a task in one buffer, with their tokens and the places where phrases may start."""

    def __init__(self, lang: list, parts: list[bytes], freq: list[int]):
        self.lang, self.freq = np.array(lang, object), np.array(freq, np.int64)
        self.data = b"\n".join(parts) + b"\n"
        self.start, self.stop, self.name, mark = tokens(self.data)
        ends = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        cuts = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.owner = np.repeat(np.arange(len(parts)), np.diff(cuts))
        self.begins = np.arange(len(self.start)) < (cuts[1:] - OVERLAP)[self.owner]
        self.spoken = _lang_hashes(self.lang)[self.owner]
        self.word = ~mark

    def keys(self, size: int) -> np.ndarray:
        """Hash of language and phrase at each place."""
        n = max(len(self.name) - size + 1, 0)
        return _keyed(gram_hash(self.name, size), self.spoken[:n])

    def grams(self, size: int, known: np.ndarray | None, known_size: int):
        """Distinct phrases of ``size`` words that start before the overlap: a place of each, key and weighted count.

        ``known`` is the bit filter of frequent phrases of ``known_size`` words: a phrase is
        counted only if all its parts of that size are in it.
        """
        n = max(len(self.name) - size + 1, 0)
        good = self.begins[:n].copy()
        for k in range(size):
            good &= self.word[k:n + k]
        if known is not None:
            held = _held(known, self.keys(known_size))
            for k in range(size - known_size + 1):
                good &= held[k:n + k]
        at = np.flatnonzero(good)
        key, first, group = np.unique(self.keys(size)[at], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group, self.freq[self.owner[at]])
        return at[first], key, total

    def texts(self, at: np.ndarray, size: int) -> list[bytes]:
        return [self.data[x:y] for x, y in zip(self.start[at].tolist(), self.stop[at + size - 1].tolist())]


def _blocks(batches, size: int):
    lang, parts, freq, held = [], [], [], 0
    for b in batches:
        for row in zip(b["lang"], b["chunk"], b["freq"]):
            lang.append(row[0]), parts.append(row[1]), freq.append(row[2])
            held += len(row[1])
            if held >= size:
                yield _Block(lang, parts, freq)
                lang, parts, freq, held = [], [], [], 0
    if parts:
        yield _Block(lang, parts, freq)


def phrase_counts(chunks_: DataFrame, sizes: list[int], known: np.ndarray | None, known_size: int, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, words, a): occurrences of the phrases of these sizes in the corpus."""
    shared = None if known is None else chunks_.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for x in _blocks(batches, block):
            for size in sizes:
                at, _, total = x.grams(size, None if shared is None else shared.value, known_size)
                if len(at):
                    yield pd.DataFrame({"lang": x.lang[x.owner[at]], "phrase": x.texts(at, size), "words": size, "a": total})

    rows = chunks_.mapInPandas(run, "lang string, phrase binary, words int, a long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def hash_counts(chunks_: DataFrame, size: int, known: np.ndarray, known_size: int, block: int = BLOCK) -> DataFrame:
    """(key, a): occurrences of the phrases of one size by their hash, a quarter of the bytes of their texts.

    Phrases with equal hashes are counted together, so none is counted too low.
    """
    shared = chunks_.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for x in _blocks(batches, block):
            _, key, total = x.grams(size, shared.value, known_size)
            if len(key):
                yield pd.DataFrame({"key": key.view(np.int64), "a": total})

    return chunks_.mapInPandas(run, "key long, a long").groupBy("key").agg(F.sum("a").alias("a"))


def _held(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _bits(keys: DataFrame, log_bits: int) -> np.ndarray:
    """The bit filter of the column ``key``; of fixed length, so that it can be sent everywhere."""
    words = 1 << (log_bits - 6)
    place = F.col("key").bitwiseAND(F.lit((1 << log_bits) - 1))
    rows = (keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())  # at most 2 ** (log_bits - 6) rows
    bits = np.zeros(words, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def phrase_filter(phrases: DataFrame, size: int, log_bits: int = FILTER_BITS) -> np.ndarray:
    """The bits of all phrases of ``size`` words in ``phrases`` (lang, phrase): what isn't in it isn't frequent, what is may be."""
    def run(batches):
        for b in batches:
            if len(b):
                name = tokens(b"\n".join(b["phrase"]) + b"\n")[2].reshape(len(b), size)
                gram = np.zeros(len(b), np.uint64)
                for k in range(size):
                    gram = gram * _BASE + name[:, k]
                key = _keyed(_mix(gram + np.uint64(size)), _lang_hashes(b["lang"].to_numpy()))
                yield pd.DataFrame({"key": key.view(np.int64)})

    return _bits(phrases.select("lang", "phrase").mapInPandas(run, "key long"), log_bits)


def frequent_phrases(docs: DataFrame, least: int = LEAST, cut: int = CUT, longest: int = CHUNK, block: int = BLOCK,
                     log_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, words, a) of all phrases with at least ``least`` occurrences, single words too."""
    parse = stored(dictionary(docs, cut, longest), "dictionary")
    words = stored(phrase_counts(parse, [1], None, 1, block), "words")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = words.where(F.col("a") >= least)
    known = phrase_filter(found, 1, log_bits)
    pairs = stored(hash_counts(parse, 2, known, 1, block).where(F.col("a") >= least).select("key"), "pairs")
    known = _bits(pairs, log_bits)
    more = stored(phrase_counts(parse, list(range(2, LONGEST + 1)), known, 2, block).where(F.col("a") >= least), "phrases")
    return total, found.union(more)


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("split", first, count), " ")


def collocations(docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, **parse) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Takes lang and text of ``docs``; a null lang is ``und``, null and empty texts
    have no words, further columns are ignored, repeated rows count each, an empty
    table gives no row. ``score`` is floor(1000 * a * n / (l * r)) at the cut where
    this is least (ties: the first), in exact decimals. A phrase is left out if
    its words lie inside a longer candidate with at least ``absorbed`` percent of its
    occurrences. Ties in score and a are ordered by the phrase's bytes.
    """
    total, found = frequent_phrases(docs, least, **parse)
    counts = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "a")
    rows = counts.where("words > 1").withColumn("split", F.split("phrase", " "))
    # words k and on of a cut; both parts are as frequent as the phrase at least, so they have been counted
    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    one = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"])
    few = total.limit(LANGS + 1).count() <= LANGS
    scored = scored.join(F.broadcast(total) if few else total, "lang")
    product = (F.col("a").cast("decimal(18,0)") * F.col("n").cast("decimal(17,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    scored = (scored.withColumn("up", product)
              .withColumn("down", (F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).cast("decimal(38,0)"))
              .withColumn("score", F.expr("up div down")))
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = (rows.where("words > 2")
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .select("lang", _part(F.col("from"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
             .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    kept = (best.join(inner, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * absorbed))
            .select("lang", "phrase", "a", "n", "best.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = "\n      UNION ALL ".join(
        f"SELECT lang, list_aggregate(w[i:i + {m - 1}], 'string_agg', ' ') AS phrase, {m} AS words FROM "
        f"(SELECT lang, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM p WHERE len(w) >= {m})" for m in range(1, LONGEST + 1))
    return rf"""
    WITH q AS (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM q),
    t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY 1),
    f AS (SELECT lang, phrase, words, count(*)::HUGEINT AS a FROM ({grams}) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
    s AS (SELECT c.lang, c.phrase, c.a, t.n, x.k, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * t.n) // (l.a * r.a) AS score
          FROM c, (VALUES (1), (2), (3), (4)) x(k), t, f l, f r
          WHERE x.k < c.words AND t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
            AND l.phrase = list_aggregate(c.w[1:x.k], 'string_agg', ' ') AND r.phrase = list_aggregate(c.w[x.k + 1:], 'string_agg', ' ')),
    b AS (SELECT DISTINCT ON (lang, phrase) * FROM s ORDER BY lang, phrase, score, k),
    i AS (SELECT lang, phrase, max(a) AS around FROM (
            SELECT lang, list_aggregate(w[j:j + m - 1], 'string_agg', ' ') AS phrase, a FROM (
              SELECT lang, w, a, m, unnest(range(1, words - m + 2)) AS j FROM c, (VALUES (2), (3), (4)) y(m) WHERE m < words)) GROUP BY 1, 2),
    k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < {ABSORBED} * b.a)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= {TOP}"""


@query("op13_collocations", _sql())
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
