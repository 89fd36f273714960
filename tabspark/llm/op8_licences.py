"""Licence scans: Dice coefficient over word bigrams, in built-in expressions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.llm.common import table
from tabspark.llm.registry import query

# Notices by which licences are commonly declared.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.8


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold against a set of this size."""
    return (math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9))


def key_words(template: list[str], threshold: float) -> set[str]:
    """Words of which a text must hold one to reach the threshold.

    Bigrams without any of them are too few to reach the least overlap.
    """
    least = math.ceil(threshold / 2 * (size_bounds(len(template), threshold)[0] + len(template)) - 1e-9)
    left, chosen = set(template), set()
    while len(left) >= least:
        words = sorted({w for b in left for w in b.split()})
        best = max(words, key=lambda w: (sum(w in b.split() for b in left) * min(len(w), 6), len(w)))
        chosen.add(best)
        left = {b for b in left if best not in b.split()}
    return chosen


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, n_units, dice) for every licence that a document declares.

    The units compared are each line, each paragraph and the whole text; a unit
    declares a licence when the Dice coefficient of its set of word bigrams with
    that of one of the licence's templates reaches ``threshold``. Only templates
    whose size bounds hold the unit's size are compared. Equal units of a text
    count once; n_units counts units, dice is the best. Null and empty texts
    declare nothing; rows with equal (also null) doc_id are taken together;
    other columns are ignored.
    """
    sets = [(name, bigrams(text)) for name, text in templates]
    words = sorted(set().union(*(key_words(b, threshold) for _, b in sets)))
    lows = [size_bounds(len(b), threshold)[0] for _, b in sets]
    known = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(size_bounds(len(b), threshold)[0]).alias("low"),
                               F.lit(size_bounds(len(b), threshold)[1]).alias("high"),
                               F.array(*map(F.lit, b)).alias("grams")) for name, b in sets])

    def dice(t: Column) -> Column:
        return (2.0 * F.size(F.array_intersect("grams", t["grams"]))) / (F.size("grams") + F.size(t["grams"]))

    text = F.lower(F.col("text"))
    units = (docs.select("doc_id", text.alias("text")).where(F.col("text").rlike("|".join(words)))
             .select("doc_id", F.explode(F.array_distinct(F.concat(
                 F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n"), F.array("text")))).alias("unit"))
             .where(F.col("unit").rlike("|".join(words)))
             .select("doc_id", F.split(F.trim(F.regexp_replace("unit", "[^a-z0-9]+", " ")), " ").alias("words"))
             .where(F.size("words") > min(lows)))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    size = F.size("grams")
    found = (units.select("doc_id", F.array_distinct(pairs).alias("grams"))
             .select("doc_id", F.explode(F.filter(F.transform(
                 F.filter(known, lambda t: (size >= t["low"]) & (size <= t["high"])),
                 lambda t: F.struct(t["licence"].alias("licence"), dice(t).alias("dice"))),
                 lambda m: m["dice"] >= threshold)).alias("m"), F.monotonically_increasing_id().alias("unit")))
    return (found.groupBy("doc_id", F.col("m.licence").alias("licence"))
            .agg(F.count_distinct("unit").alias("n_units"), F.max("m.dice").alias("dice")))


def _sql() -> str:
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in bigrams(text))) for name, text in TEMPLATES)
    return f"""
    WITH t(licence, grams) AS (VALUES {rows}),
    u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(lower(text), chr(10)),
            string_split_regex(lower(text), '\\n[ \\t\\r]*\\n')), [lower(text)]))) AS unit FROM documents),
    w AS (SELECT doc_id, row_number() OVER () AS unit, regexp_extract_all(unit, '[a-z0-9]+') AS words FROM u),
    g AS (SELECT doc_id, unit, list_distinct(list_transform(list_zip(words[1:-2], words[2:]), lambda x: x[1] || ' ' || x[2])) AS grams
          FROM w WHERE len(words) > 1 AND len(words) < 200000),
    m AS (SELECT doc_id, unit, licence,
                 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
          FROM g JOIN t ON len(g.grams) <= 1.6 * len(t.grams) AND len(g.grams) >= 0.6 * len(t.grams))
    SELECT doc_id, licence, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM m WHERE dice >= {THRESHOLD}
    GROUP BY doc_id, licence"""


@query("op8_licences", _sql())
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
