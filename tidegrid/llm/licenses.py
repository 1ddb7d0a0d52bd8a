"""License notices: minhash bands of overlapping word windows retrieve
templates, shingle containment verifies them. DataFrame functions only.

Templates fall into classes by length; a class with windows of `size` words
every 3/8 of that holds each template of up to 5/8 of it whole in some window.
Such a window and its template are similar by 0.16 at least (0.13 where a fifth
of the template's shingles is altered). BANDS bands of one minhash each then
collide with a probability of 1 - (1 - 0.13) ** 96, all but two in a million.

A window that holds no shingle of any template can't share a minhash with one,
so those are left out beforehand, as are documents without any of the words
that every template shingle has at least one of; neither loses a match.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS, SMALLEST = 5, 0.8, 96, 8

#: Notices by which public licenses ask to be named.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Reserved": "All rights reserved.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: A word: ASCII letters and digits and all beyond ASCII, in lower case.
GAP = "[\\x00-/:-`{-\\x7f]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of the runs of n words; of fewer words, one of them all."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))
    return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<long>"))


def bands(sh: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, j))))


def class_of(n_words: int) -> int:
    """Window size of a template of n_words."""
    return max(SMALLEST, 1 << math.ceil(math.log2(n_words * 8 / 5)))


def stride(size: int) -> int:
    return size * 3 // 8


def template_table(spark: SparkSession, templates: dict[str, str], n: int = SHINGLE) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()])
    t = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", words(F.col("t.text")).alias("w"))
    return t.select("template", "w", F.array_distinct(shingles(F.col("w"), n)).alias("template_shingles"))


def gate_words(shingled: list[list[str]]) -> list[list[str]]:
    """Lists of words; every shingle has all words of one of the lists. One long
    word (of five letters or more) if there is any, chosen to serve as many
    shingles as it can; all words of a shingle that has only short ones."""
    left, out = [set(s) for s in shingled], []
    while left:
        long = sorted({w for s in left for w in s if len(w) >= 5})
        out.append([max(long, key=lambda w: (sum(w in s for s in left), len(w)))] if long else sorted(left[0]))
        left = [s for s in left if not s.issuperset(out[-1])]
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document id and template found: doc_id, template,
    containment (the largest share of the template's shingles in one window),
    n_windows that verify, and first_word (0-based) of the first of them.

    Punctuation and case don't count. A null or blank text holds nothing; rows
    of one id, null included, count as one document. A template of fewer than
    SHINGLE words is one shingle of its own length, and those of each length are
    looked for with shingles of that length; one without words raises an error.
    The templates are a parameter of fixed size: their table is the only thing
    broadcast."""
    n_words = {k: int(r) for k, r in template_table(docs.sparkSession, templates).select("template", F.size("w")).collect()}
    if blank := [k for k, n in n_words.items() if n == 0]:
        raise ValueError(f"templates without words: {blank}")
    by_length: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        by_length.setdefault(min(SHINGLE, n_words[name]), {})[name] = text
    return reduce(DataFrame.unionAll, [_scan(docs, some, n, id_col, text_col, containment) for n, some in sorted(by_length.items())])


def _scan(docs: DataFrame, templates: dict[str, str], n: int, id_col: str, text_col: str, containment: float) -> DataFrame:
    """scan() of templates that all have shingles of n words."""
    table = template_table(docs.sparkSession, templates, n)
    known = {r["template"]: (r["w"], r["template_shingles"]) for r in table.collect()}
    size_of = F.create_map(*[F.lit(x) for k, (w, _) in known.items() for x in (k, class_of(len(w)))])
    table = table.withColumn("size", size_of[F.col("template")])
    sizes = sorted({class_of(len(w)) for w, _ in known.values()})
    wanted = sorted({s for _, sh in known.values() for s in sh})
    gate = gate_words([w[i : i + n] for w, _ in known.values() for i in range(len(w) - n + 1)])

    text = F.lower(F.col(text_col))
    some = F.lit(False)
    for each in gate:
        some = some | reduce(and_, [F.contains(text, F.lit(word)) for word in each])
    w = docs.where(some).select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    sh = w.select("doc_id", shingles(F.col("w"), n).alias("sh"))
    at = F.filter(F.transform("sh", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    hit = sh.withColumn("at", at)

    def windows(i: Column, size: int) -> Column:
        """Windows whose shingles include the one at i."""
        step = stride(size)
        low = F.greatest(F.lit(0), F.ceil((i - (size - n)) / F.lit(step)).cast("int"))
        return F.transform(F.sequence(low, F.floor(i / F.lit(step)).cast("int")), lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("begin")))

    around = F.array_distinct(F.flatten(F.transform("at", lambda i: F.flatten(F.array(*[windows(i, s) for s in sizes])))))
    # A filter here would be pushed down with the expressions that make the
    # arrays, and evaluate them for each element: explode_outer infers none.
    win = hit.select("doc_id", "sh", F.explode_outer(around).alias("x")).select("doc_id", "x.size", "x.begin", F.slice("sh", F.col("x.begin") + 1, F.col("x.size") - n + 1).alias("held"))
    keys = F.posexplode(bands(F.col("held"))).alias("band", "value")
    own = F.posexplode(bands(F.col("template_shingles"))).alias("band", "value")
    met = win.select("doc_id", "size", "begin", "held", keys).join(F.broadcast(table.select("template", "size", "template_shingles", own)), ["size", "band", "value"])
    found = met.groupBy("doc_id", "size", "begin", "template").agg(F.first("held").alias("held"), F.first("template_shingles").alias("template_shingles"))
    share = F.size(F.array_intersect("held", "template_shingles")) / F.size("template_shingles")
    good = found.withColumn("share", share).where(F.col("share") >= containment)
    return good.groupBy("doc_id", "template").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("begin").cast("long").alias("first_word")).withColumnRenamed("doc_id", id_col)
