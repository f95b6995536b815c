"""Licence notices in texts by Dice coefficient over word bigrams, in DataFrame functions only.

Every line of a text, and the text as a whole, is normalised (lower case, runs
of anything but letters and digits become one blank) and compared with licence
templates.  Two sets of a and b bigrams reach Dice t only if a lies between
t / (2 - t) times b and its inverse, so a count of words rules out most
templates before a bigram is made.  And a text that reaches t with a template
has at least t / (2 - t) of the template's bigrams: it can't lack all of a few
words that more than the rest of the bigrams hold.  Texts and lines without any
such word go first.  Hits are few; only they are shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80
#: Notices of common public licences (SPDX name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams_of(text: str) -> list[str]:
    ws = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(ws, ws[1:])})


def telling_words(grams: list[str], percent: int) -> set[str]:
    """Words of which a text that reaches the threshold has at least one: long ones, of those alike the ones with few vowels, until they hold enough bigrams."""
    may_lack = len(grams) - -(-len(grams) * percent // (200 - percent))
    chosen: set[str] = set()
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), sum(map(w.count, "aeiouy")), w)):
        if sum(1 for g in grams if chosen & set(g.split())) > may_lack:
            break
        chosen.add(w)
    return chosen


def bigrams(ws: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Licence notices of every text: ``doc_id, line, license, score`` of each hit.

    ``line`` counts from 0; -1 is the whole text, tried if it has several
    lines.  ``score`` is the Dice coefficient, at least ``percent`` hundredths;
    a line counts once for each licence, by its best template.  Null and empty
    texts and texts of one word have no hits; repeated rows have theirs each,
    and since hits carry no more than the id, rows of one id look like one
    document; empty tables and further columns are fine."""
    grams = [(name, bigrams_of(text)) for name, text in templates]
    low = min(len(g) for _, g in grams) * percent // (200 - percent)
    high = max(len(g) for _, g in grams) * (200 - percent) // percent + 1
    telling = sorted(set().union(*(telling_words(g, percent) for _, g in grams)))

    def may_hit(text: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in telling))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.where(may_hit(text)).select(F.col(id_col).alias("doc_id"), F.split(text, "\n").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line"), F.array_join("lines", " ").alias("t")))).otherwise(F.array().cast("array<struct<line:int,t:string>>"))
    units = rows.select("doc_id", F.explode(F.concat(F.transform("lines", lambda t, i: F.struct(i.alias("line"), t.alias("t"))), whole)).alias("u")).select("doc_id", "u.line", "u.t").where(may_hit(F.col("t")))
    # Each explode of one value keeps what stands below from being computed again for every use above.
    ws = F.split(F.trim(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " ")), " ")
    units = units.select("doc_id", "line", F.explode(F.array(ws)).alias("ws")).where(F.size("ws") > low)
    units = units.select("doc_id", "line", F.explode(F.array(bigrams(F.col("ws")))).alias("g")).where(F.size("g").between(low, high))
    scores = []
    for name, g in grams:
        n = F.size("g")
        fits = (n * (200 - percent) >= percent * len(g)) & (n * percent <= (200 - percent) * len(g))
        both = F.size(F.array_intersect("g", F.array(*map(F.lit, g))))
        score = F.when(fits, 2.0 * both / (n + len(g)))  # only texts of a fitting size are compared
        scores.append(F.struct(F.lit(name).alias("license"), F.when(score * 100 >= percent, score).alias("score")))
    hits = units.select("doc_id", "line", F.explode(F.array(*scores)).alias("s")).where("s.score is not null")
    return hits.groupBy("doc_id", "line", F.col("s.license").alias("license")).agg(F.max("s.score").alias("score"))


def per_document(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_hits, license, score, line`` for every row: its best hit (then the first licence, then line), nulls without one."""
    best = hits.groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("low"), "license", "line")).alias("b"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(best, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"), F.col("b.license").alias("license"), (-F.col("b.low")).alias("score"), F.col("b.line").cast("int").alias("line"))


def oracle(templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    """The query in SQL, templates written in."""
    rows = ", ".join("(%d, '%s', [%s])" % (i, name, ", ".join("'%s'" % g for g in bigrams_of(text))) for i, (name, text) in enumerate(templates))
    return rf"""
WITH t(k, license, tg) AS (VALUES {rows}),
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM l
      UNION ALL SELECT doc_id, -1, array_to_string(ls, ' ') FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM u),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, line, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS score
      FROM g JOIN t ON len(g) * {200 - percent} >= {percent} * len(tg) AND len(g) * {percent} <= {200 - percent} * len(tg)),
h AS (SELECT doc_id, line, license, max(score) AS score FROM s WHERE score * 100 >= {percent} GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line) AS rn FROM h)
SELECT d.doc_id, coalesce(b.n, 0) AS n_hits, b.license, b.score, CAST(b.line AS INTEGER) AS line
FROM documents d LEFT JOIN b ON b.rn = 1 AND b.doc_id = d.doc_id
"""
