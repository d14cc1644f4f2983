"""Licence scans: a paragraph classifier whose predictions templates confirm.

A paragraph is a run of lines up to a blank line or a line that ends a sentence, so that a notice that
is wrapped is one again. Where a paragraph of several lines gives no licence, its lines are judged by
themselves. A paragraph becomes the set of its word 1-, 2- and 3-grams; a softmax regression with sparse
weights over the grams of the training texts gives each licence family, and the class ``unknown``, a
probability. A temperature calibrates them: it is fitted to the probabilities that each training text
gets from weights trained without it, a fold of the texts at a time. A family counts if its calibrated probability is PROBABLE or more and one of its
templates shares ALIKE of its 2-grams, or of the paragraph's if those are fewer, with the paragraph.

The model is trained on the driver, on the fixed texts below and nothing else. The scan is DataFrame
functions. The 2-grams of every paragraph are compared with the templates', which is narrow; one that
shares too few with each template can't be confirmed, whatever its probabilities, so only the others are
exploded into grams. Equal ones are judged once. These meet the weights in a broadcast join, as their table has a size fixed by the texts below.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

#: Notices of licence families, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "This project is released under the Apache License 2.0. SPDX-License-Identifier: Apache-2.0",
        "Licensed under Apache 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is licensed under the terms of the MIT license. SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL version 2. SPDX-License-Identifier: GPL-2.0-only GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License. SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one. Licensed under the Mozilla Public License, Version 2.0. SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Sentences, most with anchor words, that give no licence.
OTHERS = [
    "He lost his driving licence after the accident.", "The licence fee rose again this year.", "She asked for permission to leave the room.", "Permission to land was refused.", "The warranty covers parts for two years.",
    "A copyright dispute between the two singers went to court.", "The restaurant has no licence to serve wine.", "License plates were stolen in the night.", "The public domain of the state includes forests.", "Fishing is permitted with a licence only.",
    "The office issues licences for hunting and fishing.", "They redistribute food to people in need.", "The bill would redistribute income and licence taxes.", "Licensed electricians and plumbers are in demand.", "A licensed guide leads the tour.",
    "The terms of the contract were not disclosed.", "The general public was invited to the party.", "The apache helicopter landed.", "MIT professors signed the letter about copyright.", "The foundation was founded in 1985 and has a licence.",
    "Please read the licence.", "Which licence applies is not known.", "The licence of this text is unclear.", "Ask the author for permission.", "Copyright law is hard.", "All rights come with duties.",
    "Under the terms of the treaty both sides withdraw.",
]
#: Words of licence notices; paragraphs with one are counted, others are judged all the same.
ANCHORS = r"(?i)licen[cs]|copyright|permission|redistribut|warrant|all rights reserved|unauthorized copying|public domain|creative commons|cc0|mpl|spdx"
UNKNOWN = "unknown"
#: Least calibrated probability and share of common 2-grams.
PROBABLE, ALIKE = 0.5, 0.6
#: Penalty, steps and rate of the training.
PENALTY, STEPS, RATE = 1e-3, 400, 2.0
#: Parts of the training texts that are left out in turn for the temperature.
FOLDS = 4
#: Where a paragraph ends: after a line that ends a sentence, and at blank lines.
PARAGRAPH_END = r"(?<=[.!?:;])[ \t]*[\r\n]+|\R[ \t]*\R\s*"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regress(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the softmax regression; every class weighs the same."""
    weigh = 1 / y.sum(0)[y.argmax(1)]
    weigh = (weigh / weigh.sum())[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(STEPS):
        gap = (soft(x @ w + b) - y) * weigh
        w -= RATE * (x.T @ gap + PENALTY * w)
        b -= RATE * gap.sum(0)
    w[np.abs(w) < 1e-3] = 0
    return w, b


@lru_cache(maxsize=1)
def train() -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Classes, grams, weights (a row per gram) and intercepts, divided by the temperature."""
    classes = [*TEMPLATES, UNKNOWN]
    texts = [(t, c) for c, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in OTHERS]
    # besides each text its first two thirds, as lines break anywhere; both are in one fold
    found, fold = [], []
    for i, (text, c) in enumerate(texts):
        w = words_of(text)
        parts = [w, w[: 2 * len(w) // 3]] if len(w) >= 12 else [w]
        found += [(p, c) for p in parts]
        fold += [i % FOLDS] * len(parts)
    grams = sorted(set().union(*(grams_of(w) for w, _ in found)))
    at = {g: i for i, g in enumerate(grams)}
    x, y, fold = np.zeros((len(found), len(grams))), np.zeros((len(found), len(classes))), np.array(fold)
    for i, (w, c) in enumerate(found):
        x[i, [at[g] for g in grams_of(w)]] = 1
        y[i, classes.index(c)] = 1
    unseen = np.zeros_like(y)
    for f in range(FOLDS):
        w, b = regress(x[fold != f], y[fold != f])
        unseen[fold == f] = x[fold == f] @ w + b
    loss = lambda t: -np.log((soft(unseen / t) * y).sum(1) + 1e-12).mean()
    t = min((0.25 * 1.15**i for i in range(30)), key=loss)
    w, b = regress(x, y)
    return classes, grams, w / t, b / t


def words_in(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^a-z0-9]+"), lambda w: w != "")


def grams_in(words: Column, sizes: tuple[int, ...]) -> Column:
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.when(i + (n - 1) <= F.size(words), F.array_join(F.slice(words, i, n), " ")))
    return F.array_compact(F.array_distinct(F.concat(*(one(n) for n in sizes))))


def two_grams_of(text: str) -> list[str]:
    return sorted(g for g in grams_of(words_of(text)) if g.count(" ") == 1)


def confirmable(line: Column) -> Column:
    """Whether a template of any family shares ALIKE of its 2-grams, or of the line's if those are fewer, with the line."""
    templates = [two_grams_of(t) for ts in TEMPLATES.values() for t in ts]
    array = lambda gs: F.array(*(F.lit(g) for g in gs))
    least = min(map(len, templates))

    def enough(x: Column) -> Column:
        each = (F.size(F.array_intersect(array(gs), x["both"])) >= ALIKE * F.least(x["own"], F.lit(float(len(gs)))) for gs in templates)
        # what even the shortest template asks for comes first, as few lines share it
        return F.when(F.size(x["both"]) >= F.greatest(F.lit(1.0), ALIKE * F.least(x["own"], F.lit(float(least)))), reduce(or_, each)).otherwise(False)

    # each step as one value, so that no later one applies it again
    words = F.array(words_in(line))
    two = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))))
    shared = F.transform(two, lambda g: F.struct(F.array_intersect(g, array(sorted(set().union(*templates)))).alias("both"), F.size(g).alias("own")))
    return F.exists(shared, enough)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_anchored, n_licensed, licenses (families, sorted, comma-joined), top_probability.

    n_licensed counts pairs of a paragraph, or line, and a family that it gives; n_anchored counts
    paragraphs with a word of notices and decides nothing. Of families that tie the first in the order of
    the training texts is predicted. A null text counts as empty: no paragraphs, no licences, a null
    top_probability. Paragraphs of any length are judged whole. Rows that share id and text give one row each with equal values; an empty table gives no rows; only the two
    columns named are read.
    """
    spark = docs.sparkSession
    classes, grams, weights, intercepts = train()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = lambda parts: F.filter(parts, lambda x: F.length(F.trim(x)) > 0)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), full(F.split(text, PARAGRAPH_END)).alias("parts"))
    # a paragraph as itself, then its lines, where it has several
    alone = lambda x, i: F.array(F.struct(i.alias("part"), F.lit(False).alias("is_line"), x.alias("line")))
    lines = lambda x, i: F.transform(full(F.split(x, r"[\r\n]+")), lambda l: F.struct(i.alias("part"), F.lit(True).alias("is_line"), l.alias("line")))
    units = F.flatten(F.transform("parts", lambda x, i: F.when(F.trim(x).rlike(r"[\r\n]"), F.concat(alone(x, i), lines(x, i))).otherwise(alone(x, i))))
    n_anchored = F.size(F.filter("parts", lambda x: x.rlike(ANCHORS))).cast("bigint")
    rows = rows.select("doc_id", F.size("parts").cast("bigint").alias("n_paragraphs"), n_anchored.alias("n_anchored"), F.filter(units, lambda u: confirmable(u["line"])).alias("alike"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "alike")  # numbered once for all that follows
    # what is like a template is short of all text; what is equal is judged once
    found = rows.select(F.explode("alike.line").alias("line")).distinct().withColumn("words", words_in(F.col("line"))).withColumn("grams", grams_in(F.col("words"), (1, 2, 3)))
    model = F.broadcast(spark.createDataFrame([(g, [float(v) for v in weights[i]]) for i, g in enumerate(grams) if weights[i].any()], "gram string, w array<double>"))
    sums = [F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + float(intercepts[k]) for k in range(len(classes))]
    scores = found.select("line", F.explode_outer("grams").alias("gram")).join(model, "gram", "left").groupBy("line").agg(F.array(*sums).alias("s"))
    largest = F.array_max("s")
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x - largest))
    best = scores.select("line", (1 / total).alias("p"), F.element_at(F.array(*(F.lit(c) for c in classes)), F.array_position("s", largest).cast("int")).alias("family")).where((F.col("family") != UNKNOWN) & (F.col("p") >= PROBABLE))
    templates = [(f, f"{f}-{i}", g, float(len(gs))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for gs in [two_grams_of(t)] for g in gs]
    templates = F.broadcast(spark.createDataFrame(templates, "family string, template string, gram string, size double"))
    pairs = best.withColumn("words", words_in(F.col("line"))).withColumn("grams", grams_in(F.col("words"), (2,))).select("line", "p", "family", F.size("grams").alias("own"), F.explode("grams").alias("gram"))
    alike = pairs.join(templates, ["family", "gram"]).groupBy("line", "p", "family", "template", "own", "size").agg(F.count("*").alias("both")).where(F.col("both") >= ALIKE * F.least("own", "size"))
    judged = alike.groupBy("line", "family").agg(F.max("p").alias("p"))
    # back to the documents, as far as they hold a judged one; a sort-merge join, where it is one, splits a line that is everywhere
    hits = rows.where(F.size("alike") > 0).select("row", F.inline("alike")).join(judged, "line")
    # a paragraph that gives a licence decides for its lines
    hits = hits.groupBy("row", "part").agg(F.min("is_line").alias("by_lines"), *(F.collect_list(F.when(F.col("is_line") == of, F.struct("family", "p"))).alias(n) for of, n in ((False, "whole"), (True, "lines"))))
    hits = hits.select("row", F.explode(F.when(F.col("by_lines"), F.col("lines")).otherwise(F.col("whole"))).alias("hit")).select("row", "hit.*")
    hits = hits.groupBy("row").agg(F.count("*").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"), F.round(F.max("p"), 6).alias("top_probability"))
    return rows.join(hits, "row", "left").select("doc_id", "n_paragraphs", "n_anchored", F.coalesce("n_licensed", F.lit(0).cast("bigint")).alias("n_licensed"), F.coalesce("licenses", F.lit("")).alias("licenses"), "top_probability")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
