"""Licence scans: sparse word n-gram logistic regression over paragraphs, with an unknown class and a template check."""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialised, spread_join

UNKNOWN = "unknown"
#: Bounds: features of the model (its table is broadcast), characters of a gram.
FEATURES, EPOCHS, TRAIN_COPIES, SEED = 4000, 30, 14, 11
#: A prediction counts if at least this share of a template's bigrams is in the line or paragraph, or of the paragraph's in a template.
CONFIRMED = 0.6
#: A paragraph's own share counts if it has this many different bigrams of the template.
OWN_BIGRAMS = 10

#: Sentences by which licence families are named or granted.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The software is provided as is, without warranty of any kind, express or implied",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the three clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior permission of the publisher.",
    ),
}
#: Sentences with words of licences that license nothing.
OTHERS = (
    "He lost his driving license and had to apply for a new copy.", "The new version of the program is faster than the old one.", "All of the people have rights and duties.",
    "She reserved a table for two and paid in general without a word.", "The public library is open to any person free of charge.", "The work of the foundation is known in the domain of software.",
    "Apache is the name of a people and of a helicopter.", "The creative director left a note with attribution to the commons.", "You may use the file if you obtain a key at the desk.",
    "The city granted permission to build the bridge.", "Students at the institute in Massachusetts study software.", "The license plate was found under the car.", "Terms of the contract were modified in writing last year.",
    "The above list shows the following conditions of the patients.", "The fishing license is valid until March.", "The international version of the film was released in May.", "Their source code was stolen and distributed.",
)
#: Words too common to tell anything alone; a gram needs another one.
COMMON = frozenset("a an and any are as at be by can copy for form free from had has have he if in is it its kind list new no not of on one or part people person she should that the their this to two use was were with without you your".split())


def words_of(text: str) -> list[str]:
    """Lower-case words of letters, digits and inner dots and hyphens; the same as _words()."""
    import re

    return [w for w in (x.strip(".-") for x in re.split(r"[^a-z0-9.-]+", text.lower())) if w]


def grams_of(words: list[str]) -> set[str]:
    return {w for w in words if w not in COMMON} | {f"{a} {b}" for a, b in zip(words, words[1:]) if not (a in COMMON and b in COMMON)}


@lru_cache(maxsize=1)
def model() -> dict:
    """families, weights {gram: [a weight for each family and unknown]}, bias, temperature, least (probability that counts).

    Softmax regression on variations of the templates (words dropped, neighbours added, cuts) against OTHERS, shuffled
    templates and mixed words, by stochastic gradient steps; temperature and threshold are set on variations held out.
    Deterministic; it takes about a second on the driver and reads no data.
    """
    draw = random.Random(SEED)
    families = [*TEMPLATES, UNKNOWN]
    neutral = [w for s in OTHERS for w in words_of(s)]
    samples = []
    for k, sentences in enumerate(TEMPLATES.values()):
        for sentence in sentences:
            words = words_of(sentence)
            for copy in range(TRAIN_COPIES):
                own = list(words)
                if copy and len(own) > 4 and draw.random() < 0.5:
                    del own[draw.randrange(len(own))]
                if copy and len(own) > 12 and draw.random() < 0.3:
                    own = own[: draw.randrange(10, len(own))]
                if copy and draw.random() < 0.6:
                    own = draw.choices(neutral, k=draw.randrange(1, 8)) + own + draw.choices(neutral, k=draw.randrange(0, 8))
                samples.append((sorted(grams_of(own)), k))
            for _ in range(2):
                own = list(words)
                draw.shuffle(own)
                if len(own) > 5:
                    samples.append((sorted(grams_of(draw.choices(neutral, k=4) + own[: len(own) // 2])), len(families) - 1))
    for sentence in OTHERS:
        for _ in range(4):
            own = words_of(sentence)
            samples.append((sorted(grams_of(own[draw.randrange(3) :] + draw.choices(neutral, k=4))), len(families) - 1))
    samples += [(sorted(grams_of(draw.choices(neutral, k=draw.randrange(3, 25)))), len(families) - 1) for _ in range(200)]
    draw.shuffle(samples)
    held, train = samples[::5], [s for i, s in enumerate(samples) if i % 5]
    weights: dict[str, list[float]] = {}
    bias = [0.0] * (len(families) - 1) + [2.0]  # what shows nothing is unknown
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + 0.2 * epoch)
        for grams, k in train:
            scale = 1 / math.sqrt(len(grams) or 1)
            p = _softmax(_logits(grams, weights, bias))
            for j in range(len(families)):
                step = rate * (p[j] - (j == k))
                if abs(step) > 1e-4:
                    for g in grams:
                        weights.setdefault(g, [0.0] * len(families))[j] -= step * scale
    kept = sorted(weights, key=lambda g: (-max(map(abs, weights[g])), g))[:FEATURES]
    weights = {g: [round(x, 5) for x in weights[g]] for g in sorted(kept)}
    logits = [(_logits(g, weights, bias), k) for g, k in held]
    temperature = min((0.25 * 1.25**i for i in range(14)), key=lambda t: sum(-math.log(max(_softmax([x / t for x in row])[k], 1e-12)) for row, k in logits))
    least, wrong = 0.5, [max(p[:-1]) for p, k in ((_softmax([x / temperature for x in row]), k) for row, k in logits) if k == len(families) - 1 or p.index(max(p)) != k]
    if wrong:
        least = min(0.9, max(least, sorted(wrong)[int(0.99 * (len(wrong) - 1))]))
    return {"families": families, "weights": weights, "bias": bias, "temperature": round(temperature, 6), "least": round(least, 6)}


def _logits(grams, weights, bias) -> list[float]:
    out = list(bias)
    for g in grams:
        if g in weights:
            for j, x in enumerate(weights[g]):
                out[j] += x
    return out


def _softmax(row: list[float]) -> list[float]:
    top = max(row)
    e = [math.exp(x - top) for x in row]
    return [x / sum(e) for x in e]


def _words(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), r"[^a-z0-9.-]+"), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    return F.filter(parts, lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _weights(spark: SparkSession, m: dict) -> DataFrame:
    """The model as a table (gram, w: an array), FEATURES rows at most, from a literal."""
    rows = json.dumps([{"gram": g, "w": w} for g, w in m["weights"].items()])
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<gram: string, w: array<double>>>")).alias("r")).select("r.gram", "r.w")


def lines(docs: DataFrame) -> DataFrame:
    """The lines of whole texts, split at newlines, that aren't blank: doc_id, pos (0 based line), paragraph."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    return split.where(F.trim("paragraph") != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs of whole texts, runs of lines with a letter or digit: doc_id, pos (0 based, the first line), paragraph."""
    split = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    split = split.withColumn("full", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    beside = lambda i, by: F.coalesce(F.get("full", i + by), F.lit(False))
    first = F.filter(at, lambda i: F.get("full", i) & ~beside(i, -1))
    last = F.filter(at, lambda i: F.get("full", i) & ~beside(i, 1))
    split = split.where("lines is not null").select("doc_id", "lines", F.explode(F.arrays_zip(first.alias("a"), last.alias("z"))).alias("r"))
    return split.select("doc_id", F.col("r.a").alias("pos"), F.array_join(F.slice("lines", F.col("r.a") + 1, F.col("r.z") - F.col("r.a") + 1), "\n").alias("paragraph"))


def classify(distinct: DataFrame, own_share: bool = False) -> DataFrame:
    """For distinct paragraphs (id, paragraph): id, family, probability of those that are in a licence family, confirmed by a template.

    Grams of the model are found by a broadcast join on the exploded grams (the table is bounded by FEATURES); sums of
    weights give calibrated probabilities. Of a predicted family some template must share enough bigrams: CONFIRMED of
    its own or, with `own_share`, of the paragraph's, if these are OWN_BIGRAMS or more.
    """
    m = model()
    n = len(m["families"])
    words = _words(F.col("paragraph"))
    rows = distinct.select("id", words.alias("words"))
    grams = rows.select("id", F.explode(F.array_distinct(F.concat(F.filter("words", lambda w: ~w.isin(*sorted(COMMON))), _bigrams(F.col("words"))))).alias("gram"))
    hit = grams.join(F.broadcast(_weights(distinct.sparkSession, m)), "gram")
    sums = hit.groupBy("id").agg(*[F.sum(F.get("w", F.lit(j))).alias(f"w{j}") for j in range(n)])
    scaled = [(F.col(f"w{j}") + F.lit(float(m["bias"][j]))) / F.lit(m["temperature"]) for j in range(n)]
    sums = sums.select("id", F.array(*scaled).alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    best = F.array_position(F.col("z"), F.col("top"))
    found = sums.select("id", best.cast("int").alias("best"), (1 / total).alias("probability")).where((F.col("best") < n) & (F.col("probability") >= m["least"]))
    bigrams = {k: [sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for w in map(words_of, t)] for k, t in TEMPLATES.items()}
    own = F.array_distinct(_bigrams(F.col("words")))

    def shares(template: list[str]) -> Column:
        both = F.size(F.array_intersect(own, F.array(*map(F.lit, template))))
        share = both / F.lit(len(template))
        return F.greatest(share, F.when(both >= OWN_BIGRAMS, both / F.size(own))) if own_share else share

    checks = F.array(*[F.greatest(*map(shares, bigrams[k]), F.lit(0.0)) for k in TEMPLATES])
    found = found.join(rows, "id").select("id", "best", "probability", F.get(checks, F.col("best") - 1).alias("confirmed"))
    names = F.array(*map(F.lit, m["families"]))
    return found.where(F.col("confirmed") >= CONFIRMED).select("id", F.get(names, F.col("best") - 1).alias("family"), "probability")


@lru_cache(maxsize=1)
def cues() -> tuple[str, ...]:
    """Words of which every confirmed paragraph holds one: neither CONFIRMED of a template's bigrams nor OWN_BIGRAMS of them can be had without them.

    Chosen greedily, the words of most templates first, until in each template the bigrams without a cue are fewer
    than CONFIRMED of all and than OWN_BIGRAMS.
    """
    templates = [{(a, b) for a, b in zip(w, w[1:])} for w in (words_of(s) for t in TEMPLATES.values() for s in t)]
    found: set[str] = set()
    open_ = lambda t: sum(not found & set(g) for g in t) >= min(CONFIRMED * len(t), OWN_BIGRAMS)
    while left := [t for t in templates if open_(t)]:
        bare = [[g for g in t if not found & set(g)] for t in left]
        words = {w for t in bare for g in t for w in g}
        found.add(max(sorted(words), key=lambda w: (w not in COMMON, sum(any(w in g for g in t) for t in bare), len(w))))
    return tuple(sorted(found))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_licences (lines and paragraphs in a licence family), families (distinct, by name, comma-joined), matches (pos:family, comma-joined).

    Each line of the whole text is classified, then what other lines each paragraph has, joined, so that wrapped
    licences are found; such a match is at the first of those lines, and not listed if a line of the paragraph has its
    family already. Text without any of cues() can't be confirmed, so it is unknown. Each distinct line or paragraph
    with one is classified once; one that many documents share costs no more than another.
    A null or empty text has none. Rows with one doc_id share their matches, each listed once. Equal probabilities go
    to the family first in TEMPLATES. Paragraphs of any length are read whole. Other columns aren't read.
    """
    def has_cue(text: Column) -> Column:
        # folded once: written out for each cue, a filter would fold the text as often as there are cues
        any_of = lambda folded: reduce(lambda found, w: found | folded.contains(w), cues(), F.lit(False))
        return F.get(F.transform(F.array(F.lower(text)), any_of), F.lit(0))

    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    docs_with = materialised(docs.where(has_cue(F.col("text"))).select("doc_id", "text"), "licence-texts")
    rows = lines(docs_with).where(has_cue(F.col("paragraph")))
    rows = materialised(rows.withColumn("id", digest(F.col("paragraph"))), "licence-lines")
    distinct = rows.groupBy("id", "paragraph").agg(F.count("*").alias("n"))
    found = materialised(classify(distinct.select("id", "paragraph")).join(distinct.select("id", "n"), "id"), "licences")
    total = rows.count()
    met = spread_join(rows.select("doc_id", "pos", "id"), found.select("id", "family", "n"), "id", "n", total, ["doc_id", "pos"])

    whole = paragraphs(docs_with).where(has_cue(F.col("paragraph")))
    whole = materialised(whole.withColumn("key", digest(F.col("paragraph"))), "licence-paragraphs")
    each = whole.groupBy("key", "paragraph").agg(F.count("*").alias("n"))
    sizes = each.select("key", "n")
    parts = each.select("key", F.posexplode(F.split("paragraph", "\n")).alias("at", "line")).withColumn("id", digest(F.col("line")))
    parts = spread_join(parts, found.select("id", "family", "n"), "id", "n", total, ["key", "at"], "left")
    rest = F.array_sort(F.collect_list(F.when(F.col("family").isNull(), F.struct("at", "line"))))
    parts = parts.groupBy("key").agg(F.collect_set("family").alias("named"), rest.alias("rest")).where(F.size("rest") > 0)
    parts = parts.select("key", "named", F.get("rest", F.lit(0))["at"].alias("at"), F.array_join(F.col("rest.line"), "\n").alias("paragraph"))
    parts = materialised(parts.where(has_cue(F.col("paragraph"))), "licence-rests")
    joined = classify(parts.select(F.col("key").alias("id"), "paragraph"), own_share=True).withColumnRenamed("id", "key")
    joined = joined.join(parts.select("key", "named", "at"), "key").where(~F.array_contains("named", F.col("family"))).join(sizes, "key")
    joined = materialised(joined.select("key", "at", "family", "n"), "licence-joined")
    wrapped = spread_join(whole.select("doc_id", "pos", "key"), joined, "key", "n", whole.count(), ["doc_id", "pos"])
    met = met.select("doc_id", "pos", "family").unionByName(wrapped.select("doc_id", (F.col("pos") + F.col("at")).alias("pos"), "family"))
    one = F.array_sort(F.collect_set(F.struct("pos", "family")))
    by = met.groupBy("doc_id").agg(one.alias("m")).withColumnRenamed("doc_id", "m_id")
    out = docs.select("doc_id").join(by, F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    listed = F.coalesce("m", F.array().cast("array<struct<pos: int, family: string>>"))
    return out.select(
        "doc_id", F.size(listed).cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform(listed, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["pos"].cast("string"), x["family"])), ",").alias("matches"),
    )
