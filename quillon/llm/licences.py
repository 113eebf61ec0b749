"""Licence scans: a trained paragraph classifier, in DataFrame operations alone.

A paragraph is a line, or a notice that its lines wrap: the words of every block of consecutive lines that are not blank are
also read in windows of 16, 32 and 48 words, each half over the next, so that a notice of up to 25 words lies in one of them
wherever lines end. A paragraph's features are the word pairs and single words that occur in the training paragraphs; a
multinomial logistic regression over them (sparse: what a paragraph lacks adds nothing) gives each licence family and the
class unknown a probability. The unknown class is trained on near misses, among them names with a foreign word inside; a
temperature and the unknown class's bias are fitted on variants held out from training, so that probabilities are calibrated.

A predicted family is confirmed when the paragraph holds enough of the distinct word pairs of one of the family's templates,
all pairs of the name in it (so ``GNU Affero General`` is no ``GNU General``), and no negation before a licensing verb. A
confirmed paragraph therefore has one of a few marker words, a word of each name, and only paragraphs that have one are read;
the families found are the same without that filter. Windows count only if they are confirmed; of windows that overlap, those
of the family with the largest containment stand. A wrapped notice counts once a block and family, and not where a line of its
block is confirmed for the family. Training uses the templates below alone, a fixed and small set, with words dropped by rule.

Weights are a few thousand numbers whatever the corpus, and are broadcast. A paragraph's words meet them in one join.

Cases. Null or empty text has no paragraph with words and no licence. Repeated rows give equal rows. Long texts are read
whole. An empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.decontaminate import _words, lowered

CONFIDENT, CONFIRMED = 0.6, 0.6
#: Words of the windows over a block; the largest holds any template at a step of half its size.
WINDOWS = (16, 32, 48)
UNKNOWN = "unknown"

# Usual notices of each licence family, the name between bars.
NOTICES = {
    "agpl": ["Licensed under the |GNU Affero General Public License|, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the |GNU Affero General Public License|.", "Licensed under |the AGPL|, version 3 or later.", "SPDX-|License-Identifier: AGPL|-3.0-only"],
    "apache-2.0": ["Licensed under the |Apache License|, Version 2.0.", "Licensed under the |Apache License|, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is released under the |Apache 2.0 license|.", "SPDX-|License-Identifier: Apache|-2.0"],
    "bsd": ["|Redistribution and use in source and binary forms|, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the |BSD 3-Clause License|.", "Use of this source code is governed by a |BSD-style license|.", "SPDX-|License-Identifier: BSD|-3-Clause"],
    "bsl": ["Distributed under the |Boost Software License|, Version 1.0.", "Use, modification and distribution are subject to the |Boost Software License|.", "SPDX-|License-Identifier: BSL|-1.0"],
    "cc-by": ["Licensed under |CC BY 4|.0.", "This work is licensed under a |Creative Commons Attribution 4|.0 International License.", "Licensed under |CC BY-SA 4|.0.", "SPDX-License-|Identifier: CC-BY-4|.0"],
    "cc-by-nc": ["Licensed under |CC BY-NC| 4.0.", "This work is licensed under a |Creative Commons Attribution-NonCommercial| 4.0 International License.", "SPDX-License-|Identifier: CC-BY-NC|-4.0"],
    "cc0": ["This work is dedicated to the public domain under |CC0 1|.0 Universal.", "To the extent possible under law, the author has waived all copyright under |CC0 1|.0.", "SPDX-License-|Identifier: CC0-1|.0"],
    "epl": ["Licensed under the |Eclipse Public License|, version 2.0.", "This program is made available under the terms of the |Eclipse Public License|.", "SPDX-|License-Identifier: EPL|-2.0"],
    "gpl": ["This work is licensed under the |GNU General Public License|, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the |GNU General Public License|.", "Licensed under |the GPL|, version 2 or later.", "SPDX-|License-Identifier: GPL|-3.0-or-later"],
    "isc": ["Licensed under the |ISC License|.", "|Permission to use, copy, modify, and/or distribute this software| for any purpose with or without fee is hereby granted.", "SPDX-|License-Identifier: ISC|"],
    "lgpl": ["Licensed under the |GNU Lesser General Public License|, version 3.", "This library is free software; you can redistribute it under the terms of the |GNU Lesser General Public License|.", "Licensed under |the LGPL|, version 2.1 or later.", "SPDX-|License-Identifier: LGPL|-2.1-only"],
    "mit": ["Released under the |MIT License|.", "Licensed under the |MIT License|.", "|Permission is hereby granted, free of charge|, to any person obtaining a copy of this software and associated documentation files.", "SPDX-|License-Identifier: MIT|"],
    "mpl": ["This Source Code Form is subject to the terms of the |Mozilla Public License|, v. 2.0.", "Licensed under the |Mozilla Public License|, version 2.0.", "SPDX-|License-Identifier: MPL|-2.0"],
    "unlicense": ["This is |free and unencumbered software| released into the public domain.", "Released under |the Unlicense|."],
}
TEMPLATES = {family: [t.replace("|", "") for t in texts] for family, texts in NOTICES.items()}

# Near misses of the class unknown, and words that negate a licence or grant it.
OTHERS = ["A driving license was released by the office under version rules.", "The work is under way and the public is free to use it.", "This is the version of the terms that you may not modify.", "He was released under the general terms.", "The source of the file is the following.", "The license fee is due.", "Copyright and all rights reserved.", "She has a general license to use the public path.", "Permission is granted to no person.", "All of this software is for you.", "Licensed under the Acme General Public License, version 3.", "Licensed under the Example License, Version 2.0.", "Released under the house license.", "This program is made available under the terms of the Example Public License.", "Distributed under a commercial software license.", "SPDX-License-Identifier: Proprietary", "The license of the road is free for the public domain."]
NEGATIVE = ["never", "not", "no", "neither", "nor", "cannot"]
GRANTING = ["licensed", "released", "distributed", "available", "granted", "covered", "governed"]


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _grams(words: list[str]) -> set[tuple[str, str]]:
    return {(w, "") for w in words} | set(zip(words, words[1:], strict=False))


@lru_cache(1)
def trained() -> tuple[list[str], dict[tuple[str, str], list[float]], list[float]]:
    """Families (the last is unknown), weights by gram, biases."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows: list[tuple[set, int]] = []
    for k, family in enumerate(families):
        for text in TEMPLATES.get(family, OTHERS):
            words = _tokens(text)
            rows.append((_grams(words), k))
            rows += [(_grams(words[:i] + words[i + 1 :]), k) for i in range(0, len(words), 2) if len(words) > 4]
    rows += [(set(), len(families) - 1)] * 20
    grams = sorted(set().union(*(g for g, _ in rows)))
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1))
    x[:, -1] = 1
    for i, (own, _) in enumerate(rows):
        x[i, [place[g] for g in own]] = 1
    y = np.eye(len(families))[[k for _, k in rows]]
    weigh = 1 / y.sum(0)[[k for _, k in rows]]
    w, speed = np.zeros((x.shape[1], len(families))), 0.0
    for _ in range(800):  # gradient descent with momentum
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.05 * (x.T @ ((p - y) * weigh[:, None]) + 2e-3 * w)
        w = w + speed
    w = np.round(w, 6)
    # calibration: variants with a word changed in each odd place, which training never drops
    held = [(_grams([*words[:i], "\0", *words[i + 1 :]]), k) for k, family in enumerate(families) for words in map(_tokens, TEMPLATES.get(family, OTHERS)) for i in range(1, len(words), 2)]
    z = np.array([sum((w[place[g]] for g in own if g in place), w[-1].copy()) for own, _ in held])
    of, weigh = np.array([k for _, k in held]), 1 / np.bincount([k for _, k in held])[[k for _, k in held]]
    best = (np.inf, 1.0, 0.0)
    for heat in np.geomspace(0.25, 4, 25):
        for shift in np.linspace(-2, 2, 17):
            x = z / heat
            x[:, -1] += shift
            loss = (weigh * (np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[np.arange(len(x)), of])).sum()
            best = min(best, (float(loss), float(heat), float(shift)))
    w = np.round(w / best[1], 6)
    w[-1, -1] = round(w[-1, -1] + best[2], 6)
    return families, {g: w[i].tolist() for g, i in place.items()}, w[-1].tolist()


def named(notice: str) -> tuple[list[str], list[str]]:
    """The words of a notice and those of the name in it."""
    return _tokens(notice.replace("|", "")), _tokens(notice.split("|")[1])


@lru_cache(1)
def markers() -> list[str]:
    """A word of every name: what is confirmed has one of them."""
    usual = ["license", "gnu", "redistribution", "identifier", "creative", "permission", "unencumbered", "gpl", "lgpl", "agpl", "cc", "cc0"]
    names = [named(t)[1] for texts in NOTICES.values() for t in texts]
    return sorted({next((w for w in usual if w in name), None) or max(name, key=lambda w: (len(w), w)) for name in names})


def _array(values, kind: str) -> str:
    return f"cast(array({', '.join(map(str, values))}) as array<{kind}>)"


def _place(kind: int, at: Column) -> Column:
    return (F.lit(kind << 30).cast("long") + F.col("block")) * F.lit(1 << 31) + at


def _window(kind: int, size: int):
    return lambda i: F.struct(_place(kind, i).alias("paragraph"), F.slice("own", i + 1, F.lit(size)).alias("words"))


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, block, line, family, probability, containment, confirmed) of every paragraph that a family is predicted
    for; line is its number in the block, null for a notice over several lines."""
    spark = docs.sparkSession
    families, weights, bias = trained()
    grams = sorted(weights)
    number = {g: i for i, g in enumerate(grams)}
    quoted = lambda s: "'" + s + "'"  # noqa: E731  words hold neither quotes nor backslashes
    table = F.broadcast(spark.sql("select * from values " + ", ".join(f"({quoted(a)}, {quoted(b)}, {number[a, b]}, {_array(weights[a, b], 'double')})" for a, b in grams) + " as t(first, second, gram, weight)"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blocks = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.posexplode_outer(F.split(text, r"\n[\x20\x09-\x0D]*\n")).alias("block", "body"))
    # one number says it all: which window (0: a line), the block, and the line of the block or the window's first word
    marked = F.array(*map(F.lit, markers()))
    held = F.rlike(lowered(F.col("body")), F.lit("|".join(markers())))
    blocks = blocks.where(held).withColumn("own", _words(lowered(F.col("body")))).where(F.arrays_overlap("own", marked))
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(_place(0, i).alias("paragraph"), _words(lowered(x)).alias("words")))
    parts = [F.filter(lines, lambda x: F.arrays_overlap(x["words"], marked))]
    for k, size in enumerate(WINDOWS, 1):
        starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(size // 2))
        cut = F.transform(starts, _window(k, size))
        parts.append(F.filter(cut, lambda x: F.arrays_overlap(x["words"], marked)))
    denied = F.exists(F.sequence(F.lit(1), F.size("words")), lambda i: F.get(F.col("words"), i - 1).isin(*NEGATIVE) & F.arrays_overlap(F.slice("words", i + 1, F.lit(3)), F.array(*map(F.lit, GRANTING))))
    words = blocks.select("id", "h", F.explode(F.concat(*parts)).alias("x")).select("id", "h", "x.paragraph", "x.words").select("id", "h", "paragraph", "words", denied.alias("denied"))
    words = words.select("id", "h", "paragraph", "words", "denied", F.posexplode("words").alias("pos", "word"))
    follows = F.when(F.col("pos") + 1 < F.size("words"), F.element_at("words", F.col("pos") + 2))
    met = words.join(table, (F.col("word") == F.col("first")) & ((F.col("second") == "") | (F.col("second") == follows))).select("id", "h", "paragraph", "denied", "gram", "weight")
    # a gram counts once in a paragraph
    once = met.groupBy("id", "h", "paragraph", "denied", "gram").agg(F.first("weight").alias("weight"))
    sums = [F.sum(F.col("weight")[k]).alias(f"z{k}") for k in range(len(families))]
    scored = once.groupBy("id", "h", "paragraph", "denied").agg(F.collect_set("gram").alias("grams"), *sums)
    z = [F.col(f"z{k}") + bias[k] for k in range(len(families))]
    top = F.greatest(*z)
    total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    best = F.coalesce(*[F.when(v == top, F.lit(f)) for v, f in zip(z, families, strict=True)])
    out = scored.select("id", "h", "paragraph", "denied", "grams", best.alias("family"), (1 / total).alias("probability"))
    out = out.where((F.col("family") != UNKNOWN) & (F.col("probability") >= CONFIDENT))
    shares = [F.lit(0.0)]
    within = lambda own: F.size(F.array_intersect("grams", F.expr(_array(own, "int"))))
    for family, texts in NOTICES.items():
        for words_of, name in map(named, texts):
            own, must = (sorted({number[g] for g in zip(some, some[1:], strict=False)}) for some in (words_of, name))
            shares.append(F.when((F.col("family") == family) & (within(must) == len(must)), within(own) / len(own)).otherwise(0.0))
    out = out.withColumn("containment", F.greatest(*shares))
    place, confirmed = F.col("paragraph"), (F.col("containment") >= CONFIRMED) & ~F.col("denied")
    kind = F.shiftright(place, 61).cast("int")
    at = F.struct(kind.alias("kind"), place.bitwiseAND(2**31 - 1).cast("int").alias("at"), "family", F.round("probability", 6).alias("probability"), F.round("containment", 6).alias("containment"), confirmed.alias("confirmed"))
    block = F.shiftright(place, 31).bitwiseAND(2**30 - 1).cast("int").alias("block")
    found = out.select("id", "h", block, at.alias("x")).groupBy("id", "h", "block").agg(F.collect_list("x").alias("all"))
    found = found.select("id", "h", "block", F.filter("all", lambda x: x["kind"] == 0).alias("lines"), F.filter("all", lambda x: (x["kind"] > 0) & x["confirmed"]).alias("wide"))
    size = lambda x: F.element_at(F.array(*map(F.lit, WINDOWS)), x["kind"])
    rival = lambda x, y: (x["family"] != y["family"]) & (y["containment"] > x["containment"]) & (y["at"] < x["at"] + size(x)) & (x["at"] < y["at"] + size(y))
    several = F.size(F.array_distinct(F.transform("wide", lambda x: x["family"]))) > 1
    found = found.withColumn("wide", F.when(several, F.filter("wide", lambda x: ~F.exists("wide", lambda y: rival(x, y)))).otherwise(F.col("wide")))
    wrapped = F.array_except(F.transform("wide", lambda x: x["family"]), F.transform(F.filter("lines", lambda x: x["confirmed"]), lambda x: x["family"]))
    best = lambda f: F.array_max(F.transform(F.filter("wide", lambda x: x["family"] == f), lambda x: F.struct(x["containment"].alias("c"), x["probability"].alias("p"))))
    row = lambda line, f, p, c, ok: F.struct(line.cast("int").alias("line"), f.alias("family"), p.alias("probability"), c.alias("containment"), ok.alias("confirmed"))
    ones = F.transform("lines", lambda x: row(x["at"], x["family"], x["probability"], x["containment"], x["confirmed"]))
    more = F.transform(wrapped, lambda f: row(F.lit(None), f, best(f)["p"], best(f)["c"], F.lit(True)))
    return found.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "block", F.explode(F.concat(ones, more)).alias("x")).select(id_col, "text_hash", "block", "x.*")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_paragraphs, n_predicted, n_confirmed, families (confirmed, sorted)."""
    found = licence_paragraphs(docs, id_col, text_col).groupBy(F.col(id_col).alias("fid"), F.col("text_hash").alias("fh")).agg(F.count("*").alias("n_predicted"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_paragraphs"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n_predicted", zero).alias("n_predicted"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
