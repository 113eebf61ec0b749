"""Cases that earlier versions got wrong, and brute-force versions of the models' reading."""

import math
import re

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import bpe, common, decontaminate, graph, licences, minhash, paragraphs, radix, sharding, suffixes, toxicity  # noqa: E402,F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, _uid string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None, "u", "v") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def twins(n=10):
    """A word of 2**n letters and its complement: equal under any polynomial modulo 2**64."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_ranges_tell_twins_apart(spark):
    a, b = twins(11)
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = common.Ranges(data).of(np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert h[0] != h[1]
    text = " ".join([a, "x", "y", b, "x", "y", a, "x"])
    got = minhash.near_duplicates(docs(spark, [text, text.replace(a, "c")]), shingle=3, percent=85).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == [len(minhash._set(t, 3)) for t in (text, text.replace(a, "c"))]
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixes.repeated_strings(docs(spark, [a, b, a[:2000] + "!"]), length=2001).collect()}
    assert kept == {0: a, 1: b, 2: a[:2000] + "!"}


def test_ranges_over_several_blocks():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3 * common.Ranges._BLOCK + 17, dtype=np.uint8)
    data[-500:] = data[100:600]
    r = common.Ranges(data)
    n = len(data)
    assert r.of(np.array([100]), np.array([600])) == r.of(np.array([n - 500]), np.array([n]))
    assert (r.every(64) == r.of(np.arange(n - 63), np.arange(n - 63) + 64)).all()
    wide = common.Ranges(data.astype(np.uint64) << np.uint64(40))
    assert wide.of(np.array([100]), np.array([600])) == wide.of(np.array([n - 500]), np.array([n])) != wide.of(np.array([101]), np.array([601]))


def test_radix_does_not_outgrow_its_positions(spark, monkeypatch):
    monkeypatch.setattr(radix, "WIDEST", 1 << 12)
    monkeypatch.setattr(radix, "FIRST_BYTES", 64)
    long = "".join(f"{i}," for i in range(9000))
    texts = [long, long, long + "x", long[:-1], "short"]
    assert {r.doc_id: r.group_size for r in radix.exact_duplicates(docs(spark, texts)).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1}


def test_paragraphs_keep_what_stands_between_repeats(spark):
    sentence = lambda d, k: " ".join(f"d{d}s{k}w{i}" for i in range(30)) + "."
    donors = [" ".join(sentence(d, k) for k in range(8)) for d in range(6)]
    unique = [f"UNIQ{i} id{i} stays here." for i in range(5)]
    mix = sentence(0, 3)
    for d in range(1, 6):
        mix += " " + unique[d - 1] + " " + sentence(d, 3)
    got = {r.doc_id: r.kept for r in paragraphs.repeated_paragraphs(docs(spark, [*donors, mix])).collect()}
    assert all(u in got[6] for u in unique)
    assert [w for w in got[6].split()] == " ".join(unique).split()
    assert all(got[d] == donors[d] for d in range(6))


def test_components_of_a_large_graph(spark):
    n = 300_000
    edges = spark.range(n).select(F.col("id").alias("a"), F.when(F.col("id") % 1000 != 999, F.col("id") + 1).otherwise(F.col("id") - 999).alias("b"))
    hub = spark.range(n, n + 250_000).select(F.lit(n).alias("a"), F.col("id").alias("b"))
    found = graph.components(edges.unionAll(hub), few=1000)
    assert found.where(F.when(F.col("id") < n, F.col("component") != F.col("id") - F.col("id") % 1000).otherwise(F.col("component") != n)).isEmpty()
    assert found.count() == n + 250_000


def readings_by_force(weights, text):
    """The grammar read word by word from its definition, every clause scanned anew."""
    text = text.lower()
    patterns = [(p.rstrip("-"), p.endswith("-"), w) for p, w in [*weights.items(), *((t, 0.0) for t in toxicity.THREATS if t not in weights)]]
    total = np.zeros(5)
    best = 0.0
    for clause in re.split(r"[.;:!?](?=\s)|\n", text):
        words = [(m.group(), m.start()) for m in toxicity.WORD.finditer(clause)]
        plain = turned = directed = 0.0
        found = 0
        last = {"turn": -99, "target": -99, "threat": -99}
        for k, (word, at) in enumerate(words):
            for name, some in (("turn", toxicity.NEGATIONS | toxicity.REPORTS), ("target", toxicity.TARGETS), ("threat", toxicity.THREATS)):
                if word in some:
                    last[name] = k
            near = {n for n, j in last.items() if k - j <= toxicity.REACH}
            own = [w for p, stem, w in patterns if clause[at:].startswith(p) and (at == 0 or not clause[at - 1].isalpha()) and (stem or not clause[at + len(p) : at + len(p) + 1].isalpha())]
            w = max(own, default=0.0)
            if w:
                found += 1
                if "turn" in near:
                    turned += w
                else:
                    plain += w
                    directed += w if "target" in near else 0
            if (word in toxicity.TARGETS or word in toxicity.THREATS) and {"target", "threat"} <= near and "turn" not in near:
                directed += 1
        total += [found > 0, found, plain, directed, turned]
        best = max(best, plain + 0.5 * turned)
    return total, best


def test_grammar_against_force():
    import random

    rng = random.Random(6)
    weights = {"idiot": 5.0, "moro-": 4.0, "fool-": 2.0, "kill": 1.5, "swine": 3.0}
    pool = ["idiot", "morons", "foolish", "fool", "kill", "burn", "swine", "you", "they", "not", "never", "said", "the", "a", "road", "green", "hurt"]
    grammar = toxicity.Grammar(weights)
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", "; "]) for _ in range(rng.randint(0, 30)))
        total, best = readings_by_force(weights, text)
        got = grammar.readings(text)
        want = [np.log1p(total[0]), np.log1p(total[1]), np.log1p(total[2]), np.log1p(total[3]), np.log1p(total[4]), np.log1p(best)]
        assert got[1:7] == pytest.approx(want), text


def test_grammar_is_linear():
    import time

    grammar = toxicity.Grammar({"idiot": 5.0})
    grammar.readings("you idiot. ")

    def seconds(text):
        began = time.process_time()
        grammar.readings(text)
        return time.process_time() - began

    small, large = seconds("you idiot " * 20_000), seconds("you idiot " * 200_000)
    assert large < 40 * small + 1


def test_transducers_compose():
    one = toxicity.Transducer.memory("x", 1, 2).composed(toxicity.Transducer.memory("y", 2, 1))
    state, seen = 0, []
    for symbol in (0, 1, 2, 0, 0, 3):
        state = one.follows[state][symbol]
        seen.append(set(one.near[state]))
    assert seen == [set(), {"x"}, {"x", "y"}, {"x", "y"}, set(), {"x", "y"}]


def licences_by_force(text):
    """Families of a text from the definition: every line and every window, each scored and checked on its own."""
    families, weights, bias = licences.trained()
    number = {g: i for i, g in enumerate(sorted(weights))}

    def judged(words):
        grams = {number[g] for g in licences._grams(words) if g in number}
        z = np.array(bias) + sum((np.array(weights[g]) for g in licences._grams(words) if g in weights), np.zeros(len(families)))
        p = np.exp(z - z.max())
        family, sure = families[int(z.argmax())], 1 / p.sum()
        if family == licences.UNKNOWN or sure < licences.CONFIDENT or not grams:
            return None
        best = 0.0
        for notice in licences.NOTICES[family]:
            own, name = licences.named(notice)
            pairs, must = set(zip(own, own[1:], strict=False)), set(zip(name, name[1:], strict=False))
            have = set(zip(words, words[1:], strict=False))
            if must <= have:
                best = max(best, len(pairs & have) / len(pairs))
        denied = any(w in licences.NEGATIVE and set(words[i + 1 : i + 4]) & set(licences.GRANTING) for i, w in enumerate(words))
        return (family, best) if best >= licences.CONFIRMED and not denied else None

    out = set()
    for block in re.split(r"\n[\x20\x09-\x0D]*\n", text or ""):
        lines = [judged(licences._tokens(line)) for line in block.split("\n")]
        sure = {f for f, _ in filter(None, lines)}
        words, wide = licences._tokens(block), []
        for size in licences.WINDOWS:
            for i in range(0, max(len(words), 1), size // 2):
                if words[i : i + size] and (x := judged(words[i : i + size])):
                    wide.append((i, i + size, *x))
        for i, j, f, c in wide:
            if not any(g != f and d > c and a < j and i < b for a, b, g, d in wide):
                sure.add(f)
        out |= sure
    return sorted(out)


LICENCE_TEXTS = [
    "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the Eclipse Public License, version 2.0.", "This was never licensed under the MIT License.", "It is not released under the Apache 2.0 license.",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: CC-BY-NC-4.0", "SPDX-License-Identifier: Acme", "Licensed under the Acme General Public License, version 3.", "prose before\nLicensed under the GNU Lesser General Public License, version 3.\nprose after",
    "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy was not distributed", "Released under the Unlicense.", "Licensed under CC BY-\nNC 4.0.", "Distributed under the Boost Software License, Version 1.0.", "mit der Bahn, und die Lizenz", "A driving license was released under version rules.",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "Licensed under the GPL, version 2 or later. Licensed under CC BY 4.0.", "", None, "the license " * 30,
]


def test_licences_against_force(spark):
    got = {r.doc_id: r.families for r in licences.licences(docs(spark, LICENCE_TEXTS)).collect()}
    assert [got[i] for i in range(len(LICENCE_TEXTS))] == [licences_by_force(t) for t in LICENCE_TEXTS]
    assert got[0] == ["agpl"] and got[1] == ["epl"] and got[2] == [] and got[3] == [] and got[4] == ["mit"] and got[6] == ["cc-by-nc"] and got[7] == [] and got[8] == [] and got[9] == ["lgpl"] and got[12] == ["cc-by-nc"] and got[15] == []


def test_licence_probabilities_are_calibrated():
    families, weights, bias = licences.trained()
    rows = []
    for k, family in enumerate(families):
        for text in licences.TEMPLATES.get(family, licences.OTHERS):
            words = licences._tokens(text)
            for i in range(1, len(words), 2):
                z = np.array(bias) + sum((np.array(weights[g]) for g in licences._grams([*words[:i], "\0", *words[i + 1 :]]) if g in weights), np.zeros(len(families)))
                p = np.exp(z - z.max())
                rows.append((p.max() / p.sum(), int(z.argmax()) == k))
    sure, right = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert right.mean() > 0.9 and abs(sure.mean() - right.mean()) < 0.08


def test_categories_keep_their_order(spark):
    rows = [(i, "t" * (i % 50), "en", f"s{i % 9}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    slots = {r.source: r.s for r in d.select("source", sharding._category(d, "source", 4).alias("s")).distinct().collect()}
    assert [slots[f"s{i}"] for i in range(9)] == list(range(9))
    many = spark.range(1000).select(F.format_string("v%04d", "id").alias("source"))
    got = [r.s for r in many.select("source", sharding._category(many, "source", 4).alias("s")).orderBy("source").collect()]
    assert got == sorted(got) and len(set(got)) == 16 and max(map(got.count, set(got))) < 70


def test_hilbert_index_from_its_definition(spark):
    """The index of each row, its cell's coordinates worked out by hand and looked up on a curve drawn step by step."""
    rows = [(i, "x" * (7 * i % 90), ["de", "en", None][i % 3], f"s{i % 4}") for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = sharding.curve(4, 3)
    sources, langs = ["s0", "s1", "s2", "s3"], ["\0", "de", "en"]
    for r in sharding.hilbert_shards(d, 4).collect():
        _, text, lang, source = rows[r.doc_id]
        size = min(int(math.log2(len(text) + 1)), 31) >> 1
        cell = (sources.index(source) * 16 + langs.index(lang or "\0")) * 16 + size
        assert r.curve_index == table[cell]


def test_contamination_beyond_the_broadcast_bound(spark):
    words = [f"w{i % 23}" for i in range(400)]
    items = spark.createDataFrame([(1, " ".join(words[5:40])), (2, "w1 w2"), (3, None)], "item_id long, text string")
    d = docs(spark, [" ".join(words), " ".join(reversed(words)), "w1 w2 w1 w2", None, "w1 W2"])
    key = lambda r: r.doc_id
    small = sorted(decontaminate.contaminated(d, items).collect(), key=key)
    large = sorted(decontaminate.contaminated(d, items, broadcast_bytes=0).collect(), key=key)
    assert small == large and small[0].n_hit == 400


def test_pipeline_keeps_columns_of_any_name(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.createDataFrame([(1, "a b", "u1", "k1"), (2, "a  b", "u2", "k2"), (3, "c", "u3", "k3")], "doc_id long, text string, uid string, _uid string")
    got = sorted(tuple(r) for r in corpus_pipeline.by_copies(spark, d, "").collect())
    assert got == [(2, "a  b", "u2", "k2"), (3, "c", "u3", "k3")]
    twice = sorted(tuple(r) for r in corpus_pipeline.by_copies(spark, d.unionAll(d), "").collect())
    assert twice == got


def test_scratch_is_swept(spark):
    mark = common.marked()
    keep, gone = common.stored(spark.range(3)), common.stored(spark.range(4))
    common.swept(mark, keep)
    assert keep.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|cannot"):
        gone.count()
