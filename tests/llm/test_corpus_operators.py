"""Small fixtures: brute-force versions, and the odd cases that every operator defines."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
bpe = pytest.importorskip("quillon.llm.bpe")

from quillon.llm import decontaminate, graph, licences, minhash, paragraphs, quality, radix, rules, sharding, suffixes, toxicity  # noqa: E402

PASSAGE = " ".join(f"w{i}x{i * 7 % 13}" for i in range(80))
LONG = " ".join(f"long{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, h string, rest string, id string, words string"


def rows_of(*texts, start=0):
    """Documents with clashing extra columns and nulls among them."""
    return [(start + i, t, None if i % 3 else "en", None if i % 2 else "s", None, "u", "h", "r", "i", "w") for i, t in enumerate(texts)]


ODD = rows_of("", None, "   ", "\n\t", "a", "a ", "one two", "one  two", PASSAGE, PASSAGE + " tail", PASSAGE.upper(), LONG, LONG, "é" * 300, "日本語 テキスト です " * 30, "idiot " * 5, "Released under the MIT License.", "\x00\x07 odd bytes")
ODD += [ODD[8], ODD[0]]  # repeated rows
ODD.append((None, "no id at all", None, None, None, None, None, None, None, None))
LABELS = [(i, i % 2, int(i in (3, 15))) for i in range(18)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*LABELS, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (None, "no id at"), (1, PASSAGE)], "item_id long, text string")


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "sharding": lambda d, **k: sharding.hilbert_shards(d),
    "bpe": lambda d, **k: bpe.decoded(bpe.encoded(d, PATH, public_tokenizers.PATTERN), PATH),
    "minhash": lambda d, **k: minhash.near_duplicates(d),
    "paragraphs": lambda d, **k: paragraphs.repeated_paragraphs(d),
    "toxicity": lambda d, labels, **k: toxicity.scored(d, toxicity.fitted(d, labels, F.lit(True))),
    "radix": lambda d, **k: radix.exact_duplicates(d),
    "decontaminate": lambda d, items, **k: decontaminate.contaminated(d, items),
    "licences": lambda d, **k: licences.licences(d),
    "quality": lambda d, labels, **k: quality.scored(d, quality.fitted(d, labels, F.lit(True))),
    "suffixes": lambda d, **k: suffixes.repeated_strings(d),
    "rules": lambda d, labels, **k: rules.ruled(d, rules.fitted(d, labels)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(name, odd, none, labels, items):
    """One result row for each row, whatever it holds; none for none."""
    got = OPERATORS[name](odd, labels=labels, items=items).collect()
    assert len(got) == len(ODD)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ODD)
    assert OPERATORS[name](none, labels=labels.where("false"), items=items.where("false")).count() == 0


def test_shards_differ_by_one_and_keep_the_curve(odd):
    got = sharding.hilbert_shards(odd, 4).collect()
    sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(v == list(range(len(v))) for v in sizes.values())
    order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    text = {r[0]: r[1] or "" for r in ODD}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1 for r in got)


def test_curve_visits_neighbours():
    table = sharding.curve(3, 3)
    at = {v: (k >> 6, k >> 3 & 7, k & 7) for k, v in enumerate(table)}
    assert len(at) == 512 and all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(511))


def test_shard_files(odd, tmp_path, spark):
    ids = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(ids, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("_shard").count().count() == 3


def test_bpe_as_the_library(odd):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    texts = {r[0]: r[1] or "" for r in ODD}
    for r in OPERATORS["bpe"](odd).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    known = bpe.Vocabulary(open(PATH, "rb").read())
    for piece in [b"a" * 1000, b"ab" * 99, b"!?" * 64, b" " * 300, "é".encode() * 200, bytes(range(256))]:
        want = np.array(other._encode_single_piece(piece), "<u4").tobytes()
        assert known.encode_long(piece) == want
        assert known.encode_wide([piece[:128]], 128) == [np.array(other._encode_single_piece(piece[:128]), "<u4").tobytes()]


def near_texts():
    import random

    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(120)) for _ in range(6)]
    out = []
    for k in range(150):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
        out.append(" ".join(words))
    return out


def closure(sets, percent):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(sets))]


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, shingle, percent):
    texts = near_texts()
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows_of(*texts), SCHEMA), shingle=shingle, percent=percent).collect()}
    sets = [minhash._set(t, shingle) for t in texts]
    want = closure(sets, percent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert len(set(want)) > 6, "the fixture holds groups that fall apart"


def test_components_small_and_distributed(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7] + [(100, 3), (5, 5)], "a long, b long")
    few = dict(map(tuple, graph.components(pairs).collect()))
    many = dict(map(tuple, graph.components(pairs, few=0).collect()))
    assert few == many and few[100] == few[3] == 1


def test_paragraphs(spark):
    texts = ["start\n" + PASSAGE + "\nend", "other text\n" + PASSAGE, PASSAGE.replace("w7x", "q7x", 1), "short line\nshort line", "clean " * 3]
    got = {r.doc_id: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows_of(*texts), SCHEMA)).collect()}
    assert got[0].kept == texts[0] and got[3].kept == texts[3] and got[4].kept == texts[4]
    assert got[1].kept == "other text\n" and got[2].kept == ""


def test_exact_duplicates(odd):
    import re

    got = radix.exact_duplicates(odd).collect()
    bare = {r[0]: re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in ODD}
    groups = {}
    for r in ODD:
        groups.setdefault(bare[r[0]], []).append(r)
    for r in got:
        own = groups[bare[r.doc_id]]
        best = max(own, key=lambda x: (len(x[1] or ""), x[0] is not None, -(x[0] or 0)))
        assert r.group_size == len(own) and r.keep_id == best[0] and r.text_sha256 == hashlib.sha256(bare[r.doc_id].encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)


def test_radix_goes_past_its_first_blocks(spark):
    texts = ["x" * n + c for n in (0, 255, 256, 257, 4351, 4352, 5000, 70_000) for c in ("", "a", "b", "a")]
    got = {r.doc_id: r.group_size for r in radix.exact_duplicates(spark.createDataFrame(rows_of(*texts), SCHEMA)).collect()}
    assert got == {i: texts.count(t) for i, t in enumerate(texts)}


def test_contamination(spark, items):
    words = PASSAGE.split()
    texts = ["pre " + " ".join(words[5:20]) + " post", " ".join(words[5:14]), "ONE, two! three", "one x two", None, "Ünïcode ONE-TWO É", "no id at"]
    got = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(rows_of(*texts), SCHEMA), items).collect()}
    assert [got[i].n_hit for i in range(7)] == [15, 0, 2, 0, 0, 2, 3]
    assert got[0].item_ids == ["1"] and got[2].item_ids == ["2"] and got[6].item_ids == [] and got[5].n_words == 4
    shuffled = decontaminate.contaminated(spark.createDataFrame(rows_of(*texts), SCHEMA), items, broadcast_bytes=0).collect()
    assert {r.doc_id: r.n_hit for r in shuffled} == {i: got[i].n_hit for i in got}


def test_licences(spark):
    texts = ["some prose\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "the license of the road is free", "LICENSED under the apache license, version 2.0", None, ""]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows_of(*texts), SCHEMA)).collect()}
    assert [got[i].families for i in range(7)] == [["mit"], ["cc-by-nc"], ["gpl"], [], ["apache-2.0"], [], []]


def test_licences_held_out():
    """Notices with a word changed in each odd place, which training never drops, are still told apart."""
    import numpy as np

    families, weights, bias = licences.trained()
    right = total = 0
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            words = licences._tokens(t)
            for i in range(1, len(words), 2):
                grams = licences._grams([*words[:i], "changed", *words[i + 1 :]])
                z = np.array(bias) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(families)))
                right += families[int(z.argmax())] == family
                total += 1
    assert right / total > 0.9


def removed_by_force(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length,gram", [(200, 64), (40, 16), (24, 24)])
def test_repeated_strings_against_force(spark, length, gram):
    texts = [*near_texts()[:40], PASSAGE, "x" + PASSAGE + "y", PASSAGE[: length + 3], "ab" * 300, "é" * 250, None, "", PASSAGE[5 : 5 + length], PASSAGE[5 : 4 + length]]
    got = {r.doc_id: r for r in suffixes.repeated_strings(spark.createDataFrame(rows_of(*texts), SCHEMA), length=length, gram=gram).collect()}
    for i, want in enumerate(removed_by_force(texts, length)):
        assert bytes(got[i].kept) == want
        assert sum(s.end - s.begin for s in got[i].spans) == got[i].n_bytes - len(want)


def test_repeated_rows_are_removed(odd):
    got = suffixes.repeated_strings(odd).collect()
    assert all(bytes(r.kept) == b"" for r in got if r.doc_id in (8, 11, 12))


def test_classifiers_without_labels(odd, labels):
    nothing = labels.where("false")
    assert {r.score for r in quality.scored(odd, quality.fitted(odd, nothing, F.lit(True))).collect()} == {quality.PRIOR}
    assert {r.score for r in toxicity.scored(odd, toxicity.fitted(odd, nothing, F.lit(True))).collect()} == {toxicity.PRIOR}


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({"idiot": 5.0, "moro-": 4.0})
    plain, negated, quoted, directed = (grammar.readings(t) for t in ("what an idiot.", "he is not an idiot.", "she said idiot.", "you idiot."))
    assert plain[5] == 0 and negated[5] > 0 and quoted[5] > 0 and directed[4] > plain[4]
    assert grammar.readings("a tomoron")[1] == 0 and grammar.readings("many morons!")[1] > 0
    assert not grammar.readings(None)[1:].any()


def test_held_out_accuracy(spark):
    """On the smallest tables with enough labels: both classifiers on the fold they did not learn from."""
    import os

    from quillon.llm import queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, label in (("op5_toxicity", "toxic"), ("op9_quality", "quality")):
        rows = [r for r in queries.QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in labels]
        right = sum(r.predicted == labels[r.doc_id][label] for r in rows)
        assert right / len(rows) > 0.9


def spliced_texts():
    """Passages of 24 to 80 words in the middle of other words, without marks and with one after every word, and periodic text."""
    import random

    rng = random.Random(11)
    words = lambda n: [f"s{rng.randint(0, 10**9)}" for _ in range(n)]
    out = []
    for n in (24, 25, 26, 40, 51, 51, 51, 60, 80):
        for mark in ("", ".", "?!"):
            passage = words(n)
            for _ in range(3):
                out.append(" ".join(w + mark for w in [*words(rng.randint(0, 60)), *passage, *words(rng.randint(0, 60))]))
    long = words(100)
    out += [" ".join(x) for x in (long, words(9) + long[:60] + words(9), words(3) + long[37:75] + long[:30], long[70:] + long[70:], ["a"] * 70, "a b c".split() * 30, ["é", "É"] * 30, long[:50] + ["edit"] + long[51:])]
    return out


def runs_by_force(texts, run):
    seen, gone, repeats = {}, [], set()
    split = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for t in texts]
    for d, words in enumerate(split):
        own = set()
        for i in range(len(words) - run + 1):
            first = seen.setdefault(tuple(words[i : i + run]), d)
            if (d, i) != seen.setdefault((tuple(words[i : i + run]),), (d, i)):
                own |= set(range(i, i + run))
                repeats |= {d, first}
        gone.append(own)
    return [[w for i, w in enumerate(t.split()) if i not in gone[d]] for d, t in enumerate(texts)], repeats


def test_spliced_runs_against_force(spark):
    texts = spliced_texts()
    rows = spark.createDataFrame(rows_of(*texts), SCHEMA).repartition(3).select(F.col("doc_id").alias("uid"), "text")
    got = paragraphs._spliced(rows).collect()
    want, repeats = runs_by_force(texts, paragraphs.RUN)
    assert {r.uid for r in got} == repeats
    for d, text in enumerate(texts):
        kept = text
        for r in sorted((r for r in got if r.uid == d and not r.first), key=lambda r: -r.begin):
            kept = kept[: r.begin] + kept[r.end :]
        assert kept.split() == want[d]


def test_licences_wrapped(spark):
    """Notices that lines wrap at any width, alone or in other prose, and no notice over a blank line."""
    import textwrap

    notices = {
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "lgpl": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    }
    prose = "the rivers of the north were low that year and the mills stood still for most of the summer "
    want, texts = [], []
    for family, t in notices.items():
        for width in (20, 34, 50, 72):
            for before in ("", prose * 4):
                want.append([family])
                texts.append("\n".join(textwrap.wrap(before + t + " " + before, width, break_long_words=False, break_on_hyphens=False)))
    want += [[], []]
    texts += ["Redistribution and use in source and binary\n\nforms, with or without modification, are permitted\n\nprovided that the following conditions are met", "\n".join(textwrap.wrap(prose * 9 + "the license of the mit of the road", 40))]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows_of(*texts), SCHEMA)).collect()}
    assert [(i, got[i].families) for i in range(len(texts))] == list(enumerate(want))
    assert all(got[i].n_confirmed == len(want[i]) for i in range(len(texts)) if "\n" in texts[i][30:])


def test_grammar_keeps_word_and_stem_of_the_same_letters():
    for weights in ({"kill-": 4.0, "moron": 5.0, "moron-": 3.0}, {"moron-": 3.0, "moron": 5.0, "kill-": 4.0}):
        hits = lambda t, g=toxicity.Grammar(weights): [h for *_, h in g.clauses(t)]
        assert hits("kill") == [{0: 4.0}] and hits("killing") == [{0: 4.0}]
        assert hits("moron") == [{0: 5.0}] and hits("morons") == [{0: 3.0}]
        assert hits("burn") == [{0: 0.0}] and hits("burning") == []


def test_bands_follow_the_threshold(spark):
    for percent in (50, 80, 85, 95):
        bands = minhash.permutations_for(percent) // 2
        assert (1 - (percent / 100) ** 4) ** bands <= minhash.MISSED < (1 - (percent / 100) ** 4) ** (bands - 1)
    assert minhash.permutations_for(85) == minhash.PERMUTATIONS and minhash.permutations_for(80) == 56
