"""The index of alike names against all pairs, and how little of them it compares; first returns in one large pair."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, names

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edited(rng, name):
    s = list(name)
    for _ in range(rng.randint(0, 6)):
        at, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.4 and s:
            s.pop(min(at, len(s) - 1))
        elif what < 0.8:
            s.insert(at, rng.choice("abcde é"))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(LETTERS)
    return "".join(s)


def mixed(rng):
    out = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14))) for _ in range(90)]
    out += [edited(rng, rng.choice(out)) for _ in range(90)]
    out += ["north east steel works", "north  east steel work", "steel works north east", "a", "ab", "abc", "公司名称", "公司的名称", "x" * 60, "x" * 55 + "y" * 6]
    return sorted({x for x in out if x})


@pytest.mark.parametrize("least", [0.9, 0.75, 0.6])
def test_alike_names_as_all_pairs(spark, least):
    rows = mixed(random.Random(int(least * 100)))
    df = spark.createDataFrame([(n,) for n in [*rows, rows[0], "", None]], "name string")
    got = {(r.a, r.b): r.ratio for r in names.similar_names(df, least).collect()}
    alike = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {(a, b): alike(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if alike(a, b) > least}


def test_few_random_names_are_compared(spark):
    rng = random.Random(4)
    n = 1500
    rows = [("".join(rng.choice(LETTERS) for _ in range(17)),) for _ in range(n)]
    df = spark.createDataFrame(rows, "name string").repartition(4)
    pairs = n * (n - 1) / 2
    assert names.met(df, 0.75).count() < 0.01 * pairs
    assert names.candidates(df, 0.6).count() < 0.01 * pairs


def test_long_names_meet_by_pieces(spark):
    """Names of few syllables, 8 to 44 characters, with edits: as all pairs, and the long ones are in no set of runs."""
    rng = random.Random(12)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", " "]
    rows = ["".join(rng.choice(syllables) for _ in range(rng.randint(5, 22)))[:44] for _ in range(160)]
    rows = sorted({x for x in rows + [edited(rng, rng.choice(rows)) for _ in range(160)] + [x + rng.choice("abc") for x in rows] if x})
    got = {(r.a, r.b): r.ratio for r in names.similar_names(spark.createDataFrame([(n,) for n in rows], "name string"), 0.9).collect()}
    alike = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {(a, b): alike(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if alike(a, b) > 0.9} and len(got) > 100
    sets = names.Sets(0.9, list(range(12, 41)))
    assert (30, 30, 6) in sets.pieced() and not any(sets.of(n) for n in range(15, 38))


def test_first_return_in_one_pair_of_many(spark):
    """A pair that holds all flows: answers as by a walk over them."""
    n = 20_000
    flows = spark.range(n).select("id", (F.col("id") * 7919 % 3 == 0).cast("int").alias("src"), (F.col("id") * 7919 % 3 != 0).cast("int").alias("dst"), (F.col("id") * 104729 % 9973).cast("double").alias("amount"))
    got = {r.id: r.back for r in joins.first_returns(flows, "id", "src", "dst", "amount", 0.8).collect()}
    rows = [(i, int(i * 7919 % 3 == 0), float(i * 104729 % 9973)) for i in range(n)]
    want, waiting = {}, {0: [], 1: []}  # questions that wait for a flow of the other direction, by need
    import heapq

    for i, src, amount in rows:
        line = waiting[1 - src]
        while line and line[0][0] <= amount:
            want[heapq.heappop(line)[1]] = i
        heapq.heappush(waiting[src], (0.8 * amount, i))
    assert got == want


def test_titles_of_odd_texts_are_stored(spark, tmp_path):
    """The first four words as over all words of a text, and names that are read again without the texts."""
    import re

    from quillon.analytics import compliance

    texts = [None, "", " \t\n", "One", "\n A  b\tC\nd e f", "x" * 100_000, "ΟΔΟΣ ΣΑΣ Σ α β", "İx y", "a b c", " 1\r\n2 3 4", "p q r s" + " t" * 50_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = compliance._titles(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in got.inputFiles())
    assert {r.doc_id: r.name for r in got.collect()} == {i: " ".join(re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower())[:4]) for i, t in enumerate(texts)}


def test_meetings_are_held_against_edits_before_they_are_shuffled(spark):
    """What is shuffled after names meet is within the edits; names that make keys are dealt out over more than one task."""
    df = spark.createDataFrame([("north east steel works one",), ("north east steel works two",)], "name string")
    plan = names.candidates(df, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("levenshtein")  # the bound lies below the only shuffle of pairs
    assert plan.count("Aggregate") == 1
