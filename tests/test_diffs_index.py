"""Line diffs against a longest common subsequence, and answers of the stored index against full scores."""

import random

from pyspark.sql import functions as F

from quillon.functions.diffs import hunks
from quillon.operators import diffs, inverted
from quillon.sources.scratch import cut


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def rebuilt(a, b, script):
    """``b`` from ``a`` and the hunks, and how many lines stay."""
    out, at, stay = [], 0, 0
    for i, j, p, q in script:
        stay += i - at
        out += a[at:i]
        assert len(out) == p
        out += b[p:q]
        at = j
    return out + a[at:], stay + len(a) - at


def test_hunks_are_shortest():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "abcde"[: rng.randint(1, 5)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
        got, stay = rebuilt(a, b, hunks(a, b))
        assert got == b and stay == longest(a, b)
    long = [str(rng.randint(0, 900)) for _ in range(3000)]
    other = [x for x in long if rng.random() > 0.05]
    assert rebuilt(long, other, hunks(long, other)) == (other, len(other))


def test_line_diff_over_rows(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, "x", "x"), (3, None, "n\nm"), (4, "p", None), (5, None, None), (6, "", "q"), (1, "a", "b")]
    got = {}
    for r in diffs.line_diff(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b").collect():
        got.setdefault(r.id, []).append((r.a_from, r.a_to, r.b_from, r.b_to, tuple(r.gone), tuple(r.come)))
    assert sorted(got[1]) == sorted([(1, 2, 1, 1, ("b",), ()), (3, 3, 2, 3, (), ("d",)), (0, 1, 0, 1, ("a",), ("b",))])
    assert got[3] == [(0, 0, 0, 2, (), ("n", "m"))] and got[4] == [(0, 1, 0, 0, ("p",), ())] and got[6] == [(0, 1, 0, 1, ("",), ("q",))]
    assert set(got) == {1, 3, 4, 6}


def test_index_gives_the_best_and_skips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE", 8)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(vocabulary[: rng.choice([10, 60])]) for _ in range(rng.randint(1, 40))) for i in range(400)} | {400: None, 401: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    path = str(tmp_path / "index")
    inverted.build(docs, "id", F.col("text"), path)
    asked = {"q1": ["w1", "w2", "w59"], "q2": ["w50"], "q3": ["nowhere"], "q4": ["w3", "w4", "w5", "w6", "w55", "w56"]}
    queries = spark.createDataFrame([(q, t) for q, some in asked.items() for t in some], "query string, term string")
    import math

    words = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / sum(t is not None for t in texts.values())
    df = {t: sum(t in w for w in words.values()) for t in {t for some in asked.values() for t in some}}
    want = {}
    for q, some in asked.items():
        scores = []
        for i, w in words.items():
            s = sum((math.log((len(words) + 1) / (df[t] + 1)) + 1) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in some)
            if s:
                scores.append((-round(s, 9), i))
        want[q] = [(i, -s) for s, i in sorted(scores)[:5]]
    found, counts = inverted.best(spark, path, queries, 5)
    got = {q: [] for q in asked}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r["query"]].append((r.doc, r.score))
    for q in asked:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    n = counts.first()
    assert n.read < 0.8 * n.ranges
    # another set of questions reads the folders of its own terms only
    blocks, _ = inverted._asked(spark, path, queries.where("query = 'q2'"))
    assert {f.split("folder=")[1].split("/")[0] for f in blocks.inputFiles()} <= {str(r[0]) for r in queries.where("query = 'q2'").select(inverted._folder("term")).collect()} or len(blocks.select("folder").distinct().collect()) == 1


def test_sums_of_documents_are_not_shuffled(spark, tmp_path):
    """Postings are made and scores are summed where a range's documents are: nothing is dealt out anew once postings are single rows."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(9))) for i in range(60)], "id long, text string")
    path = str(tmp_path / "index")
    inverted.build(docs, "id", F.col("text"), path)
    blocks, terms = inverted._asked(spark, path, spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w3")], "query long, term string"))
    terms = cut(terms)
    wanted = blocks.select("range").distinct().crossJoin(terms.select("query").distinct())
    plan = inverted._scored(blocks, terms, wanted, True, 9.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")] and "Exchange" in plan
    assert [f.dataType.simpleString() for f in blocks.schema if f.name in ("docs", "tfs", "lens")] == ["array<bigint>", "array<int>", "array<int>"]
