"""The vector index against all cosines."""

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import vectors

SCHEMA = "id long, v array<double>"


def brute(rows, asked, k, others=False):
    """The k nearest by all cosines, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 9)
        out[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if not (others and ids[i] == q)][:k]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query, []).append((r.id, r.score))
    return out


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-9)


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    own = rng.integers(0, groups, n)
    own[: n // 3] = 0  # one group has a third of all
    return [(int(i), (middles[g] + 0.15 * rng.normal(size=dim)).tolist()) for i, g in enumerate(own)]


def test_best_is_exact_and_leaves_cells_unread(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 32), ("BUNDLE", 8), ("SLOT", 2)):  # many blocks, bundles and places
        monkeypatch.setattr(vectors, name, value)
    rows = clustered(1500, 16, 30, 1)
    path = str(tmp_path / "v")
    vectors.build(spark.createDataFrame(rows, SCHEMA), "id", "v", path)
    asked = [r for r in rows if r[0] % 20 == 0]
    queries = spark.createDataFrame(asked, "query long, vector array<double>")
    found, counts = vectors.best(spark, path, queries, 5, probes=2, others=True)
    same(answers(found), brute(rows, asked, 5, True))
    n = counts.first()
    assert n["read"] < 0.6 * n["cells"]
    vectors.build(spark.createDataFrame(rows, SCHEMA), "id", "v", path, cells=1)  # all rows in one cell, in many blocks and places
    assert spark.read.parquet(f"{path}/blocks").count() > 40
    same(answers(vectors.best(spark, path, queries, 5, others=True)[0]), brute(rows, asked, 5, True))


def test_ties_repeats_and_odd_vectors(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(9, 0, -1)] + [(10, [3.0, 2.0, 1.0]), (11, [-1.0, 0.0, 0.0]), (12, [1e300, 2e300, 3e300]), (13, [1e-310, 2e-310, 3e-310])]
    odd = [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]), (24, [float("nan"), 1.0, 1.0]), (25, [float("inf"), 1.0, 1.0]), (26, [1.0, 2.0])]
    path = str(tmp_path / "v")
    vectors.build(spark.createDataFrame(rows + odd, SCHEMA), "id", "v", path)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), *odd], "query long, vector array<double>")
    got = answers(vectors.best(spark, path, queries, 4)[0])
    assert {q: [i for i, _ in a] for q, a in got.items()} == {1: [1, 2, 3, 4]}
    got = answers(vectors.best(spark, path, queries, 50)[0])  # fewer vectors than asked for
    assert sorted(i for i, _ in got[1]) == [*range(1, 14)] and got[1][-1][0] == 11


def test_empty_index_and_no_questions(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query long, vector array<double>")
    vectors.build(empty, "id", "v", str(tmp_path / "e"))
    assert vectors.best(spark, str(tmp_path / "e"), queries, 3)[0].collect() == []
    vectors.build(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA), "id", "v", str(tmp_path / "o"))
    assert vectors.best(spark, str(tmp_path / "o"), queries.limit(0), 3)[0].collect() == []


def test_recall_of_the_nearest_cells(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    path = str(tmp_path / "v")
    vectors.build(table, "id", "embedding", path)
    rows = [(r.id, r.embedding) for r in table.collect()]
    asked = [r for r in rows if r[0] % 20 == 0]
    want = brute(rows, asked, 10)
    queries = table.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    found, counts = vectors.best(spark, path, queries, 10, exact=False)
    got = answers(found)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(asked)
    assert counts.first()["read"] < counts.first()["cells"]
    assert tuple(vectors.recall(spark, path, queries, 10).first()) == (10 * len(asked), hits)


def test_what_leaves_a_task_together_is_bounded(spark, tmp_path, monkeypatch):
    """Questions that meet every cell leave in small frames, and blocks come in batches bounded by bytes."""
    import pandas as pd

    monkeypatch.setattr(vectors, "PAIRS", 64, raising=False)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = clustered(300, 8, 10, 3)
    path = str(tmp_path / "v")
    vectors.build(spark.createDataFrame(rows, SCHEMA), "id", "v", path, cells=20)
    cells = vectors._Cells(spark, path)

    class Questions:
        def mapInPandas(self, work, schema):
            return list(work(iter([pd.DataFrame({"query": range(100), "v": [np.array(v) / np.linalg.norm(v) for _, v in rows[:100]], "floor": -2.0})])))

    near, rest = cells.near(Questions(), 3), cells.promising(Questions(), 3)
    assert max(map(len, near)) <= 64 and max(map(len, rest)) <= 64
    met = {(q, c) for f in near + rest for q, c in zip(f["query"], f["cell"], strict=True)}
    assert len(met) == sum(map(len, near + rest)) == 100 * len(cells.ids)
    queries = spark.createDataFrame(rows[:20], "query long, vector array<double>")
    same(answers(vectors.best(spark, path, queries, 4)[0]), brute(rows, rows[:20], 4))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == vectors.BATCH
