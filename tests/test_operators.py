"""Operators against plain versions of themselves on small fixtures."""

import datetime
import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import audits, graphs, joins, retrieval, series, simulate, stats
from quillon.sources import zones


def test_nearest_against_all_pairs(spark):
    rng = random.Random(3)
    left = [(i, i % 3, round(rng.uniform(-50, 50), 1)) for i in range(200)]
    right = [(i, i % 3, round(rng.uniform(-50, 50), 1)) for i in range(60)] + [(90, 0, 5.0), (91, 0, 5.0)]
    got = joins.nearest(spark.createDataFrame(left, "t long, k int, v double"), spark.createDataFrame(right, "c long, k int, v double"), ["k"], "v", "t", "c", 3.0)
    for r in got.collect():
        near = sorted((abs(v - r.v), c) for c, k, v in right if k == r.k and abs(v - r.v) <= 3.0)
        assert r.c == (near[0][1] if near else None)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("abc de") for _ in range(rng.randint(1, 9))).strip() for _ in range(120)} - {""}
    got = {(r.a, r.b) for r in joins.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.75).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(names), 2) if difflib.SequenceMatcher(None, a, b).ratio() > 0.75}


def test_first_returns_against_all_pairs(spark):
    rng = random.Random(5)
    flows = [(i, rng.randint(0, 3), rng.randint(0, 3), float(rng.randint(1, 1000))) for i in range(900)]
    df = spark.createDataFrame(flows, "id long, s int, d int, a double").where("s <> d")
    got = {r.id: r.back for r in joins.first_returns(df, "id", "s", "d", "a", 0.8).collect()}
    want = {}
    for i, s, d, a in flows:
        back = [j for j, t, e, b in flows if s != d and t == d and e == s and j > i and b >= 0.8 * a]
        if back:
            want[i] = min(back)
    assert got == want


def test_record_matches_against_all_pairs(spark):
    rng = random.Random(6)
    names = ["acme works", "acme work", "blue sky", "north steel"]

    def rows(n):
        out = []
        for i in range(n):
            incl = rng.choice([1000.0, 1010.0, 1030.0, 2000.0, 0.0])
            out.append((i, rng.choice(names), incl, incl / 1.1, incl / 11, float(rng.randint(0, 3)), None))
        return out

    left, right, kind = rows(40), rows(30), "id long, name string, incl double, excl double, tax double, quantity double, date date"

    def score(a, b):
        total, weight = 0.2 * difflib.SequenceMatcher(None, a[1], b[1]).ratio(), 0.2
        for k, (w, t) in zip((2, 3, 4, 5), joins.RECORD_PARTS.values(), strict=True):
            if a[k] > 0 and b[k] > 0:
                total, weight = total + w * max(0.0, 1 - abs(a[k] - b[k]) / a[k] / max(2 * t, 0.01)), weight + w
        return total / weight

    for r in joins.record_matches(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect():
        a = left[r.id]
        known = [(score(a, b), -b[0]) for b in right if a[2] > 0 and b[2] > 0]
        best = max(known, default=(0, 0), key=lambda x: (round(x[0], 9), x[1]))
        assert (r.match, r.match is not None) == ((-best[1], True) if best[0] >= 0.7 else (None, False))


def test_percentile_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 50)
    monkeypatch.setattr(stats, "CELLS", 8)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=800), np.full(300, 0.25), [1e9]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for p in (0.0, 0.13, 0.5, 0.95, 1.0):
        assert stats.linear_percentile(df, "v", p) == pytest.approx(float(np.quantile(v, p)))
    assert stats.linear_percentile(df.where("false"), "v", 0.5) is None


def test_index_quartiles(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.randint(0, 9))) for k in range(4) for _ in range(3 + 5 * k)]
    got = {r.k: (r.n, r.q1, r.q3) for r in stats.index_quartiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in range(4):
        own = sorted(v for j, v in rows if j == k)
        assert got[k] == (len(own), own[len(own) // 4], own[3 * len(own) // 4])


def test_isolation_of_outliers(spark):
    rows = [(i, float(i % 10)) for i in range(400)] + [(1000, 500.0), (1001, -400.0)]
    df = spark.createDataFrame(rows, "id long, v double")
    depth = {r.id: r.iso for r in stats.isolation(df, "id", ["v"], depths=True).collect()}
    assert sorted(depth, key=depth.get)[:2] in ([1000, 1001], [1001, 1000])


def paths_by_force(edges, start, most):
    out, front = [], [(start,)]
    for _ in range(most):
        front = [p + (d,) for p in front for s, d in edges if s == p[-1] and d not in p]
        out += front
    return out


def test_paths_against_force(spark):
    rng = random.Random(9)
    edges = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(30)} - {(i, i) for i in range(13)})
    df = spark.createDataFrame([(s, d, float(s + d)) for s, d in edges], "src long, dst long, w double")
    starts = spark.createDataFrame([(0,), (1,)], "id long")
    short = {(r.start, r.id): r for r in graphs.shortest_paths(df, starts, 4, "w").collect() if r.hop}
    some = graphs.simple_paths(df, starts, 5, "w", 7).collect()
    for start in (0, 1):
        every = paths_by_force(edges, start, 5)
        for node in {p[-1] for p in every if len(p) <= 5}:
            own = [p for p in every if p[-1] == node]
            least = min(map(len, own))
            own = sorted(p for p in own if len(p) == least)
            r = short[start, node]
            assert (r.hop, r.paths, tuple(r.path)) == (least - 1, len(own), own[0])
            assert r.total == sum(a + b for a, b in zip(own[0], own[0][1:], strict=False))
        assert [tuple(r.path) for r in sorted((r for r in some if r.start == start), key=lambda r: (r.hops, r.path))] == sorted(every, key=lambda p: (len(p), p))[:7]


def test_rings_against_force(spark):
    rng = random.Random(10)
    edges = {(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(35)}
    df = spark.createDataFrame([(s, d, 1.0) for s, d in edges], "src long, dst long, w double")
    got = {r.ring for r in graphs.rings(df, range(3, 6)).collect()}
    want = set()
    for n in range(3, 6):
        for p in itertools.permutations(range(10), n):
            if p[0] == min(p) and all((a, b) in edges for a, b in zip(p, p[1:] + p[:1], strict=True)):
                want.add(">".join(map(str, p)))
    assert got == want


def test_greedy_modularity_finds_planted_groups(spark):
    edges = [(g * 10 + a, g * 10 + b, 1.0) for g in range(4) for a in range(6) for b in range(a)] + [(g * 10, (g + 1) % 4 * 10, 0.1) for g in range(4)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    label = graphs.greedy_modularity(df)
    got = {r.id: r.label for r in label.collect()}
    assert all(len({got[g * 10 + a] for a in range(6)}) == 1 for g in range(4)) and len(set(got.values())) == 4
    alone = label.select("id", F.col("id").alias("label"))
    assert graphs.modularity(df, label).first()[0] > graphs.modularity(df, alone).first()[0]


def test_cusum_rows_carry_their_state(spark):
    rng = random.Random(11)
    rows = [(k, i, rng.uniform(-3, 3) if rng.random() < 0.9 else None) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, v double").withColumn("m", F.lit(0.1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(tuple(r) for r in series.cusum_rows(df, "k", ["i"], "v", "m", 0.5, 4.0).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(3):
        sums, at = (0.0, 0.0), 0
        for _, _, v in (r for r in rows if r[0] == k and r[2] is not None):
            at += 1
            sums, alarms = series.cusum_step(sums, v - 0.1, 0.5, 4.0)
            want += [(k, at, side, top) for side, top in alarms]
    assert got == sorted(want) and len(want) > 3


def test_one_side_of_a_cusum_starts_anew():
    assert series.cusum_step((5.0, 2.0), 1.0, 0.5, 5.0) == ((0.0, 0.5), [("up", 5.5)])


def test_strongest_spans_against_all_pairs(spark):
    rng = random.Random(12)
    rows = [(i, i % 4, b, b + rng.randint(1, 90), rng.randint(1, 3)) for i, b in enumerate(rng.randint(0, 300) for _ in range(120))]
    got = {r.id for r in series.strongest_spans(spark.createDataFrame(rows, "id int, k int, b int, e int, l int"), ["k"], "b", "e", "l", "id").collect()}
    beats = lambda x, y: x[4] > y[4] or (x[4] == y[4] and (x[2], x[0]) < (y[2], y[0]))
    assert got == {y[0] for y in rows if not any(x[1] == y[1] and x[0] != y[0] and x[2] < y[3] and y[2] < x[3] and beats(x, y) for x in rows)}


def test_assignments(spark):
    projects = [(u, u * 100 + i, (i * 3 + u) % 7) for u in range(3) for i in range(5)]
    staff = [(u, u * 10 + i, (i * 2 + u) % 7) for u in range(3) for i in range(3)]
    p, a = spark.createDataFrame(projects, "unit int, project long, need long"), spark.createDataFrame(staff, "unit int, auditor long, skill long")
    greedy = {r.project: r.auditor for r in simulate.assigned(p, a, True).collect()}
    best = {r.project: r.auditor for r in simulate.assigned(p, a, False).collect()}
    for u in range(3):
        need, skill = np.array([x[2] for x in projects if x[0] == u]), np.array([x[2] for x in staff if x[0] == u])
        cost = simulate.cost_of(need, skill)
        assert [greedy[u * 100 + j] - u * 10 for j in range(5)] == simulate.greedily(cost)
        total = lambda who: cost[list(who), range(5)].sum() + 0.1 * np.bincount(who, minlength=3).max()  # noqa: E731, B023
        least = min(total(w) for w in itertools.product(range(3), repeat=5))
        assert total([best[u * 100 + j] - u * 10 for j in range(5)]) == pytest.approx(least, abs=0.11)


def test_draws_of_returns(spark):
    base = spark.createDataFrame([(1000.0, 300.0)], "cost double, saving double")
    r = simulate.returns(spark, base, 4000, 7).first()
    want = -1000 + 300 * sum(1 / 1.08**y for y in range(1, 6))
    assert r.p10 < r.p50 < r.p90 and abs(r["mean"] - want) < 15 and 0 < r.losing < 0.5


def test_versions(spark):
    log = spark.createDataFrame([(1, i + 1, k) for i, k in enumerate(["patch", "minor", "patch", "major", "patch", "minor"])], "p int, n int, kind string")
    got = [(r.old_version, r.new_version) for r in audits.versions(log, "p", "n", "kind").orderBy("n").collect()]
    assert [b for _, b in got] == ["1.0.1", "1.1.0", "1.1.1", "2.0.0", "2.0.1", "2.1.0"] and [a for a, _ in got] == ["1.0.0", *[b for _, b in got[:-1]]]


def test_zones_bear_odd_records(spark):
    rows = spark.createDataFrame([(1, None), (2, "not json"), (3, "[]"), (4, '{"amount": "1,000", "company": "C"}')], "id int, raw string")
    master = spark.createDataFrame([("1", "one")], "code string, name string")
    got = {r.id: r for r in zones.standardised(rows, "raw", master).collect()}
    assert len(got) == 4 and got[4].amount == 1000.0 and "amount_type_converted" in got[4].flags and got[2].company_code == "UNKNOWN"
    assert zones.landed(rows.withColumn("s", F.lit(None).cast("string")), "raw", "s", "b").count() == 4


def test_asked_postings_are_the_postings(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b d"), (3, None)], "id int, text string")
    queries = spark.createDataFrame([(1, "b"), (1, "z"), (2, "b")], "query int, term string")
    got = sorted(tuple(r) for r in retrieval.asked_postings(docs, "id", F.col("text"), queries).collect())
    assert got == [(1, "b", 2), (2, "b", 1)]


def test_nearest_by_a_score_that_two_distances_share(spark):
    """3.3 - 2.2 and 4.4 - 3.3 differ in the last digits only, their scores do not: the smaller id wins, as when ordered by score."""
    below, above = 3.3 - 2.2, 4.4 - 3.3
    score = lambda d: 1 / (1 + d / 1000)
    assert below != above and score(below) == score(above)
    far, near = (2.2, 4.4) if below > above else (4.4, 2.2)
    targets = spark.createDataFrame([(1, 1, 3.3)], "t long, g int, v double")
    for small, large in ((far, near), (near, far)):
        candidates = spark.createDataFrame([(7, 1, small), (8, 1, large)], "c long, g int, v double")
        got = joins.nearest(targets, candidates, ["g"], "v", "t", "c", 400.0, score).collect()
        assert [r.c for r in got] == [7]


def test_record_pairs_are_not_shuffled_by_name(spark):
    """Few pairs of names come to the pairs of records by a broadcast, so that the pairs stay where they were made."""
    a = F.col("id")
    rows = spark.range(300).select("id", F.when(a % 2 == 0, "north steel").otherwise("south steel").alias("name"), (100.0 + a % 3).alias("incl"), (90.0 + a % 3).alias("excl"), F.lit(10.0).alias("tax"), F.lit(1.0).alias("quantity"), F.lit("2024-01-01").cast("date").alias("date"))
    got = joins.record_matches(rows, rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {r.id: r.match for r in got.collect()} == {i: i % 6 for i in range(300)}


def _records(r, n, names, start=0):
    day = lambda: None if r.random() < 0.1 else datetime.date(2024, 1, 1) + datetime.timedelta(r.randint(0, 50))
    out = []
    for i in range(n):
        x = r.choice([100.0, 101.0, 104.0, 250.0]) * r.choice([0.97, 0.99, 1.0, 1.0, 1.002, 1.01])
        out.append((start + i // 2 * 2, r.choice(names), r.choice([x] * 9 + [0.0]), x / 1.13 * r.choice([1.0, 1.0, 1.01]), r.choice([None, x * 0.13]), float(r.randint(0, 3)), day(), r.choice("uv")))
    return out


RECORD = "id long, name string, incl double, excl double, tax double, quantity double, date date, side string"


@pytest.mark.parametrize("name_pairs", [200_000, 0])
def test_record_matches_step_by_step_against_all_pairs(spark, monkeypatch, name_pairs):
    """What finds no score that lacks little looks further; ids may come twice, with the same or with another record."""
    monkeypatch.setattr(joins, "FEW_MEETINGS", 0)
    monkeypatch.setattr(joins, "NAME_PAIRS", name_pairs)
    rng = random.Random(8)
    names = ["acme works", "acme work", "bluesky", "north steel", "", None, *("".join(rng.choice("abc ") for _ in range(8)) for _ in range(12))]
    left, right = _records(rng, 160, names), _records(rng, 120, names, 1000)

    def score(a, b):
        total, weight = 0.2 * difflib.SequenceMatcher(None, a[1], b[1]).ratio() if a[1] and b[1] else 0.0, 0.2
        for k, (w, t) in zip((2, 3, 4, 5), joins.RECORD_PARTS.values(), strict=True):
            if (a[k] or 0) > 0 and (b[k] or 0) > 0:
                total, weight = total + w * max(0.0, 1 - abs(a[k] - b[k]) / a[k] / max(2 * t, 0.01)), weight + w
        if a[6] and b[6]:
            total, weight = total + 0.1 * max(0, 1 - abs((a[6] - b[6]).days) / 30), weight + 0.1
        return total / weight

    got = joins.record_matches(spark.createDataFrame(left, RECORD), spark.createDataFrame(right, RECORD), by=("side",)).collect()
    assert sorted((x.id, x.side) for x in got) == sorted((a[0], a[7]) for a in left)
    lacks = set()
    for x in got:
        own = [a for a in left if (a[0], a[7]) == (x.id, x.side) and a[2] > 0]
        known = [(round(score(a, b), 9), -b[0]) for a in own for b in right if a[7] == b[7] and b[2] > 0]
        best = max((k for k in known if k[0] >= 0.7), default=None)
        assert (x.match, x.score and round(x.score, 9)) == ((-best[1], best[0]) if best else (None, None))
        lacks.add(sum(1 - best[0] > lack for lack in joins.LACKS) if best else None)
    assert lacks == {0, 1, 2, 3, None}  # every step settles some


def test_record_pairs_far_from_the_best_are_not_met(spark, monkeypatch):
    """Of records whose best lacks little, fewer pairs are scored than lie within 4 % of an amount."""
    monkeypatch.setattr(joins, "FEW_MEETINGS", 0, raising=False)
    seen, plain = spark.sparkContext.accumulator(0), joins.record_score

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    monkeypatch.setattr(joins, "record_score", lambda a, b, likeness: plain(a, b, likeness + 0 * counted(F.col(b + "incl"))))
    a = F.col("id")
    rows = spark.range(1000).select("id", F.when(a % 2 == 0, "north steel").otherwise("sunny").alias("name"), (1000.0 + 2 * a).alias("incl"), (900.0 + 2 * a).alias("excl"), F.lit(10.0).alias("tax"), F.lit(1.0).alias("quantity"), F.lit("2024-01-01").cast("date").alias("date"))
    got = {x.id: x.match for x in joins.record_matches(rows, rows).collect()}
    assert got == {i: i for i in range(1000)}
    within = sum(abs(i - j) * 2 <= 0.04 * (1000 + 2 * i) for i in range(1000) for j in range(1000))
    assert 1000 <= seen.value < within / 3


def test_records_of_one_id_are_matched_apart(spark, monkeypatch):
    """An id with two records has the better match of both; another id with one of these records has that record's."""
    monkeypatch.setattr(joins, "FEW_MEETINGS", 0)
    schema = "id long, name string, incl double, excl double, tax double, quantity double, date date"
    one = lambda i, x: (i, "sunny", x, x / 1.13, x / 10, 3.0, None)
    got = joins.record_matches(spark.createDataFrame([one(1, 1000.0), one(1, 2000.0), one(2, 1000.0), one(3, 2000.0)], schema), spark.createDataFrame([one(7, 1010.0), one(8, 2000.0)], schema))
    assert sorted((x.id, x.match) for x in got.collect()) == [(1, 8), (1, 8), (2, 7), (3, 8)]


def test_records_equal_to_nine_decimals_are_ties(spark):
    """As in the SQL beside join_4way, the smaller id is taken, though the other's score is larger in its last digits."""
    schema = "id long, name string, incl double, excl double, tax double, quantity double, date date"
    one = lambda i, x: (i, "sunny", 1000.0, x, 100.0, 3.0, None)
    got = joins.record_matches(spark.createDataFrame([one(1, 900.0)], schema), spark.createDataFrame([one(7, 900.0 + 1e-10), one(8, 900.0)], schema))
    assert [x.match for x in got.collect()] == [7]
