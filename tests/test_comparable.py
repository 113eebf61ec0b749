"""The most comparable companies against all pairs, and how few of them are scored."""

import random

from pyspark.sql import functions as F

from quillon.operators import stats

SCHEMA = "id long, country int, region int, industry int, sub int, revenue double, margin double, roa double, functions array<int>"


def some(rng, n, kinds):
    made = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1]), rng.choice([0, 1, 2, None]), rng.randint(0, 2), rng.choice([0.0, 0.1, 0.2]), rng.choice([0.0, 0.15]), rng.choice([[1, 2], [2, 3, 4], [], None])) for _ in range(kinds)]
    rows = []
    for i in range(1, n + 1):
        country, region, industry, sub, margin, roa, functions = rng.choice(made)
        rows.append((i, country, region, industry, sub, rng.choice([None, -5.0, 100.0, 100.0 + 1e-8, round(rng.uniform(1, 900), 2)]), margin, roa, functions))
    return rows


def scored(t, c):
    _, country, region, industry, sub, revenue, margin, roa, functions = range(9)
    same = lambda i: t[i] is not None and t[i] == c[i]
    size = min(t[revenue], c[revenue]) / max(t[revenue], c[revenue]) if (t[revenue] or 0) > 0 and (c[revenue] or 0) > 0 else 0.5
    shared = 0.5 if t[functions] is None or c[functions] is None or not (t[functions] or c[functions]) else len(set(t[functions]) & set(c[functions])) / len(set(t[functions]) | set(c[functions]))
    returns = max(0.0, 1 - abs(t[margin] - c[margin]) - abs(t[roa] - c[roa])) if t[margin] != 0 or t[roa] != 0 else 0.5
    parts = [(0.3, (1.0 if same(sub) else 0.8) if same(industry) else 0.1), (0.2, 1.0 if same(country) else 0.7 if same(region) else 0.0), (0.2, size), (0.15, shared), (0.15, returns)]
    out = parts[0][0] * parts[0][1]
    for w, p in parts[1:]:
        out += w * p
    return round(out, 9)


def test_comparable_as_all_pairs(spark):
    for n, kinds, k in ((150, 12, 5), (60, 60, 4), (4, 3, 5), (40, 1, 3)):
        rows = some(random.Random(n), n, kinds)
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted((r.target, r["rank"], r.candidate, round(r.score, 9)) for r in stats.comparable(df.where("id % 4 = 0"), df, k).collect())
        want = []
        for t in rows[3::4]:
            best = sorted((-scored(t, c), c[0]) for c in rows if c[0] != t[0])[:k]
            want += [(t[0], i + 1, c, -s) for i, (s, c) in enumerate(best)]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, sorted(want), strict=True))


def test_few_companies_are_scored(spark):
    rows = some(random.Random(2), 2000, 80)
    df = spark.createDataFrame(rows, SCHEMA).where("revenue > 0")
    asked, c = stats.comparable_kinds(df.where("id % 20 = 0"), df, 5)
    met, n = asked.join(c, "p").count(), df.count()
    assert met < 0.2 * n * df.where("id % 20 = 0").count()
    assert asked.select(F.countDistinct("target")).first()[0] == df.where("id % 20 = 0").count()
