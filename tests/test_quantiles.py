"""Exact places of groups of any spread, and how few values are put in order."""

import random

from pyspark.sql import functions as F

from quillon.operators import stats


def test_places_by_rank_whatever_the_spread(spark):
    rng, groups = random.Random(6), {}
    groups["far"] = [rng.random() for _ in range(6000)] + [1e300, -1e300]
    groups["ties"] = [float(rng.randint(0, 3)) for _ in range(5000)]
    groups["one"] = [7.0]
    groups["two"] = [2.0, 1.0]
    groups["powers"] = [2.0 ** rng.randint(-300, 300) for _ in range(3000)]
    rows = [(g, v) for g, some in groups.items() for v in some] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    got = {r.g: r for r in stats.at_ranks(df, ["g"], "v", {"first": F.lit(0), "q1": F.floor(n / 4), "mid": F.floor((n - 1) / 2), "p99": F.floor((n - 1) * 0.99), "last": n - 1}).collect()}
    assert set(got) == set(groups)
    for g, some in groups.items():
        s, k = sorted(some), len(some)
        assert (got[g].n, got[g]["first"], got[g].q1, got[g].mid, got[g].p99, got[g]["last"]) == (k, s[0], s[k // 4], s[(k - 1) // 2], s[int((k - 1) * 0.99)], s[-1])


def test_draws_do_not_depend_on_partitions(spark):
    from quillon.operators.simulate import normal, uniform

    def drawn(parts):
        return sorted((r.id, r.g, r.u) for r in spark.range(0, 5000, 1, parts).select("id", normal(7).alias("g"), uniform(7).alias("u")).collect())

    one = drawn(1)
    assert one == drawn(6)
    g, u = [r[1] for r in one], [r[2] for r in one]
    assert abs(sum(g) / 5000) < 0.06 and abs(sum(x * x for x in g) / 5000 - 1) < 0.08
    assert abs(sum(u) / 5000 - 0.5) < 0.02 and 0 <= min(u) < max(u) < 1
