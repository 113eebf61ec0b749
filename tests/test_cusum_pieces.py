"""A CUSUM over pieces of a series against one fold over the whole."""

import random

import duckdb
from pyspark.sql import functions as F

from quillon.functions import numbers
from quillon.operators import series


def fold(values, k, h):
    sums, out = (0.0, 0.0), []
    for i, z in enumerate(values, 1):
        sums, alarms = series.cusum_step(sums, z, k, h)
        out += [(i, side, round(top, 6)) for side, top in alarms]
    return out


def test_map_gives_the_exit_of_every_entry():
    rng = random.Random(5)
    for _ in range(400):
        k, h, drift = rng.choice([0.0, 0.5]), rng.choice([3.0, 8.0]), rng.choice([-0.5, 0.0, 0.4, 2.0])
        zs = [rng.gauss(drift, rng.choice([0.2, 1.5])) for _ in range(rng.randint(0, 60))]
        way = series.CusumMap(k, h)
        for z in zs:
            way.step(z)
        for s in [0.0, h, *[rng.uniform(0, h) for _ in range(20)]]:
            sums = (s, 0.0)
            for z in zs:
                sums, _ = series.cusum_step(sums, z, k, h)
            assert abs(series.cusum_exit(s, way.row()) - sums[0]) < 1e-9


def test_one_key_in_many_pieces(spark):
    rng = random.Random(6)
    rows = [("hot", i, rng.gauss(0.45 if i % 700 < 300 else -0.2, 1.0)) for i in range(6000)] + [(f"k{j}", i, rng.gauss(0.4, 1.0)) for j in range(12) for i in range(j * 9)] + [("gap", 1, None), ("gap", 2, 9.0), *[(None, i, rng.gauss(0.6, 1.0)) for i in range(700)]]
    order = rows[:]
    rng.shuffle(order)
    df = spark.createDataFrame(order, "k string, i int, v double").withColumn("m", F.lit(0.0))
    got = {}
    for r in series.cusum_rows(df, "k", ["i"], "v", "m", 0.5, 6.0, pieces=45).collect():
        got.setdefault(r.k, []).append((r["at"], r.side, round(r["sum"], 6)))
    want = {}
    for name in {r[0] for r in rows}:
        alarms = fold([v for n, _, v in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]) if v is not None], 0.5, 6.0)
        if alarms:
            want[name] = alarms
    assert {n: sorted(a) for n, a in got.items()} == {n: sorted(a) for n, a in want.items()}
    assert len(want["hot"]) > 20


def test_keys_of_whole_numbers_and_none_at_all(spark):
    rng = random.Random(7)
    rows = [(key, i, rng.gauss(0.6, 1.0)) for key in (None, 2**60 + 1, 2**60 + 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i int, v double").withColumn("m", F.lit(0.0))
    got = {}
    for r in series.cusum_rows(df, "k", ["i"], "v", "m", 0.5, 4.0, pieces=18).collect():
        got.setdefault(r.k, []).append((r["at"], r.side, round(r["sum"], 6)))
    assert {n: sorted(a) for n, a in got.items()} == {key: fold([v for n, _, v in rows if n == key], 0.5, 4.0) for key in (None, 2**60 + 1, 2**60 + 2)}
    assert series.cusum_rows(df.limit(0), "k", ["i"], "v", "m").collect() == []


def test_sums_to_the_last_bit_over_pieces(spark):
    """Sums that go through whole pieces are those of one fold, bit by bit, and are rounded as SQL rounds them."""
    rng = random.Random(8)
    rows = [(key, i, round(rng.gauss(0.5, 0.8), 2)) for key in ("a", "b", "c") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v double").withColumn("m", F.lit(1.0 / 3.0))
    got = {(r.k, r["at"], r.side): r.sum for r in series.cusum_rows(df, "k", ["i"], "v", "m", 0.01, 40.0, pieces=24).collect()}
    want = {}
    for key in ("a", "b", "c"):
        sums = (0.0, 0.0)
        for i, v in enumerate((v for n, _, v in rows if n == key), 1):
            sums, alarms = series.cusum_step(sums, v - 1.0 / 3.0, 0.01, 40.0)
            want |= {(key, i, side): top for side, top in alarms}
    assert want and got == want
    halves = [x / 100000 for x in range(100005, 700000, 730)]
    out = spark.createDataFrame([(x,) for x in halves], "x double").select(numbers.rounded(F.col("x"), 4)).collect()
    assert [r[0] for r in out] == [duckdb.execute("select round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in halves]


def test_means_are_added_in_order(spark):
    rng = random.Random(9)
    rows = [(f"k{j}", i, rng.uniform(0, 1000) * 10 ** rng.randint(-3, 3)) for j in range(9) for i in range(300)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, i int, v double").repartition(5)
    want = {}
    for name, _, v in sorted(rows):
        want[name] = want.get(name, 0.0) + v
    assert {r.k: r.m for r in series.ordered_means(df, "k", ["i"], "v").collect()} == {name: v / 300 for name, v in want.items()}
    assert all(abs(r.m - want[r.k] / 300) < 1e-6 * want[r.k] for r in series.ordered_means(df, "k", ["i"], "v", most=100).collect())
