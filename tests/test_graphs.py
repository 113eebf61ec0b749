"""Graphs with hubs, long chains and rings, against plain walks."""

import itertools
import random

from pyspark.sql import functions as F

from quillon.operators import graphs


def reach(edges, a):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for s, d in edges:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_strong_components_and_rings_as_brute_force(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(16), rng.randrange(16)) for _ in range(30)} | {(100, 101), (101, 102), (102, 100), (102, 103), (200, 200)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    nodes = {x for e in edges for x in e}
    to = {a: reach(edges, a) for a in nodes}
    want = {a: max(b for b in to[a] if a in to[b]) for a in nodes if any(b != a and a in to[b] for b in to[a])}
    assert {r.id: r.component for r in graphs.strong(df).collect()} == want
    rings = set()
    for n in (3, 4):
        for path in itertools.permutations(sorted(nodes), n) if n == 3 else ():
            if path[0] == min(path) and all((a, b) in edges for a, b in zip(path, path[1:] + path[:1], strict=True)):
                rings.add((n, ">".join(map(str, path))))
    got = {(r.length, r.ring) for r in graphs.rings(df, [3]).collect()}
    assert got == rings and (3, "100>101>102") in got


def test_a_hub_without_rings_makes_no_paths(spark):
    n = 10_000
    hub = spark.range(1, n + 1).select("id", F.lit(0).cast("long").alias("hub"))
    df = hub.where("id <= 5000").select(F.col("id").alias("src"), F.col("hub").alias("dst")).unionAll(hub.where("id > 5000").select(F.col("hub").alias("src"), F.col("id").alias("dst")))
    assert graphs.core(df).count() == 0
    assert graphs.rings(df, [3, 4, 5, 6]).count() == 0


def test_trees_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(130)] + [(1000 + i, 50) for i in range(20)] + [(5000, 5001), (5001, 5000), (5002, 5000)]
    got = {r.id: r for r in graphs.tree(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert len(got) == 150 and got[129].level == 129 and got[129].path == "/".join(map(str, range(130)))
    assert got[50].children == 21 and got[1003].level == 51


def test_components_of_a_long_chain(spark):
    df = spark.range(1, 200).select((F.col("id") * 7 % 201).alias("src"), ((F.col("id") + 1) * 7 % 201).alias("dst"))
    assert graphs.components(df).select("component").distinct().count() == 1


def test_levels_raise_modularity_on_a_ring_of_cliques(spark):
    edges, k, size = [], 24, 4
    for c in range(k):
        edges += [(c * size + i, c * size + j, 1.0) for i in range(size) for j in range(i)]
        edges.append((c * size, (c * size + size + 1) % (k * size), 1.0))
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    score = lambda label: graphs.modularity(df, label).first()[0]
    one, many = graphs.greedy_modularity(df), graphs.louvain(df)
    assert many.count() == k * size and many.select("label").distinct().count() < k
    assert score(many) > score(one) + 1e-4
    rng = random.Random(7)
    mixed = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 5))) for _ in range(150)], "src long, dst long, w double").where("src <> dst")
    score = lambda label: graphs.modularity(mixed, label).first()[0]
    assert score(graphs.louvain(mixed)) >= score(graphs.greedy_modularity(mixed)) - 1e-12


def test_first_rows_in_no_single_task(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 13).cast("double").alias("risk")).repartition(7)
    want = sorted(((i, float(i * 7919 % 13)) for i in range(1000)), key=lambda r: (-r[1], r[0]))[:100]
    assert sorted(map(tuple, graphs.first_rows(df, [F.desc("risk"), "id"], 100).collect())) == sorted(want)


def test_pairs_do_not_swap_for_ever(spark):
    """Two nodes that want each other's community join, whichever halves they fall into."""
    edges = spark.createDataFrame([(2 * i, 2 * i + 1, 1.0) for i in range(64)], "src long, dst long, w double")
    assert {(r.id, r.label) for r in graphs.louvain(edges).collect()} == {(i, i - i % 2) for i in range(128)}
