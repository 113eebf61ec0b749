"""Connected components: union-find in one task while the edges are few, else alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored

#: Edges, at 16 bytes each, up to which one task may hold them all. Beyond it no task does.
FEW_EDGES = 1 << 19


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (a, b) with a > b. Minima are pre-aggregated and joined back, so a hub is never gathered."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _joined(batches):
    """Union-find over all pairs of the one partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "component"])


def components(pairs: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(id, component) of every id in ``pairs``; component is the smallest id that can be reached. No pairs: no rows."""
    edges = stored(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b"))
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "id long, component long")
    before = None
    while True:
        edges = stored(_starred(_starred(edges, True), False))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("pmod(xxhash64(b, a), 1000000007)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
