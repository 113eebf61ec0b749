"""A stored index of vectors: coarse cells, eight-bit codes of what a cell's centre leaves, and an exact second pass.

Vectors are taken at unit length, so likeness is the cosine. Centres are fitted on a bounded sample; every vector is indexed. A
cell is stored in blocks, each with the codes of its vectors and, for each vector, how far its code is off. A code's product with
a question is wrong by no more than that, so what the codes cannot rule out is a set that holds the true answer; only those vectors
are read whole. The nearest cells of a question give a k-th score; another cell is read only if its centre and its widest angle
leave room for more. ``best`` is therefore exact; with ``exact=False`` it reads a share of the cells, the nearest, and ends.

Cases: a vector that is null, empty, all zeros, holds a null or a number that is not finite, or is not as long as most, is neither
indexed nor found, and as a question has no answers. Ids are unique. Ties go to the smaller id, cosines compared to nine places.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import cut

#: Vectors that the centres are fitted on (those with the smallest hash of their id), rounds of the fit, cells at most.
FIT, ROUNDS, CELLS = 16384, 12, 4096
#: Vectors of a block, questions of a bundle (about), blocks that a bundle meets in one place.
BLOCK, BUNDLE, SLOT = 1024, 256, 16
#: Cells of a question that are read first; share of the cells that are read where the answer need not be exact. How many answers a
#: share finds depends on the vectors (``recall`` measures it): of 64 nearly unordered dimensions .6 found .90 to .92, .7 found .94 to .96.
PROBES, SHARE = 8, 0.7
#: Questions with a cell that leave a task together, and bytes of an Arrow batch: a bundle and a block are some 200 KB, and a batch of Spark's
#: 10 000 rows would be gigabytes in a worker.
PAIRS, BATCH = 4096, "4m"
#: What rounding may take from a product of unit vectors.
SLACK = 1e-9

BLOCKS = "cell int, part int, n int, slack binary, ids binary, codes binary, low double, step double"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def unit(vector: Column) -> Column:
    """The vector at unit length as doubles; null where it has no direction."""
    v = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform(v, F.abs))
    scaled = _bound(top, lambda m: F.transform(v, lambda x: x / m))  # squares neither overflow nor vanish
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    whole = _bound(scaled, lambda w: _bound(norm(w), lambda n: F.transform(w, lambda x: x / n)))
    return F.when((F.size(vector) > 0) & ~odd & (top > 0), whole)


def centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Directions of ``cells`` groups at most of unit vectors; an emptied group keeps its last direction."""
    distinct = np.unique(sample, axis=0)
    at = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(ROUNDS if len(at) else 0):
        own = np.concatenate([np.argmax(part @ at.T, axis=1) for part in np.array_split(sample, -(-len(sample) // BLOCK))])
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), at)
        if np.abs(moved - at).max() < 1e-6:
            break
        at = moved
    return at


def _dealt(df: DataFrame, id_: str, size: int, name: str) -> DataFrame:
    """Rows with the place of their hash among as many places as their cell needs for ``size`` rows each. Counts are a row a cell."""
    counts = df.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("_places"))
    return df.join(F.broadcast(counts), "cell").withColumn(name, F.pmod(F.xxhash64(id_), F.col("_places")).cast("int")).drop("_places")


def build(df: DataFrame, id_: str, vector: str, path: str, cells: int | None = None) -> None:
    """Writes the index at ``path``: vectors with their cell, blocks of codes, cells with their centre and the cosine of their farthest
    vector. ``cells`` is the square root of the rows if not given, CELLS at most."""
    spark = df.sparkSession
    rows = cut(df.select(F.col(id_).cast("long").alias("id"), unit(F.col(vector)).alias("v")).where("v is not null"))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    dim, n = (most.dim, most.n) if most else (0, 0)
    rows = rows.where(F.size("v") == dim)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(FIT).select("v").collect()
    at = centres(np.array([r.v for r in some]).reshape(len(some), dim), min(cells or max(1, round(n**0.5)), CELLS))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.iloc[i : i + BLOCK]
                products = np.stack(part["v"].to_numpy()) @ at.T
                own = products.argmax(axis=1)
                yield part.assign(cell=own.astype("int32"), near=products[np.arange(len(own)), own])

    rows.mapInPandas(assign, "id long, v array<double>, cell int, near double").write.mode("overwrite").parquet(f"{path}/vectors")
    placed = spark.read.parquet(f"{path}/vectors")

    def pack(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        v, centre = np.stack(block["v"].to_numpy()), at[key[0]]
        left = v - centre
        low = float(left.min())
        step = float(left.max() - low) / 255 or 1.0
        codes = np.rint((left - low) / step).clip(0, 255).astype("uint8")
        off = np.linalg.norm(left - (low + codes * step), axis=1) + SLACK
        one = (key[0], key[1], len(v), off.astype("<f8").tobytes(), block["id"].to_numpy("<i8").tobytes(), codes.tobytes(), low, step)
        return pd.DataFrame([one], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    blocks = _dealt(placed, "id", BLOCK, "part").groupBy("cell", "part").applyInPandas(pack, BLOCKS)
    blocks.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/blocks")
    kept = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("farthest"))
    directions = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, centre array<double>")
    directions.join(kept, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # CELLS rows at most


def _paired(part: pd.DataFrame, at: np.ndarray, cells: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows ``at`` of ``part`` with their cells, PAIRS at a time: vectors repeat with every cell and would fill a worker."""
    for i in range(0, len(at), PAIRS):
        yield part.iloc[at[i : i + PAIRS]].assign(cell=cells[i : i + PAIRS])


class _Cells:
    """The cells' table in memory: CELLS rows at most."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.ids = np.array([r.cell for r in rows], dtype="int32")
        self.at = np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))
        self.dim = self.at.shape[1]
        self.angles = np.arccos(np.clip([r.farthest for r in rows], -1, 1)) + 1e-7 if rows else np.zeros(0)

    def near(self, questions: DataFrame, probes: int) -> DataFrame:
        """(query, v, floor, cell) of the ``probes`` nearest cells."""
        ids, at = self.ids, self.at

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), BLOCK):
                    part = batch.iloc[i : i + BLOCK]
                    best = np.argsort(-(np.stack(part["v"].to_numpy()) @ at.T), axis=1, kind="stable")[:, :probes]
                    yield from _paired(part.assign(floor=-2.0), np.repeat(np.arange(len(part)), best.shape[1]), ids[best.ravel()])

        return questions.mapInPandas(pick, "query long, v array<double>, floor double, cell int")

    def promising(self, questions: DataFrame, probes: int) -> DataFrame:
        """(query, v, floor, cell) of the other cells that may hold a vector as near as ``floor``."""
        ids, at, angles = self.ids, self.at, self.angles

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), BLOCK):
                    part = batch.iloc[i : i + BLOCK]
                    products = np.stack(part["v"].to_numpy()) @ at.T
                    most = np.cos(np.maximum(np.arccos(np.clip(products, -1, 1)) - angles, 0))
                    open_ = most >= part["floor"].to_numpy()[:, None] - SLACK
                    np.put_along_axis(open_, np.argsort(-products, axis=1, kind="stable")[:, :probes], False, axis=1)
                    q, c = np.nonzero(open_)
                    yield from _paired(part, q, ids[c])

        return questions.mapInPandas(pick, "query long, v array<double>, floor double, cell int")


def _undecided(spark: SparkSession, path: str, cells: _Cells, wanted: DataFrame, k: int) -> DataFrame:
    """(query, id, cell, low, high) of what the codes leave of the wanted (query, v, floor, cell): in each block, all that its k-th
    surest does not beat. Questions meet blocks in bundles; a cell of many blocks lies in many places."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    at = dict(zip(cells.ids.tolist(), cells.at, strict=True))
    some = [r[0] for r in wanted.select("cell").distinct().collect()]  # CELLS at most
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("cell").isin(some or [-1])).withColumn("slot", F.floor(F.col("part") / SLOT))
    places = blocks.groupBy("cell").agg((F.max("slot") + 1).alias("slots"))
    bundles = _dealt(wanted, "query", BUNDLE, "bundle").groupBy("cell", "bundle").agg(F.collect_list(F.struct("query", "v", "floor")).alias("asked"))
    bundles = bundles.join(F.broadcast(places), "cell").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots", "bundle")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, off = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.slack, "<f8")
                codes = np.frombuffer(r.codes, "uint8").reshape(r.n, -1)
                query = np.array([a["query"] for a in r.asked])
                products = np.stack([a["v"] for a in r.asked]) @ (at[r.cell] + r.low + codes * r.step).T
                low, high = products - off, products + off
                floor = np.array([a["floor"] for a in r.asked]) - SLACK
                if r.n > k:
                    floor = np.maximum(floor, np.partition(low, r.n - k, axis=1)[:, r.n - k])
                q, x = np.nonzero(high >= floor[:, None])
                yield pd.DataFrame({"query": query[q], "id": ids[x], "cell": np.full(len(q), r.cell, "int32"), "low": low[q, x], "high": high[q, x]})

    met = bundles.join(blocks, ["cell", "slot"]).select("cell", "n", "slack", "ids", "codes", "low", "step", "asked")
    return met.mapInPandas(score, "query long, id long, cell int, low double, high double")


def _exact(spark: SparkSession, path: str, left: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query, id, score) of what is left once the k-th surest of all blocks is known, by the whole vectors."""
    left = cut(left)
    surest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"), "id"))
    floor = left.withColumn("_nth", surest).where(F.col("_nth") <= k).where(F.col("_nth") == k).select("query", F.col("low").alias("_floor"))
    held = left.join(floor, "query", "left").where(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor") - SLACK)).select("query", "id")
    whole = spark.read.parquet(f"{path}/vectors").select("id", "v")
    both = held.join(whole, "id").join(questions.select("query", F.col("v").alias("w")), "query")
    return both.select("query", "id", F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))


def best(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True, others: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query, id, rank, score), the ``k`` nearest to each of ``queries`` (query, vector); ``others`` leaves out the id that is the
    query's own. And (cells, read): cells that the questions could meet, and how many they met."""
    cells, many = _Cells(spark, path), k + others
    probes = probes or (PROBES if exact else math.ceil(SHARE * len(cells.ids)))
    questions = queries.select(F.col("query").cast("long").alias("query"), unit(F.col("vector")).alias("v"))
    questions = cut(questions.where(F.col("v").isNotNull() & (F.size("v") == cells.dim)))
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    ranked = lambda df, n: df.withColumn("score", F.round("score", 9)).withColumn("rank", nearest).where(F.col("rank") <= n)
    first = cut(cells.near(questions, probes))
    top = cut(ranked(_exact(spark, path, _undecided(spark, path, cells, first, many), questions, many), many))
    read = first.select("query", "cell")
    if exact:
        floor = top.where(F.col("rank") == many).select("query", F.col("score").alias("_floor"))
        asked = questions.join(floor, "query", "left").select("query", "v", F.coalesce("_floor", F.lit(-2.0)).alias("floor"))
        rest = cut(cells.promising(asked, probes))
        more = _exact(spark, path, _undecided(spark, path, cells, rest, many), questions, many)
        top, read = cut(ranked(top.drop("rank").unionByName(more), many)), read.unionAll(rest.select("query", "cell"))
    found = ranked(top.where("id <> query").drop("rank"), k) if others else top
    counts = questions.agg((F.count("*") * len(cells.ids)).alias("cells")).crossJoin(read.agg(F.count("*").alias("read")))  # one row each
    return found.select("query", "id", "rank", "score"), counts


def recall(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(answers, found): how many of the exact answers the nearest cells alone give."""
    whole = best(spark, path, queries, k)[0].select("query", "id")
    some = best(spark, path, queries, k, probes, exact=False)[0].select("query", "id", F.lit(1).alias("met"))
    return whole.join(some, ["query", "id"], "left").agg(F.count("*").alias("answers"), F.count("met").alias("found"))
