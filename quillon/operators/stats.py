"""Outlier statistics: first digits, fences, peer comparison, distance to the centre, isolation forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.functions.numbers import first_digit
from quillon.sources.scratch import cut

#: Critical value of chi-squared at 5 % with eight degrees of freedom.
CHI2 = 15.507


def benford(df: DataFrame, amount: str, keys: list[str] | None = None) -> DataFrame:
    """First digits 1 to 9 by group: digit, n, observed, expected, ratio, term of chi-squared. Digits that do not occur have n = 0."""
    keys = keys or []
    counts = df.select(*keys, first_digit(F.col(amount)).alias("digit")).where("digit between 1 and 9").groupBy(*keys, "digit").agg(F.count("*").alias("n"))
    wide = counts.groupBy(*keys).agg(F.sum("n").alias("total"), *[F.coalesce(F.max(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(1, 10)])
    long = wide.select(*keys, "total", F.explode(F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("n"), F.lit(math.log10(1 + 1 / d)).alias("expected")) for d in range(1, 10)])).alias("x")).select(*keys, "total", "x.*")
    long = long.withColumn("observed", F.col("n") / F.col("total")).withColumn("ratio", F.col("observed") / F.col("expected"))
    return long.withColumn("chi2", F.pow(F.col("n") - F.col("expected") * F.col("total"), 2) / (F.col("expected") * F.col("total")))


def benford_score(df: DataFrame, amount: str, keys: list[str], least: int = 10) -> DataFrame:
    """Chi-squared by group, its ratio to the critical value capped at 1, and the largest deviation of a share."""
    own = benford(df, amount, keys).groupBy(*keys).agg(F.max("total").alias("n"), F.sum("chi2").alias("chi2"), F.max(F.abs(F.col("observed") - F.col("expected"))).alias("max_dev"))
    return own.withColumn("score", F.when(F.col("n") >= least, F.least(F.col("chi2") / CHI2, F.lit(1.0))).otherwise(0.0))


#: Steps of the grid of a group's quantiles, and how exact the sketch is: a rank is off by 1 / SKETCH of the group at most.
GRID, SKETCH = 1024, 8192


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column a name): the values at given places, counted from 0, of each group in order; a place is an expression
    over ``n``, the group's size. Exact.

    A mergeable quantile sketch of each group gives two values, by rank and not by width, between which a place certainly lies:
    some four in GRID of the group's rows, however its values are spread. One more pass counts the rows below and, value by
    value, those between; only their distinct values are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], SKETCH)
    known = rows.groupBy(*keys).agg(F.count("*").alias("n"), grid.alias("_grid"))

    def ask(name: str, place: Column) -> Column:
        rank, off = place.cast("long"), GRID / SKETCH + 1
        share = rank.cast("double") / F.col("n") * GRID
        low, high = F.floor(share - off).cast("int"), F.ceil(share + off).cast("int")  # null where the group's end is the bound
        return F.struct(F.lit(name).alias("name"), rank.alias("rank"), F.when(low >= 0, F.get("_grid", low)).alias("low"), F.when(high <= GRID, F.get("_grid", high)).alias("high"))

    asked = known.select(*keys, "n", F.array(*[ask(name, place) for name, place in ranks.items()]).alias("_asks"))
    met = rows.join(asked.select(*keys, "_asks"), keys).select(*keys, "_v", F.explode("_asks").alias("_x")).where(F.col("_x.high").isNull() | (F.col("_v") <= F.col("_x.high")))
    inside = F.when(F.col("_x.low").isNull() | (F.col("_v") >= F.col("_x.low")), F.col("_v"))  # null: below
    counts = met.groupBy(*keys, F.col("_x.name").alias("_name"), F.col("_x.rank").alias("_rank"), inside.alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first()))
    hit = counts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k")))
    found = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return found.join(known.select(*keys, "n"), keys).select(*keys, "n", *ranks)


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, one column a name): percentiles of each group with linear interpolation between ranks; exact, and no task holds a
    group."""
    at = {k: (F.col("n") - 1) * p for k, p in points.items()}
    ends = {f"_{k}_{side}": f(place) for k, place in at.items() for side, f in (("a", F.floor), ("b", F.ceil))}
    got = at_ranks(df, keys, value, ends)
    return got.select(*keys, "n", *[(F.col(f"_{k}_a") + (F.col(f"_{k}_b") - F.col(f"_{k}_a")) * (place - F.floor(place))).alias(k) for k, place in at.items()])


def fences(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows with the group's fences at the quartiles less and plus ``k`` ranges, and whether they lie outside."""
    q = percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    q = q.select(*keys, (F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))).alias("low"), (F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))).alias("high"))
    return df.join(q, keys).withColumn("outside", (F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def price_profile(df: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """Mean, population deviation and five percentiles of groups with ``least`` rows or more."""
    points = {f"p{int(p * 100)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.95)}
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return percentiles(df, keys, value, points).where(F.col("n") >= least).join(moments, keys).select(*keys, "n", "mean", "std", *points)


def centre_distance(df: DataFrame, features: list[str]) -> DataFrame:
    """``distance`` of each row's standardised features (population deviation, 0 counts as 1) to their centre."""
    one = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    z = [F.pow((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0), 2) for f in features]
    return df.crossJoin(F.broadcast(one)).withColumn("distance", F.sqrt(sum(z[1:], z[0]))).select(*df.columns, "distance")


def top_share(df: DataFrame, score: str, share: float, into: str) -> DataFrame:
    """Whether a row's score is above the linear percentile 1 - ``share`` of all scores.

    The percentile's rank is looked for cell by cell: counts over CELLS equal cells between the ends say in which cell it
    lies, that cell is cut again, and the few values of the last one are put in order. No task holds all scores.
    """
    bound = linear_percentile(df, score, 1 - share)
    return df.withColumn(into, F.col(score) > bound) if bound is not None else df.withColumn(into, F.lit(None).cast("boolean"))


#: Cells of a search for a rank, and values that are put in order at its end.
CELLS, FEW = 4096, 100_000


def linear_percentile(df: DataFrame, value: str, p: float) -> float | None:
    """The percentile with linear interpolation between the ranks around (n - 1) p; None without values. Exact."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = (n - 1) * p
    wanted = [math.floor(at), math.ceil(at)]
    found = []
    for rank in wanted:
        found.append(_ranked_value(rows, rank, n, low, high))
    return found[0] + (found[1] - found[0]) * (at - wanted[0])


def _ranked_value(rows: DataFrame, rank: int, n: int, low: float, high: float) -> float:
    """The value with ``rank`` smaller or equal ones before it."""
    inside, before = n, 0
    while inside > FEW and low < high:
        width = (high - low) / CELLS
        own = rows.where(F.col("v").between(low, high))
        cell = F.least(F.floor((F.col("v") - low) / width), F.lit(CELLS - 1))
        counts = own.groupBy(cell.alias("c")).agg(F.count("*").alias("k"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("c").collect()  # CELLS rows at most
        for r in counts:
            if before + r.k > rank:
                low, high, inside = r.a, r.b, r.k
                break
            before += r.k
    if low == high:
        return low
    some = sorted(r.v for r in rows.where(F.col("v").between(low, high)).collect())  # FEW at most
    return some[rank - before]


class IsolationForest:
    """Random trees over a bounded sample; what is broadcast is ``trees`` times at most 2 * ``sample`` nodes."""

    def __init__(self, rows: np.ndarray, trees: int = 50, sample: int = 256, seed: int = 42) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.size = min(sample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grown(rows[rng.choice(len(rows), self.size, False)], rng, 0) for _ in range(trees)]

    def _grown(self, rows: np.ndarray, rng, depth: int):
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
        if depth >= self.depth or len(rows) < 2 or not spread.any():
            return depth + self.expected(len(rows))
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] < cut
        return f, cut, self._grown(rows[left], rng, depth + 1), self._grown(rows[~left], rng, depth + 1)

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depths(self, rows: np.ndarray) -> np.ndarray:
        """Mean depth of each row over the trees."""
        total = np.zeros(len(rows))

        def walk(node, at: np.ndarray) -> None:
            if not isinstance(node, tuple):
                total[at] += node
            elif len(at):
                left = rows[at, node[0]] < node[1]
                walk(node[2], at[left])
                walk(node[3], at[~left])

        for tree in self.trees:
            walk(tree, np.arange(len(rows)))
        return total / len(self.trees)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 where a row is soon alone."""
        return 2.0 ** (-self.depths(rows) / max(self.expected(self.size), 1e-9))


def isolation(df: DataFrame, id_: str, features: list[str], trees: int = 50, sample: int = 256, fit_rows: int = 10_000, seed: int = 42, depths: bool = False) -> DataFrame:
    """``iso`` of every row, its score or its mean depth; trees are fitted on the ``fit_rows`` rows with the smallest hashes of the id."""
    spark = df.sparkSession
    fit = df.orderBy(F.xxhash64(id_), id_).limit(fit_rows).select(*[F.col(f).cast("double") for f in features]).toPandas().to_numpy()
    if not len(fit):
        return df.withColumn("iso", F.lit(None).cast("double"))
    shared = spark.sparkContext.broadcast(IsolationForest(fit, trees, sample, seed))

    @pandas_udf("double")
    def iso(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(shared.value.depths(rows) if depths else shared.value.score(rows))

    return df.withColumn("iso", iso(*[F.col(f).cast("double") for f in features]))


def unsupervised(df: DataFrame, id_: str, features: list[str], least: float = 0.65, soonest: float = 0.05, farthest: float = 0.1) -> DataFrame:
    """Rows with ``iso``, ``distance``, ``by_forest``, ``by_centre`` and ``flagged``: rows whose forest score is above ``least`` or among
    the highest ``soonest`` of all (one at least, ties with the last included), and rows whose distance to the centre of the standardised
    features is among the largest ``farthest`` and not 0. Fewer than eight rows say nothing: none is flagged.

    Scores are written once; both bounds are places in them, found exactly without sorting them."""
    scored = cut(isolation(centre_distance(df, features), id_, features))
    bounds = {}
    for score, share in (("iso", soonest), ("distance", farthest)):
        place = {f"_{score}": F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * share))}
        bounds[score] = at_ranks(scored.withColumn("_one", F.lit(1)), ["_one"], score, place)
    one = bounds["iso"].join(bounds["distance"].drop("n"), "_one").drop("_one")  # a row at most
    met = scored.join(F.broadcast(one), F.lit(True), "left")
    enough = F.coalesce(F.col("n") >= 8, F.lit(False))
    flags = {"by_forest": enough & ((F.col("iso") > least) | (F.col("iso") >= F.col("_iso"))), "by_centre": enough & (F.col("distance") >= F.col("_distance")) & (F.col("distance") > 0)}
    return met.withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}).withColumn("flagged", F.col("by_forest") | F.col("by_centre")).drop("n", "_iso", "_distance")


def fused(parts: list[tuple[float, Column]]) -> Column:
    return sum((c * w for w, c in parts[1:]), parts[0][1] * parts[0][0])


def dense_matrix(df: DataFrame, rows: str, columns: str, *aggs: Column) -> DataFrame:
    """Every row value with every column value, empty cells included. The two lists of values are small by nature and multiply."""
    r, c = df.select(rows).distinct(), df.select(columns).distinct()
    return r.crossJoin(F.broadcast(c)).join(df.groupBy(rows, columns).agg(*aggs), [rows, columns], "left")


def ranked(df: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """Top ``k`` of each group, ties by id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_))).where(F.col("rank") <= k)


# Shares of first digits, rounded to three places.
ROUNDED = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}


def benford_rounded(df: DataFrame, amount: str, keys: list[str]) -> DataFrame:
    """The largest deviation, by group, of a share of first digits that are not 0 from the rounded table."""
    digits = df.select(*keys, F.regexp_extract(F.col(amount).cast("string"), "[1-9]", 0).alias("d")).where("d <> ''")
    wide = digits.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("d") == str(d)).alias(f"d{d}") for d in ROUNDED])
    return wide.select(*keys, F.greatest(*[F.abs(F.col(f"d{d}") / F.col("n") - e) for d, e in ROUNDED.items()]).alias("max_dev"))


def index_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, q1, q3): the values at places n // 4 and 3 n // 4 of each group in order."""
    return at_ranks(df, keys, value, {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)})


def group_scores(df: DataFrame, keys: list[str], value: str, id_: str) -> DataFrame:
    """(keys, id, group_score): z over six, .5 at most, and the excess beyond fences at index quartiles, .5 at most; .5 where a group
    has fewer than three values."""
    positive = df.where(F.col(value) > 0)
    moments = positive.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    ends = index_quartiles(positive, keys, value).join(moments, keys)
    v, low, high = F.col(value), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    z = F.when(F.col("_sd") > 0, F.abs((v - F.col("_m")) / F.col("_sd"))).otherwise(0.0)
    beyond = lambda gap, end: F.least(F.lit(0.5), gap / F.greatest(F.abs(end), F.lit(1.0)) * 2 + 0.3)
    excess = F.when(v < low, beyond(low - v, low)).when(v > high, beyond(v - high, high)).otherwise(0.0)
    score = F.when(F.coalesce("n", F.lit(0)) < 3, 0.5).otherwise(F.least(F.lit(0.5), z / 6) + excess)
    return df.join(ends, keys, "left").select(*keys, id_, score.alias("group_score"))


def peers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, std) of the positive values, with the sample deviation; 0 for a single value."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def fair_prices(df: DataFrame, price: str, peer: str, history: str, margin: str, owned: str, dependence: str) -> DataFrame:
    """Rows with ``score``: nearness to comparable prices (.45, from three on), to the party's history (.35, from two on) and a known
    margin (.2), over the first weights by the number of methods at hand, less for ownership and dependence."""
    near = lambda m, s: F.greatest(F.lit(0.0), 1 - F.abs((F.col(price) - F.col(m)) / F.when(F.col(s) == 0, 0.001).otherwise(F.col(s))) / 3)
    a = peers(df, [peer], price).toDF(peer, "_an", "_am", "_as")
    b = peers(df, [history], price).toDF(history, "_bn", "_bm", "_bs")
    met = df.join(a, peer, "left").join(b, history, "left")
    one = F.when(F.col("_an") >= 3, near("_am", "_as") * 0.45)
    two = F.when(F.col("_bn") >= 2, near("_bm", "_bs") * 0.35)
    three = F.when(F.col(margin) != 0, 0.2)
    methods = one.isNotNull().cast("int") + two.isNotNull().cast("int") + three.isNotNull().cast("int")
    weight = F.when(methods == 1, 0.45).when(methods == 2, 0.8).otherwise(1.0)
    adjust = 1 - 0.3 * F.least(F.lit(1.0), F.col(owned)) - 0.15 * F.least(F.lit(1.0), F.col(dependence))
    total = F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0)) + F.coalesce(three, F.lit(0.0))
    return met.select(*df.columns, F.when(methods == 0, 0.5).otherwise(total / weight * adjust).alias("score"))


def edge_risk(edges: DataFrame, src: str, dst: str, amount: str, bound: float, weights: tuple[float, float, float]) -> DataFrame:
    """(id, anomalies, risk): a party's degree among all parties, its transfers beyond ``bound`` deviations (a fifth each), and how
    one-sided its flows are, weighted."""
    one = edges.where(F.col(amount) > 0).agg(F.avg(amount).alias("_m"), F.stddev_pop(amount).alias("_s"))
    odd = F.abs((F.col(amount) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(0.01))) > bound
    z = edges.crossJoin(F.broadcast(one)).select(src, dst, amount, odd.alias("_odd"))
    ends = F.array(F.struct(F.col(src).alias("id"), F.lit(0.0).alias("i"), F.col(amount).cast("double").alias("o")), F.struct(F.col(dst).alias("id"), F.col(amount).cast("double").alias("i"), F.lit(0.0).alias("o")))
    got = z.select("_odd", F.explode(ends).alias("x")).groupBy("x.id").agg(F.count("*").alias("deg"), F.count_if("_odd").alias("anomalies"), F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    got = got.crossJoin(F.broadcast(got.agg(F.count("*").alias("_n"))))
    parts = [F.least(F.lit(1.0), F.col("deg") / F.greatest(F.col("_n") - 1, F.lit(1))), F.least(F.lit(1.0), F.col("anomalies") / 5.0), F.coalesce(F.try_divide(F.abs(F.col("i") - F.col("o")), F.col("i") + F.col("o")), F.lit(0.0))]
    return got.select("id", "anomalies", fused(list(zip(weights, parts, strict=True))).alias("risk"))


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Each feature less its mean over its population deviation, over 1 where that is 0."""
    one = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    return df.crossJoin(F.broadcast(one)).withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}).select(*df.columns)


# Weights, means and deviations of the credit model.
CREDIT = {"credit_score": (-0.035, 680, 80), "dti_ratio": (2.8, 0.35, 0.15), "ltv_ratio": (1.9, 0.75, 0.2), "employment_years": (-0.15, 8, 5), "default_history": (1.6, 0.3, 0.8), "loan_amount": (0.00002, 300_000, 200_000)}
CREDIT_BIAS = -1.2


def credit_logit(df: DataFrame) -> DataFrame:
    """Rows with ``logit`` and ``p``, the default probability by the fixed model; a missing figure counts as 0."""
    z = F.lit(CREDIT_BIAS)
    for name, (w, mean, std) in CREDIT.items():
        z = z + w * (F.coalesce(F.col(name), F.lit(0.0)) - mean) / std
    return df.withColumn("logit", z).withColumn("p", F.when(F.col("logit") < 500, 1 / (1 + F.exp(-F.col("logit")))).otherwise(1.0))


#: What companies of one kind have in common; of one kind only size and id differ.
KIND = ["country", "region", "industry", "sub", "functions", "margin", "roa"]
#: The share of size in the likeness of two companies, and what rounding may take from a score.
SIZE_PART, SCORE_SLACK = 0.20, 1e-8


def _comparable_score(size: Column) -> Column:
    """The likeness of a candidate of kind ``p`` to a target of kind ``q``, of which ``size`` is the part of their revenues."""
    c, o = lambda n: F.col("p." + n), lambda n: F.col("q." + n)
    parts = [
        (0.30, F.when((c("sub") == o("sub")) & (c("industry") == o("industry")), 1.0).when(c("industry") == o("industry"), 0.8).otherwise(0.1)),
        (0.20, F.when(c("country") == o("country"), 1.0).when(c("region") == o("region"), 0.7).otherwise(0.0)),
        (SIZE_PART, size),
        (0.15, F.coalesce(F.try_divide(F.size(F.array_intersect(c("functions"), o("functions"))), F.size(F.array_union(c("functions"), o("functions")))), F.lit(0.5))),
        (0.15, F.when((o("margin") != 0) | (o("roa") != 0), F.greatest(F.lit(0.0), 1 - F.abs(o("margin") - c("margin")) - F.abs(o("roa") - c("roa")))).otherwise(0.5)),
    ]
    return fused(parts)


def comparable_kinds(targets: DataFrame, candidates: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(target, q, asked, floor, p): the kinds ``p`` that may hold one of a target's ``k`` best, none of which scores below ``floor``; and
    the candidates (id, p, revenue)."""
    own = F.struct(*KIND)
    c = cut(candidates.select("id", own.alias("p"), "revenue"))
    t = cut(targets.select(F.col("id").alias("target"), own.alias("q"), F.col("revenue").alias("asked")))
    kinds, asked = cut(c.groupBy("p").agg(F.count("*").alias("n"))), cut(t.select("q").distinct())
    like = asked.crossJoin(kinds).select("q", "p", "n", _comparable_score(F.lit(1.0)).alias("_most"))
    # the kinds most alike that have k others together: each has one row at least, and the target may be one of theirs
    best = Window.partitionBy("q").orderBy(F.desc("_most"), F.desc("n"))
    top = like.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k + 1)
    before = F.sum("n").over(Window.partitionBy("q").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    first = cut(top.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= k).select("q", "p"))
    kth = ranked(_comparable_met(t.join(first, "q"), c), ["target"], "_s", "candidate", k).where(F.col("rank") == k)
    floors = cut(t.join(kth.select("target", F.col("_s").alias("floor")), "target", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))))
    least = floors.groupBy("q").agg(F.min("floor").alias("_least"))
    open_ = like.join(least, "q").where(F.col("_most") >= F.col("_least") - SCORE_SLACK).select("q", "p", "_most")
    return floors.join(open_, "q").where(F.col("_most") >= F.col("floor") - SCORE_SLACK).select("target", "q", "asked", "floor", "p"), c


def _comparable_met(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, candidate, score, _s) of all candidates of the kinds ``p`` that the targets ask for; ``_s`` to nine places, and ``floor`` if
    there."""
    x, y = F.col("asked"), F.col("revenue")
    size = F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y)).otherwise(0.5)
    met = asked.join(candidates, "p").where(F.col("id") != F.col("target"))
    floor = [c for c in asked.columns if c == "floor"]
    return met.select("target", F.col("id").alias("candidate"), _comparable_score(size).alias("score"), *floor).withColumn("_s", F.round("score", 9))


def comparable(targets: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(target, candidate, rank, score): the ``k`` candidates most like each of a stated set of targets. Exact.

    Companies of one kind differ in size alone, so kinds are compared once. The kinds most alike to a target's give it ``k`` scores,
    whose lowest is a floor; of all other kinds only those that reach it with the same size are met. Each task keeps ``k``
    candidates a target, so what is shuffled is bounded by targets and tasks. Where every company is a kind of its own, kinds
    are compared as companies would be.
    """
    asked, c = comparable_kinds(targets, candidates, k)
    met = _comparable_met(asked, c).where(F.col("_s") >= F.col("floor")).drop("floor")
    return ranked(met, ["target"], "_s", "candidate", k).drop("_s")
