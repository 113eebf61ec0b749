"""Pairs of alike names from an index of short runs of characters, without comparing all pairs.

The matching blocks of two names are a common subsequence. At a ratio above ``least`` they hold M characters or more of the s
that both names have, so at most D = s - 2 M characters stand between blocks, and there are at most D + 1 blocks: at least
T = M - (D + 1) pairs of neighbouring characters lie inside blocks and stand in both names, in the same order, each moved by no
more than the insertions or deletions allow. A prefix filter uses that. Each name's runs are put in one order, rare ones first;
of T runs in common, the first k lie among the first (runs - T + k) of either name. So names are indexed by all k-sets of those
runs, k-sets meet by key, places are held against the moves allowed, and no pair is lost. Where T is below one (low ``least``
or very short names), single characters stand in for runs, with M for T.

Names so long that their pieces have PIECE characters or more on average meet by pieces instead: of D + 1 pieces of the shorter name one at
least lies whole inside a block, as a character between blocks breaks one piece at most, and stands in the other name no further off than
its deletions and insertions allow. Names meet by lengths, piece and its text; every pair of lengths takes one of the two ways.

What meets is then bounded once more, by the edit distance, before a ratio is taken.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.similar import ratio
from quillon.sources.scratch import cut

#: Runs whose counts are broadcast to put the frequent last; others count as rare.
FREQUENT = 1 << 16
#: Sets of one kind that a name may be in, for names of one length together; decides how large the sets are.
MOST_KEYS = 500
#: Runs in a set, at most, for runs of one and of two characters.
MOST_RUNS = {1: 5, 2: 3}
#: Characters in a piece, on average at least, where names meet by pieces.
PIECE = 3.5


def least_matched(s: int, least: float) -> int:
    """Characters in blocks that a ratio above ``least`` needs, of ``s`` in both names."""
    return math.floor(least * s / 2 - 1e-9) + 1


def kind(s: int, least: float) -> tuple[int, int]:
    """(q, need) for names of ``s`` characters together: runs of q, and how many of them both have."""
    m = least_matched(s, least)
    t = 3 * m - s - 1
    return (2, t) if t >= 1 else (1, m)


def in_pieces(n: int, m: int, least: float) -> bool:
    """Whether names of ``n`` and ``m`` characters meet by pieces."""
    return min(n, m) >= PIECE * (n + m - 2 * least_matched(n + m, least) + 1)


class Sets:
    """Which sets of runs a name is indexed by, among names of the lengths in ``lengths``."""

    def __init__(self, least: float, lengths: list[int]) -> None:
        self.least, self.lengths, self.known, self.sizes = least, set(lengths), {}, {}

    def partners(self, n: int) -> list[int]:
        share = self.least / (2 - self.least)
        some = range(max(1, math.ceil(n * share - 1e-9)), math.floor(n / share + 1e-9) + 1)
        return [m for m in some if m in self.lengths and least_matched(n + m, self.least) <= min(n, m) and not in_pieces(n, m, self.least)]

    def pieced(self) -> list[tuple[int, int, int]]:
        """(n, m, D) of the lengths, n the shorter one, of names that meet by pieces."""
        share = self.least / (2 - self.least)
        pairs = [(n, m, n + m - 2 * least_matched(n + m, self.least)) for n in self.lengths for m in range(n, math.floor(n / share + 1e-9) + 1) if m in self.lengths]
        return [(n, m, d) for n, m, d in pairs if n > 0 and d >= m - n and in_pieces(n, m, self.least)]

    def k(self, s: int) -> int:
        """Runs in a set for names of ``s`` characters together: as many as leave their longest name MOST_KEYS sets."""
        if s not in self.sizes:
            q, need = kind(s, self.least)
            longest = max(n for n in range((s + 1) // 2, s) if n in self.lengths and s - n in self.partners(n))
            k = min(MOST_RUNS[q], need)
            while k > 1 and math.comb(longest - q + 1 - need + k, k) > MOST_KEYS:
                k -= 1
            self.sizes[s] = k
        return self.sizes[s]

    def of(self, n: int) -> dict[tuple[int, int], int]:
        """Of the runs of q of a name of ``n`` characters the first so many are in its sets of k, by (q, k)."""
        if n not in self.known:  # a name that meets all others by pieces has no sets
            out: dict[tuple[int, int], int] = {}
            for other in self.partners(n):
                (q, need), k = kind(n + other, self.least), self.k(n + other)
                out[q, k] = max(out.get((q, k), 0), n - q + 1 - need + k)
            self.known[n] = out
        return self.known[n]


PLACES = [f"{end}{i}" for i in range(max(MOST_RUNS.values())) for end in ("low", "high")]


def _sets(name: str, sets: Sets, frequent: dict[str, int]) -> dict[str, tuple]:
    """The keys of a name: of its sets of one key the least place of the last run in the order, and each run's first and last place."""
    n, out = len(name), {}
    for (q, k), size in sets.of(n).items():
        runs = sorted((frequent.get(name[i : i + q], 0), name[i : i + q], i) for i in range(n - q + 1))
        for some in itertools.combinations(range(min(size, len(runs))), k):
            placed = sorted((runs[at][2], runs[at][1]) for at in some)
            key, places = f"{q}{k}" + "".join(x for _, x in placed), [i for i, _ in placed]
            last, low, high = out.get(key, (some[-1], places, places))
            out[key] = (min(last, some[-1]), list(map(min, low, places)), list(map(max, high, places)))
    return out


def _keyed(shared):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int16()] * len(PLACES)]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], ["key", "n", "size", "last", *PLACES])

    def work(batches):
        frequent, sets = shared.value
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                for key, (last, low, high) in _sets(name, sets, frequent).items():
                    ends = [x for pair in zip(low, high, strict=True) for x in pair]
                    out.append((key, name, len(name), last, *ends, *[0] * (len(PLACES) - len(ends))))
                if len(out) > 20_000:
                    yield table(out)
                    out = []
            yield table(out)

    return work


def _met_in_pieces(own: DataFrame, pieced: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b, sa, sb), a < b, of the names ``n`` that meet by pieces; a pair may come more than once."""
    spark, rows = own.sparkSession, []
    for n, m, d in pieced:
        gone, at = (d - (m - n)) // 2, 0
        for i in range(d + 1):
            size = n // (d + 1) + (i < n % (d + 1))
            rows.append((n, m, i, at + 1, size, max(1, at + 1 - gone), min(m - size + 1, at + 1 + d - gone)))
            at += size
    cuts = F.broadcast(spark.createDataFrame(rows, "_n int, _m int, piece int, at int, size int, low int, high int"))  # by lengths, not by names
    sized = own.select("n", F.char_length("n").alias("len"))
    key = lambda name, at: F.substring(F.col(name), at, F.col("size"))
    short = sized.join(cuts, F.col("len") == F.col("_n")).select(F.col("n").alias("x"), "_n", "_m", "piece", key("n", F.col("at")).alias("text"))
    places = F.array_distinct(F.transform(F.sequence("low", "high"), lambda i: key("n", i)))
    long = sized.join(cuts, F.col("len") == F.col("_m")).select(F.col("n").alias("y"), "_n", "_m", "piece", F.explode(places).alias("text"))
    # of names of one length each pair is met from both sides
    met = short.join(long, ["_n", "_m", "piece", "text"]).where("x <> y and (_n < _m or x < y)")
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("_n")).otherwise(F.col("_m")).alias("sa"), F.when(first, F.col("_m")).otherwise(F.col("_n")).alias("sb"))


def _matched(least: float) -> Column:
    return F.floor(least * (F.col("sa") + F.col("sb")) / 2 - 1e-9) + 1


def _in_pieces(least: float) -> Column:
    return F.least("sa", "sb") >= PIECE * (F.col("sa") + F.col("sb") - 2 * _matched(least) + 1)


def met(names: DataFrame, least: float) -> DataFrame:
    """(a, b, sa, sb), a < b: the distinct names of the column ``name`` that meet in the index. Names are 32 767 characters at most."""
    return _meetings(names, least).distinct()


def _meetings(names: DataFrame, least: float) -> DataFrame:
    """The pairs of ``met``, once for each key that they meet by."""
    spark = names.sparkSession
    own = names.select(F.col("name").cast("string").alias("n")).where("n <> ''").distinct()
    # a name makes some hundred keys, so names are dealt out although they are small
    own = cut(own.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "n"))
    lengths = [r[0] for r in own.select(F.char_length("n")).distinct().collect()]
    sets = Sets(least, lengths)
    in_sets = own.where(F.char_length("n").isin([n for n in lengths if sets.of(n)] or [-1]))
    runs = lambda q: F.transform(F.sequence(F.lit(1), F.char_length("n") - q + 1), lambda i: F.substring(F.col("n"), i, F.lit(q)))
    grams = in_sets.select(F.explode(F.when(F.char_length("n") > 1, F.concat(runs(1), runs(2))).otherwise(F.array("n"))).alias("g"))
    counts = grams.groupBy("g").count().orderBy(F.desc("count"), "g").limit(FREQUENT).collect()
    shared = spark.sparkContext.broadcast(({r[0]: r[1] for r in counts}, sets))
    keys = cut(in_sets.mapInArrow(_keyed(shared), "key string, n string, size int, last int, " + ", ".join(f"{p} short" for p in PLACES)))
    side = lambda n, s, x: keys.select("key", F.col("n").alias(n), F.col("size").alias(s), *[F.col(c).alias(c + x) for c in ("last", *PLACES)])
    s, matched = F.col("sa") + F.col("sb"), _matched(least)
    apart, runs_in_both = s - 2 * matched, 3 * matched - s - 1
    more = F.floor((apart + F.col("sb") - F.col("sa")) / 2)  # characters that only b may have; the rest of ``apart`` only a
    q, k = F.substring("key", 1, 1).cast("int"), F.substring("key", 2, 1).cast("int")
    need = F.when(q == 2, runs_in_both).otherwise(matched)
    near = (matched <= F.least("sa", "sb")) & ((q == 2) == (runs_in_both >= 1))
    for x, size in (("_a", "sa"), ("_b", "sb")):
        near &= F.col("last" + x) < F.col(size) - q + 1 - need + k
    for i in range(max(MOST_RUNS.values())):
        near &= (F.col(f"low{i}_b") - F.col(f"high{i}_a") <= more) & (F.col(f"high{i}_b") - F.col(f"low{i}_a") >= more - apart)
    near &= ~_in_pieces(least)
    by_sets = side("a", "sa", "_a").join(side("b", "sb", "_b"), "key").where("a < b").where(near).select("a", "b", "sa", "sb")
    return _met_in_pieces(own, sets.pieced()).unionByName(by_sets)


def candidates(names: DataFrame, least: float) -> DataFrame:
    """(a, b) of ``met`` whose edit distance allows a ratio above ``least``: those whose ratio is taken. Blocks are kept, and what
    stands between takes at most an edit for each character that only one name has. Pairs are held against that where they meet, so
    what is shuffled is candidates, not meetings."""
    apart = (F.col("sa") + F.col("sb") - 2 * _matched(least)).cast("int")
    return _meetings(names, least).where(F.call_function("levenshtein", F.col("a"), F.col("b"), apart) >= 0).select("a", "b").distinct()


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, ratio), a < b, of the distinct values of the column ``name`` whose matching-blocks ratio is above ``least``, between
    0 and 1."""
    return candidates(names, least).withColumn("ratio", ratio("a", "b")).where(F.col("ratio") > least)
