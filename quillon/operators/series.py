"""Ordered series: windows over (entity, order), runs, folds. A series is one entity's rows; long tables stay distributed by entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import cut


def _by(keys: list[str], order: list[str], reverse: bool = False):
    return Window.partitionBy(*keys).orderBy(*[F.desc(o) if reverse else F.asc(o) for o in order])


def tail(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each series, with ``back`` = 1 for the last."""
    return df.withColumn("back", F.row_number().over(_by(keys, order, True))).where(F.col("back") <= n)


def zscored(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and z of each row in its group; z is 0 where nothing deviates."""
    own = Window.partitionBy(*keys)
    out = df.withColumn("mean", F.avg(value).over(own)).withColumn("std", F.stddev_pop(value).over(own))
    return out.withColumn("z", F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0))


def folded(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row a series with ``values`` in order, for folds that no window expresses; a series has to fit a row."""
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_s"))
    return got.select(*keys, F.transform("_s", lambda s: s["_v"]).alias("values"))


def ordered_means(df: DataFrame, key: str, order: list[str], value: str, most: int = 1 << 20) -> DataFrame:
    """(key, m): means whose sums are taken in ``order``, as an engine adds what a window has sorted, so that the last digits do not
    hang on how rows lie in files. A key of more than ``most`` rows is added up in parts by many tasks, in no set order."""
    plain = df.groupBy(key).agg(F.avg(value).alias("m"), F.count("*").alias("_n"))
    long = cut(plain.where(F.col("_n") > most).select(key, "m"))
    short = df.join(F.broadcast(long.select(key)), key, "left_anti").select(key, *order, value)
    # a sum of doubles keeps the sort below it, and the aggregate needs no other shuffle
    return short.repartition(key).sortWithinPartitions(key, *order).groupBy(key).agg(F.avg(value).alias("m")).unionByName(long)


def ewma(values: Column, weight: float = 0.3) -> Column:
    """Exponentially weighted mean, seeded with the first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1).cast("double"), lambda s, x: s * (1 - weight) + x * weight)


def cusum(values: Column, target: Column, scale: Column, k: float = 0.5, h: float = 5.0) -> Column:
    """Alarms of a two-sided CUSUM: array of (at, side, sum). A side that alarms starts anew, the other goes on; both may alarm at
    once. ``scale`` divides the deviations (1: not scaled)."""
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("n"), F.array().cast("array<struct<at:int,side:string,sum:double>>").alias("alarms"))

    def step(s, x):
        z = (x - target) / scale
        up, down, n = F.greatest(s["up"] + z - k, F.lit(0.0)), F.greatest(s["down"] - z - k, F.lit(0.0)), s["n"] + 1
        new = F.array_compact(F.array(*[F.when(side > h, F.struct(n.alias("at"), F.lit(name).alias("side"), side.alias("sum"))) for name, side in (("up", up), ("down", down))]))
        return F.struct(F.when(up > h, 0.0).otherwise(up).alias("up"), F.when(down > h, 0.0).otherwise(down).alias("down"), n.alias("n"), F.when(F.size(new) > 0, F.concat(s["alarms"], new)).otherwise(s["alarms"]).alias("alarms"))

    return F.aggregate(values, start, step, lambda s: s["alarms"])


def cusum_step(sums: tuple[float, float], z: float, k: float, h: float) -> tuple[tuple[float, float], list[tuple[str, float]]]:
    """Both sums after a deviation, and the sides that alarm, which start anew."""
    up, down = max(sums[0] + z - k, 0.0), max(sums[1] - z - k, 0.0)
    alarms = [(side, top) for side, top in (("up", up), ("down", down)) if top > h]
    return (0.0 if up > h else up, 0.0 if down > h else down), alarms


class CusumMap:
    """What a piece of a series does to one side's sum, for every sum it may start from, 0 to ``h``.

    Sums that neither met 0 nor an alarm yet keep their distance: one interval, ``low`` to ``high`` of the entry, moved by ``moved``.
    Entries below it met 0 and go on together; entries above it alarmed, in slices, the higher the sooner, and each slice goes on from
    0. Slices whose sums are the same again become one.
    """

    def __init__(self, k: float, h: float) -> None:
        self.k, self.h, self.low, self.high, self.moved = k, h, 0.0, h, 0.0
        self.open, self.under, self.tops = True, None, []  # tops: [lowest entry, sum], the highest entries first

    def step(self, z: float) -> None:
        k, h = self.k, self.h
        after = lambda s: 0.0 if (t := max(s + z - k, 0.0)) > h else t
        self.under = None if self.under is None else after(self.under)
        for top in self.tops:
            top[1] = after(top[1])
        if self.open:
            self.moved += z - k
            if self.high + self.moved <= 0.0:  # all that is left meets 0
                self.open, self.under = False, 0.0
            elif self.low + self.moved > h:  # all that is left alarms
                self.open = False
                self.tops.append([self.low, 0.0])
            else:
                if self.low + self.moved <= 0.0:
                    self.low, self.under = -self.moved, 0.0
                if self.high + self.moved > h:
                    self.high = h - self.moved
                    self.tops.append([self.high, 0.0])
        kept = []
        for top in self.tops:  # a slice whose sum is its lower neighbour's takes that one's border
            if kept and kept[-1][1] == top[1]:
                kept[-1][0] = top[0]
            else:
                kept.append(top)
        self.tops = kept

    def row(self) -> tuple:
        """(open, low, high, moved, under, borders, sums)."""
        return self.open, self.low, self.high, self.moved, self.under, [t[0] for t in self.tops], [t[1] for t in self.tops]


def cusum_exit(at: float, way: tuple) -> float:
    """The sum at the end of a piece that was entered with ``at``, by the piece's map."""
    open_, low, high, moved, under, borders, sums = way
    if open_ and low <= at <= high:
        return max(at + moved, 0.0)
    for border, total in zip(borders, sums, strict=True):
        if at > border or (under is None and not open_ and at >= border):
            return total
    return under if under is not None else max(at + moved, 0.0)


_WAY = "open boolean, low double, high double, moved double, under double, borders array<double>, sums array<double>"


def cusum_rows(df: DataFrame, key: str, order: list[str], value: str, target: str, k: float = 0.5, h: float = 5.0, pieces: int | None = None) -> DataFrame:
    """(key, at, side, sum) of the alarms over each series, ``target`` being a column; at counts from 1, nulls are passed over.

    Rows lie in ``pieces`` (the session's shuffle partitions if not given), ranges of (key, order), written once, so that a key with all rows is read by many tasks. A piece in
    the midst of a series first gives its map from the sums at its start to those at its end; the maps are joined in order,
    a row a piece. A map moves a sum that meets neither 0 nor an alarm by one addition instead of many, so its last digits are only
    near: every piece is then folded from its start, and where it does not end as the next one starts, that one is folded again, so
    that all sums are, to the last bit, those of one fold. Each round settles a piece more of a series at least, and all pieces that a sum of 0 or an
    alarm settles. Rows alike in key and order stay together.
    """
    name = df.schema[key].dataType.simpleString()  # within Python a key is text, whatever its type, and null stays null
    many = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("_key"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], (F.col(value).cast("double") - F.col(target).cast("double")).alias("_z"))
    by = ["_key", *[f"_o{i}" for i in range(len(order))]]
    held = cut(rows.repartitionByRange(many, *by).withColumn("_piece", F.spark_partition_id()))
    spans = cut(held.groupBy("_key", "_piece").agg(F.count("*").alias("_n")))
    whole = Window.partitionBy("_key")
    spans = spans.withColumn("_many", F.count("*").over(whole)).withColumn("_nth", F.row_number().over(whole.orderBy("_piece"))).where("_many > 1")
    spans = cut(spans.select("_key", "_piece", "_n", "_nth"))  # a piece has two such keys at most, its first and its last

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ways = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*now, *[dict(zip(("open", "low", "high", "moved", "under", "borders", "sums"), w.row(), strict=True)) for w in ways])], columns=["_key", "_piece", "_up", "_down"])

        for batch in batches:
            for part, who, z in batch.itertuples(index=False):
                if now != (who, part):
                    if now is not None:
                        yield done()
                    now, ways = (who, part), (CusumMap(k, h), CusumMap(k, h))
                ways[0].step(z)
                ways[1].step(-z)
        if now is not None:
            yield done()

    def carry(pieces: pd.DataFrame) -> pd.DataFrame:
        out, up, down, before = [], 0.0, 0.0, 0
        for r in pieces.sort_values("_nth").itertuples(index=False):
            out.append((r[0], r[1], up, down, before))
            up, down = (cusum_exit(s, tuple(w[n] for n in ("open", "low", "high", "moved", "under", "borders", "sums"))) for s, w in ((up, r[4]), (down, r[5])))
            before += r[2]
        return pd.DataFrame(out, columns=["_key", "_piece", "up", "down", "before"])

    here = lambda df: (held["_piece"] == df["_piece"]) & held["_key"].eqNullSafe(df["_key"])
    middle = spans.select("_key", "_piece")
    within = held.join(F.broadcast(middle), here(middle), "left_semi")
    ways = within.repartition(many, "_piece").sortWithinPartitions("_piece", *by).select("_piece", "_key", "_z").mapInPandas(maps, f"_key string, _piece int, _up struct<{_fields(_WAY)}>, _down struct<{_fields(_WAY)}>")
    both = ways.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), "_up", "_down")
    starts = spans.join(both, (F.col("_piece") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_piece", "_n", "_nth", "_up", "_down")
    starts = cut(starts.groupBy("_key").applyInPandas(carry, f"_key string, _piece int, up double, down double, before long"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, out = None, (0.0, 0.0), []
        for batch in batches:
            for part, who, z, up, down in batch.itertuples(index=False):
                if now != (who, part):
                    out += [] if now is None else [(*now, *sums)]
                    now, sums = (who, part), (up, down)
                sums, _ = cusum_step(sums, z, k, h)
        out += [] if now is None else [(*now, *sums)]  # two keys a piece
        yield pd.DataFrame(out, columns=["_key", "_piece", "up_end", "down_end"])

    wrong, ended = starts, None
    while True:
        again = wrong.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), "up", "down")
        met = within.join(F.broadcast(again), (F.col("_piece") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k"))).repartition(many, "_piece").sortWithinPartitions("_piece", *by)
        got = met.select("_piece", "_key", "_z", "up", "down").mapInPandas(ends, "_key string, _piece int, up_end double, down_end double")
        if ended is not None:
            kept = ended.join(wrong.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p")), (F.col("_piece") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left_anti")
            got = kept.unionByName(got)
        ended = cut(got)
        ordered = Window.partitionBy("_key").orderBy("_piece")
        reached = ended.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), *[F.coalesce(F.lag(f"{c}_end").over(ordered), F.lit(0.0)).alias(f"{c}_new") for c in ("up", "down")])
        checked = starts.join(reached, (F.col("_piece") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")))
        new = checked.select("_key", "_piece", F.col("up_new").alias("up"), F.col("down_new").alias("down"), "before", ((F.col("up") != F.col("up_new")) | (F.col("down") != F.col("down_new"))).alias("_wrong"))
        new = cut(new)
        starts, wrong = new.drop("_wrong"), new.where("_wrong")
        if wrong.isEmpty():
            break

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, at = None, (0.0, 0.0), 0
        for batch in batches:
            out = []
            for part, who, z, up, down, before in batch.itertuples(index=False):
                if now != (who, part):
                    now, sums, at = (who, part), (up, down), int(before)
                at += 1
                sums, alarms = cusum_step(sums, z, k, h)
                out += [(who, at, side, top) for side, top in alarms]
            yield pd.DataFrame(out, columns=["_key", "at", "side", "sum"])

    start = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("up", "down", "before")}
    ready = held.join(F.broadcast(starts), here(starts), "left").select(held["_piece"], held["_key"], *[held[c] for c in by[1:]], "_z", "up", "down", "before").withColumns(start).repartition(many, "_piece").sortWithinPartitions("_piece", *by)
    got = ready.select("_piece", "_key", "_z", "up", "down", "before").mapInPandas(read, f"_key string, at long, side string, sum double")
    return got.select(F.col("_key").cast(name).alias(key), "at", "side", "sum")


def _fields(columns: str) -> str:
    """Columns as the fields of a struct."""
    return columns.replace(" ", ":").replace(",:", ",")


def slope(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares slope and fit of a series on its index."""
    at = df.withColumn("_i", (F.row_number().over(_by(keys, order)) - 1).cast("double"))
    return at.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(value, "_i").alias("slope"), F.regr_r2(value, "_i").alias("r2"))


def runs(df: DataFrame, keys: list[str], order: list[str], where: Column, least: int) -> DataFrame:
    """Maximal runs of rows for which ``where`` holds, ``least`` rows or longer: keys, first, last, n."""
    rows = df.withColumn("_ok", F.coalesce(where, F.lit(False)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_ok").groupBy(*keys, "_island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def moves(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``move``: 1, -1 or 0 against the row before (null for the first)."""
    return df.withColumn("move", F.signum(F.col(value) - F.lag(value).over(_by(keys, order))).cast("int"))


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, least: float) -> DataFrame:
    """Rows where the means of the ``width`` rows before and from here on differ by more than ``least``, relative to the former."""
    by = _by(keys, order)
    before, after = by.rowsBetween(-width, -1), by.rowsBetween(0, width - 1)
    out = df.withColumn("before", F.avg(value).over(before)).withColumn("after", F.avg(value).over(after))
    out = out.withColumn("_n", F.count(value).over(before)).withColumn("_m", F.count(value).over(after)).where(f"_n = {width} and _m = {width}").drop("_n", "_m")
    return out.withColumn("change", F.try_divide(F.col("after") - F.col("before"), F.abs("before"))).where(F.abs("change") > least)


def year_on_year(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """``growth`` against the year before, where that is there and not 0."""
    by = _by(keys, [year])
    out = df.withColumn("_y", F.lag(year).over(by)).withColumn("_v", F.lag(value).over(by))
    return out.withColumn("growth", F.when(F.col("_y") == F.col(year) - 1, F.try_divide(F.col(value) - F.col("_v"), F.abs("_v")))).drop("_y", "_v")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``value`` with nulls taken from the last row before that has one."""
    return df.withColumn(value, F.last(value, True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def chained(df: DataFrame, keys: list[str], order: list[str], content: Column, size: int = 16) -> DataFrame:
    """One row a series: the hashes of a chain in which each takes in the one before."""
    got = df.select(*keys, F.struct(*order, content.alias("_c")).alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    start = F.array().cast("array<string>")
    link = lambda s, x: F.array_append(s, F.left(F.sha2(F.concat(F.coalesce(F.get(s, F.size(s) - 1), F.lit("")), x["_c"]), 256), F.lit(size)))
    return got.select(*keys, F.aggregate("_s", start, link).alias("hashes"))


def chain_head(df: DataFrame, keys: list[str], order: list[str], content: Column, size: int = 16) -> DataFrame:
    """(keys, n, head): the length and the last hash of each series' chain, carried as one value, not as a list that grows."""
    got = df.select(*keys, F.struct(*order, content.alias("_c")).alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    link = lambda h, x: F.left(F.sha2(F.concat(h, x["_c"]), 256), F.lit(size))
    return got.select(*keys, F.size("_s").cast("long").alias("n"), F.aggregate("_s", F.lit(""), link).alias("head"))


def seasonal(df: DataFrame, keys: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """Seasonal strength: the share of a series' variance that lies between the means of its ``period`` phases."""
    rows = df.withColumn("_p", (F.row_number().over(_by(keys, order)) - 1) % period).withColumn("_m", F.avg(value).over(Window.partitionBy(*keys)))
    phase = rows.groupBy(*keys, "_p").agg(F.count("*").alias("n"), F.avg(value).alias("pm"), F.first("_m").alias("m"), F.sum(F.pow(F.col(value) - F.col("_m"), 2)).alias("ss"))
    out = phase.groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("pm") - F.col("m"), 2)).alias("between"), F.sum("ss").alias("total"))
    return out.select(*keys, F.coalesce(F.try_divide("between", "total"), F.lit(0.0)).alias("strength"))


def reciprocal_ranks(df: DataFrame, keys: list[str], id_: str, scores: list[str], k: int = 60) -> DataFrame:
    """Rank fusion: sum of 1 / (k + rank) over several orderings."""
    total = sum((1 / (k + F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(s), id_))) for s in scores[1:]), 1 / (k + F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(scores[0]), id_))))
    return df.withColumn("rrf", total)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each series, ``back`` = 1 for the last. The rank is filtered right above the window, so the planner
    puts a group limit on both sides of the shuffle: a long series moves ``n`` rows a task."""
    return df.withColumn("back", F.row_number().over(_by(keys, order, True))).where(F.col("back") <= n)


def strongest_spans(df: DataFrame, keys: list[str], begin: str, end: str, level: str, id_: str) -> DataFrame:
    """Spans that no span they touch beats; a higher level beats a lower one, of the same level the one that begins earlier (then the
    smaller id). Spans meet the cells they lie in, so only those near each other are compared."""
    width = 64
    cells = df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    other = cells.select(*keys, "_cell", F.col(begin).alias("_b"), F.col(end).alias("_e"), F.col(level).alias("_l"), F.col(id_).alias("_id"))
    touch = (F.col("_b") < F.col(end)) & (F.col(begin) < F.col("_e")) & (F.col("_id") != F.col(id_))
    stronger = (F.col("_l") > F.col(level)) | ((F.col("_l") == F.col(level)) & ((F.col("_b") < F.col(begin)) | ((F.col("_b") == F.col(begin)) & (F.col("_id") < F.col(id_)))))
    beaten = cells.join(other, [*keys, "_cell"]).where(touch & stronger).select(*keys, id_).distinct()
    return df.join(beaten, [*keys, id_], "left_anti")
