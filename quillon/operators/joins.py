"""Joins that need a shape of their own: reversed edges, near dates, pairs that share a value, best match in blocks."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers
from quillon.functions.similar import ratio
from quillon.operators.names import similar_names
from quillon.sources.scratch import cut


def reversed_flows(edges: DataFrame, src: str, dst: str, amount: str, least: float = 0.7) -> DataFrame:
    """Unordered pairs with flows both ways whose smaller sum is ``least`` of the larger or more: a, b, out, back, ratio.

    Both directions fold onto one key before the shuffle, so it is one aggregate and no self-join.
    """
    both = edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    sums = both.agg(F.sum(F.when(F.col(src) < F.col(dst), F.col(amount))).alias("out"), F.sum(F.when(F.col(src) > F.col(dst), F.col(amount))).alias("back"))
    return sums.where("out is not null and back is not null").withColumn("ratio", F.try_divide(F.least("out", "back"), F.greatest("out", "back"))).where(F.col("ratio") >= least)


def near_repeats(df: DataFrame, keys: list[str], id_: str, when: str, days: int) -> DataFrame:
    """Rows with another row of the same keys within ``days``; the nearest one on either side decides, so no pairs are made."""
    by = Window.partitionBy(*keys).orderBy(when, id_)
    gap = lambda other: F.abs(F.datediff(F.col(when), other))
    return df.withColumn("gap", F.least(gap(F.lag(when).over(by)), gap(F.lead(when).over(by)))).where(F.col("gap") <= days)


def sharing_pairs(df: DataFrame, id_: str, attributes: list[str], most: int = 200) -> DataFrame:
    """Pairs (a, b, kind, value) of ids that share an attribute's value.

    A value that more than ``most`` ids share is given by membership, linear in the rows: ``a`` is its smallest id and ``b``
    each of the others, so all ids with one (kind, value) are linked and no id is lost. ``members`` is the number of ids.
    """
    long = df.select(id_, F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("x")).select(id_, "x.kind", "x.value").where("value is not null and value <> ''").distinct()
    sizes = long.groupBy("kind", "value").agg(F.count("*").alias("members"), F.min(id_).alias("a")).where("members > 1")
    small = long.join(sizes.where(F.col("members") <= most).select("kind", "value", "members"), ["kind", "value"])
    left = small.withColumnRenamed(id_, "a")
    pairs = left.join(small.select("kind", "value", F.col(id_).alias("b")), ["kind", "value"]).where("a < b").select("a", "b", "kind", "value", "members")
    large = sizes.where(F.col("members") > most)
    hubs = long.join(large, ["kind", "value"]).where(F.col(id_) > F.col("a")).select("a", F.col(id_).alias("b"), "kind", "value", "members")
    return pairs.unionAll(hubs)


def best_match(targets: DataFrame, candidates: DataFrame, block: list[str], target_id: str, candidate_id: str, score: Column, least: float) -> DataFrame:
    """For each target the best candidate of its block with a score of ``least`` or more; on ties the smallest id. No match: nulls."""
    met = targets.join(candidates, block).withColumn("score", score).where(F.col("score") >= least)
    best = met.groupBy(target_id).agg(F.max_by(F.struct(F.col(candidate_id), "score"), F.struct("score", (-F.col(candidate_id)).alias("o"))).alias("best"))
    return targets.join(best, target_id, "left").select(*targets.columns, F.col(f"best.{candidate_id}").alias(candidate_id), F.col("best.score").alias("score"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """For each left row the last right value at or before its time, by one union and one window."""
    one = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    two = right.select(*[F.col(c) if c in [*keys, when] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), value)
    by = Window.partitionBy(*keys).orderBy(when, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return one.unionByName(two).withColumn(value, F.last(value, True).over(by)).where("_side = 1").drop("_side")


def nearest(targets: DataFrame, candidates: DataFrame, keys: list[str], value: str, target_id: str, candidate_id: str, within: float, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each target the candidate of its keys whose ``value`` is nearest, at most ``within`` away; on ties the smallest id. With
    ``score``, which never rises with the distance, the best scored is taken: distances below and above that differ in digits
    which the score no longer shows are ties, as they are where rows are ordered by it.

    Values fall into cells ``within`` wide, so the nearest lies in the own cell, where a window finds it, or is an end of a
    neighbouring cell. Nothing is paired; the work is linear in the rows.
    """
    cell = F.floor(F.col(value) / within).cast("long")
    spots = candidates.groupBy(*keys, value).agg(F.min(candidate_id).alias("_id")).withColumn("_cell", cell)
    spot = F.struct(F.col(value).alias("v"), F.col("_id").alias("id"))
    ends = spots.groupBy(*keys, "_cell").agg(F.min_by(spot, value).alias("_low"), F.max_by(spot, value).alias("_high"))
    own = targets.select(*keys, value, target_id).withColumn("_cell", cell)
    none = F.lit(None).cast(spots.schema["_id"].dataType)
    both = spots.select(*keys, value, "_cell", F.lit(None).cast(targets.schema[target_id].dataType).alias(target_id), "_id").unionByName(own.withColumn("_id", none))
    by = Window.partitionBy(*keys, "_cell").orderBy(value)
    held = F.when(F.col("_id").isNotNull(), spot)
    near = both.withColumn("_below", F.last(held, True).over(by.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_above", F.first(held, True).over(by.rangeBetween(0, Window.unboundedFollowing)))
    near = near.where(F.col(target_id).isNotNull())
    near = near.join(ends.select(*keys, (F.col("_cell") + 1).alias("_cell"), "_high"), [*keys, "_cell"], "left").join(ends.select(*keys, (F.col("_cell") - 1).alias("_cell"), "_low"), [*keys, "_cell"], "left")
    options = F.filter(F.array("_below", "_above", "_high", "_low"), lambda s: s.isNotNull() & (F.abs(s["v"] - F.col(value)) <= within))
    order = (lambda d: -score(d)) if score else (lambda d: d)
    best = F.array_min(F.transform(options, lambda s: F.struct(order(F.abs(s["v"] - F.col(value))).alias("order"), s["id"].alias("id"), F.abs(s["v"] - F.col(value)).alias("distance"))))
    return targets.join(near.select(target_id, best["id"].alias(candidate_id), best["distance"].alias("distance")), target_id, "left")


def entity_links(parties: DataFrame, id_: str, code: str, stem: str, least: float = 0.75) -> DataFrame:
    """(a, b, score, hard): parties with the same valid code (null otherwise) score 1, others by their stems' likeness above ``least``.

    Parties that share a code or a stem are linked to the smallest of them, not to each other; different stems link through
    their smallest parties. The closure is the same as over all pairs.
    """
    own = parties.select(F.col(id_).alias("id"), F.col(code).alias("code"), F.col(stem).alias("stem"))
    codes = own.where("code is not null").groupBy("code").agg(F.min("id").alias("a"))
    hard = own.join(codes, "code").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(True).alias("hard"))
    stems = own.where("stem <> ''").groupBy("stem").agg(F.min("id").alias("a"))
    same = own.join(stems, "stem").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(False).alias("hard"))
    like = similar_names(stems.select(F.col("stem").alias("name")), least)
    near = like.join(stems.select(F.col("stem").alias("a"), F.col("a").alias("x")), "a").join(stems.select(F.col("stem").alias("b"), F.col("a").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("ratio").alias("score"), F.lit(False).alias("hard"))
    return hard.unionAll(same).unionAll(near)


# Weights and tolerances of the parts of two records' likeness.
RECORD_PARTS = {"incl": (0.35, 0.02), "excl": (0.20, 0.02), "tax": (0.10, 0.05), "quantity": (0.05, 0.05)}
SUPPLIER_PART, DATE_PART = 0.20, 0.10


#: Pairs of names up to which they are broadcast to the pairs of records; each takes some hundred bytes.
NAME_PAIRS = 200_000
#: What a score may lack of 1 at most to be looked for first; what finds none as good goes on to the next.
LACKS = (0.05, 0.1, 0.2)
#: Pairs of records up to which all are met at once.
FEW_MEETINGS = 4_000_000


def record_score(a: str, b: str, likeness: Column, days: int = 30) -> Column:
    """Likeness of two records whose columns begin with ``a`` and ``b`` (incl, excl, tax, quantity, date): the mean of the parts
    that both have, by their weights; ``likeness`` is that of the suppliers' names."""
    total, weight = likeness * SUPPLIER_PART, F.lit(SUPPLIER_PART)
    for name, (w, tolerance) in RECORD_PARTS.items():
        x, y = F.col(a + name), F.col(b + name)
        have = F.coalesce((x > 0) & (y > 0), F.lit(False))
        share = F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(x - y), x) / max(2 * tolerance, 0.01))
        total, weight = total + F.when(have, share * w).otherwise(0.0), weight + F.when(have, w).otherwise(0.0)
    x, y = F.col(a + "date"), F.col(b + "date")
    have = x.isNotNull() & y.isNotNull()
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(x, y)) / float(days))
    return (total + F.when(have, near * DATE_PART).otherwise(0.0)) / (weight + F.when(have, DATE_PART).otherwise(0.0))


def record_matches(targets: DataFrame, candidates: DataFrame, least: float = 0.7, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, by, match, score) of every target, both with id, by, name, incl, excl, tax, quantity, date: its best candidate with the same
    ``by`` at ``least`` (above .65) or more, the smallest id where scores are equal to nine decimals, else nulls.

    A pair whose amounts are more than 4 % apart keeps at most .65 of its weight, so no match is lost by that bound; a record
    without an amount matches none. Names of which one is null or empty are not alike, and that counts. Records that are equal in
    all but their id meet once.

    What a score lacks of 1 bounds how far amounts are apart, and the nearer the less alike the names are. So targets look for a score that
    lacks little first, in narrow cells of the amount's logarithm and among names alike enough; what finds one has its best, as any
    better one stood there too. The others look further, but no further than the best they saw leaves room for.
    """
    by = list(by)
    alike = [c for c in targets.columns if c not in ("id", *by)]
    filled = lambda df: df.withColumn("name", F.coalesce("name", F.lit(""))).where("incl > 0")
    sided = lambda df, side: df.select(*[F.col(c).alias(c if c in by else side + c) for c in df.columns])
    left = cut(sided(filled(targets).select(*by, *alike).distinct(), "a_").withColumn("_kind", F.monotonically_increasing_id()))
    right = cut(sided(filled(candidates).groupBy(*by, *alike).agg(F.min("id").alias("id")), "b_"))
    cell = lambda c, width: F.floor(F.log(c) / width).cast("long")
    wide = lambda df, c: df.withColumn("_cell", cell(F.col(c), math.log(1.045)))
    # names are compared once a pair of different names of neighbouring cells; while those are few they come to the pairs of records,
    # which are then never shuffled
    own = wide(left, "a_incl").select(*by, F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"), "a_name").distinct()
    pairs = own.join(wide(right, "b_incl").select(*by, "_cell", "b_name").distinct(), [*by, "_cell"]).select("a_name", "b_name").distinct()
    named = cut(pairs.withColumn("_like", F.when((F.col("a_name") != "") & (F.col("b_name") != ""), ratio("a_name", "b_name")).otherwise(0.0)))
    few = named.limit(NAME_PAIRS + 1).count() <= NAME_PAIRS
    first = F.min_by("best", F.struct((-numbers.rounded(F.col("best.score"), 9)).alias("o"), F.col("best.b_id").alias("id")))

    def looked(rows: DataFrame, lack: float, last: bool) -> DataFrame:
        """The pairs of ``rows`` within their ``_room``, and those that could bound the next."""
        apart = lambda room: room * (2 * RECORD_PARTS["incl"][1] / RECORD_PARTS["incl"][0]) + 1e-9
        width = apart(lack) / 2
        near, keys, floor = rows, [*by, "_cell"], F.col("_floor") if last else F.greatest("_floor", F.lit(1 - 2 * lack))
        by_name = few and not last
        if by_name:  # unlike names leave less for the amounts
            near = near.join(F.broadcast(named.where(F.col("_like") >= 1 - lack / SUPPLIER_PART - 1e-9)), "a_name")
            near, keys = near.withColumn("_room", F.col("_room") - SUPPLIER_PART * (1 - F.col("_like"))).where("_room > -1e-9"), [*keys, "b_name"]
        near = near.withColumn("_apart", apart(F.greatest("_room", F.lit(0.0)))).withColumn("_cell", F.explode(F.sequence(cell(F.col("a_incl") * (1 - F.col("_apart")), width), cell(F.col("a_incl") * (1 + F.col("_apart")), width))))
        met = near.join(right.withColumn("_cell", cell(F.col("b_incl"), width)), keys).where(F.abs(F.col("a_incl") - F.col("b_incl")) <= F.col("_apart") * F.col("a_incl"))
        if not by_name:
            if not few:
                met = met.where(record_score("a_", "b_", F.lit(1.0)) >= floor - 1e-9)  # no name could lift the others
            met = met.join(F.broadcast(named) if few else named, ["a_name", "b_name"])
        scored = met.withColumn("score", record_score("a_", "b_", F.col("_like"))).where(F.col("score") >= floor)
        return scored.select("_kind", F.struct("b_id", "score").alias("best")).groupBy("_kind").agg(first.alias("best"))

    sizes = wide(right, "b_incl").groupBy(*by, "_cell").agg(F.count("*").alias("_theirs"))
    open_, found, lacks = left.withColumn("_room", F.lit(1 - least)).withColumn("_floor", F.lit(least)), [], [x for x in LACKS if x < 1 - least]
    while lacks:
        meetings = wide(open_, "a_incl").groupBy(*by, "_cell").agg(F.count("*").alias("_ours")).join(sizes, [*by, "_cell"]).agg(F.sum(F.col("_ours").cast("double") * F.col("_theirs"))).first()[0]
        if 2 * (meetings or 0) <= FEW_MEETINGS:
            break
        lack = lacks.pop(0)
        rows = open_.withColumn("_room", F.least("_room", F.lit(lack)))
        seen = cut(rows.join(looked(rows, lack, False), "_kind", "left").withColumn("_settled", F.coalesce(F.col("best.score") >= 1 - F.col("_room") + 2e-9, F.lit(False))))
        found.append(seen.where("_settled").select("_kind", "best"))
        # what is as good as the best seen lacks no more
        open_ = seen.where("not _settled").withColumn("_floor", F.coalesce(F.col("best.score") - 1e-8, F.lit(least))).withColumn("_room", 1 - F.col("_floor")).drop("best", "_settled")
    found.append(looked(open_, 1 - least, True))
    of = left.join(functools.reduce(DataFrame.unionByName, found), "_kind").select(*[F.col(c).alias("_" + c) for c in by], *[F.col("a_" + c) for c in alike], "best")
    rows = filled(targets)
    same = [rows[c].eqNullSafe(of["_" + c]) for c in by] + [rows[c].eqNullSafe(of["a_" + c]) for c in alike]
    got = rows.join(of, functools.reduce(lambda x, y: x & y, same)).groupBy("id", *by).agg(first.alias("best"))
    return targets.select("id", *by).join(got, ["id", *by], "left").select("id", *by, F.col("best.b_id").alias("match"), F.col("best.score").alias("score"))


#: Children of a node of the tree of maxima.
FANOUT = 64


def _children(level: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _parent, _nodes): the places and maxima of each node's children, FANOUT at most, in order."""
    return level.groupBy(*keys, F.floor(F.col("_place") / FANOUT).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("_place", "_top"))).alias("_nodes"))


def first_returns(flows: DataFrame, id_: str, src: str, dst: str, amount: str, share: float) -> DataFrame:
    """(id, back): for each flow the first later one, by id, from ``dst`` to ``src`` with ``share`` of its amount or more; of rows with
    one id any.

    The flows of a pair and direction are the leaves of a tree of maxima, FANOUT children a node, whose places come from a rank
    over the whole pair in pieces of a range partitioning, never from one task's window over the pair. A question climbs from the
    leaf before it until a later sibling's maximum is enough, then goes down to the first child that is: it meets two nodes'
    children a level, so a pair of any size is answered in the logarithm of its flows.
    """
    rows = flows.where(F.col(amount).isNotNull()).select(F.col(id_).alias("_id"), F.least(src, dst).alias("_a"), F.greatest(src, dst).alias("_b"), (F.col(src) < F.col(dst)).alias("_way"), F.col(amount).alias("_amount"))
    keys = ["_a", "_b", "_way"]
    # flows and questions in one order by pair and id: a question's place is the number of flows before it in its direction
    asked = rows.select("_a", "_b", (~F.col("_way")).alias("_way"), "_id", F.lit(1).alias("_asks"), (F.col("_amount") * share).alias("_amount"))
    both = rows.withColumn("_asks", F.lit(0)).unionByName(asked)
    order = [*keys, "_id", "_asks"]
    dealt = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    piece, flow = F.shiftright("_at", 33), 1 - F.col("_asks")
    pieces = dealt.groupBy(*keys, piece.alias("_piece")).agg(F.sum(flow).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*keys, "_piece", before.alias("_before"))
    within = F.sum(flow).over(Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_piece", piece).join(pieces, [*keys, "_piece"]).withColumn("_place", F.col("_before") + within)
    # flows are numbered from 0; a question looks from the number of flows up to and with its own id
    placed = cut(placed.select(*keys, "_id", "_asks", "_amount", (F.col("_place") - flow).alias("_place")))
    leaves = placed.where("_asks = 0").select(*keys, "_place", F.col("_amount").alias("_top"), F.col("_id").alias("_back"))
    levels = [leaves]
    while True:
        up = levels[-1].groupBy(*keys, F.floor(F.col("_place") / FANOUT).alias("_place")).agg(F.max("_top").alias("_top"))
        levels.append(cut(up))
        if levels[-1].where("_place > 0").isEmpty():
            break
    open_ = placed.where("_asks = 1").select(*keys, F.col("_id").alias("_asker"), F.col("_amount").alias("_need"), F.col("_place").alias("_from"))
    found = []
    for depth, level in enumerate(levels[:-1]):  # up: the later siblings of the place one stands before
        asks = open_.withColumn("_parent", F.floor(F.col("_from") / FANOUT)).join(_children(level, keys), [*keys, "_parent"], "left")
        enough = F.filter("_nodes", lambda x: (x["_place"] >= F.col("_from")) & (x["_top"] >= F.col("_need")))
        asks = cut(asks.select(*keys, "_asker", "_need", "_from", F.get(enough, F.lit(0))["_place"].alias("_hit")))
        found.append((depth, asks.where("_hit is not null").select(*keys, "_asker", "_need", F.col("_hit").alias("_place"))))
        open_ = asks.where("_hit is null").select(*keys, "_asker", "_need", (F.floor(F.col("_from") / FANOUT) + 1).alias("_from"))
    # down: the first child whose maximum is enough, from the highest level on
    here = None
    for depth in range(len(levels) - 2, -1, -1):
        own = [f for d, f in found if d == depth]
        here = own[0] if here is None else here.unionByName(own[0])
        if depth:
            met = here.withColumnRenamed("_place", "_parent").join(_children(levels[depth - 1], keys), [*keys, "_parent"])
            here = met.select(*keys, "_asker", "_need", F.element_at(F.filter("_nodes", lambda x: x["_top"] >= F.col("_need")), 1)["_place"].alias("_place"))
    return here.join(leaves.select(*keys, "_place", "_back"), [*keys, "_place"]).select(F.col("_asker").alias("id"), F.col("_back").alias("back"))
