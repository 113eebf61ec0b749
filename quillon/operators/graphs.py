"""Iterative graph operators on an edge table (src, dst, w). Each round is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import cut


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, dangling: bool = True, every: int = 5, tolerance: float = 0.0) -> DataFrame:
    """(id, rank), weights aside. Without ``dangling`` the mass of nodes without a way out is lost. The ranks are written each round,
    since a round reads those of the one before twice; each ``every`` rounds it is seen whether the last one moved a
    rank by ``tolerance``, and if not it ends."""
    edges = cut(edges.select("src", "dst").distinct())
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(degree.withColumnRenamed("src", "id"), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks = nodes.select("id", "deg", F.lit(1.0 / n).alias("rank"))
    lost = nodes.where("deg is null").count() / n
    for k in range(rounds):
        gained = edges.join(ranks.where("deg is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share")), "src").groupBy("dst").agg(F.sum("share").alias("in")).withColumnRenamed("dst", "id")
        new = ranks.select("id", "deg", F.col("rank").alias("before")).join(gained, "id", "left")
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("in", F.lit(0.0)) + (lost / n if dangling else 0.0))
        # what the next round needs of this one as a whole is summed while it is written
        seen = Observation()
        new = cut(new.select("id", "deg", "before", rank.alias("rank")).observe(seen, F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"), F.max(F.abs(F.col("rank") - F.col("before"))).alias("moved")))
        lost = seen.get["lost"]
        if tolerance and (k + 1) % every == 0 and seen.get["moved"] < tolerance:
            return new.select("id", "rank")
        ranks = new.select("id", "deg", "rank")
    return ranks.select("id", "rank")


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, id, hop) of everything within ``most`` hops, at its least hop. ``starts`` has a column id."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")).distinct()
    for k in range(1, most + 1):
        new = front.join(edges, front["id"] == edges["src"]).select("start", F.col("dst").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(new.select("start", "id", F.lit(k).alias("hop")))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Directed simple cycles of ``length`` nodes, each once, beginning with its smallest node: n1, n2, ..."""
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    out = edges.select(F.col("src").alias("n1"), F.col("dst").alias("n2")).where("n1 < n2")
    for k in range(3, length + 1):
        step = edges.select(F.col("src").alias(f"n{k - 1}"), F.col("dst").alias(f"n{k}"))
        out = out.join(step, f"n{k - 1}").where(F.col(f"n{k}") > F.col("n1"))
        for i in range(2, k - 1):
            out = out.where(F.col(f"n{k}") != F.col(f"n{i}"))
    back = edges.select(F.col("src").alias(f"n{length}"), F.col("dst").alias("n1"))
    return out.join(back, [f"n{length}", "n1"]).select(*[f"n{i}" for i in range(1, length + 1)])


def labels(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) by synchronous label propagation over undirected edges; ties go to the smallest label."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    now = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(now.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        won = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("top"))
        now = cut(won.select(F.col("dst").alias("id"), (-F.col("top.neg")).alias("label")))
    return now


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest reachable id, by minimum labels with pointer jumping, until no label changes."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now = cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("c")).select("id", F.least("id", "c").alias("c")))
    while True:
        near = both.join(now.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        low = now.join(near, "id", "left").select("id", F.least("c", "m").alias("c"))
        jumped = low.join(now.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c", "left").select("id", F.least("c", "cc").alias("new"))
        new = cut(jumped.join(now, "id"))
        stable = new.where("new <> c").isEmpty()
        now = new.select("id", F.col("new").alias("c"))
        if stable:
            break
    return now.withColumnRenamed("c", "component")


def contagion(edges: DataFrame, seeds: DataFrame, decay: float, depth: int) -> DataFrame:
    """(id, shock): the strongest shock that reaches a node from ``seeds`` (id, shock), times ``decay`` and the edge's w a hop."""
    edges = cut(edges.select("src", "dst", "w"))
    best = front = seeds.select("id", "shock")
    for _ in range(depth):
        front = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("shock") * decay * F.col("w")).alias("shock"))
        front = cut(front)
        best = best.unionAll(front)
    return best.groupBy("id").agg(F.max("shock").alias("shock"))


def degrees(edges: DataFrame, amount: str) -> DataFrame:
    """In and out degree and volume of every node, from one pass over both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.col(amount).alias("a")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.col(amount).alias("a")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.sum(F.when(F.col("o") == 1, F.col("a")).otherwise(0.0)).alias("out_volume"), F.sum(F.when(F.col("o") == 0, F.col("a")).otherwise(0.0)).alias("in_volume"))


def ultimate_parents(children: DataFrame, most: int = 20) -> DataFrame:
    """(id, root, level) from (id, parent) by pointer jumping; a null parent, or oneself, is a root; a larger ring has none."""
    now = cut(children.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.coalesce(F.col("parent") == F.col("id"), F.lit(True)), 0).otherwise(1).alias("level")))
    for _ in range(most):
        over = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        new = cut(now.join(over, "up", "left").select("id", "up", F.coalesce("next", "up").alias("next"), "level", F.when(F.col("next") != F.col("up"), F.col("more")).otherwise(0).alias("more")))
        stable = new.where("next <> up").isEmpty()
        now = new.select("id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        if stable:
            break
    return now.select("id", F.col("up").alias("root"), "level")


def betweenness(edges: DataFrame, sources: DataFrame, most: int = 10) -> DataFrame:
    """(id, score): how much of all shortest paths of at most ``most`` hops from ``sources`` (id) runs through a node.

    Path counts go forward level by level, dependencies come back the same way; each level is one join and one aggregate.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    levels = [cut(sources.select(F.col("id").alias("start"), "id", F.lit(1.0).alias("paths")).distinct())]
    seen = levels[0].select("start", "id")
    for _ in range(most):
        step = levels[-1].join(edges, F.col("id") == F.col("src")).groupBy("start", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen, ["start", "id"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionAll(new.select("start", "id"))
    owed = levels[-1].withColumn("delta", F.lit(0.0))
    parts = [owed]
    for level in reversed(levels[:-1]):
        below = owed.select("start", F.col("id").alias("dst"), F.col("paths").alias("q"), "delta")
        share = level.join(edges, F.col("id") == F.col("src")).join(below, ["start", "dst"]).groupBy("start", "id").agg(F.sum(F.col("paths") / F.col("q") * (1 + F.col("delta"))).alias("delta"))
        owed = cut(level.join(share, ["start", "id"], "left").select("start", "id", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        parts.append(owed)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.where("id <> start").groupBy("id").agg(F.sum("delta").alias("score"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling (id, label) of undirected weighted edges (src, dst, w)."""
    named = edges.join(label.toDF("src", "ls"), "src").join(label.toDF("dst", "ld"), "dst").select("ls", "ld", "w")
    inside = named.groupBy(F.col("ls").alias("l")).agg(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inner"))
    ends = named.select(F.explode(F.array("ls", "ld")).alias("l"), "w").groupBy("l").agg(F.sum("w").alias("degree"))
    total = edges.agg(F.sum("w").alias("m"))
    return ends.join(inside, "l", "left").crossJoin(F.broadcast(total)).agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int, weight: str, product: bool = False) -> DataFrame:
    """(start, id, hop, paths, path, total) of everything within ``most`` hops of ``starts`` (id): how many shortest paths there are,
    the first of them in order of ids, and the sum (or product) of ``weight`` along it."""
    edges = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("q")).where("src <> dst"))
    empty = 1.0 if product else 0.0
    front = cut(starts.select(F.col("id").alias("start"), "id").distinct().select("start", "id", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("paths"), F.array("id").alias("path"), F.lit(empty).alias("total")))
    seen = front
    for k in range(1, most + 1):
        total = F.col("total") * F.col("q") if product else F.col("total") + F.col("q")
        step = front.join(edges, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), "paths", F.struct(F.array_append("path", F.col("dst")).alias("path"), total.alias("total")).alias("way"))
        new = step.groupBy("start", "id").agg(F.sum("paths").alias("paths"), F.min("way").alias("way")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(new.select("start", "id", F.lit(k).alias("hop"), "paths", "way.path", "way.total"))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, most: int, weight: str, first: int) -> DataFrame:
    """(start, hops, path, total) of the ``first`` simple paths from each start, the shorter first, then by ids.

    Paths of a length are all that a longer one can come from, and a start that has had its number drops out, so what is kept
    is bounded by the starts. Within a length each start's paths are the first ones of its first ones: order by ids is order
    of prefixes.
    """
    edges = cut(edges.select("src", "dst", F.col(weight).alias("q")).where("src <> dst"))
    front = cut(starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.lit(0.0).alias("total")))
    found, had = None, starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("had"))
    for k in range(1, most + 1):
        step = front.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", F.array_append("path", F.col("dst")).alias("path"), (F.col("total") + F.col("q")).alias("total"))
        front = cut(step.join(had.where(F.col("had") < first), "start"))
        if front.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("start").orderBy("path"))
        own = cut(front.withColumn("nth", nth).where(F.col("nth") + F.col("had") <= first).select("start", F.lit(k).alias("hops"), "path", "total"))
        found = own if found is None else found.unionAll(own)
        had = cut(had.join(own.groupBy("start").agg(F.count("*").alias("new")), "start", "left").select("start", (F.col("had") + F.coalesce("new", F.lit(0))).alias("had")))
        front = front.select("start", "path", "total")
    return found if found is not None else front.select("start", F.lit(0).alias("hops"), "path", "total")


def strong(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of strongly connected components of two nodes or more, each named by its largest id.

    Every node takes the largest id that reaches it, going forward until nothing changes; the nodes of one colour that reach the
    node it is named by are its component. They leave, as do nodes without a way in or out and edges between colours, and the
    rest goes on: all pivots work at once. Nothing but one label a node is carried.
    """
    rest, found = cut(edges.select("src", "dst").where("src <> dst").distinct()), []
    while True:
        ins, outs = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        rest = cut(rest.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if rest.isEmpty():
            break
        now = cut(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct().withColumn("c", F.col("id")))
        while True:
            come = rest.join(now.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            new = cut(now.join(come, "id", "left").select("id", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("moved")))
            now = new.select("id", "c")
            if new.where("moved").isEmpty():
                break
        inner = rest.join(now.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(now.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst").where("cs = cd")
        inner = cut(inner.select("src", "dst", F.col("cs").alias("c")))
        front = back = cut(now.where("id = c"))
        while True:
            before = inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = cut(before.join(back.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        found.append(back)
        gone = back.select("id")
        rest = inner.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    out = edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("id"), F.col("src").alias("component")).schema)
    for part in found:
        out = out.unionAll(part)
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(sizes, "component", "left_semi").select("id", "component")


def core(edges: DataFrame) -> DataFrame:
    """The edges that lie on some ring: those inside a strongly connected component."""
    part = cut(strong(edges))
    plain = edges.select("src", "dst").where("src <> dst").distinct()
    both = plain.join(part.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(part.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
    return cut(both.where("a = b").select("src", "dst"))


def rings(edges: DataFrame, lengths) -> DataFrame:
    """(length, start, ring) of the directed rings of each length, as text from the smallest node. Paths are made inside strongly
    connected components only."""
    inner = core(edges)
    found = []
    for n in lengths:
        nodes = [f"n{i}" for i in range(1, n + 1)]
        found.append(cycles(inner, n).select(F.lit(n).alias("length"), F.col("n1").alias("start"), F.concat_ws(">", *[F.col(c).cast("string") for c in nodes]).alias("ring")))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def first_rows(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows in an order without ties, which no single task sorts: ranges are sorted, and their sizes say where each
    begins."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)
    sizes = dealt.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    by = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_piece", "_first", F.coalesce(F.sum("_k").over(by), F.lit(0)).alias("_before")).where(F.col("_before") < k)
    return dealt.withColumn("_piece", piece).join(starts, "_piece").where(F.col("_at") - F.col("_first") + F.col("_before") < k).select(df.columns)


def spread_risk(edges: DataFrame, own: DataFrame, decay: float, least: float, most: int) -> DataFrame:
    """(id, risk) from own risks (id, risk): the largest of a node's own and what comes along edges (src, dst, w) from the riskiest
    tenth (three at least), times ``decay`` and w a hop, as long as it is ``least`` or more; over the largest, doubled, 1 at most."""
    edges, own = cut(edges.select("src", "dst", "w")), cut(own.select("id", "risk"))
    best = own
    front = first_rows(own, [F.desc("risk"), "id"], max(3, own.count() // 10)).select("id", F.col("risk").alias("val"))
    for _ in range(most):
        step = front.where(F.col("val") >= least).join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("val") * decay * F.col("w")).alias("val"))
        front = cut(step)
        if front.isEmpty():
            break
        best = best.unionAll(front.select("id", F.col("val").alias("risk")))
    top = best.groupBy("id").agg(F.max("risk").alias("risk"))
    return top.crossJoin(F.broadcast(top.agg(F.max("risk").alias("most")))).select("id", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("risk"), F.col("most")), F.lit(0.0)) * 2).alias("risk"))


def tree(children: DataFrame) -> DataFrame:
    """(id, path, level, children) from (id, parent): the path from the root, level by level until none is left; a null parent is a
    root. Ids are unique; those on a ring of parents, or below one, have no root and no row."""
    children = cut(children.select("id", "parent"))
    front = children.where("parent is null").select("id", F.col("id").cast("string").alias("path"), F.lit(0).alias("level"))
    out, k, most = front, 0, None
    while True:
        k += 1
        above = front.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        front = cut(children.join(above, "parent").select("id", F.concat_ws("/", "up", F.col("id").cast("string")).alias("path"), F.lit(k).alias("level")))
        if front.isEmpty():
            break
        if k % 64 == 0:  # no chain is longer than there are nodes
            most = children.count() if most is None else most
            if k > most:
                raise ValueError("an id stands below itself: ids are not unique")
            out = cut(out)
        out = out.unionAll(front)
    counts = children.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return out.join(counts, "id", "left").select("id", "path", "level", F.coalesce("children", F.lit(0).cast("long")).alias("children"))


def greedy_modularity(edges: DataFrame, sweeps: int = 20) -> DataFrame:
    """(id, label): communities by moves that raise the modularity of undirected weights most.

    In each sweep the nodes of one half move at once to the community that gains most, if any gains; ties go to the smallest
    label. Halves are drawn anew by a hash for every two sweeps, which take one half each: nodes that want each other's community and
    fall into one half only swap, and with fixed halves they would swap for ever. It ends when both halves have moved nothing. Gains
    need only the weights between a node and its neighbours' communities and the communities' totals: two aggregates a sweep.
    """
    both = cut(edges.select("src", "dst", "w").where("src <> dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w").where("src <> dst")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    loops = edges.where("src = dst").select(F.col("src").alias("id"), (2 * F.col("w")).alias("w"))
    strength = cut(both.select(F.col("src").alias("id"), "w").unionAll(loops).groupBy("id").agg(F.sum("w").alias("k")))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    now, still = strength.select("id", "k", F.col("id").alias("label")), 0
    for sweep in range(sweeps):
        sums = now.groupBy("label").agg(F.sum("k").alias("total"))
        near = both.join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("inner"))
        own = now.join(near, ["id", "label"], "left").join(sums, "label").select("id", "k", F.col("label").alias("old"), F.coalesce("inner", F.lit(0.0)).alias("old_inner"), (F.col("total") - F.col("k")).alias("old_total"))
        turn = F.pmod(F.xxhash64("id", F.lit(sweep // 2)), F.lit(2)) == sweep % 2
        options = own.where(turn).join(near, "id").where("label <> old").join(sums, "label")
        gain = F.col("inner") - F.col("old_inner") - F.col("k") * (F.col("total") - F.col("old_total")) / total
        best = options.withColumn("gain", F.round(gain, 6)).where("gain > 0").groupBy("id").agg(F.max(F.struct("gain", (-F.col("label")).alias("neg"))).alias("b"))
        moved = cut(now.join(best, "id", "left").select("id", "k", F.coalesce(-F.col("b.neg"), "label").alias("label"), F.col("b").isNotNull().alias("moved")))
        still = still + 1 if moved.where("moved").isEmpty() else 0
        now = moved.select("id", "k", "label")
        if still == 2 and sweep % 2:
            break
    names = now.groupBy("label").agg(F.min("id").alias("name"))
    return now.join(names, "label").select("id", F.col("name").alias("label"))


def louvain(edges: DataFrame, sweeps: int = 20, least: float = 1e-7) -> DataFrame:
    """(id, label): communities level by level. Nodes move (``greedy_modularity``), communities become the nodes of a smaller graph
    whose edges add up what lay between them, and moves go on there, until a level gains less than ``least`` of modularity. A level
    that gains nothing is not taken, so the result is never worse than one level's. Labels are the smallest ids."""
    edges = cut(edges.select("src", "dst", "w"))
    graph, now, had = edges, None, None
    while True:
        moved = cut(greedy_modularity(graph, sweeps))
        new = moved if now is None else now.join(moved.toDF("label", "into"), "label").select("id", F.col("into").alias("label"))
        new = cut(new)
        gained = modularity(edges, new).first()[0]
        if had is not None and (gained is None or gained < had + least):
            break
        now, had = new, gained
        ends = graph.join(moved.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(moved.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
        graph = cut(ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")))
        if had is None or graph.where("src <> dst").isEmpty():
            break
    names = now.groupBy("label").agg(F.min("id").alias("name"))
    return now.join(names, "label").select("id", F.col("name").alias("label"))
