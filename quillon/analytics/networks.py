"""Graph analytics over transfers between customers, and ledgers and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.derive import doubles
from quillon.analytics.registry import query, table
from quillon.analytics.risk import trade
from quillon.functions import numbers
from quillon.operators import graphs, ledgers
from quillon.operators.simulate import normal, uniform

TRADE = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
#: Large transfers between customers: an edge for each fifth order or so, so the graph grows with the tables.
LINKS = "t AS (SELECT o_custkey AS src, (o_custkey * 31 + o_orderkey * 7) % (SELECT max(c_custkey) + 1 FROM customer) AS dst, o_totalprice AS w FROM orders WHERE o_totalprice > 400000), g AS (SELECT src, dst, sum(w) AS w FROM t WHERE src <> dst GROUP BY ALL)"


def strong(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, w): large transfers between customers."""
    n = table(spark, sf, "customer").agg((F.max("c_custkey") + 1).alias("n"))  # one row
    o = table(spark, sf, "orders").where("o_totalprice > 400000").crossJoin(F.broadcast(n))
    t = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey") * 7) % F.col("n")).alias("dst"), F.col("o_totalprice").alias("w"))
    return graphs.cut(t.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))


def _rank_sql(rounds: int, dangling: bool, every: int = 5, tolerance: float = 1e-6, edges: str = "src, dst FROM g") -> str:
    """PageRank round by round; of the rounds that are looked at, the first that moved no rank by ``tolerance``, or the last."""
    spread = "(SELECT coalesce(sum(rank), 0) FROM {p} WHERE deg IS NULL) / n" if dangling else "0"
    parts = [f"WITH {LINKS}, h AS MATERIALIZED (SELECT DISTINCT {edges}), d AS (SELECT src, count(*) AS deg FROM h GROUP BY 1), v AS MATERIALIZED (SELECT id, deg FROM (SELECT src AS id FROM h UNION SELECT dst FROM h) LEFT JOIN d ON id = src), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS MATERIALIZED (SELECT id, deg, 1 / n AS rank FROM v, c)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(f"r{k} AS MATERIALIZED (SELECT v.id, v.deg, 0.15 / n + 0.85 * (coalesce(i.s, 0) + {spread.format(p=p)}) AS rank FROM v CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / deg) AS s FROM h JOIN {p} ON src = id GROUP BY 1) i ON i.dst = v.id)")
    seen = [k for k in range(1, rounds + 1) if k % every == 0]
    moved = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT max(abs(x.rank - y.rank)) FROM r{k} x JOIN r{k - 1} y USING (id)) AS m" for k in seen)
    all_ = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM r{k}" for k in seen)
    return ", ".join(parts) + f", m AS ({moved}), stop AS (SELECT coalesce(min(k) FILTER (m < {tolerance}), {seen[-1]}) AS k FROM m) SELECT id, round(rank, 8) AS rank FROM ({all_}) JOIN stop USING (k)"


@query(_rank_sql(50, True))
def g_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """At most 50 rounds, until no rank moves by 1e-6; the mass of dead ends is spread."""
    return graphs.pagerank(strong(spark, sf), 50, tolerance=1e-6).select("id", F.round("rank", 8).alias("rank"))


@query(_rank_sql(30, False, tolerance=0))
def g_pagerank_30(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty rounds, the mass of dead ends lost."""
    return graphs.pagerank(strong(spark, sf), 30, dangling=False).select("id", F.round("rank", 8).alias("rank"))


@query(_rank_sql(50, False, edges="dst AS src, src AS dst FROM g"))
def g_pagerank_rev(spark: SparkSession, sf: str) -> DataFrame:
    """Along reversed edges: a node's rank comes from those it points to."""
    back = strong(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.pagerank(back, 50, dangling=False, tolerance=1e-6).select("id", F.round("rank", 8).alias("rank"))


@query(_rank_sql(50, True, edges="src, dst FROM (SELECT src, dst FROM g UNION SELECT dst, src FROM g)").replace("SELECT id, round(rank, 8) AS rank FROM (", "SELECT id, round(rank, 8) AS rank, (SELECT count(*) FROM h WHERE h.src = id) AS degree FROM ("))
def g_pagerank_und(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks and degrees when every edge goes both ways (its betweenness is g_centrality)."""
    g = strong(spark, sf)
    both = graphs.cut(g.select("src", "dst").union(g.select("dst", "src")).distinct())
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graphs.pagerank(both, 50, tolerance=1e-6).join(degree, "id").select("id", F.round("rank", 8).alias("rank"), "degree")


#: Nodes that searches start from: a stated set, one customer in 40.
STARTS = "SELECT DISTINCT src AS id FROM g WHERE src % 20 = 0"


def starts(g: DataFrame) -> DataFrame:
    return g.where("src % 20 = 0").select(F.col("src").alias("id")).distinct()


@query(f"""
WITH RECURSIVE {LINKS}, r AS (SELECT id AS start, id, 0 AS hop FROM ({STARTS}) UNION SELECT r.start, g.dst, r.hop + 1 FROM r JOIN g ON g.src = r.id WHERE r.hop < 4)
SELECT start, id, min(hop)::INT AS hop FROM r GROUP BY ALL
""")
def g_bfs_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Everything within four hops of each start, at its least hop."""
    g = strong(spark, sf)
    return graphs.hops(g, starts(g), 4).select("start", "id", "hop")


KIND = "CASE src % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.3 END"
PATHS = f"""
k AS (SELECT src, dst, {KIND}::DOUBLE AS q FROM g), r AS (SELECT id AS start, id, 0 AS hop, [id] AS path, 0.0::DOUBLE AS total FROM ({STARTS}) UNION ALL SELECT r.start, k.dst, r.hop + 1, list_append(r.path, k.dst), r.total + k.q FROM r JOIN k ON k.src = r.id WHERE r.hop < 5 AND NOT list_contains(r.path, k.dst)),
b AS (SELECT *, rank() OVER (PARTITION BY start, id ORDER BY hop) AS shortest, row_number() OVER (PARTITION BY start, id ORDER BY hop, path) AS first FROM r WHERE hop > 0)
"""


@query(f"""
WITH RECURSIVE {LINKS}, {PATHS}, n AS (SELECT start, id, count(*) AS paths FROM b WHERE shortest = 1 GROUP BY ALL)
SELECT start, id, hop::INT AS hop, n.paths, array_to_string(path, '>') AS path, round(total / hop / hop, 6) AS strength, hop >= 3 AS hidden FROM b JOIN n USING (start, id) WHERE first = 1
""")
def g_bfs_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All shortest paths of at most five hops from each start: how many, the first in order of ids, its strength (mean weight of
    its relations over its hops), and whether the link is hidden (three hops or more)."""
    g = strong(spark, sf)
    got = graphs.shortest_paths(g.withColumn("q", F.expr(f"cast({doubles(KIND)} as double)")), starts(g), 5, "q")
    return got.where("hop > 0").select("start", "id", "hop", "paths", F.concat_ws(">", "path").alias("path"), F.round(F.col("total") / F.col("hop") / F.col("hop"), 6).alias("strength"), (F.col("hop") >= 3).alias("hidden"))


@query(f"""
WITH RECURSIVE {LINKS}, {PATHS} SELECT start AS src, id AS dst, hop::INT AS hops, array_to_string(path, '>') AS path FROM b WHERE first = 1 AND hop BETWEEN 2 AND 4
""")
def g_paths_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The first shortest path of each start and each node two to four hops away."""
    g = strong(spark, sf)
    got = graphs.shortest_paths(g.withColumn("q", F.lit(1.0)), starts(g), 4, "q").where("hop between 2 and 4")
    return got.select(F.col("start").alias("src"), F.col("id").alias("dst"), F.col("hop").alias("hops"), F.concat_ws(">", "path").alias("path"))


@query(f"""
WITH RECURSIVE {LINKS}, {PATHS}, p AS (SELECT start, id, hop, path FROM b WHERE first = 1 AND hop BETWEEN 2 AND 4),
e AS (SELECT start, id, hop, unnest(path) AS n, unnest(range(1, len(path) + 1)) AS i FROM p), c AS (SELECT e.*, c_nationkey AS country, ([0, 10, 30, 60, 90])[n % 5 + 1] AS level FROM e JOIN customer ON c_custkey = n),
s AS (SELECT start, id, hop, max(level) AS top, avg(level) AS mean, count(DISTINCT country) > 1 AS crossing FROM c GROUP BY ALL)
SELECT start AS src, id AS dst, crossing, round(least(top + mean + CASE WHEN crossing THEN 20 ELSE 0 END - 2 * hop, 100), 4) AS risk FROM s
""")
def g_flow_score(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of each path: its largest and mean sensitivity, 20 more across a border, 2 less a hop, 100 at most."""
    g = strong(spark, sf)
    paths = graphs.shortest_paths(g.withColumn("q", F.lit(1.0)), starts(g), 4, "q").where("hop between 2 and 4")
    nodes = paths.select("start", "id", "hop", F.explode("path").alias("n"))
    level = F.element_at(F.array(*map(F.lit, [0, 10, 30, 60, 90])), (F.col("n") % 5 + 1).cast("int"))
    met = nodes.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("country")), "n")
    got = met.groupBy("start", "id", "hop").agg(F.max(level).alias("top"), F.avg(level).alias("mean"), (F.min("country") != F.max("country")).alias("crossing"))
    risk = F.least(F.col("top") + F.col("mean") + F.when(F.col("crossing"), 20).otherwise(0) - 2 * F.col("hop"), F.lit(100.0))
    return got.select(F.col("start").alias("src"), F.col("id").alias("dst"), "crossing", F.round(risk, 4).alias("risk"))


def _ring_sql(length: int) -> str:
    tables = ", ".join(f"g e{i}" for i in range(1, length + 1))
    joins = " AND ".join([f"e{i}.dst = e{i + 1}.src" for i in range(1, length)] + [f"e{length}.dst = e1.src"] + [f"e1.src < e{i}.src" for i in range(2, length + 1)] + [f"e{i}.src <> e{j}.src" for i in range(2, length + 1) for j in range(i + 1, length + 1)])
    nodes = " || '>' || ".join(f"e{i}.src::VARCHAR" for i in range(1, length + 1))
    return f"SELECT {length} AS length, e1.src AS start, {nodes} AS ring FROM {tables} WHERE {joins}"


@query(f"WITH {LINKS} " + " UNION ALL ".join(map(_ring_sql, range(3, 7))))
def g_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of three to six, each once, from its smallest node. Only nodes of a strongly connected core can be on one, so those
    without a way in or out leave first."""
    return graphs.rings(strong(spark, sf), range(3, 7))


@query(f"WITH {LINKS}, r AS (" + " UNION ALL ".join(map(_ring_sql, (3, 4))) + ") SELECT start, length, ring FROM r QUALIFY row_number() OVER (PARTITION BY start ORDER BY length, ring) = 1")
def g_cycle_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first ring of three or four for each smallest node, the shorter first."""
    got = graphs.rings(strong(spark, sf), (3, 4))
    return got.groupBy("start").agg(F.min(F.struct("length", "ring")).alias("x")).select("start", "x.length", "x.ring")


@query(f"""
WITH RECURSIVE {LINKS}, r AS (SELECT id AS start, id, [id] AS path, 0.0::DOUBLE AS total FROM ({STARTS}) UNION ALL SELECT r.start, g.dst, list_append(r.path, g.dst), r.total + g.w FROM r JOIN g ON g.src = r.id WHERE len(r.path) <= 6 AND NOT list_contains(r.path, g.dst)),
b AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), path) AS i FROM r WHERE len(path) > 1)
SELECT start, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path, round(total, 2) AS total FROM b WHERE i <= 20
""")
def g_trace_funds(spark: SparkSession, sf: str) -> DataFrame:
    """Where funds go from each start: the first twenty simple paths of at most six hops, with their amounts."""
    g = strong(spark, sf)
    got = graphs.simple_paths(g, starts(g), 6, "w", 20)
    return got.select("start", "hops", F.concat_ws(">", "path").alias("path"), F.round("total", 2).alias("total"))


@query(f"""
WITH RECURSIVE {LINKS}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT src AS id, src AS c FROM u UNION SELECT u.dst, r.c FROM r JOIN u ON u.src = r.id WHERE r.c < u.dst)
SELECT id, min(c) AS component FROM r GROUP BY 1
""")
def g_cc(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components."""
    return graphs.components(strong(spark, sf))


def _label_sql(rounds: int) -> str:
    parts = [f"WITH {LINKS}, u AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g), l0 AS (SELECT DISTINCT src AS id, src AS label FROM u)"]
    for k in range(1, rounds + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT dst AS id, label FROM (SELECT dst, label, count(*) AS n FROM u JOIN l{k - 1} ON src = id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) = 1)")
    return ", ".join(parts) + f" SELECT id, label FROM l{rounds}"


@query(_label_sql(5))
def g_lpa(spark: SparkSession, sf: str) -> DataFrame:
    """Synchronous label propagation, five rounds, ties to the smallest label."""
    return graphs.labels(strong(spark, sf), 5).select("id", "label")


@query()
def g_louvain(spark: SparkSession, sf: str) -> DataFrame:
    """Communities by modularity, level by level: nodes move, then communities as nodes of a smaller graph. Nodes of alternating halves
    move at once, so the result does not depend on an order of nodes; tests hold its modularity against one level's."""
    return graphs.louvain(strong(spark, sf))


@query(f"""
WITH RECURSIVE {LINKS}, x AS (SELECT src, dst, w / (SELECT max(w) FROM g) AS q FROM g), s AS (SELECT src AS id, 1.0::DOUBLE AS shock FROM g GROUP BY src QUALIFY row_number() OVER (ORDER BY sum(w) DESC, src) <= 3),
r AS (SELECT id, shock, 0 AS d FROM s UNION SELECT x.dst, r.shock * 0.7 * x.q * (1 - (x.dst % 10) / 10.0), r.d + 1 FROM r JOIN x ON x.src = r.id WHERE r.d < 5)
SELECT id, round(max(shock)::DOUBLE, 6) AS shock FROM r GROUP BY 1
""")
def g_contagion(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest shock from the three largest senders within five hops, weaker by .7, the edge and the receiver's health."""
    g = strong(spark, sf)
    x = g.crossJoin(F.broadcast(g.agg(F.max("w").alias("top")))).select("src", "dst", (F.col("w") / F.col("top") * (1 - (F.col("dst") % 10) / 10.0)).alias("w"))
    seeds = g.groupBy("src").agg(F.sum("w").alias("t")).orderBy(F.desc("t"), "src").limit(3).select(F.col("src").alias("id"), F.lit(1.0).alias("shock"))
    return graphs.contagion(x, seeds, 0.7, 5).select("id", F.round("shock", 6).alias("shock"))


@query(f"""
WITH RECURSIVE {LINKS}, x AS (SELECT src, dst, w / (SELECT max(w) FROM g) AS q FROM g), v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), b AS (SELECT id, (id * 7919 % 1000) / 1000.0 AS risk FROM v), s AS (SELECT * FROM b QUALIFY row_number() OVER (ORDER BY risk DESC, id) <= greatest(3, (SELECT count(*) FROM v) // 10)),
r AS (SELECT id, risk::DOUBLE AS val, 0 AS d FROM s UNION SELECT x.dst, r.val * 0.7 * x.q, r.d + 1 FROM r JOIN x ON x.src = r.id WHERE r.d <= 8 AND r.val >= 0.01), m AS (SELECT id, max(risk) AS risk FROM (SELECT id, risk::DOUBLE AS risk FROM b UNION ALL SELECT id, val FROM r) GROUP BY 1)
SELECT id, round(least(1.0, risk / (SELECT max(risk) FROM m) * 2)::DOUBLE, 6) AS risk FROM m
""")
def g_risk_prop(spark: SparkSession, sf: str) -> DataFrame:
    """Own risks, and what reaches a node from the riskiest tenth along edges at .7 a hop while it is .01 or more, nine hops at
    most, over the largest, doubled, 1 at most."""
    g = strong(spark, sf)
    x = g.crossJoin(F.broadcast(g.agg(F.max("w").alias("top")))).select("src", "dst", (F.col("w") / F.col("top")).alias("w"))
    own = g.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("risk", (F.col("id") * 7919 % 1000) / 1000.0)
    return graphs.spread_risk(x, own, 0.7, 0.01, 9).select("id", F.round("risk", 6).alias("risk"))


@query(f"""
WITH RECURSIVE {LINKS}, {PATHS}, pr AS (SELECT id AS n, (id * 7919 % 1000) / 100000.0 AS rank FROM (SELECT src AS id FROM g UNION SELECT dst FROM g)),
f AS (SELECT start, id, hop, path[len(path) - 1] AS before FROM b WHERE first = 1 AND hop <= 3)
SELECT start, count(*) + 1 AS reached, round(sum(w / 500000 / hop * rank)::DOUBLE, 6) AS score FROM f JOIN g ON g.src = before AND g.dst = f.id JOIN pr ON n = f.id GROUP BY 1
""")
def g_propagate(spark: SparkSession, sf: str) -> DataFrame:
    """How far an event spreads from each start within three hops: nodes reached, and the sum of edge over depth times rank."""
    g = strong(spark, sf)
    paths = graphs.shortest_paths(g.withColumn("q", F.lit(1.0)), starts(g), 3, "q").where("hop > 0")
    last = paths.select("start", F.col("id").alias("dst"), "hop", F.element_at("path", -2).alias("src"))
    rank = (F.col("dst") * 7919 % 1000) / 100000.0
    met = last.join(g, ["src", "dst"])
    return met.groupBy("start").agg((F.count("*") + 1).alias("reached"), F.round(F.sum(F.col("w") / 500_000 / F.col("hop") * rank), 6).alias("score"))


OWNERS = "o AS (SELECT c_custkey AS child, c_custkey // 3 AS owner, 0.6 AS ratio FROM customer WHERE c_custkey % 7 <> 1 AND c_custkey > 2 UNION ALL SELECT c_custkey, c_custkey // 5, 0.3 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey > 4)"


@query(f"""
WITH RECURSIVE {OWNERS}, h AS (SELECT child, owner, max(ratio) AS ratio FROM o GROUP BY ALL), r AS (SELECT c_custkey AS start, c_custkey AS id, [c_custkey] AS path, 1.0::DOUBLE AS ratio FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT r.start, h.owner, list_append(r.path, h.owner), r.ratio * h.ratio FROM r JOIN h ON h.child = r.id WHERE len(r.path) <= 20 AND NOT list_contains(r.path, h.owner)),
f AS (SELECT * FROM r WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY len(path), path) = 1)
SELECT start, id AS controller, array_to_string(path, '>') AS path, round(ratio, 6) AS ratio FROM f WHERE id NOT IN (SELECT child FROM h)
""")
def g_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Ultimate controllers of a stated set of companies, one in ten: upwards over holdings to owners that nobody holds, each by its
    first shortest path, with the product of the shares along it."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    one = c.where("c_custkey % 7 <> 1 and c_custkey > 2").select(k.alias("src"), F.expr("c_custkey div 3").alias("dst"), F.lit(0.6).alias("ratio"))
    two = c.where("c_custkey % 4 = 0 and c_custkey > 4").select(k.alias("src"), F.expr("c_custkey div 5").alias("dst"), F.lit(0.3).alias("ratio"))
    held = graphs.cut(one.unionAll(two).groupBy("src", "dst").agg(F.max("ratio").alias("ratio")))
    paths = graphs.shortest_paths(held, c.where("c_custkey % 10 = 0").select(k.alias("id")), 20, "ratio", product=True).where("hop > 0")
    top = paths.join(held.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return top.select("start", F.col("id").alias("controller"), F.concat_ws(">", "path").alias("path"), F.round("total", 6).alias("ratio"))


@query(f"""
WITH {LINKS}, s AS ({STARTS}) SELECT DISTINCT a.src::VARCHAR || '>' || a.dst::VARCHAR || '>' || b.dst::VARCHAR AS path, 2 AS hops FROM s JOIN g a ON a.src = s.id JOIN g b ON b.src = a.dst
UNION ALL SELECT DISTINCT a.src::VARCHAR || '>' || a.dst::VARCHAR || '>' || b.dst::VARCHAR || '>' || c.dst::VARCHAR, 3 FROM s JOIN g a ON a.src = s.id JOIN g b ON b.src = a.dst JOIN g c ON c.src = b.dst
""")
def g_fund_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of funds of two and three hops from each start, each once; a path may come back."""
    g = strong(spark, sf).select("src", "dst")
    out = starts(g).select(F.array("id").alias("path"))
    found = []
    for k in range(1, 4):
        out = out.join(g, F.element_at("path", -1) == F.col("src")).select(F.array_append("path", F.col("dst")).alias("path"))
        if k > 1:
            found.append(out.select(F.concat_ws(">", "path").alias("path"), F.lit(k).alias("hops")))
    return found[0].unionAll(found[1])


@query(f"WITH {LINKS}, b AS (SELECT src AS id, 1 AS o, w * (src % 5) / 10.0 AS a FROM g UNION ALL SELECT dst, 0, w * (src % 5) / 10.0 FROM g) SELECT id, sum(o)::BIGINT AS given, sum(1 - o)::BIGINT AS taken, round(coalesce(sum(a) FILTER (o = 1), 0), 4) AS exposure FROM b GROUP BY 1")
def agg_guarantee(spark: SparkSession, sf: str) -> DataFrame:
    """Guarantees given and taken by each party, and what it stands for: amounts times their ratio."""
    x = strong(spark, sf).withColumn("a", F.col("w") * (F.col("src") % 5) / 10.0)
    return graphs.degrees(x, "a").select("id", F.col("out_degree").alias("given"), F.col("in_degree").alias("taken"), F.round("out_volume", 4).alias("exposure"))


@query(f"""
WITH {TRADE}, b AS (SELECT src AS id, 1 AS o, w FROM e UNION ALL SELECT dst, 0, w FROM e)
SELECT id, sum(o)::BIGINT AS out_degree, sum(1 - o)::BIGINT AS in_degree, round(coalesce(sum(w) FILTER (o = 1), 0), 2) AS out_volume, round(coalesce(sum(w) FILTER (o = 0), 0), 2) AS in_volume FROM b GROUP BY 1
""")
def agg_degree_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees and volumes."""
    got = graphs.degrees(trade(spark, sf), "w")
    return got.select("id", "out_degree", "in_degree", F.round("out_volume", 2).alias("out_volume"), F.round("in_volume", 2).alias("in_volume"))


@query(f"WITH {LINKS} SELECT src, dst, a.c_nationkey AS from_nation, b.c_nationkey AS to_nation FROM g JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE a.c_nationkey <> b.c_nationkey")
def g_cross_border(spark: SparkSession, sf: str) -> DataFrame:
    """Flows that leave their country."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return strong(spark, sf).join(c.toDF("src", "from_nation"), "src").join(c.toDF("dst", "to_nation"), "dst").where("from_nation <> to_nation").select("src", "dst", "from_nation", "to_nation")


@query("""
WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 1 OR c_custkey = 0 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer), ok AS (SELECT id, CASE WHEN parent IN (SELECT id FROM p) THEN parent END AS parent FROM p),
r AS (SELECT id, id AS root, 0 AS level FROM ok WHERE parent IS NULL UNION ALL SELECT ok.id, r.root, r.level + 1 FROM ok JOIN r ON ok.parent = r.id)
SELECT id, root, level FROM r
""")
def g_group(spark: SparkSession, sf: str) -> DataFrame:
    """Ultimate parents in a derived ownership tree."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 1, F.expr("c_custkey div 3")).alias("parent"))
    known = c.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return graphs.ultimate_parents(c.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent")))


@query("""
WITH h AS (SELECT o_custkey, sha256(o_orderkey || '|' || o_orderstatus) AS h, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS block, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4 AS i FROM orders),
b AS (SELECT o_custkey, block, count(*) AS n, list(h ORDER BY i) AS hs FROM h GROUP BY ALL),
p AS (SELECT o_custkey, block, n, CASE n WHEN 1 THEN hs[1] WHEN 2 THEN sha256(hs[1] || hs[2]) ELSE sha256(sha256(hs[1] || hs[2]) || CASE WHEN n = 3 THEN sha256(hs[3] || hs[3]) ELSE sha256(hs[3] || hs[4]) END) END AS root FROM b)
SELECT o_custkey, block, n, root, sha256(coalesce(lag(root) OVER (PARTITION BY o_custkey ORDER BY block), '') || root) AS link FROM p
""")
def lg_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of four with Merkle roots, linked."""
    b = ledgers.blocks(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus"), 4)
    return ledgers.linked(b, ["o_custkey"], ["block"], "root")


@query("""
WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 1 OR c_custkey = 0 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer),
r AS (SELECT id, id::VARCHAR AS path, 0 AS level FROM p WHERE parent IS NULL UNION ALL SELECT p.id, r.path || '/' || p.id::VARCHAR, r.level + 1 FROM p JOIN r ON p.parent = r.id), n AS (SELECT parent, count(*) AS children FROM p WHERE parent IS NOT NULL GROUP BY 1)
SELECT r.id, path, level, coalesce(children, 0) AS children FROM r LEFT JOIN n ON n.parent = r.id
""")
def g_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Parents and children as a tree: each node with its path from the root, its level and the number of its children."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.when((k % 7 != 1) & (k != 0), F.expr("c_custkey div 3")).alias("parent"))
    return graphs.tree(c)


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS h, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS block FROM orders), b AS (SELECT o_custkey, block, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT o_custkey, block, n, (o_custkey + block) % 5 = 0 AS forged, (o_custkey + block) % 7 = 0 AS cut FROM b)
SELECT o_custkey, count(*) AS blocks, sum(forged::INT)::BIGINT AS bad_roots, sum((cut AND block > 0)::INT)::BIGINT AS bad_links FROM t GROUP BY 1
""")
def lg_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of which some blocks were forged (another root than its content has) and some cut from the block before: what the
    check finds, chain by chain."""
    o = table(spark, sf, "orders")
    built = ledgers.linked(ledgers.blocks(o, ["o_custkey"], ["o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus"), 4), ["o_custkey"], ["block"], "root")
    at = F.col("o_custkey") + F.col("block")
    kept = built.select("o_custkey", "block", F.when(at % 5 == 0, F.sha2(F.col("root"), 256)).otherwise(F.col("root")).alias("root"), F.col("root").alias("own"), F.when((at % 7 == 0) & (F.col("block") > 0), F.sha2(F.col("link"), 256)).otherwise(F.col("link")).alias("link"))
    return ledgers.audited(kept, ["o_custkey"], ["block"])


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS block FROM orders) SELECT o_custkey, block, count(*) AS n, min(o_orderkey) AS first_tx, max(o_orderkey) AS last_tx FROM h GROUP BY ALL
""")
def lg_block(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions in blocks of four, by number."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    h = table(spark, sf, "orders").withColumn("block", F.floor((F.row_number().over(by) - 1) / 4))
    return h.groupBy("o_custkey", "block").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_tx"), F.max("o_orderkey").alias("last_tx"))


@query("SELECT s_suppkey, true AS found, true AS first FROM supplier")
def lg_pow(spark: SparkSession, sf: str) -> DataFrame:
    """Proof of work: the nonce found gives a digest with two zeros (checked again by the engine), and none below it does."""
    mined = ledgers.mined(table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("content")), "content", 2)
    digest = lambda n: F.sha2(F.concat(F.col("content"), n.cast("string")), 256)
    earlier = F.exists(F.when(F.col("nonce") > 0, F.sequence(F.lit(0).cast("long"), F.col("nonce") - 1)).otherwise(F.array().cast("array<bigint>")), lambda n: digest(n).startswith("00"))
    return mined.select("s_suppkey", digest(F.col("nonce")).startswith("00").alias("found"), (~earlier).alias("first"))


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS h, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS block, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4 AS i FROM orders),
b AS (SELECT o_custkey, block, count(*) AS n, list(h ORDER BY i) AS hs FROM h GROUP BY ALL)
SELECT o_orderkey, CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS steps, CASE WHEN n = 1 THEN NULL WHEN i % 2 = 1 THEN hs[i] WHEN i + 2 <= n THEN hs[i + 2] ELSE hs[i + 1] END AS sibling, true AS proves FROM h JOIN b USING (o_custkey, block)
""")
def lg_proof(spark: SparkSession, sf: str) -> DataFrame:
    """For each transaction the Merkle proof of its own leaf: its length, its first sibling, and that it leads to the root."""
    from quillon.operators.checks import merkle_proof

    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").withColumn("nth", F.row_number().over(by) - 1)
    rows = o.select("o_custkey", "o_orderkey", F.floor(F.col("nth") / 4).alias("block"), (F.col("nth") % 4).cast("int").alias("i"), F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("h"))
    # four to a block
    leaves = rows.groupBy("o_custkey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("hs"))
    met = rows.join(leaves, ["o_custkey", "block"]).withColumn("proof", merkle_proof(F.col("hs"), F.col("i"), 2))
    end = F.aggregate("proof", F.col("h"), lambda a, s: F.when(s["left"], F.sha2(F.concat(s["hash"], a), 256)).otherwise(F.sha2(F.concat(a, s["hash"]), 256)))
    return met.select("o_orderkey", F.size("proof").alias("steps"), F.get("proof", F.lit(0))["hash"].alias("sibling"), (end == ledgers.merkle(F.col("hs"), 2)).alias("proves"))


@query("""
SELECT p_partkey, round(-p_retailprice * 3 + p_size * 60 / 1.08 + p_size * 60 / 1.08 ** 2 + p_size * 60 / 1.08 ** 3 + p_size * 60 / 1.08 ** 4 + p_size * 60 / 1.08 ** 5, 4) AS npv FROM part
""")
def n_npv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(numbers.npv(F.col("p_retailprice") * 3, F.col("p_size") * 60.0, 5, 0.08), 4).alias("npv"))


@query()
def n_irr(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by bisection; tests hold them against the root of the present value."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("initial"), F.array_repeat(F.col("p_size") * 60.0, 5).alias("flows"))
    return p.select("p_partkey", F.round(numbers.irr(F.col("initial"), F.col("flows")), 6).alias("irr"))


@query("""
SELECT p_brand, f::DOUBLE AS factor, round(sum(p_retailprice * f) - 0.6 * sum(p_retailprice), 2) AS margin FROM part, (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2]) AS f) GROUP BY ALL
""")
def sens_tornado(spark: SparkSession, sf: str) -> DataFrame:
    """A margin at five factors."""
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("t"))
    return p.select("p_brand", "t", F.explode(F.array(*map(F.lit, (0.8, 0.9, 1.0, 1.1, 1.2)))).alias("factor")).select("p_brand", "factor", F.round(F.col("t") * F.col("factor") - 0.6 * F.col("t"), 2).alias("margin"))


@query()
def mc_value(spark: SparkSession, sf: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Monte Carlo by brand: draws are rows, so they spread; each is a hash of its number, the same on any cluster."""
    base = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("t"))
    runs = spark.range(draws).select(normal(seed).alias("g"), uniform(-seed).alias("u"))
    tri = F.when(F.col("u") < 0.5, F.sqrt(F.col("u") / 2)).otherwise(1 - F.sqrt((1 - F.col("u")) / 2))
    x = runs.select((1 + 0.1 * F.col("g")).alias("normal"), (0.8 + 0.4 * tri).alias("triangular")).crossJoin(F.broadcast(base))
    return x.groupBy("p_brand").agg(F.percentile(F.col("t") * F.col("normal") * F.col("triangular"), F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("p")).select("p_brand", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"))
