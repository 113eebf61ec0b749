"""Statistics, models, ordered series, groups and simulations over the tables, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.derive import doubles
from quillon.analytics.registry import query, table
from quillon.functions import numbers
from quillon.operators import diffs, rules, series, stats, vectors
from quillon.sources.scratch import fresh

BENFORD = ", ".join(f"({d}, {math.log10(1 + 1 / d)!r})" for d in range(1, 10))


@query(f"""
WITH c AS (SELECT o_orderstatus, substr(floor(o_totalprice)::BIGINT::VARCHAR, 1, 1)::INT AS d, count(*) AS k FROM orders WHERE o_totalprice >= 1 GROUP BY ALL), t AS (SELECT o_orderstatus, sum(k) AS n FROM c GROUP BY 1)
SELECT o_orderstatus, n::BIGINT AS n, round(sum(power(coalesce(k, 0) - e * n, 2) / (e * n)) / n, 8) AS deviation FROM t CROSS JOIN (VALUES {BENFORD}) AS b(d, e) LEFT JOIN c USING (o_orderstatus, d) GROUP BY o_orderstatus, n
""")
def st_benford_dev(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-squared of first digits over the number of amounts."""
    got = stats.benford(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])
    return got.groupBy("o_orderstatus").agg(F.max("total").alias("n"), F.round(F.sum("chi2") / F.max("total"), 8).alias("deviation"))


@query("""
WITH d AS (SELECT l_returnflag, regexp_extract(l_extendedprice::VARCHAR, '[1-9]') AS d FROM lineitem), c AS (SELECT l_returnflag, d::INT AS d, count(*) AS k FROM d WHERE d <> '' GROUP BY ALL), t AS (SELECT l_returnflag, sum(k) AS n FROM c GROUP BY 1)
SELECT l_returnflag, round(max(abs(coalesce(k, 0) / n - e)), 8) AS max_dev FROM t CROSS JOIN (VALUES (1, 0.301), (2, 0.176), (3, 0.125), (4, 0.097), (5, 0.079), (6, 0.067), (7, 0.058), (8, 0.051), (9, 0.046)) AS b(d, e) LEFT JOIN c USING (l_returnflag, d) GROUP BY l_returnflag
""")
def st_benford_maxdev(spark: SparkSession, sf: str) -> DataFrame:
    """The largest deviation of a first digit's share from the rounded table."""
    return stats.benford_rounded(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("max_dev", 8).alias("max_dev"))


GROUP_Z = """
g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd, list_sort(list(p_retailprice)) AS s FROM part GROUP BY 1), q AS (SELECT p_brand, n, m, sd, s[n // 4 + 1] AS q1, s[3 * n // 4 + 1] AS q3 FROM g), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q),
z AS (SELECT p_partkey, p_brand, CASE WHEN n < 3 THEN 0.5 ELSE least(0.5, CASE WHEN sd > 0 THEN abs((p_retailprice - m) / sd) ELSE 0 END / 6) + CASE WHEN p_retailprice < low THEN least(0.5, (low - p_retailprice) / greatest(abs(low), 1) * 2 + 0.3) WHEN p_retailprice > high THEN least(0.5, (p_retailprice - high) / greatest(abs(high), 1) * 2 + 0.3) ELSE 0 END END AS score FROM part JOIN f USING (p_brand))
"""


@query(f"WITH {GROUP_Z} SELECT p_partkey, round(score::DOUBLE, 8) AS score FROM z")
def st_group_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """A price against its group: z over six, and how far it lies beyond the fences, each .5 at most."""
    got = stats.group_scores(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_partkey")
    return got.select("p_partkey", F.round("group_score", 8).alias("score"))


@query(f"""
WITH {GROUP_Z}, c AS (SELECT substr(floor(p_retailprice)::BIGINT::VARCHAR, 1, 1)::INT AS d, count(*) AS k FROM part WHERE p_retailprice >= 1 GROUP BY 1), t AS (SELECT sum(k) AS n FROM c), b AS (SELECT least(1, sum(power(coalesce(k, 0) - e * n, 2) / (e * n)) / 15.507) AS benford FROM t CROSS JOIN (VALUES {BENFORD}) AS b(d, e) LEFT JOIN c USING (d)),
r AS (SELECT p_partkey, 0.15 * benford + 0.30 * score + 0.35 * (p_partkey % 100) / 100.0 AS combined FROM z, b)
SELECT p_partkey, round(combined::DOUBLE, 6) AS combined, CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM r
""")
def st_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """First digits (.15), group statistics (.30) and an isolation score (.35, here derived from the key) in one; .20 stays unused."""
    p = table(spark, sf, "part")
    own = stats.group_scores(p, ["p_brand"], "p_retailprice", "p_partkey").select("p_partkey", "group_score")
    digits = stats.benford(p, "p_retailprice").agg(F.least(F.sum("chi2") / stats.CHI2, F.lit(1.0)).alias("benford"))  # one row
    iso = (F.col("p_partkey") % 100) / 100.0
    got = own.crossJoin(F.broadcast(digits)).select("p_partkey", stats.fused([(0.15, F.col("benford")), (0.30, F.col("group_score")), (0.35, iso)]).alias("combined"))
    return got.select("p_partkey", F.round("combined", 6).alias("combined"), rules.bands(F.col("combined"), [(0.7, "high"), (0.4, "medium")], "low").alias("level"))


@query("""
WITH e AS (SELECT o_orderkey, o_custkey AS src, o_orderkey % 500 AS dst, o_totalprice AS a FROM orders), s AS (SELECT avg(a) AS m, stddev_pop(a) AS sd FROM e WHERE a > 0),
z AS (SELECT e.*, (a - m) / greatest(sd, 0.01) AS z FROM e, s), b AS (SELECT src AS id, abs(z) > 1.5 AS odd, 0.0 AS i, a AS o FROM z UNION ALL SELECT dst, abs(z) > 1.5, a, 0 FROM z), n AS (SELECT count(DISTINCT id) AS n FROM b),
r AS (SELECT id, count(*) AS deg, sum(odd::INT) AS odd, sum(i) AS i, sum(o) AS o FROM b GROUP BY 1)
SELECT id, odd::BIGINT AS anomalies, round((0.25 * least(1, deg / greatest(n - 1, 1)) + 0.35 * least(1, odd / 5.0) + 0.15 * coalesce(abs(i - o) / nullif(i + o, 0), 0))::DOUBLE, 6) AS risk FROM r, n
""")
def st_edge_z(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers whose amount is unusual, and what they make of their parties: degree, anomalies and one-sidedness, weighted."""
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst"), F.col("o_totalprice").alias("a"))
    got = stats.edge_risk(e, "src", "dst", "a", 1.5, (0.25, 0.35, 0.15))
    return got.select("id", "anomalies", F.round("risk", 6).alias("risk"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS unit, (l_suppkey % 11) / 10.0 AS own, (l_orderkey % 7) / 6.0 AS dep, CASE WHEN l_linenumber % 2 = 0 THEN 0.1 ELSE 0 END AS margin FROM lineitem),
p AS (SELECT l_partkey, count(*) AS n, avg(unit) AS m, coalesce(stddev_samp(unit), 0) AS s FROM x WHERE unit > 0 GROUP BY 1), h AS (SELECT l_suppkey, count(*) AS n, avg(unit) AS m, coalesce(stddev_samp(unit), 0) AS s FROM x WHERE unit > 0 GROUP BY 1),
q AS (SELECT l_orderkey, l_linenumber, own, dep, CASE WHEN p.n >= 3 THEN greatest(0, 1 - abs((unit - p.m) / CASE WHEN p.s = 0 THEN 0.001 ELSE p.s END) / 3) * 0.45 END AS a, CASE WHEN h.n >= 2 THEN greatest(0, 1 - abs((unit - h.m) / CASE WHEN h.s = 0 THEN 0.001 ELSE h.s END) / 3) * 0.35 END AS b, CASE WHEN margin <> 0 THEN 0.2 END AS c FROM x LEFT JOIN p USING (l_partkey) LEFT JOIN h USING (l_suppkey)),
r AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS k FROM q), f AS (SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN 0.5 ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / CASE k WHEN 1 THEN 0.45 WHEN 2 THEN 0.8 ELSE 1.0 END * (1 - 0.3 * least(1, own) - 0.15 * least(1, dep)) END AS score FROM r)
SELECT l_orderkey, l_linenumber, round(score::DOUBLE, 6) AS score, CASE WHEN round(score::DOUBLE, 9) >= 0.8 THEN 'fair' WHEN round(score::DOUBLE, 9) >= 0.55 THEN 'slightly_biased' ELSE 'significantly_biased' END AS level FROM f
""")
def st_pricing(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a related party's price is fair: comparable prices .45, history .35, margin .2 over the first weights by the number of
    methods at hand, less for ownership and dependence."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), ((F.col("l_suppkey") % 11) / 10.0).alias("own"), ((F.col("l_orderkey") % 7) / 6.0).alias("dep"), F.when(F.col("l_linenumber") % 2 == 0, 0.1).otherwise(0.0).alias("margin"))
    got = stats.fair_prices(x, "unit", "l_partkey", "l_suppkey", "margin", "own", "dep").withColumn("s", F.round("score", 9))
    return got.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), rules.bands(F.col("s"), [(0.8, "fair"), (0.55, "slightly_biased")], "significantly_biased").alias("level"))


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(p_retailprice) ELSE 0 END, 6) AS std FROM part WHERE p_retailprice > 0 GROUP BY 1")
def agg_peer(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and sample deviation of the positive prices of a group."""
    got = stats.peers(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return got.select("p_brand", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


FEATURES = {"log_amount": "ln(1 + o_totalprice)", "hour_": "CASE WHEN o_orderkey % 24 = 0 THEN 12 ELSE o_orderkey % 24 END", "day_": "day(o_orderdate)", "month_": "month(o_orderdate)", "whole": "CASE WHEN o_totalprice = floor(o_totalprice) THEN 1 ELSE 0 END", "thousands": "CASE WHEN floor(o_totalprice) % 1000 < 10 THEN 1 ELSE 0 END", "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"}
FEATURE_SQL = "f AS (SELECT o_orderkey, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in FEATURES.items()) + " FROM orders)"


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Seven features of a transaction; hour 0 counts as 12, as a missing hour does."""
    return table(spark, sf, "orders").select("o_orderkey", *[F.expr(f"cast({doubles(e)} as double)").alias(n) for n, e in FEATURES.items()])


@query(f"WITH {FEATURE_SQL} SELECT o_orderkey, " + ", ".join(f"round({n}, 8) AS {n}" for n in FEATURES) + " FROM f")
def ml_features(spark: SparkSession, sf: str) -> DataFrame:
    """Amount, time and shape of each transaction as numbers."""
    return features(spark, sf).select("o_orderkey", *[F.round(n, 8).alias(n) for n in FEATURES])


@query(f"WITH {FEATURE_SQL}, s AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS s_{n}" for n in FEATURES) + " FROM f) SELECT o_orderkey, " + ", ".join(f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in FEATURES) + " FROM f, s")
def ml_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Features by their mean and population deviation; what does not vary is divided by 1."""
    got = stats.standardised(features(spark, sf), list(FEATURES))
    return got.select("o_orderkey", *[F.round(n, 6).alias(n) for n in FEATURES])


@query()
def ml_iforest_path(spark: SparkSession, sf: str) -> DataFrame:
    """Mean depth at which random cuts part a price, its size and its brand's number from the rest; tests hold its order against
    planted outliers."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return stats.isolation(p, "p_partkey", ["p_retailprice", "p_size"], depths=True).select("p_partkey", F.round("iso", 6).alias("depth"))


@query()
def ml_iforest_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation scores of one metric, and those above their 95th percentile; tests hold them against planted outliers."""
    e = table(spark, sf, "events").where("value is not null")
    scored = stats.isolation(e, "event_id", ["value"])
    return stats.top_share(scored, "iso", 0.05, "odd").select("event_id", F.round("iso", 6).alias("iso"), "odd")


APPLICANT = {"credit_score": "550 + c_custkey * 7 % 300", "dti_ratio": "(c_custkey * 13 % 80) / 100.0", "ltv_ratio": "(c_custkey * 17 % 100) / 100.0", "employment_years": "c_custkey % 25", "default_history": "c_custkey % 4", "loan_amount": "abs(c_acctbal) * 60"}


@query("""
WITH a AS (SELECT c_custkey, """ + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in APPLICANT.items()) + """ FROM customer),
z AS (SELECT c_custkey, -1.2 + -0.035 * (credit_score - 680) / 80 + 2.8 * (dti_ratio - 0.35) / 0.15 + 1.9 * (ltv_ratio - 0.75) / 0.2 + -0.15 * (employment_years - 8) / 5 + 1.6 * (default_history - 0.3) / 0.8 + 0.00002 * (loan_amount - 300000) / 200000 AS z FROM a), p AS (SELECT c_custkey, z, 1 / (1 + exp(-z)) AS p FROM z)
SELECT c_custkey, round(z, 6) AS logit, round(p, 6) AS p, CASE WHEN p <= 0.05 THEN 'A' WHEN p <= 0.15 THEN 'B' WHEN p <= 0.3 THEN 'C' WHEN p <= 0.5 THEN 'D' ELSE 'E' END AS rating, CASE WHEN p <= 0.15 THEN 'approve' WHEN p <= 0.3 THEN 'review' ELSE 'refuse' END AS decision FROM p
""")
def ml_logit(spark: SparkSession, sf: str) -> DataFrame:
    """Default probability by fixed weights over scaled figures, with rating and decision."""
    a = table(spark, sf, "customer").select("c_custkey", *[F.expr(f"cast({doubles(e)} as double)").alias(n) for n, e in APPLICANT.items()])
    got = stats.credit_logit(a)
    p = F.col("p")
    rating = F.when(p <= 0.05, "A").when(p <= 0.15, "B").when(p <= 0.3, "C").when(p <= 0.5, "D").otherwise("E")
    decision = F.when(p <= 0.15, "approve").when(p <= 0.3, "review").otherwise("refuse")
    return got.select("c_custkey", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"), rating.alias("rating"), decision.alias("decision"))


FIRM = "SELECT s_suppkey AS id, s_nationkey AS country, s_nationkey % 5 AS region, s_suppkey % 6 AS industry, s_suppkey % 12 AS sub, s_acctbal + 1000 AS revenue, (s_suppkey * 3 % 40) / 100.0 AS margin, (s_suppkey * 7 % 30) / 100.0 AS roa, list_distinct([s_suppkey % 3, s_suppkey % 4 + 3, s_suppkey % 5 + 7]) AS functions FROM supplier"


@query(f"""
WITH c AS ({FIRM}), t AS (SELECT * FROM c WHERE id % 20 = 0),
s AS (SELECT t.id AS target, c.id AS candidate, 0.30 * CASE WHEN c.sub = t.sub AND c.industry = t.industry THEN 1.0 WHEN c.industry = t.industry THEN 0.8 ELSE 0.1 END + 0.20 * CASE WHEN c.country = t.country THEN 1.0 WHEN c.region = t.region THEN 0.7 ELSE 0 END + 0.20 * CASE WHEN t.revenue > 0 AND c.revenue > 0 THEN least(t.revenue, c.revenue) / greatest(t.revenue, c.revenue) ELSE 0.5 END
 + 0.15 * len(list_intersect(t.functions, c.functions)) / len(list_distinct(list_concat(t.functions, c.functions))) + 0.15 * CASE WHEN t.margin <> 0 OR t.roa <> 0 THEN greatest(0, 1 - abs(t.margin - c.margin) - abs(t.roa - c.roa)) ELSE 0.5 END AS score FROM t JOIN c ON c.id <> t.id)
SELECT target, candidate, rank::INT AS rank, round(score::DOUBLE, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score::DOUBLE, 9) DESC, candidate) AS rank FROM s) WHERE rank <= 5
""")
def ml_comparable(spark: SparkSession, sf: str) -> DataFrame:
    """The five companies most comparable to each of a stated set of targets, one in twenty, by industry, region, size, functions and
    returns. Companies alike in all but size are of one kind; a target meets the kinds that can hold one of its five."""
    k = F.col("s_suppkey")
    functions = F.array_distinct(F.array(k % 3, k % 4 + 3, k % 5 + 7))
    c = table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("country"), (F.col("s_nationkey") % 5).alias("region"), (k % 6).alias("industry"), (k % 12).alias("sub"), (F.col("s_acctbal") + 1000).alias("revenue"), ((k * 3 % 40) / 100.0).alias("margin"), ((k * 7 % 30) / 100.0).alias("roa"), functions.alias("functions"))
    got = stats.comparable(c.where("id % 20 = 0"), c, 5)
    return got.select("target", "candidate", "rank", F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, c.vec_id AS found, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query, found, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS rank FROM s) WHERE rank <= 10
""")
def ml_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all vectors by cosine to every vector whose id is divisible by 20, exact, from a stored index."""
    e, path = table(spark, sf, "embeddings"), fresh(spark)
    vectors.build(e, "vec_id", "embedding", path)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found, _ = vectors.best(spark, path, asked, 10, others=True)
    return found.select("query", F.col("id").alias("found"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT vec_id, d::INT AS d, (vec_id * 31 + d * 17) % 1000 AS u FROM embeddings, (SELECT unnest(range(0, 4)) AS d)), v AS (SELECT vec_id, d, (u + 0.5) / 1000.0 - 0.5 AS c FROM n)
SELECT vec_id, d, round((-0.1 * sign(c) * ln(1 - 2 * abs(c)))::DOUBLE, 8) AS noise FROM v
""")
def ml_dp_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Laplace noise by the inverse of its distribution, here of uniform numbers derived from the key, so that it can be checked."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"))
    u = ((F.col("vec_id") * 31 + F.col("d") * 17) % 1000 + 0.5) / 1000.0
    return rows.select("vec_id", "d", F.round(numbers.laplace(u, 0.1), 8).alias("noise"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z, least(60 + floor(5 * abs(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END)), 100)::BIGINT AS score FROM e WHERE back <= 5
""")
def win_last5_z(spark: SparkSession, sf: str) -> DataFrame:
    """The last five values of each series against its mean and deviation. The moments are an aggregate joined to the five rows."""
    e = table(spark, sf, "events")
    moments = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    last = series.last_rows(e.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], 5)
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0)
    got = last.join(moments, "user_id").withColumn("z", z)
    return got.select("event_id", F.round("z", 6).alias("z"), F.least(F.lit(60) + F.floor(5 * F.abs("z")), F.lit(100)).cast("long").alias("score"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id)), s AS (SELECT * FROM e WHERE n >= 4 AND sd > 0 AND abs(value - m) > 2 * sd)
SELECT user_id, event_id, (i - 1)::INT AS at, round((value - m) / sd, 6) AS deviations, CASE WHEN value > m THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM s) WHERE k <= 5
""")
def win_spike(spark: SparkSession, sf: str) -> DataFrame:
    """The first five values of each series beyond two population deviations."""
    e = table(spark, sf, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    moments = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("n >= 4 and sd > 0")
    odd = e.join(moments, "user_id").where(F.abs(F.col("value") - F.col("m")) > 2 * F.col("sd"))
    first = odd.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).where("k <= 5")
    return first.select("user_id", "event_id", F.col("at").cast("int").alias("at"), F.round((F.col("value") - F.col("m")) / F.col("sd"), 6).alias("deviations"), F.when(F.col("value") > F.col("m"), "up").otherwise("down").alias("direction"))


@query("SELECT user_id, event_id, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 3")
def win_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    """The last three values of each series, the newest first."""
    return series.last_rows(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", F.col("back").cast("int").alias("back"))


@query("""
WITH h AS (SELECT user_id, event_id, value, lead(value, 1) OVER w AS a, lead(value, 4) OVER w AS e4, lead(value, 3) OVER w AS e3, lead(value, 2) OVER w AS e2, row_number() OVER w AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
d AS (SELECT user_id, n, (coalesce(e4, e3, e2, a) - value) / greatest(0.001, coalesce(e4, e3, e2, a)) AS drop_ FROM h WHERE back = 1 AND n >= 3)
SELECT user_id, round(100 * drop_, 4) AS drop_pct, CASE WHEN drop_ > 0.2 THEN 'red' WHEN drop_ > 0.1 THEN 'orange' WHEN drop_ > 0.05 THEN 'yellow' ELSE 'none' END AS level, CASE WHEN drop_ < -0.05 THEN 'up' WHEN drop_ > 0.05 THEN 'down' ELSE 'stable' END AS trend FROM d
""")
def win_degradation(spark: SparkSession, sf: str) -> DataFrame:
    """How far the last of five scores fell below the first, by level; series with two scores before it at least."""
    e = table(spark, sf, "events")
    last = series.last_rows(e.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], 5)
    ends = last.groupBy("user_id").agg(F.max_by("value", "back").alias("first"), F.min_by("value", "back").alias("now"), F.count("*").alias("n")).where("n >= 3")
    drop = (F.col("first") - F.col("now")) / F.greatest(F.lit(0.001), F.col("first"))
    got = ends.withColumn("d", drop)
    level = F.when(F.col("d") > 0.2, "red").when(F.col("d") > 0.1, "orange").when(F.col("d") > 0.05, "yellow").otherwise("none")
    return got.select("user_id", F.round(100 * F.col("d"), 4).alias("drop_pct"), level.alias("level"), F.when(F.col("d") < -0.05, "up").when(F.col("d") > 0.05, "down").otherwise("stable").alias("trend"))


SOLVED = "SELECT c_custkey, c_nationkey, round(((c_custkey * 7 % 100) * 0.6 + CASE c_custkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 10 END * 0.4)::DOUBLE, 9) AS priority, c_custkey * 11 % 60 + 1 AS days FROM customer"


@query(f"WITH s AS ({SOLVED}) SELECT c_nationkey, c_custkey, round(priority::DOUBLE, 6) AS priority, row_number() OVER (PARTITION BY c_nationkey ORDER BY priority DESC, c_custkey) AS position FROM s")
def win_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Solutions of each project in order of their priority."""
    return _solved(spark, sf).select("c_nationkey", "c_custkey", F.round("priority", 6).alias("priority"), "position")


@query(f"WITH s AS ({SOLVED}), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY priority DESC, c_custkey) AS position, ceil(days / 7.0)::BIGINT AS weeks FROM s) SELECT c_nationkey, c_custkey, (sum(weeks) OVER w - weeks)::BIGINT AS from_week, sum(weeks) OVER w::BIGINT AS to_week FROM r WINDOW w AS (PARTITION BY c_nationkey ORDER BY position)")
def win_roadmap(spark: SparkSession, sf: str) -> DataFrame:
    """When each solution of a project begins and ends if they follow each other, in whole weeks."""
    r = _solved(spark, sf).withColumn("weeks", F.ceil(F.col("days") / 7.0))
    end = F.sum("weeks").over(Window.partitionBy("c_nationkey").orderBy("position"))
    return r.withColumn("to_week", end).select("c_nationkey", "c_custkey", (F.col("to_week") - F.col("weeks")).alias("from_week"), "to_week")


def _solved(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    urgency = F.when(k % 3 == 0, 40).when(k % 3 == 1, 25).otherwise(10)
    s = table(spark, sf, "customer").select(k, "c_nationkey", F.round((k * 7 % 100) * 0.6 + urgency * 0.4, 9).alias("priority"), (k * 11 % 60 + 1).alias("days"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("priority"), "c_custkey")))


@query("""
WITH f AS (SELECT event_type, (['Scope 1', 'Scope 2', 'Scope 3'])[user_id % 3 + 1] AS scope, value FROM events WHERE user_id % 3 <> 1)
SELECT s AS scope, round(coalesce(sum(value), 0) / 1000, 6) AS tons, count(value) AS n FROM (SELECT unnest(['Scope 1', 'Scope 2', 'Scope 3', 'Unknown']) AS s) LEFT JOIN f ON scope = s GROUP BY 1
""")
def agg_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Emissions by scope in tons, scopes without any included."""
    scope = F.element_at(F.array(*map(F.lit, ["Scope 1", "Scope 2", "Scope 3"])), (F.col("user_id") % 3 + 1).cast("int"))
    sums = table(spark, sf, "events").where("user_id % 3 <> 1").groupBy(scope.alias("scope")).agg(F.sum("value").alias("kg"), F.count("value").alias("k"))
    every = spark.createDataFrame([("Scope 1",), ("Scope 2",), ("Scope 3",), ("Unknown",)], "scope string")
    return every.join(sums, "scope", "left").select("scope", F.round(F.coalesce("kg", F.lit(0.0)) / 1000, 6).alias("tons"), F.coalesce("k", F.lit(0).cast("long")).alias("n"))


@query("SELECT user_id AS host, event_type AS platform, count(*) AS rules, sum((value < 70)::INT)::BIGINT AS passed, sum((value >= 90)::INT)::BIGINT AS severe, round(100.0 * sum((value < 70)::INT) / count(*), 4) AS compliance FROM events GROUP BY ALL")
def agg_host(spark: SparkSession, sf: str) -> DataFrame:
    """Rules passed and severe failures by host and platform."""
    ok = F.sum((F.col("value") < 70).cast("int"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("host"), F.col("event_type").alias("platform")).agg(F.count("*").alias("rules"), ok.alias("passed"), F.sum((F.col("value") >= 90).cast("int")).alias("severe"), F.round(100.0 * ok / F.count("*"), 4).alias("compliance"))


@query("SELECT user_id % 7 AS domain, count(*) AS executions, count(*) FILTER (value < 70) AS passed, count(*) FILTER (value >= 70) AS failed FROM events GROUP BY 1")
def agg_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Checks that passed and failed by domain."""
    return table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("domain")).agg(F.count("*").alias("executions"), F.count_if(F.col("value") < 70).alias("passed"), F.count_if(F.col("value") >= 70).alias("failed"))


FINDING = {"impact": "o_totalprice", "coef": "(o_orderkey % 11) / 10.0", "pre": "(o_orderkey * 7 % 10) / 10.0", "post": "(o_orderkey * 3 % 10) / 20.0", "category": "o_orderkey % 4", "regulations": "o_orderkey % 3", "adopted": "CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 0 END", "strategic": "o_orderkey * 13 % 100", "bu": "o_custkey % 9", "severe": "CASE WHEN o_orderkey % 6 < 2 THEN 1 ELSE 0 END", "remedied": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"}
VALUE_SQL = "f AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in FINDING.items()) + " FROM orders), v AS (SELECT *, impact * coef AS financial, greatest(pre - post, 0) * impact * 10 AS risk, CASE WHEN category = 0 OR regulations > 0 THEN (CASE regulations WHEN 2 THEN 650000 ELSE 500000 END) * coef * 0.7 ELSE 0 END AS compliance, CASE WHEN category = 1 OR adopted = 1 THEN 1000000 * strategic / 100.0 * CASE WHEN adopted = 1 THEN 1.5 ELSE 0.6 END ELSE 0 END AS strategy FROM f), t AS (SELECT *, 0.4 * financial + 0.3 * risk + 0.2 * compliance + 0.1 * strategy AS total FROM v)"


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings derived from orders, with the four parts of their value and the weighted whole."""
    f = table(spark, sf, "orders").select("o_orderkey", *[F.expr(doubles(e)).alias(n) for n, e in FINDING.items()])
    penalty = F.when(F.col("regulations") == 2, 650_000.0).otherwise(500_000.0)
    parts = {
        "financial": F.col("impact") * F.col("coef"), "risk": F.greatest(F.col("pre") - F.col("post"), F.lit(0)) * F.col("impact") * 10,
        "compliance": F.when((F.col("category") == 0) | (F.col("regulations") > 0), penalty * F.col("coef") * 0.7).otherwise(0.0),
        "strategy": F.when((F.col("category") == 1) | (F.col("adopted") == 1), F.lit(1_000_000.0) * F.col("strategic") / 100.0 * F.when(F.col("adopted") == 1, 1.5).otherwise(0.6)).otherwise(0.0),
    }
    return f.withColumns(parts).withColumn("total", stats.fused([(0.4, F.col("financial")), (0.3, F.col("risk")), (0.2, F.col("compliance")), (0.1, F.col("strategy"))]))


@query(f"WITH {VALUE_SQL} SELECT o_orderkey, round(financial::DOUBLE, 6) AS financial, round(risk::DOUBLE, 6) AS risk, round(compliance::DOUBLE, 6) AS compliance, round(strategy::DOUBLE, 6) AS strategy, round(total::DOUBLE, 6) AS total FROM t")
def agg_value(spark: SparkSession, sf: str) -> DataFrame:
    """The value of a finding: money, risk taken away, penalties avoided, strategy, and the whole."""
    return findings(spark, sf).select("o_orderkey", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("financial", "risk", "compliance", "strategy", "total")])


@query(f"""
WITH {VALUE_SQL}, b AS (SELECT bu, count(*) AS n FROM t GROUP BY 1) SELECT round(sum(total)::DOUBLE, 2) AS value, round((sum(total) / 5e9 * 100)::DOUBLE, 6) AS roi, sum(severe)::BIGINT AS high_risk, round(100.0 * sum(remedied) / greatest(count(*), 1), 6) AS remediation_rate, round(least(100, 60 + 30.0 * sum(remedied) / greatest(count(*), 1) + sum(total) / 5e9 * 10)::DOUBLE, 6) AS satisfaction, round(100.0 * sum(adopted) / greatest(count(*), 1), 6) AS adoption_rate, (SELECT round(avg(n), 6) FROM b) AS findings_per_bu, (SELECT round(stddev_pop(n), 6) FROM b) AS load_std FROM t
""")
def agg_kpi_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Strategic, operational and executive figures of all findings, one row. Units are counted first; their spread is over units."""
    t = findings(spark, sf)
    n, rate = F.greatest(F.count("*"), F.lit(1)), F.lit(100.0) * F.sum("remedied") / F.greatest(F.count("*"), F.lit(1))
    ratio = F.sum(F.col("total").cast("double")) / 5e9
    one = t.agg(F.round(F.sum(F.col("total").cast("double")), 2).alias("value"), F.round(ratio * 100, 6).alias("roi"), F.sum("severe").cast("long").alias("high_risk"), F.round(rate, 6).alias("remediation_rate"), F.round(F.least(F.lit(100.0), 60 + rate * 0.3 + ratio * 10), 6).alias("satisfaction"), F.round(F.lit(100.0) * F.sum("adopted") / n, 6).alias("adoption_rate"))
    units = t.groupBy("bu").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("findings_per_bu"), F.round(F.stddev_pop("n"), 6).alias("load_std"))
    return one.crossJoin(F.broadcast(units))


@query("""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(' ' || lower(translate(text, chr(10) || '.,;:!?', '       ')) || ' ', ' (?:the|of) ')) AS a, len(regexp_extract_all(lower(text), 'license')) AS b, len(regexp_extract_all(text, '[0-9]+')) AS c FROM documents)
SELECT doc_id, a::INT AS common, b::INT AS licence, c::INT AS amounts, round((0.2 * least(a, 10) + 0.5 * least(b, 4) + 0.05 * least(c, 20))::DOUBLE, 6) AS signal FROM s
""")
def agg_doc_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of words by category in each document, and the weighted signal they add up to."""
    text = F.concat(F.lit(" "), F.lower(F.translate("text", "\n.,;:!?", "       ")), F.lit(" "))
    s = table(spark, sf, "documents").select("doc_id", F.regexp_count(text, F.lit(" (?:the|of) ")).alias("common"), F.regexp_count(F.lower("text"), F.lit("license")).alias("licence"), F.regexp_count("text", F.lit("[0-9]+")).alias("amounts"))
    return s.withColumn("signal", F.round(0.2 * F.least("common", F.lit(10)) + 0.5 * F.least("licence", F.lit(4)) + 0.05 * F.least("amounts", F.lit(20)), 6))


@query("""
SELECT c_nationkey AS group_, count(*) AS entities, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, count(*) FILTER (c_custkey % 10 < 7) AS unqualified, count(*) FILTER (c_custkey % 10 BETWEEN 7 AND 8) AS qualified, count(*) FILTER (c_custkey % 10 = 9) AS adverse FROM customer GROUP BY 1
""")
def agg_group_submission(spark: SparkSession, sf: str) -> DataFrame:
    """A group's submissions consolidated: sums, means and the opinions given."""
    o = F.col("c_custkey") % 10
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("group_")).agg(F.count("*").alias("entities"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count_if(o < 7).alias("unqualified"), F.count_if(o.between(7, 8)).alias("qualified"), F.count_if(o == 9).alias("adverse"))


@query("""
WITH f AS (SELECT 'orders' AS step, o_orderkey AS ref, CASE WHEN o_totalprice > 450000 THEN 'high' ELSE 'medium' END AS severity FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'events', event_id, 'low' FROM events WHERE event_type = 'error' AND value > 50 UNION ALL SELECT 'customers', c_custkey, 'high' FROM customer WHERE c_acctbal < -500)
SELECT step, severity, count(*) AS n, min(ref) AS first FROM f GROUP BY ALL
""")
def agg_findings_report(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of several analytics brought to one form and counted by analytic and severity."""
    from quillon.plans.steps import findings as together

    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_totalprice") > 450_000, "high").otherwise("medium").alias("severity"))
    e = table(spark, sf, "events").where("event_type = 'error' and value > 50").select(F.col("event_id").alias("ref"), F.lit("low").alias("severity"), "ts")
    c = table(spark, sf, "customer").where("c_acctbal < -500").select(F.col("c_custkey").alias("ref"), F.lit("high").alias("severity"))
    return together({"orders": o, "events": e, "customers": c}).groupBy("step", "severity").agg(F.count("*").alias("n"), F.min("ref").alias("first"))


@query("""
WITH p AS (SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 = 0 THEN 'U' || (c_custkey % 200)::VARCHAR ELSE '' END, '') AS code, 'name' || (c_custkey % 300)::VARCHAR AS name, c_acctbal FROM customer), k AS (SELECT *, coalesce(code, name) AS k FROM p)
SELECT k, min(c_custkey) AS kept, count(*) AS n FROM k GROUP BY 1
""")
def dedup_fallback_key(spark: SparkSession, sf: str) -> DataFrame:
    """One row a party, by its credit code, or by its name where it has none."""
    k = F.col("c_custkey")
    code = F.nullif(F.when(k % 3 == 0, F.concat(F.lit("U"), (k % 200).cast("string"))).otherwise(""), F.lit(""))
    return table(spark, sf, "customer").groupBy(F.coalesce(code, F.concat(F.lit("name"), (k % 300).cast("string"))).alias("k")).agg(F.min("c_custkey").alias("kept"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def dedup_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between customers and suppliers, each once by both ends and kind."""
    met = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")).dropDuplicates()


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(list_intersect(a, b))::INT AS common, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS only_b, coalesce(array_to_string(list_sort(list_intersect(a, b)), ','), '') AS shared FROM p
""")
def set_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The words two neighbouring turns share, and those that only one has."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("a"))
    met = w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    both = F.array_intersect("a", "b")
    return met.select("conv_id", "turn", F.size(both).alias("common"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"), F.concat_ws(",", F.array_sort(both)).alias("shared"))


@query()
def text_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn of a conversation changes of the turn before, line by line; tests hold the hunks against a longest common
    subsequence."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("b"))
    met = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("a")), ["conv_id", "turn"])
    return diffs.line_diff(met, ["conv_id", "turn"], "a", "b")


@query()
def doc_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that begin with the same line, each against the smallest of them: a line a hunk."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("head"))
    first = d.groupBy("head").agg(F.min("doc_id").alias("base"), F.count("*").alias("n")).where("n > 1")
    met = d.join(first, "head").where("doc_id <> base").select("doc_id", "base", F.col("text").alias("b"))
    both = met.join(d.select(F.col("doc_id").alias("base"), F.col("text").alias("a")), "base")
    return diffs.line_diff(both, ["base", "doc_id"], "a", "b")


@query("""
WITH s AS (SELECT event_id, user_id, (event_id * 37 % 400)::INT AS b, (event_id * 37 % 400 + 5 + event_id % 30)::INT AS e, (event_id % 4 + 1)::INT AS level FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b, level DESC, event_id) AS i FROM s)
SELECT user_id, event_id, b, e, level FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.user_id = r.user_id AND q.i <> r.i AND q.b < r.e AND r.b < q.e AND (q.level > r.level OR (q.level = r.level AND q.i < r.i)))
""")
def dedup_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of sensitive data that overlap: one stays if no span it touches has a higher level, or the same and begins earlier."""
    k = F.col("event_id")
    s = table(spark, sf, "events").select("event_id", "user_id", (k * 37 % 400).cast("int").alias("b"), (k * 37 % 400 + 5 + k % 30).cast("int").alias("e"), (k % 4 + 1).cast("int").alias("level"))
    return series.strongest_spans(s, ["user_id"], "b", "e", "level", "event_id").select("user_id", "event_id", "b", "e", "level")


@query("""
WITH b AS (SELECT *, (event_id // 1000) AS batch FROM events), m AS (SELECT batch, event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM b GROUP BY ALL), l AS (SELECT * FROM m WHERE n >= 2)
SELECT batch::BIGINT AS batch, event_type, round(mean, 6) AS mean, round(greatest(sd, 0.001), 6) AS std, n FROM l
""")
def ss_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline that each batch of events leaves behind: mean and sample deviation of each metric with two values or more."""
    b = table(spark, sf, "events").groupBy(F.expr("event_id div 1000").alias("batch"), "event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).where("n >= 2")
    return b.select("batch", "event_type", F.round("mean", 6).alias("mean"), F.round(F.greatest("sd", F.lit(0.001)), 6).alias("std"), "n")


@query("""
WITH b AS (SELECT *, (event_id // 1000) AS batch FROM events), m AS (SELECT batch, event_type, avg(value) AS mean, greatest(stddev_samp(value), 0.001) AS sd FROM b GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT event_type, batch, mean, sd, coalesce(lead(batch) OVER (PARTITION BY event_type ORDER BY batch), 9000000000) AS until FROM m)
SELECT event_id, round((value - mean) / sd, 6) AS z, coalesce(abs((value - mean) / sd) > 1.6, false) AS odd, value > 90 AS ruled FROM b LEFT JOIN p ON p.event_type = b.event_type AND p.batch < b.batch AND b.batch <= p.until
""")
def ss_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Every event against the rules and against the baseline that the batches before it left, which it does not yet count for."""
    b = table(spark, sf, "events").withColumn("batch", F.expr("event_id div 1000"))
    m = b.groupBy("event_type", "batch").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).where("n >= 2")
    # batches of a metric are few rows; each batch takes the one before
    batches = b.select("event_type", "batch").distinct()
    by = Window.partitionBy("event_type").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    known = batches.join(m, ["event_type", "batch"], "left")
    left = known.select("event_type", "batch", F.last(F.when(F.col("mean").isNotNull(), F.struct("mean", F.greatest("sd", F.lit(0.001)).alias("sd"))), True).over(by).alias("x"))
    got = b.join(left, ["event_type", "batch"]).withColumn("z", (F.col("value") - F.col("x.mean")) / F.col("x.sd"))
    return got.select("event_id", F.round("z", 6).alias("z"), F.coalesce(F.abs("z") > 1.6, F.lit(False)).alias("odd"), (F.col("value") > 90).alias("ruled"))


CONFIRMED = "c AS (SELECT event_id, (['sent', 'delivered', 'replied', 'closed'])[event_id % 4 + 1] AS status, date_diff('microsecond', ts, TIMESTAMP '2024-01-20') / 3600000000.0 AS hours, ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-20' AS late, value AS audit, CASE WHEN event_id % 3 = 0 THEN value ELSE value + (event_id % 5) / 10.0 END AS bank FROM events)"
STATE = "CASE WHEN status = 'sent' THEN CASE WHEN hours > 48 THEN 'timeout' ELSE 'delivered' END WHEN status = 'delivered' AND late THEN 'timeout' ELSE status END"


def confirmations(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmations derived from the events, with the state they have on a given day."""
    k, now = F.col("event_id"), F.lit("2024-01-20").cast("timestamp")
    status = F.element_at(F.array(*map(F.lit, ["sent", "delivered", "replied", "closed"])), (k % 4 + 1).cast("int"))
    c = table(spark, sf, "events").select("event_id", status.alias("status"), ((F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("hours"), F.col("value").alias("audit"), F.when(k % 3 == 0, F.col("value")).otherwise(F.col("value") + (k % 5) / 10.0).alias("bank"))
    timed = F.when(F.col("status") == "sent", F.when(F.col("hours") > 48, "timeout").otherwise("delivered")).when((F.col("status") == "delivered") & (F.col("hours") > 240), "timeout").otherwise(F.col("status"))
    return c.withColumn("state", timed)


@query(f"WITH {CONFIRMED} SELECT event_id, status AS before, {STATE} AS after FROM c WHERE status <> {STATE}")
def ss_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmations that change their state: sent ones arrive, or time out after 48 hours, delivered ones after their deadline."""
    return confirmations(spark, sf).where("status <> state").select("event_id", F.col("status").alias("before"), F.col("state").alias("after"))


@query(f"""
WITH {CONFIRMED}, s AS (SELECT *, {STATE} AS state FROM c), d AS (SELECT *, CASE WHEN state = 'replied' THEN CASE WHEN abs(audit - bank) > 0.01 THEN 'difference' ELSE 'reconciled' END ELSE state END AS final FROM s)
SELECT event_id, final AS state, CASE WHEN final = 'difference' THEN round(bank - audit, 6) END AS diff, CASE WHEN final IN ('sent', 'delivered', 'timeout') THEN CASE WHEN hours >= 168 THEN 'director' WHEN hours >= 72 THEN 'manager' WHEN hours >= 24 THEN 'reminder' END END AS escalation FROM d
""")
def c_confirm_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The life of a confirmation on one day: its state moves, replies are reconciled, what is open is escalated by age."""
    s = confirmations(spark, sf)
    final = F.when(F.col("state") == "replied", F.when(F.abs(F.col("audit") - F.col("bank")) > 0.01, "difference").otherwise("reconciled")).otherwise(F.col("state"))
    d = s.withColumn("final", final)
    level = rules.bands(F.col("hours"), [(168, "director"), (72, "manager"), (24, "reminder")], None)
    return d.select("event_id", F.col("final").alias("state"), F.when(F.col("final") == "difference", F.round(F.col("bank") - F.col("audit"), 6)).alias("diff"), F.when(F.col("final").isin("sent", "delivered", "timeout"), level).alias("escalation"))


@query("""
WITH t AS (SELECT o_orderkey, (['planned', 'fieldwork', 'review', 'done'])[o_orderkey % 4 + 1] AS status, date_diff('day', o_orderdate::DATE, DATE '1998-06-01') AS age FROM orders)
SELECT o_orderkey, CASE status WHEN 'planned' THEN 10 WHEN 'fieldwork' THEN 50 WHEN 'review' THEN 80 ELSE 100 END AS percent, status <> 'done' AND age > 365 AS overdue, status <> 'done' AND age BETWEEN 335 AND 365 AS warning FROM t
""")
def ss_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress by status, with those overdue and those soon to be."""
    status = F.element_at(F.array(*map(F.lit, ["planned", "fieldwork", "review", "done"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    t = table(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.datediff(F.lit("1998-06-01").cast("date"), "o_orderdate").alias("age"))
    open_ = F.col("status") != "done"
    return t.select("o_orderkey", F.when(F.col("status") == "planned", 10).when(F.col("status") == "fieldwork", 50).when(F.col("status") == "review", 80).otherwise(100).alias("percent"), (open_ & (F.col("age") > 365)).alias("overdue"), (open_ & F.col("age").between(335, 365)).alias("warning"))


@query("""
WITH i AS (SELECT o_orderkey, o_totalprice AS impact, (o_orderkey % 3 + 1) AS methods, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.4 END AS share FROM orders) SELECT o_orderkey, round((impact * share)::DOUBLE, 4) AS attributed, round((impact * (1 - share))::DOUBLE, 4) AS other FROM i
""")
def mc_attrib(spark: SparkSession, sf: str) -> DataFrame:
    """What of an impact is the audit's own, by a contribution of .4 to .9 that the state gives."""
    share = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.4)
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * share, 4).alias("attributed"), F.round(F.col("o_totalprice") * (1 - share), 4).alias("other"))


@query()
def mc_roi(spark: SparkSession, sf: str, draws: int = 5_000, seed: int = 7) -> DataFrame:
    """Present values and returns over seeded draws of cost, saving and risk; tests hold mean and order of the percentiles."""
    from quillon.operators.simulate import returns

    base = table(spark, sf, "part").agg(F.sum("p_retailprice").alias("cost"), F.sum(F.col("p_size") * 60).alias("saving"))
    return returns(spark, base, draws, seed)


@query("""
WITH s AS (SELECT p_brand, sum(p_retailprice) AS revenue, 0.6 * sum(p_retailprice) AS cost, sum(p_size) * 10.0 AS hours FROM part GROUP BY 1), w AS (SELECT * FROM (VALUES ('more_staff', 1.0, 1.1, 1.2), ('less_budget', 0.95, 0.8, 1.0), ('automation', 1.1, 0.9, 0.7)) AS t(scenario, r, c, h))
SELECT p_brand, scenario, round(revenue * r - cost * c, 4) AS margin, round(hours * h, 4) AS hours, round((revenue * r - cost * c) - (revenue - cost), 4) AS change FROM s, w
""")
def what_if(spark: SparkSession, sf: str) -> DataFrame:
    """Margins and hours of each brand if revenue, cost and effort change, against how they are."""
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("revenue"), (F.sum("p_size") * 10.0).alias("hours")).withColumn("cost", 0.6 * F.col("revenue"))
    w = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(h).alias("h")) for n, r, c, h in (("more_staff", 1.0, 1.1, 1.2), ("less_budget", 0.95, 0.8, 1.0), ("automation", 1.1, 0.9, 0.7))]))
    x = s.withColumn("w", w)
    margin = F.col("revenue") * F.col("w.r") - F.col("cost") * F.col("w.c")
    return x.select("p_brand", "w.scenario", F.round(margin, 4).alias("margin"), F.round(F.col("hours") * F.col("w.h"), 4).alias("hours"), F.round(margin - (F.col("revenue") - F.col("cost")), 4).alias("change"))


@query()
def opt_ga(spark: SparkSession, sf: str) -> DataFrame:
    """Auditors to projects, one search a nation, each a small matrix; seeded. Tests hold it against the best assignment there is."""
    from quillon.operators.simulate import assigned

    projects = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("project"), (F.col("c_custkey") % 7).alias("need"))
    auditors = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("auditor"), (F.col("s_suppkey") % 7).alias("skill"))
    return assigned(projects, auditors, greedy=False)


@query()
def opt_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Each project to the auditor whose skill fits best less half the load so far, one after the other within a nation; tests hold
    it against the same rule by hand."""
    from quillon.operators.simulate import assigned

    projects = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("project"), (F.col("c_custkey") % 7).alias("need"))
    auditors = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("auditor"), (F.col("s_suppkey") % 7).alias("skill"))
    return assigned(projects, auditors, greedy=True)
