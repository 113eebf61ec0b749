"""Composites of the primitives: reconciliation, indicators, limits, timelines, evidence, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.registry import query, table
from quillon.analytics.risk import trade
from quillon.operators import graphs, rules


@query("""
WITH x AS (SELECT o_custkey, count(*) FILTER (o_totalprice >= 160000 AND o_totalprice < 200000) AS near, count(*) AS n, avg(CASE WHEN o_totalprice < 200000 THEN 1.0 ELSE 0 END) AS small, sum(o_totalprice) AS total, count(DISTINCT o_orderpriority) AS parties, count(*) FILTER (o_totalprice >= 300000) AS large FROM orders GROUP BY 1)
SELECT o_custkey, near >= 3 AS structuring, n >= 5 AND small >= 0.8 AND total >= 500000 AS many_small, parties >= 3 AND large >= 2 AS spread, least(40 + 20 * (near >= 3)::INT + 10 * (n >= 5 AND small >= 0.8 AND total >= 500000)::INT + 5 * (parties >= 3 AND large >= 2)::INT + CASE WHEN total > 1000000 THEN 15 ELSE 0 END, 100)::INT AS risk FROM x
""")
def c_sar_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Suspicion patterns and the risk they add up to."""
    p = F.col("o_totalprice")
    x = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if((p >= 160_000) & (p < 200_000)).alias("near"), F.count("*").alias("n"), F.avg(F.when(p < 200_000, 1.0).otherwise(0.0)).alias("small"), F.sum(p).alias("total"), F.countDistinct("o_orderpriority").alias("parties"), F.count_if(p >= 300_000).alias("large"))
    known = [("structuring", 20, F.col("near") >= 3), ("many_small", 10, (F.col("n") >= 5) & (F.col("small") >= 0.8) & (F.col("total") >= 500_000)), ("spread", 5, (F.col("parties") >= 3) & (F.col("large") >= 2))]
    risk = sum((F.when(c, w).otherwise(0) for _, w, c in known), F.lit(40)) + F.when(F.col("total") > 1_000_000, 15).otherwise(0)
    return x.select("o_custkey", *[c.alias(n) for n, _, c in known], F.least(risk, F.lit(100)).alias("risk"))


@query("""
WITH m AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS mean FROM m GROUP BY 1)
SELECT user_id, round(least(sum(least(abs(v - mean) / mean * 20, 30)), 100), 4) AS score, count(*) FILTER (abs(v - mean) / mean > 0.5) AS alerts, count(*) FILTER (abs(v - mean) / mean > 0.3 AND abs(v - mean) / mean <= 0.5) AS warnings FROM m JOIN s USING (event_type) GROUP BY 1
""")
def c_indicator_score(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation of each indicator from its benchmark, capped and added."""
    m = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    x = m.join(F.broadcast(m.groupBy("event_type").agg(F.avg("v").alias("mean"))), "event_type").withColumn("dev", F.abs(F.col("v") - F.col("mean")) / F.col("mean"))
    return x.groupBy("user_id").agg(F.round(F.least(F.sum(F.least(F.col("dev") * 20, F.lit(30.0))), F.lit(100.0)), 4).alias("score"), F.count_if(F.col("dev") > 0.5).alias("alerts"), F.count_if((F.col("dev") > 0.3) & (F.col("dev") <= 0.5)).alias("warnings"))


@query("""
WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS sd, count(*) AS n FROM d GROUP BY 1)
SELECT event_type, n, round(m, 4) AS mean, round(m + 3 * greatest(sd, 0.01 * m), 4) AS ucl, round(greatest(m - 3 * greatest(sd, 0.01 * m), 0), 4) AS lcl, round(m + 2 * greatest(sd, 0.01 * m), 4) AS warn FROM s
""")
def c_control_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Limits at two and three deviations, with a floor for series that hardly vary."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    s = d.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    m, sd = F.col("m"), F.greatest(F.col("sd"), 0.01 * F.col("m"))
    return s.select("event_type", "n", F.round(m, 4).alias("mean"), F.round(m + 3 * sd, 4).alias("ucl"), F.round(F.greatest(m - 3 * sd, F.lit(0.0)), 4).alias("lcl"), F.round(m + 2 * sd, 4).alias("warn"))


@query("""
WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER w AS seq, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, seq, phase::BIGINT AS phase, event_type IN ('signup', 'purchase') AS key_node FROM x
""")
def c_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered events with key nodes and the phase they open."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    phase = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(by).alias("seq"), phase.alias("phase"), F.col("event_type").isin("signup", "purchase").alias("key_node"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS supporting, count(*) FILTER (event_type = 'error') AS contradicting FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'error') > 0
""")
def c_ev_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with evidence on both sides."""
    e = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(e == "purchase").alias("supporting"), F.count_if(e == "error").alias("contradicting")).where("supporting > 0 and contradicting > 0")


@query("""
WITH h AS (SELECT doc_id, least(0.15 * len(regexp_extract_all(text, '(?i)\\b(the|of|and|license)\\b')), 1) AS s FROM documents)
SELECT doc_id, round(s, 4) AS impact, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM h
""")
def c_impact_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A weight a term found, capped, in bands."""
    h = table(spark, sf, "documents").select("doc_id", F.least(F.regexp_count("text", F.lit("(?i)\\b(the|of|and|license)\\b")) * F.lit(0.15), F.lit(1.0)).alias("s"))
    return h.select("doc_id", F.round("s", 4).alias("impact"), rules.bands(F.col("s"), [(0.7, "high"), (0.4, "medium")], "low").alias("level"))


@query("""
WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
b AS (SELECT src AS id, w FROM e UNION ALL SELECT dst, w FROM e), d AS (SELECT id, count(*) AS deg, sum(w) AS vol FROM b GROUP BY 1)
SELECT id, round(least(0.25 * least(deg / 50.0, 1) + 0.2 * least(ln(1 + vol) / 20, 1) + CASE WHEN n_regionkey = 0 THEN 0.2 ELSE 0 END, 1)::DOUBLE, 6) AS risk FROM d JOIN nation ON id = n_nationkey
""")
def c_related_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk by degree, volume and jurisdiction."""
    d = graphs.degrees(trade(spark, sf), "w").select("id", (F.col("out_degree") + F.col("in_degree")).alias("deg"), (F.col("out_volume") + F.col("in_volume")).alias("vol"))
    n = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey"))
    risk = 0.25 * F.least(F.col("deg") / 50.0, F.lit(1.0)) + 0.2 * F.least(F.log1p("vol") / 20, F.lit(1.0)) + F.when(F.col("n_regionkey") == 0, 0.2).otherwise(0.0)
    return d.join(n, "id").select("id", F.round(F.least(risk, F.lit(1.0)), 6).alias("risk"))


@query("""
WITH r AS (SELECT p_brand, 0.35 * avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END) AS p0, 0.6 * 0.35 * avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END) AS p1, sum(p_retailprice) AS impact FROM part GROUP BY 1)
SELECT p_brand, round(least((p0 - p1) * impact * 12, 2000000000), 4) AS avoided FROM r
""")
def c_risk_avoided(spark: SparkSession, sf: str) -> DataFrame:
    """Change of probability times impact over a year, capped."""
    share = 0.35 * F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
    r = table(spark, sf, "part").groupBy("p_brand").agg(share.alias("p0"), F.sum("p_retailprice").alias("impact"))
    return r.select("p_brand", F.round(F.least((F.col("p0") - 0.6 * F.col("p0")) * F.col("impact") * 12, F.lit(2e9)), 4).alias("avoided"))
