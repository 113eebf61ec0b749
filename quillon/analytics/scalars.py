"""Scalar functions over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.analytics.networks import starts, strong
from quillon.analytics.registry import query, table
from quillon.functions import numbers, texts
from quillon.operators import graphs, stats


@query("SELECT o_orderkey, round(o_totalprice, 2) AS plain, floor(o_totalprice / 10000) * 10000 AS units FROM orders")
def n_parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written with marks, commas and units, read back."""
    o = table(spark, sf, "orders")
    marked = F.concat(F.lit("¥ "), F.format_number("o_totalprice", 2))
    unit = F.concat(F.floor(F.col("o_totalprice") / 10_000).cast("string"), F.lit("万"))
    return o.select("o_orderkey", numbers.parse_amount(marked).alias("plain"), numbers.parse_amount(unit).alias("units"))


@query("""
WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 16, '4') AS c FROM orders),
d AS (SELECT o_orderkey, 17 - i AS place, substr(c, i, 1)::INT AS v FROM n, (SELECT unnest(range(1, 17))::INT AS i)),
s AS (SELECT o_orderkey, sum(CASE WHEN place % 2 = 0 THEN CASE WHEN 2 * v > 9 THEN 2 * v - 9 ELSE 2 * v END ELSE v END) % 10 = 0 AS ok FROM d GROUP BY 1)
SELECT o_orderkey, ok FROM s
""")
def s_luhn(spark: SparkSession, sf: str) -> DataFrame:
    """Luhn's check of derived card numbers."""
    return table(spark, sf, "orders").select("o_orderkey", numbers.luhn(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")).alias("ok"))


@query("""
WITH n AS (SELECT c_custkey, lpad((c_custkey * 104729)::VARCHAR, 17, '3') AS c FROM customer),
s AS (SELECT c_custkey, c, (SELECT sum(substr(c, i, 1)::INT * w) FROM (SELECT unnest([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2]) AS w, unnest(range(1, 18))::INT AS i))::INT % 11 AS r FROM n)
SELECT c_custkey, substr('10X98765432', r + 1, 1) = 'X' AS ok FROM s
""")
def s_id18(spark: SparkSession, sf: str) -> DataFrame:
    """Which derived identity codes are right with a final X."""
    return table(spark, sf, "customer").select("c_custkey", numbers.id18(F.concat(F.lpad((F.col("c_custkey") * 104_729).cast("string"), 17, "3"), F.lit("X"))).alias("ok"))


@query("""
WITH p AS (SELECT n_nationkey AS k, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)
SELECT a.k AS a, b.k AS b, round(2 * 6371 * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1))), 4) AS km FROM p a JOIN p b ON a.k = b.k - 1
""")
def n_haversine(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between neighbours in key order, at derived places."""
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon"))
    met = p.toDF("a", "lat1", "lon1").join(p.toDF("b", "lat2", "lon2"), F.col("a") == F.col("b") - 1)
    return met.select("a", "b", F.round(numbers.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("""
SELECT p_brand, round(list_sort(list(p_retailprice))[floor(count(*) * 0.9)::INT + 1], 4) AS p90 FROM part GROUP BY 1
""")
def n_percentile_idx(spark: SparkSession, sf: str) -> DataFrame:
    """The value at index int(n p), without interpolation."""
    got = stats.at_ranks(table(spark, sf, "part"), ["p_brand"], "p_retailprice", {"p90": F.floor(F.col("n") * 0.9)})
    return got.select("p_brand", F.round("p90", 4).alias("p90"))


@query("""
SELECT conv_id, turn, (length(text) - length(replace(text, 'th', ''))) // 2 AS n_th, CASE WHEN role = 'user' THEN '2.0.0' ELSE '1.5.0' END AS version FROM conversations
""")
def s_count_sub(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of a part, and version bumps by role."""
    change = F.when(F.col("role") == "user", "major").otherwise("minor")
    return table(spark, sf, "conversations").select("conv_id", "turn", texts.count_of(F.col("text"), "th").alias("n_th"), texts.bump(F.lit("1.4.2"), change).alias("version"))


@query()
def g_centrality(spark: SparkSession, sf: str) -> DataFrame:
    """Betweenness over the shortest paths of five hops from a stated set of sources; tests hold it against all shortest paths."""
    g = strong(spark, sf)
    return graphs.betweenness(g, starts(g), 5).select("id", F.round("score", 6).alias("score"))
