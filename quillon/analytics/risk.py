"""Fraud, credit, invoice and supplier analytics over orders, lineitem, supplier, customer and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.derive import doubles
from quillon.analytics.registry import query, table
from quillon.functions import numbers
from quillon.operators import joins, rules, stats


@query("""
WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice AS a, o_orderdate AS d, o_orderpriority AS p FROM orders),
m AS (SELECT o_orderkey, o_custkey, list_filter([CASE WHEN month(d) IN (3,6,9,12) AND day(d) >= 28 AND a >= 100000 THEN 'quarter_end' END,
  CASE WHEN floor(a)::BIGINT % 1000 = 0 AND floor(a) > 0 THEN 'round' END,
  CASE WHEN p = '1-URGENT' AND a >= 250000 THEN 'urgent_large' END,
  CASE WHEN left(floor(a)::BIGINT::VARCHAR, 1) = '9' AND a >= 90000 AND a < 100000 THEN 'below_limit' END], lambda x: x IS NOT NULL) AS r FROM t)
SELECT o_orderkey, o_custkey, array_to_string(r, ',') AS rules,
  (CASE WHEN list_contains(r,'quarter_end') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(r,'round') THEN 0.25 ELSE 0 END + CASE WHEN list_contains(r,'urgent_large') THEN 0.35 ELSE 0 END + CASE WHEN list_contains(r,'below_limit') THEN 0.4 ELSE 0 END)::DOUBLE AS score
FROM m WHERE len(r) > 0
""")
def fo_supervised(spark: SparkSession, sf: str) -> DataFrame:
    """Named patterns on every transaction."""
    t = table(spark, sf, "orders")
    at = lambda **c: rules.pattern(c, F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderpriority"))
    known = [("quarter_end", 0.3, at(month_in=[3, 6, 9, 12], day_min=28, amount_min=100_000)), ("round", 0.25, at(multiple_of=1000)), ("urgent_large", 0.35, at(type="1-URGENT", amount_min=250_000)), ("below_limit", 0.4, at(first_digit=9, amount_min=90_000) & (F.col("o_totalprice") < 100_000))]
    got = rules.apply_rules(t, known).where(F.size("rules") > 0)
    return got.select("o_orderkey", "o_custkey", F.concat_ws(",", "rules").alias("rules"), F.round("score", 2).alias("score"))


BENFORD_SQL = """
WITH d AS (SELECT left(floor(abs(l_extendedprice))::BIGINT::VARCHAR, 1)::INT AS digit FROM lineitem WHERE l_extendedprice IS NOT NULL),
c AS (SELECT g.digit, count(d.digit) AS n FROM (SELECT unnest(range(1, 10))::INT AS digit) g LEFT JOIN d ON d.digit = g.digit GROUP BY g.digit),
x AS (SELECT digit, n, sum(n) OVER () AS total, log10(1 + 1.0::DOUBLE / digit) AS expected FROM c)
SELECT digit, n::BIGINT AS n, round(n::DOUBLE / total, 6) AS observed, round(expected, 6) AS expected, round(power(n - expected * total, 2) / (expected * total), 4) AS chi2, (n::DOUBLE / total) / expected > 1.5 AS flagged FROM x
"""


@query(BENFORD_SQL)
def st_benford_chi2(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.benford(table(spark, sf, "lineitem"), "l_extendedprice")
    return got.select("digit", "n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round("chi2", 4).alias("chi2"), (F.col("ratio") > 1.5).alias("flagged"))


@query("""
WITH d AS (SELECT l_suppkey, left(floor(abs(l_extendedprice))::BIGINT::VARCHAR, 1)::INT AS digit FROM lineitem),
s AS (SELECT l_suppkey, count(*) AS total FROM d WHERE digit BETWEEN 1 AND 9 GROUP BY 1),
c AS (SELECT s.l_suppkey, s.total, g.digit, log10(1 + 1.0::DOUBLE / g.digit) AS e, count(d.digit) AS n FROM s CROSS JOIN (SELECT unnest(range(1,10))::INT AS digit) g LEFT JOIN d ON d.l_suppkey = s.l_suppkey AND d.digit = g.digit GROUP BY ALL)
SELECT l_suppkey, max(total)::BIGINT AS n, round(sum(power(n - e * total, 2) / (e * total)), 4) AS chi2, round(max(abs(n::DOUBLE / total - e)), 6) AS max_dev,
  round(CASE WHEN max(total) >= 10 THEN least(sum(power(n - e * total, 2) / (e * total)) / 15.507, 1.0) ELSE 0.0 END, 4) AS score FROM c GROUP BY 1
""")
def st_benford_score(spark: SparkSession, sf: str) -> DataFrame:
    """Also st_benford_maxdev."""
    got = stats.benford_score(table(spark, sf, "lineitem"), "l_extendedprice", ["l_suppkey"])
    return got.select("l_suppkey", "n", F.round("chi2", 4).alias("chi2"), F.round("max_dev", 6).alias("max_dev"), F.round("score", 4).alias("score"))


@query("""
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0), 4) AS z
FROM orders WINDOW w AS (PARTITION BY o_custkey) QUALIFY count(*) OVER w >= 4 AND abs((o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0)) > 2.5
""")
def st_zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.operators.series import zscored

    got = zscored(table(spark, sf, "orders").withColumn("k", F.count("*").over(Window.partitionBy("o_custkey"))), ["o_custkey"], "o_totalprice")
    return got.where((F.col("k") >= 4) & (F.abs("z") > 2.5)).select("o_orderkey", F.round("z", 4).alias("z"))


@query("""
WITH u AS (SELECT l_orderkey, l_linenumber, p_brand, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT p_brand, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM u GROUP BY 1)
SELECT p_brand, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n_outside, count(*) AS n
FROM u JOIN q USING (p_brand) GROUP BY ALL
""")
def st_group_fences(spark: SparkSession, sf: str) -> DataFrame:
    """Unit prices outside the fences of their brand."""
    u = _unit_prices(spark, sf)
    got = stats.fences(u, ["p_brand"], "price").groupBy("p_brand", "low", "high").agg(F.count(F.when(F.col("outside"), 1)).alias("n_outside"), F.count("*").alias("n"))
    return got.select("p_brand", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n_outside", "n")


def _unit_prices(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return lines.join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


@query("""
WITH u AS (SELECT p_brand, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, round(quantile_cont(price, 0.1), 4) AS p10, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95 FROM u GROUP BY 1 HAVING count(*) >= 5
""")
def agg_price_profile(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.price_profile(_unit_prices(spark, sf), ["p_brand"], "price")
    return got.select("p_brand", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p95")])


@query("""
WITH u AS (SELECT p_brand, p_type, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)
SELECT p_type, count(*) AS n, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(list_sort(list(price))[(count(*) // 4)::INT + 1], 4) AS q1, round(list_sort(list(price))[(3 * count(*) // 4)::INT + 1], 4) AS q3, round(stddev_samp(price), 4) AS std FROM u GROUP BY 1 HAVING count(*) >= 3
""")
def agg_pli(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median, sample deviation and index quartiles of unit prices by type."""
    u = _unit_prices(spark, sf)
    half = {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.ceil((F.col("n") - 1) / 2)}
    places = stats.at_ranks(u, ["p_type"], "price", {**half, "q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)})
    moments = u.groupBy("p_type").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"))
    met = places.join(moments, "p_type").withColumn("median", (F.col("_a") + F.col("_b")) / 2)
    got = met.select("p_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "q1", "q3", "std")])
    return got.where("n >= 3")


@query("""
SELECT o_custkey, count(*) FILTER (o_totalprice >= 0.9 * 200000 AND o_totalprice < 200000) AS near_limit, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, round(sum(o_totalprice) FILTER (o_totalprice >= 0.9 * 200000 AND o_totalprice < 200000), 2) AS amount
FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice >= 0.9 * 200000 AND o_totalprice < 200000) >= 3
""")
def agg_smurf(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with three or more amounts just below a limit."""
    near = (F.col("o_totalprice") >= 0.9 * 200_000) & (F.col("o_totalprice") < 200_000)
    got = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(near).alias("near_limit"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.sum(F.when(near, F.col("o_totalprice"))), 2).alias("amount"))
    return got.where("near_limit >= 3")


@query("""
SELECT s_suppkey, n_src AS n_sources, n_lines FROM (SELECT l_suppkey AS s_suppkey, count(DISTINCT o_custkey) AS n_src, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice < 10000 GROUP BY 1) WHERE n_src >= 3
""")
def agg_inbound(spark: SparkSession, sf: str) -> DataFrame:
    """Receivers of small amounts from three or more senders."""
    small = table(spark, sf, "lineitem").where("l_extendedprice < 10000").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    met = small.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("s_suppkey").agg(F.countDistinct("o_custkey").alias("n_sources"), F.count("*").alias("n_lines")).where("n_sources >= 3")


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN value > 80 THEN 'large' END, CASE WHEN event_type = 'purchase' THEN 'spend' END, CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'after_hours' END, CASE WHEN event_type IN ('login', 'logout', 'signup') THEN 'access' END], lambda x: x IS NOT NULL), ',') AS rules,
 least(CASE WHEN value > 80 THEN 45 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 25 ELSE 0 END + CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 30 ELSE 0 END + CASE WHEN event_type IN ('login', 'logout', 'signup') THEN 15 ELSE 0 END, 100)::DOUBLE AS score,
 CASE WHEN score >= 80 THEN 'P0' WHEN score >= 60 THEN 'P1' WHEN score >= 40 THEN 'P2' ELSE 'P3' END AS severity FROM events
""")
def rule_score(spark: SparkSession, sf: str) -> DataFrame:
    """Alert scores and severity bands."""
    hour = F.hour("ts")
    known = [("large", 45.0, rules.compare(F.col("value"), ">", 80)), ("spend", 25.0, rules.compare(F.col("event_type"), "==", "purchase")), ("after_hours", 30.0, F.coalesce((hour < 6) | (hour > 22), F.lit(False))), ("access", 15.0, rules.compare(F.col("event_type"), "in", ["login", "logout", "signup"]))]
    got = rules.apply_rules(table(spark, sf, "events"), known, cap=100.0)
    return got.select("event_id", F.concat_ws(",", "rules").alias("rules"), "score", rules.bands(F.col("score"), [(80, "P0"), (60, "P1"), (40, "P2")], "P3").alias("severity"))


#: Invoices derived from lines: the number, rate, amounts, date and parties of some are wrong by turns.
INVOICE = {
    "no": "CASE l_orderkey % 17 WHEN 0 THEN '' WHEN 1 THEN 'A-1' ELSE lpad(cast(l_orderkey as {text}), 10, '0') END", "rate": "CASE WHEN l_linenumber % 6 = 0 THEN 0.05 ELSE 0.13 END", "excl": "CASE WHEN l_orderkey % 29 = 0 THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END",
    "tax_factor": "CASE WHEN l_orderkey % 7 = 2 THEN 1.1 ELSE 1.0 END", "incl_factor": "CASE WHEN l_orderkey % 11 = 3 THEN 1.05 ELSE 1.0 END", "seller": "CASE WHEN l_suppkey % 19 = 4 THEN '' ELSE 'seller' END",
}
INVOICE_RISKS = [("no_empty", "error", 0.3), ("no_format", "error", 0.2), ("rate", "warning", 0.15), ("total", "error", 0.35), ("tax", "warning", 0.2), ("date", "error", 0.25), ("party", "warning", 0.15), ("amount", "error", 0.3)]


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate, """ + ", ".join(f"{e.format(text='varchar')} AS {n}" for n, e in INVOICE.items()) + """ FROM lineitem), y AS (SELECT *, excl * rate * tax_factor AS tax, (excl + excl * rate * tax_factor) * incl_factor AS incl FROM x),
z AS (SELECT l_orderkey, l_linenumber, [CASE WHEN no = '' THEN 'no_empty' END, CASE WHEN no <> '' AND NOT regexp_matches(no, '^[0-9]{8,20}$') THEN 'no_format' END, CASE WHEN rate NOT IN (0.0, 0.01, 0.03, 0.06, 0.09, 0.13) THEN 'rate' END, CASE WHEN excl + tax > 0 AND abs(incl - excl - tax) / (excl + tax) > 0.02 THEN 'total' END, CASE WHEN excl * rate > 0 AND tax > 0 AND abs(tax - excl * rate) / (excl * rate) > 0.02 THEN 'tax' END, CASE WHEN l_shipdate > TIMESTAMP '2000-06-30' THEN 'date' END, CASE WHEN seller = '' THEN 'party' END, CASE WHEN incl <= 0 THEN 'amount' END] AS i FROM y), w AS (SELECT l_orderkey, l_linenumber, list_filter(i, lambda v: v IS NOT NULL) AS i FROM z)
SELECT l_orderkey, l_linenumber, array_to_string(i, ',') AS issues, round(least(1, """ + " + ".join(f"CASE WHEN list_contains(i, '{n}') THEN {w} ELSE 0 END" for n, _, w in INVOICE_RISKS) + """)::DOUBLE, 4) AS risk, CASE WHEN len(list_intersect(i, ['no_empty', 'no_format', 'total', 'date', 'amount'])) > 0 THEN 'abnormal' ELSE 'warning' END AS status FROM w WHERE len(i) > 0
""")
def rule_invoice(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with what is wrong with them: number, rate, totals, tax, date, parties, amount; the risk of all, and the status of the
    worst. Duplicates are join_interval_dup's."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *[F.expr(doubles(e.format(text="string"))).alias(n) for n, e in INVOICE.items()])
    y = x.withColumn("tax", F.col("excl") * F.col("rate") * F.col("tax_factor")).withColumn("incl", (F.col("excl") + F.col("tax")) * F.col("incl_factor"))
    got = rules.invoice_issues(y, F.lit("2000-06-30").cast("timestamp")).where(F.size("issues") > 0)
    return got.select("l_orderkey", "l_linenumber", F.concat_ws(",", "issues").alias("issues"), F.round("risk", 4).alias("risk"), "status")


@query("""
WITH x AS (SELECT o_orderkey, least(greatest((1 / (1 + exp(-(-3.5 + 1.2 * (o_totalprice / 300000) + CASE WHEN c_acctbal < 0 THEN 1.4 ELSE 0 END)))), 0.001), 0.99) AS pd, o_totalprice AS ead, CASE c_mktsegment WHEN 'BUILDING' THEN 0.45 WHEN 'MACHINERY' THEN 0.5 WHEN 'AUTOMOBILE' THEN 0.4 ELSE 0.6 END AS lgd, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderstatus, count(*) AS n, round(sum(ead), 2) AS ead, round(sum(pd * lgd * ead), 2) AS el, round(sum(pd * lgd * ead) / sum(ead), 6) AS el_rate, count(*) FILTER (pd >= 0.2) AS weak FROM x GROUP BY 1
""")
def agg_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """Expected loss by status: logistic default odds, loss by segment."""
    x = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pd_ = numbers.sigmoid(-3.5 + 1.2 * (F.col("o_totalprice") / 300_000) + F.when(F.col("c_acctbal") < 0, 1.4).otherwise(0.0))
    lgd = F.when(F.col("c_mktsegment") == "BUILDING", 0.45).when(F.col("c_mktsegment") == "MACHINERY", 0.5).when(F.col("c_mktsegment") == "AUTOMOBILE", 0.4).otherwise(0.6)
    x = x.select("o_orderstatus", F.col("o_totalprice").alias("ead_"), F.least(F.greatest(pd_, F.lit(0.001)), F.lit(0.99)).alias("pd"), lgd.alias("lgd"))
    loss = F.sum(F.col("pd") * F.col("lgd") * F.col("ead_"))
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("ead_"), 2).alias("ead"), F.round(loss, 2).alias("el"), F.round(loss / F.sum("ead_"), 6).alias("el_rate"), F.count_if(F.col("pd") >= 0.2).alias("weak"))


@query("""
WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT x.src AS a, x.dst AS b, round(x.w, 2) AS out, round(y.w, 2) AS back, round(least(x.w, y.w) / greatest(x.w, y.w), 6) AS ratio FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst AND least(x.w, y.w) / greatest(x.w, y.w) >= 0.7
""")
def join_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that trade both ways in like amounts."""
    got = joins.reversed_flows(trade(spark, sf), "src", "dst", "w")
    return got.select("a", "b", F.round("out", 2).alias("out"), F.round("back", 2).alias("back"), F.round("ratio", 6).alias("ratio"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, w): what customers of one nation buy from suppliers of another. Dimension tables join by their keys."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    met = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("w"))


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER w AS p, lead(o_orderdate::DATE) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, o_custkey, o_orderpriority, least(coalesce(abs(d - p), 99999), coalesce(abs(n - d), 99999))::INT AS gap FROM x WHERE least(coalesce(abs(d - p), 99999), coalesce(abs(n - d), 99999)) <= 30
""")
def join_interval_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that repeat within 30 days; neighbours in time decide, so no self-join."""
    got = joins.near_repeats(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate", 30)
    return got.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("gap").cast("int").alias("gap"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS nation, floor(s_acctbal / 1000)::BIGINT::VARCHAR AS band FROM supplier),
l AS (SELECT id, 'nation' AS kind, nation AS value FROM s UNION SELECT id, 'band', band FROM s)
SELECT x.id AS a, y.id AS b, x.kind, x.value, count(*) OVER (PARTITION BY 1) * 0 + (SELECT count(*) FROM l z WHERE z.kind = x.kind AND z.value = x.value) AS members FROM l x JOIN l y ON x.kind = y.kind AND x.value = y.value AND x.id < y.id
WHERE (SELECT count(*) FROM l z WHERE z.kind = x.kind AND z.value = x.value) <= 200
UNION ALL SELECT m.a, l.id, l.kind, l.value, m.members FROM l JOIN (SELECT kind, value, min(id) AS a, count(*) AS members FROM l GROUP BY kind, value HAVING count(*) > 200) m ON l.kind = m.kind AND l.value = m.value AND l.id > m.a
""")
def join_share(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share a nation or a balance band."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("band"))
    return joins.sharing_pairs(s, "id", ["nation", "band"])


@query("""
WITH c AS (SELECT c_custkey, c_nationkey AS nation, c_acctbal FROM customer), s AS (SELECT s_suppkey, s_nationkey AS nation, s_acctbal FROM supplier),
m AS (SELECT c_custkey, s_suppkey, 1 / (1 + abs(c_acctbal - s_acctbal) / 1000) AS score FROM c JOIN s USING (nation)),
b AS (SELECT c_custkey, s_suppkey, score FROM m WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1)
SELECT c.c_custkey, b.s_suppkey, round(b.score, 6) AS score FROM c LEFT JOIN b USING (c_custkey)
""")
def join_best_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Best counterpart in the same nation by nearness of amounts ."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("c_acctbal"))
    # a score of .7 means at most 3000 / 7 apart, and the score falls with the distance: the nearest is the best
    score = lambda distance: 1 / (1 + distance / 1000)
    got = joins.nearest(c, s, ["nation"], "c_acctbal", "c_custkey", "s_suppkey", 3000 / 7, score).withColumn("score", score(F.col("distance")))
    return got.select("c_custkey", "s_suppkey", F.round("score", 6).alias("score"))


@query("""
WITH b AS (SELECT p_brand, avg(p_retailprice) AS base FROM part WHERE p_size >= 25 GROUP BY 1)
SELECT p_partkey, CASE WHEN base IS NULL THEN 'no_baseline' WHEN p_retailprice > 1.15 * base THEN 'high' WHEN p_retailprice < 0.85 * base THEN 'low' ELSE 'normal' END AS status FROM part LEFT JOIN b USING (p_brand)
""")
def join_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Each part against its brand's baseline, kept where there is none."""
    p = table(spark, sf, "part")
    b = p.where("p_size >= 25").groupBy("p_brand").agg(F.avg("p_retailprice").alias("base"))
    x = p.join(b, "p_brand", "left")
    return x.select("p_partkey", F.when(F.col("base").isNull(), "no_baseline").when(F.col("p_retailprice") > 1.15 * F.col("base"), "high").when(F.col("p_retailprice") < 0.85 * F.col("base"), "low").otherwise("normal").alias("status"))


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) 
""")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'undisclosed' ELSE 'matched' END AS side FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def semi_anti_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers on the list of large urgent orders, and those that are not: both sides of the same match."""
    known = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey")
    sides = [c.join(known, "c_custkey", how).withColumn("side", F.lit(name)) for how, name in (("left_semi", "matched"), ("left_anti", "undisclosed"))]
    return sides[0].unionAll(sides[1])


@query("""
WITH o AS (SELECT o_custkey, o_orderdate AS ts, o_orderkey FROM orders), r AS (SELECT o_custkey, o_orderdate AS ts, o_totalprice AS rate FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o.o_orderkey, (SELECT max_by(rate, r.ts) FROM r WHERE r.o_custkey = o.o_custkey AND r.ts <= o.ts) IS NOT NULL AS has_rate FROM o
""")
def join_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a customer has an urgent order at or before each order, by the as-of join."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("ts"), "o_orderkey")
    r = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("rate"))
    return joins.as_of(o, r, ["o_custkey"], "ts", "rate").select("o_orderkey", F.col("rate").isNotNull().alias("has_rate"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("f1"), F.dayofmonth("o_orderdate").cast("double").alias("f2"), F.month("o_orderdate").cast("double").alias("f3"))


@query("""
WITH f AS (SELECT o_orderkey, ln(1 + o_totalprice) AS f1, day(o_orderdate)::DOUBLE AS f2, month(o_orderdate)::DOUBLE AS f3 FROM orders),
s AS (SELECT avg(f1) m1, avg(f2) m2, avg(f3) m3, stddev_pop(f1) s1, stddev_pop(f2) s2, stddev_pop(f3) s3 FROM f),
d AS (SELECT o_orderkey, sqrt(power((f1 - m1) / s1, 2) + power((f2 - m2) / s2, 2) + power((f3 - m3) / s3, 2)) AS distance FROM f, s)
SELECT o_orderkey, round(distance, 6) AS distance, distance > (SELECT quantile_cont(distance, 0.9) FROM d) AS top FROM d
""")
def ml_recon(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of standardised features to the centre, top tenth flagged."""
    got = stats.top_share(stats.centre_distance(_features(spark, sf), ["f1", "f2", "f3"]), "distance", 0.1, "top")
    return got.select("o_orderkey", F.round("distance", 6).alias("distance"), "top")


@query()
def ml_unsupervised(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that the forest or their distance to the centre marks, with both scores: forest above .65 or in the top 5 %, distance
    in the top tenth."""
    got = stats.unsupervised(_features(spark, sf), "o_orderkey", ["f1", "f2", "f3"])
    return got.select("o_orderkey", F.round("iso", 6).alias("iso"), F.round("distance", 6).alias("distance"), "by_forest", "by_centre", "flagged")


@query()
def ml_iforest(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation forest on a bounded sample, scores for every row."""
    return stats.isolation(_features(spark, sf), "o_orderkey", ["f1", "f2", "f3"]).select("o_orderkey", "iso")


@query("""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
n AS (SELECT label, dim, avg(v) AS g, count(*) AS k FROM e GROUP BY ALL)
SELECT dim::INT AS dim, round(-0.1 * sum(g * k) / sum(k), 6) AS step FROM n GROUP BY 1
""")
def ml_fedavg(spark: SparkSession, sf: str) -> DataFrame:
    """Sample-weighted mean of the nodes' vectors, one step of descent."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    n = e.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("g"), F.count("*").alias("k"))
    return n.groupBy("dim").agg(F.round(-0.1 * F.sum(F.col("g") * F.col("k")) / F.sum("k"), 6).alias("step"))
