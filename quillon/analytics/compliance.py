"""Checks of settings, identities, histories, code and vectors over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.registry import query, table
from quillon.functions import texts
from quillon.operators import checks, graphs, joins


@query("""
SELECT event_id, coalesce(json_extract_string(props, '$.k')::DOUBLE > 60, false) AS over, json_extract_string(props, '$.other') IS NULL AS missing FROM events
""")
def rule_path(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on paths of the JSON properties."""
    return table(spark, sf, "events").select("event_id", checks.path_rule(F.col("props"), "k", ">", 60).alias("over"), checks.path_rule(F.col("props"), "other", "missing").alias("missing"))


@query("""
SELECT user_id, count(*) AS n, sum(CASE WHEN NOT (event_type = 'error') THEN 1 ELSE 0 END)::BIGINT AS passed, round(100.0 * sum(CASE WHEN NOT (event_type = 'error') THEN 1 ELSE 0 END) / count(*), 4) AS compliance FROM events GROUP BY 1
""")
def rule_config(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as a map, a negated rule on one key, compliance by host."""
    e = table(spark, sf, "events").select("user_id", F.create_map(F.lit("type"), "event_type").alias("config"))
    ok = checks.config_rule(F.col("config"), "type", "contains", "error", negate=True).cast("int")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(ok).alias("passed"), F.round(100.0 * F.sum(ok) / F.count("*"), 4).alias("compliance"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(abs(o_totalprice - lines) < 0.05, false) AS articulates, coalesce(o_totalprice >= 0, false) AS positive FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
""")
def rule_articulation(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals against their lines, as string identities."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("lines"))
    x = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = ["o_totalprice", "lines"]
    return x.select("o_orderkey", checks.identity("o_totalprice == lines", names, 0.05).alias("articulates"), checks.identity("o_totalprice >= 0", names).alias("positive"))


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM orders)
SELECT o_orderkey, CASE WHEN m IS NULL THEN 'no_history' WHEN o_totalprice > 2 * m THEN 'fail' ELSE 'pass' END AS verdict FROM h
""")
def rule_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Each amount against the mean of the ten before."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-10, -1)
    h = table(spark, sf, "orders").withColumn("m", F.avg("o_totalprice").over(by))
    return h.select("o_orderkey", F.when(F.col("m").isNull(), "no_history").when(F.col("o_totalprice") > 2 * F.col("m"), "fail").otherwise("pass").alias("verdict"))


@query("""
SELECT p_partkey, round(p_size * CASE WHEN p_size % 3 = 0 THEN 1000.0 WHEN p_size % 3 = 1 THEN 1.0 END, 4) AS base FROM part
""")
def n_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in a base unit; an unknown unit has none."""
    units = spark.sql("select * from values ('t', 1000.0D), ('kg', 1.0D) as u(unit, factor)")
    p = table(spark, sf, "part").withColumn("u", F.when(F.col("p_size") % 3 == 0, "t").when(F.col("p_size") % 3 == 1, "kg").otherwise("?"))
    return checks.converted(p, "p_size", "u", units).select("p_partkey", F.round("base", 4).alias("base"))


@query("""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages)
SELECT page_id, line::INT AS line, rule FROM (SELECT page_id, line, unnest(['script', 'style', 'tracking']) AS rule, unnest([regexp_matches(t, '<script'), regexp_matches(t, '<style'), regexp_matches(t, 'track\\(')]) AS hit FROM l) WHERE hit
""")
def s_code_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages that hold scripts, styles or tracking."""
    return checks.code_findings(table(spark, sf, "pages"), "page_id", "html", [("script", "<script"), ("style", "<style"), ("tracking", "track\\(")])


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS weight FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL
""")
def agg_cooccur(spark: SparkSession, sf: str) -> DataFrame:
    """Brands that occur in one order; an order's few brands are paired inside its row, so there is no self-join."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("s")).where(F.size("s") > 1)
    pairs = own.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("weight"))


@query()
def s_sim_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Part names whose matching-blocks ratio is above .6, with Levenshtein's distance beside it. Different names are compared, found by
    the characters they share; tests hold the pairs against all pairs."""
    got = joins.similar_names(table(spark, sf, "part").select(F.col("p_name").alias("name")), 0.6)
    return got.select("a", "b", F.round("ratio", 6).alias("ratio"), F.levenshtein("a", "b").alias("edits"))


#: A text's first four words and what stands between them; the rest of a text is not looked at.
FIRST_WORDS = "^\\s*(\\S+(?:\\s+\\S+){0,3})"


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a name each: their first four words, in small letters. Stored, as names are read many times and texts are long."""
    first = F.regexp_replace(F.lower(F.regexp_extract("text", FIRST_WORDS, 1)), "\\s+", " ")
    return graphs.cut(table(spark, sf, "documents").select("doc_id", F.coalesce(first, F.lit("")).alias("name")))


@query()
def s_sim_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' first words whose matching-blocks ratio is above .9, with Levenshtein's distance: thousands of distinct names, met
    through the index of character runs; tests hold the pairs against all pairs."""
    got = joins.similar_names(_titles(spark, sf), 0.9)
    return got.select("a", "b", F.round("ratio", 6).alias("ratio"), F.levenshtein("a", "b").alias("edits"))


@query()
def join_entity_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are one entity by their names, closed over chains of names above .9 alike; named by the smallest."""
    own = _titles(spark, sf).select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("code"), "name")
    links = graphs.cut(joins.entity_links(own, "id", "code", "name", 0.9))
    parts = graphs.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return own.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("entity"))


@query("""
SELECT p_partkey, 'Part ' || p_name || ' of ' || coalesce(p_brand, '[missing]') || ': [missing]' AS text, round(2.0 / 3, 6) AS completeness FROM part
""")
def s_template(spark: SparkSession, sf: str) -> DataFrame:
    """A workpaper line filled by name; what is not there is said so."""
    text, share = checks.filled("Part ${p_name} of ${p_brand}: ${note}", ["p_name", "p_brand"])
    return table(spark, sf, "part").select("p_partkey", text.alias("text"), F.round(share, 6).alias("completeness"))


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(avg(value) FILTER (i <= n // 2), 6) AS before, round(avg(value) FILTER (i > n // 2), 6) AS after, round(avg(value) FILTER (i > n - 3), 6) AS ma3, first(event_id ORDER BY value DESC, ts, event_id) AS peak, first(event_id ORDER BY value, ts, event_id) AS valley FROM d GROUP BY 1 HAVING count(*) >= 3
""")
def win_half_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the first and second half of each series and of its last three, its peak and its valley; of equal values the first."""
    own = Window.partitionBy("user_id")
    d = table(spark, sf, "events").withColumn("i", F.row_number().over(own.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(own))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("value"))), 6)
    first = F.col("i") <= F.floor(F.col("n") / 2)
    ends = [F.max_by("event_id", F.struct("value", -F.col("i"))).alias("peak"), F.min_by("event_id", F.struct("value", "i")).alias("valley")]
    return d.groupBy("user_id").agg(mean(first).alias("before"), mean(~first).alias("after"), mean(F.col("i") > F.col("n") - 3).alias("ma3"), *ends, F.count("*").alias("n")).where("n >= 3").drop("n")


@query("""
WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS l, len(regexp_extract_all(text, '\\p{Latin}')) AS a FROM documents)
SELECT doc_id, round(coalesce(a::DOUBLE / nullif(l, 0), 0), 6) AS latin FROM s
""")
def s_lang_range(spark: SparkSession, sf: str) -> DataFrame:
    """Share of Latin letters."""
    return table(spark, sf, "documents").select("doc_id", F.round(checks.script_shares(F.col("text"))["latin"], 6).alias("latin"))
