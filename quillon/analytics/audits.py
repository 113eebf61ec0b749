"""Composites of audit work over records derived from the tables, each beside its SQL."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.derive import choice, doubles
from quillon.analytics.registry import query, table
from quillon.analytics.values import INDEX_SQL, slices
from quillon.functions.similar import ratio
from quillon.operators import audits, rules, series, stats

NOTES = ["goods in transit", "wrong account, posted twice", "forged invoice", "method changed by policy", "rounding"]
REPLIES = ["goods received", "no such item", "next period cut-off", "agreed"]
LIKE = ", ".join(f"('{a}', '{b}', {difflib.SequenceMatcher(None, a, b).ratio()!r})" for a in NOTES for b in REPLIES)
DIFF_SQL = f"""
d AS (SELECT o_orderkey, {choice('o_orderkey', NOTES)[1]} AS book_text, {choice('o_custkey', REPLIES)[1]} AS reply_text, o_totalprice AS book, o_totalprice * (o_orderkey % 7 - 3) / 200.0 AS diff, CASE WHEN o_orderkey % 3 = 0 THEN 10000.0 ELSE 0 END AS materiality FROM orders),
l AS (SELECT * FROM (VALUES {LIKE}) AS t(a, b, r)), t AS (SELECT d.*, book_text || ' ' || reply_text AS t, r, diff / abs(book) AS share FROM d JOIN l ON a = book_text AND b = reply_text),
s AS (SELECT *, 0.25 * (contains(t, 'in transit')::INT + contains(t, 'cut-off')::INT + contains(t, 'next period')::INT) + CASE WHEN abs(share) <= 0.01 THEN 0.3 ELSE 0 END AS timing, 0.25 * (contains(t, 'wrong')::INT + contains(t, 'posted twice')::INT + contains(t, 'typo')::INT) + CASE WHEN diff <> 0 AND abs(share) > 0.01 THEN 0.2 ELSE 0 END AS error, 0.25 * (contains(t, 'forged')::INT + contains(t, 'fictitious')::INT) + CASE WHEN r < 0.4 THEN 0.15 ELSE 0 END AS fraud, 0.25 * (contains(t, 'policy')::INT + contains(t, 'method')::INT) AS policy FROM t),
k AS (SELECT *, greatest(timing, error, fraud, policy) AS top FROM s), c AS (SELECT *, CASE WHEN top = 0 THEN 'error' WHEN timing = top THEN 'timing' WHEN error = top THEN 'error' WHEN fraud = top THEN 'fraud' ELSE 'policy' END AS kind FROM k)
"""


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between books and replies, each with its kind; texts are compared once a pair of different ones."""
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k, F.expr(choice("o_orderkey", NOTES)[0]).alias("book_text"), F.expr(choice("o_custkey", REPLIES)[0]).alias("reply_text"), F.col("o_totalprice").alias("book"), (F.col("o_totalprice") * (k % 7 - 3) / 200.0).alias("diff"), F.when(k % 3 == 0, 10_000.0).otherwise(0.0).alias("materiality"))
    like = d.select("book_text", "reply_text").distinct().withColumn("like_", ratio("book_text", "reply_text"))
    met = d.join(like, ["book_text", "reply_text"])
    return met.withColumn("x", audits.difference_kind(F.concat_ws(" ", "book_text", "reply_text"), F.col("diff"), F.col("book"), F.col("like_"), 0.01))


@query(f"WITH {DIFF_SQL} SELECT o_orderkey, kind, round(CASE WHEN top = 0 THEN 0.1 ELSE least(top, 1) END::DOUBLE, 6) AS confidence FROM c")
def c_diff_class(spark: SparkSession, sf: str) -> DataFrame:
    """Differences by kind: words, amounts within or beyond the tolerance, and unlike texts speak for timing, error, fraud or policy."""
    return _differences(spark, sf).select("o_orderkey", "x.kind", F.round("x.score", 6).alias("confidence"))


@query(f"""
WITH {DIFF_SQL}, m AS (SELECT *, abs(diff) / CASE WHEN materiality > 0 THEN materiality ELSE abs(book) * 0.01 END AS share_ FROM c)
SELECT o_orderkey, CASE WHEN kind = 'fraud' THEN CASE WHEN share_ > 0.1 THEN 'critical' ELSE 'high' END WHEN share_ > 0.5 THEN 'critical' WHEN share_ > 0.1 THEN 'high' WHEN share_ > 0.02 THEN 'medium' ELSE 'low' END AS severity FROM m
""")
def c_diff_severity(spark: SparkSession, sf: str) -> DataFrame:
    """How severe a difference is against materiality, one per cent of the book amount by default."""
    return _differences(spark, sf).select("o_orderkey", audits.difference_severity(F.col("diff"), F.col("book"), F.col("materiality"), F.col("x.kind")).alias("severity"))


@query("""
WITH a AS (SELECT o_custkey AS id, 'balance' AS field, round(sum(o_totalprice), 2)::VARCHAR AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'account_name', c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'rate', (c_custkey % 7)::VARCHAR FROM customer),
b AS (SELECT o_custkey AS id, 'balance' AS field, round(sum(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END), 2)::VARCHAR AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'account_name', CASE WHEN c_custkey % 9 = 0 THEN upper(c_name) ELSE c_name END FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT c_custkey, 'rate', (c_custkey % 7 + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR FROM customer),
m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.field, b.field) AS field, a.v AS x, b.v AS y, try_cast(a.v AS DOUBLE) AS p, try_cast(b.v AS DOUBLE) AS q FROM a FULL JOIN b ON a.id = b.id AND a.field = b.field)
SELECT id, field, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN CASE WHEN contains(field, 'balance') THEN 'amount' ELSE 'other' END WHEN contains(field, 'account') THEN 'account' ELSE 'other' END AS kind, round(q - p, 2) AS diff FROM m WHERE CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN abs(p - q) > 0.01 ELSE x IS DISTINCT FROM y END
""")
def c_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two ledgers, field by field: numbers beyond a tolerance, texts that differ, and what one side lacks."""
    o, c, k = table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("c_custkey")
    total = lambda v: o.groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum(v), 2).cast("string").alias("v")).select("id", F.lit("balance").alias("field"), "v")
    name = lambda some, v: some.select(k.alias("id"), F.lit("account_name").alias("field"), v.alias("v"))
    rate = lambda v: c.select(k.alias("id"), F.lit("rate").alias("field"), v.cast("string").alias("v"))
    p = F.col("o_totalprice")
    a = total(p).unionAll(name(c.where("c_custkey % 5 <> 0"), F.col("c_name"))).unionAll(rate(k % 7))
    b = total(F.when(F.col("o_orderkey") % 11 == 0, p + 1).otherwise(p)).unionAll(name(c.where("c_custkey % 6 <> 0"), F.when(k % 9 == 0, F.upper("c_name")).otherwise(F.col("c_name")))).unionAll(rate(k % 7 + F.when(k % 10 == 0, 1).otherwise(0)))
    return audits.reconciled(a, b, ["id"], "field", "v").select("id", "field", "kind", F.round("diff", 2).alias("diff"))


PAPERS = ["Cash 12.3456 and 1.2345 and 2.3456 and 3.4567 and 4.5678 and 5.6789 USD -3.25", "Subsequent events are subsequent. Balance agreed", "All the the items were counted and the list was held against the books. " * 2, "★ short"]
PAPER = {"mandatory": "4", "mandatory_hit": "p_partkey % 5 - p_partkey % 5 // 4", "evidences": "p_partkey % 4", "debit": "p_partkey % 3 * 100.0", "credit": "p_partkey % 2 * 100.0", "conclusion": "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fair' ELSE 'stated fairly in all' END", "standards": "8", "standards_hit": "p_partkey % 9"}
PAPER_SQL = f"p AS (SELECT p_partkey, {choice('p_partkey', PAPERS)[1]} AS content, " + ", ".join(f"{e} AS {n}" for n, e in PAPER.items()) + """ FROM part),
s AS (SELECT *, greatest(0, least(100, 60 + 40.0 * mandatory_hit / mandatory) - CASE WHEN evidences < 2 THEN 10 ELSE 0 END) AS completeness, 80.0 - CASE WHEN debit <> 0 AND credit <> 0 AND abs(debit - credit) > 0.01 THEN 30 ELSE 0 END - CASE WHEN len(regexp_extract_all(content, '[0-9]+[.][0-9]{3,}')) > 5 THEN 10 ELSE 0 END - CASE WHEN contains(content, 'USD') AND regexp_matches(content, '-[0-9]+[.][0-9]{2}') THEN 5 ELSE 0 END AS accuracy,
75.0 - CASE WHEN conclusion = '' THEN 25 ELSE 0 END - CASE WHEN contains(content, 'subsequent') AND NOT contains(content, 'cut-off') THEN 8 ELSE 0 END AS logic, least(100, 50 + 50.0 * standards_hit / standards) AS compliance,
85.0 - CASE WHEN regexp_matches(content, '[★◆▲]') THEN 10 ELSE 0 END - CASE WHEN len(list_filter(regexp_split_to_array(content, '[.!?]'), lambda x: length(x) > 80)) > 3 THEN 10 ELSE 0 END - CASE WHEN contains(content, 'the the') THEN 3 ELSE 0 END - CASE WHEN length(conclusion) > 0 AND length(conclusion) < 10 THEN 10 ELSE 0 END AS quality FROM p)"""


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", PAPERS)[0]).alias("content"), *[F.expr(doubles(e)).alias(n) for n, e in PAPER.items()])
    return audits.paper_scores(p)


RUBRICS = {"completeness": 0.25, "accuracy": 0.25, "logic": 0.2, "compliance": 0.2, "quality": 0.1}


@query(f"WITH {PAPER_SQL} SELECT p_partkey, " + ", ".join(f"round({r}::DOUBLE, 4) AS {r}" for r in RUBRICS) + " FROM s")
def ml_quality_rubrics(spark: SparkSession, sf: str) -> DataFrame:
    """Five rubrics of a working paper, from 0 to 100."""
    return _papers(spark, sf).select("p_partkey", *[F.round(r, 4).alias(r) for r in RUBRICS])


@query(f"WITH {PAPER_SQL}, o AS (SELECT *, " + " + ".join(f"{w} * {r}" for r, w in RUBRICS.items()) + " AS overall FROM s) SELECT p_partkey, round(overall::DOUBLE, 4) AS overall, CASE WHEN round(overall::DOUBLE, 9) >= 85 THEN 'A' WHEN round(overall::DOUBLE, 9) >= 75 THEN 'B' WHEN round(overall::DOUBLE, 9) >= 60 THEN 'C' ELSE 'D' END AS grade, concat_ws(',', " + ", ".join(f"CASE WHEN {r} < 60 THEN '{r}:critical' WHEN {r} < 75 THEN '{r}:major' END" for r in RUBRICS) + ") AS issues FROM o")
def c_audit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted whole of the rubrics, its grade, and the rubrics below 75 and 60."""
    o = _papers(spark, sf).withColumn("overall", stats.fused([(w, F.col(r)) for r, w in RUBRICS.items()]))
    issues = F.concat_ws(",", *[F.when(F.col(r) < 60, f"{r}:critical").when(F.col(r) < 75, f"{r}:major") for r in RUBRICS])
    return o.select("p_partkey", F.round("overall", 4).alias("overall"), rules.bands(F.round("overall", 9), [(85, "A"), (75, "B"), (60, "C")], "D").alias("grade"), issues.alias("issues"))


@query("""
WITH a AS (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS big, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice < 20000) AS small, sum(o_totalprice) AS total, count(DISTINCT o_orderpriority) AS parties FROM orders GROUP BY 1),
s AS (SELECT o_custkey, o_custkey % 60 + 20 * (big >= 2)::INT + 10 * (urgent >= 3)::INT + 5 * (small >= 1)::INT + CASE WHEN total >= 1000000 THEN 15 WHEN total >= 100000 THEN 8 ELSE 0 END + CASE WHEN parties >= 3 THEN 8 ELSE 0 END AS raw FROM a)
SELECT o_custkey, least(100, raw) AS score, CASE WHEN raw >= 80 THEN 'high' WHEN raw >= 50 THEN 'medium' ELSE 'low' END AS level, CASE WHEN raw >= 80 THEN 'submit' WHEN raw >= 50 THEN 'investigate' ELSE 'observe' END AS action FROM s
""")
def c_sar_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of a suspicion: the alert's score, 20, 10 or 5 a pattern by its severity, more for amount and parties; level and action."""
    p = F.col("o_totalprice")
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(p > 450_000).alias("big"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(p < 20_000).alias("small"), F.sum(p).alias("total"), F.countDistinct("o_orderpriority").alias("parties"))
    add = lambda test, n: F.when(test, n).otherwise(0)
    raw = F.col("o_custkey") % 60 + add(F.col("big") >= 2, 20) + add(F.col("urgent") >= 3, 10) + add(F.col("small") >= 1, 5) + F.when(F.col("total") >= 1e6, 15).when(F.col("total") >= 1e5, 8).otherwise(0) + add(F.col("parties") >= 3, 8)
    s = a.withColumn("raw", raw)
    level = lambda names: rules.bands(F.col("raw"), [(80, names[0]), (50, names[1])], names[2])
    return s.select("o_custkey", F.least(F.lit(100), F.col("raw")).alias("score"), level(["high", "medium", "low"]).alias("level"), level(["submit", "investigate", "observe"]).alias("action"))


FORMS = {"CN": ["name", "account", "amount", "reason"], "US": ["name", "amount", "phone"], "EU": ["name", "account", "country", "reason", "phone"]}
FORM_SQL = """
c AS (SELECT c_custkey, (['CN', 'US', 'EU'])[c_custkey % 3 + 1] AS form, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'A' || c_custkey::VARCHAR END AS account, round(abs(c_acctbal), 2) AS amount, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'splitting' END AS reason, c_nationkey::VARCHAR AS country, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '555' END AS phone FROM customer),
l AS (SELECT c_custkey, form, unnest(['name', 'account', 'amount', 'reason', 'country', 'phone']) AS field, unnest([name, account, amount::VARCHAR, reason, country, phone]) AS value FROM c), f AS (SELECT l.* FROM l JOIN (VALUES """ + ", ".join(f"('{k}', '{x}')" for k, some in FORMS.items() for x in some) + """) AS t(form, field) USING (form, field))"""


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    """Report forms by regulator as (c_custkey, form, field, value), a value being null where the record has none."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.expr(choice("c_custkey", ["CN", "US", "EU"])[0]).alias("form"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.concat(F.lit("A"), k.cast("string"))).alias("account"), F.round(F.abs("c_acctbal"), 2).cast("string").alias("amount"), F.when(k % 5 == 0, "").otherwise("splitting").alias("reason"), F.col("c_nationkey").cast("string").alias("country"), F.when(k % 6 != 0, "555").alias("phone"))
    fields = F.map_from_arrays(F.array(*[F.lit(x) for x in ("name", "account", "amount", "reason", "country", "phone")]), F.array("name", "account", "amount", "reason", "country", "phone"))
    wanted = F.when(F.col("form") == "CN", F.array(*map(F.lit, FORMS["CN"]))).when(F.col("form") == "US", F.array(*map(F.lit, FORMS["US"]))).otherwise(F.array(*map(F.lit, FORMS["EU"])))
    return c.select(k, "form", fields.alias("m"), F.explode(wanted).alias("field")).select(k, "form", "field", F.nullif(F.try_element_at("m", F.col("field")), F.lit("")).alias("value"))


@query(f"WITH {FORM_SQL} SELECT c_custkey, form, field, nullif(value, '') AS value FROM f")
def c_sar_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A suspicion's record in the fields of its regulator's form."""
    return _filled(spark, sf)


STORIES = ["''", "concat('Moved ', cast(floor(coalesce(total, 0)) as bigint), ' in all')", "'Moved 1,234.50 in all'", "repeat('Transfers stay below the limit. ', 4)"]


@query(f"""
WITH {FORM_SQL}, r AS (SELECT c_custkey, avg((nullif(value, '') IS NOT NULL)::INT) AS filled, avg((nullif(value, '') IS NOT NULL)::INT) FILTER (field <> 'phone') AS mandatory FROM f GROUP BY 1),
o AS (SELECT o_custkey AS c_custkey, count(*) AS n, sum(o_totalprice) AS total, count(*) FILTER (o_orderstatus = 'F') AS attachments, (count(*) FILTER (o_totalprice > 450000) >= 2)::INT + (count(*) FILTER (o_orderpriority = '1-URGENT') >= 3)::INT AS patterns, count(DISTINCT o_orderpriority) AS related FROM orders GROUP BY 1),
x AS (SELECT c.*, filled, mandatory, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(attachments, 0) AS attachments, coalesce(patterns, 0) > 0 AS p, coalesce(related, 0) AS related, (c_custkey % 3 = 0)::INT AS ext, c_custkey % 60 AS alert, CASE c_custkey % 4 {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(STORIES))} END AS story FROM c JOIN r USING (c_custkey) LEFT JOIN o USING (c_custkey)),
y AS (SELECT *, coalesce(try_cast(replace(regexp_extract(story, '[0-9,]+(\\.[0-9]+)?'), ',', '') AS DOUBLE), 0) AS said, length(reason) + 1 + length(story) AS len FROM x),
s AS (SELECT c_custkey, 15 * mandatory + CASE WHEN attachments > 0 THEN 10 ELSE 0 END + CASE WHEN reason <> '' AND ext > 0 THEN 5 WHEN reason <> '' THEN 2.5 ELSE 0 END AS complete,
 CASE WHEN said <> 0 AND abs(said - total) / greatest(total, 1) < 0.05 THEN 10 WHEN said = 0 AND total > 0 THEN 6 ELSE 0 END + CASE WHEN n > 0 THEN 5 ELSE 0 END + CASE WHEN account IS NOT NULL THEN 5 ELSE 2.5 END + CASE WHEN reason <> '' OR p THEN 5 ELSE 0 END AS accurate,
 CASE WHEN len >= 100 AND p THEN 10 WHEN len >= 50 THEN 6 ELSE 0 END + CASE WHEN n >= 5 THEN 3 ELSE 0 END + CASE WHEN related + ext >= 3 THEN 3 ELSE 0 END + CASE WHEN p THEN 4 ELSE 0 END + CASE WHEN p AND alert > 0 THEN 5 WHEN alert > 0 THEN 3 ELSE 0 END AS logical,
 CASE WHEN filled >= 0.9 THEN 10 WHEN filled >= 0.7 THEN 7 WHEN filled >= 0.5 THEN 4 ELSE 0 END + 10 AS complies FROM y), t AS (SELECT *, round((complete + accurate + logical + complies)::DOUBLE, 6) AS total FROM s)
SELECT c_custkey, round(complete::DOUBLE, 6) AS complete, accurate::DOUBLE AS accurate, logical::DOUBLE AS logical, complies::DOUBLE AS complies, total, CASE WHEN total >= 90 THEN 'excellent' WHEN total >= 80 THEN 'good' WHEN total >= 70 THEN 'fair' ELSE 'poor' END AS grade FROM t
""")
def c_sar_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of a filed report on a customer and its orders: completeness of 30 (fields, attachments, sources), accuracy of 25 (the
    amount the narrative names, dates, identity, cause), logic of 25 (length, depth, conclusion), compliance of 20."""
    have, k = F.col("value").isNotNull().cast("int"), F.col("c_custkey")
    rate = _filled(spark, sf).groupBy("c_custkey").agg(F.avg(have).alias("filled"), F.avg(F.when(F.col("field") != "phone", have)).alias("mandatory"))
    many = (F.count_if(F.col("o_totalprice") > 450_000) >= 2).cast("int") + (F.count_if(F.col("o_orderpriority") == "1-URGENT") >= 3).cast("int")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("transactions"), F.sum("o_totalprice").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("attachments"), many.alias("patterns"), F.countDistinct("o_orderpriority").alias("related"), F.count("o_orderdate").alias("dated"), F.min("o_orderdate").isNotNull().alias("ranged"))
    c = table(spark, sf, "customer").select(k, F.col("c_name").isNotNull().alias("named"), (k % 4 != 0).alias("identified"), F.when(k % 5 == 0, "").otherwise("splitting").alias("reason"), (k % 3 == 0).cast("int").alias("external"), (k % 60).alias("alert"))
    story = F.expr("case c_custkey % 4 " + " ".join(f"when {i} then {t}" for i, t in enumerate(STORIES)) + " end")
    met = c.join(rate, "c_custkey").join(o, "c_custkey", "left").withColumn("narrative", story).withColumnRenamed("total", "amount")
    got = audits.report_quality(met)
    return got.select("c_custkey", F.round("complete", 6).alias("complete"), "accurate", "logical", "complies", F.round("total", 6).alias("total"), "grade")


IMPACT_SQL = """
g AS (SELECT o_custkey, o_orderkey, (['missing', 'partial', 'covered', 'covered'])[o_orderkey % 4 + 1] AS gap, o_orderkey % 6 = 0 AS penalty FROM orders),
a AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (gap = 'missing') AS missing, count(*) FILTER (gap = 'partial') AS partial, count(*) FILTER (penalty) AS penalties FROM g GROUP BY 1),
i AS (SELECT a.*, least(least(50.0 * missing / greatest(n, 1) + 25.0 * partial / greatest(n, 1) + CASE WHEN o_custkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN o_custkey % 4 < 2 THEN 15 ELSE 0 END, 100) + least(penalties * 5, 20), 100) AS score FROM a)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", k, F.expr(choice("o_orderkey", ["missing", "partial", "covered", "covered"])[0]).alias("gap"), (k % 6 == 0).alias("penalty"))


def _impact(spark: SparkSession, sf: str) -> DataFrame:
    g, c = _gaps(spark, sf), F.col("o_custkey")
    a = g.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("gap") == "missing").alias("missing"), F.count_if(F.col("gap") == "partial").alias("partial"), F.count_if("penalty").alias("penalties"))
    base = F.least(50 * F.col("missing") / F.col("n") + 25 * F.col("partial") / F.col("n") + F.when(c % 3 == 0, 10).otherwise(0) + F.when(c % 4 < 2, 15).otherwise(0), F.lit(100.0))
    return a.withColumn("score", F.least(base + F.least(F.col("penalties") * 5, F.lit(20)), F.lit(100.0)))


@query(f"WITH {IMPACT_SQL} SELECT o_custkey, round(score::DOUBLE, 4) AS score, CASE WHEN round(score::DOUBLE, 9) >= 70 THEN 'high' WHEN round(score::DOUBLE, 9) >= 40 THEN 'medium' ELSE 'low' END AS level FROM i")
def c_reg_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What a regulation means for a company: missing and partial duties, size, industry, and penalties."""
    return _impact(spark, sf).select("o_custkey", F.round("score", 4).alias("score"), rules.bands(F.round("score", 9), [(70, "high"), (40, "medium")], "low").alias("level"))


@query(f"""
WITH {IMPACT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, gap ORDER BY o_orderkey) AS i FROM g WHERE gap IN ('missing', 'partial')), r AS (SELECT o_custkey, o_orderkey::VARCHAR AS clause, CASE gap WHEN 'missing' THEN 'high' ELSE 'medium' END AS priority, CASE gap WHEN 'missing' THEN 'create_new_policy' ELSE 'update_existing_policy' END AS action FROM n WHERE i <= 10
UNION ALL SELECT o_custkey, 'SYSTEM-001', 'medium', 'system_upgrade' FROM i UNION ALL SELECT o_custkey, 'ORG-001', 'high', 'compliance_training' FROM i WHERE round(score::DOUBLE, 9) >= 70)
SELECT o_custkey, clause, priority, action FROM r
""")
def c_reg_recs(spark: SparkSession, sf: str) -> DataFrame:
    """What to do: a policy for the first ten missing and partial duties each, systems, and training where the impact is high."""
    n = _gaps(spark, sf).where("gap <> 'covered'").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey", "gap").orderBy("o_orderkey"))).where("i <= 10")
    missing = F.col("gap") == "missing"
    one = n.select("o_custkey", F.col("o_orderkey").cast("string").alias("clause"), F.when(missing, "high").otherwise("medium").alias("priority"), F.when(missing, "create_new_policy").otherwise("update_existing_policy").alias("action"))
    i = _impact(spark, sf)
    two = i.select("o_custkey", F.lit("SYSTEM-001").alias("clause"), F.lit("medium").alias("priority"), F.lit("system_upgrade").alias("action"))
    three = i.where(F.round("score", 9) >= 70).select("o_custkey", F.lit("ORG-001").alias("clause"), F.lit("high").alias("priority"), F.lit("compliance_training").alias("action"))
    return one.unionAll(two).unionAll(three)


CHANGES = ["new rules on personal data and privacy", "value added tax rate lowered", "trade sanctions on steel", "nothing"]
PROGRAMS = [("P1", "data", "check consent for personal data"), ("P2", "tax", "test the value added tax rate"), ("P3", "trade", "screen partners for sanctions"), ("P4", "data", "privacy notices")]
DOMAINS = {"data": ["personal data", "privacy"], "tax": ["tax"], "trade": ["sanctions"]}


@query(f"""
WITH c AS (SELECT p_partkey, {choice('p_partkey', CHANGES)[1]} AS t FROM part), m AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{p}', {difflib.SequenceMatcher(None, t, d).ratio()!r})" for t in CHANGES for p, k, d in PROGRAMS if any(w in t for w in DOMAINS[k]))}) AS x(t, program, r))
SELECT p_partkey, program, round(r, 6) AS similarity, CASE WHEN r > 0.3 THEN 'high' WHEN r > 0.15 THEN 'medium' ELSE 'low' END AS level FROM c JOIN m USING (t)
""")
def c_prog_change(spark: SparkSession, sf: str) -> DataFrame:
    """The programs that a change of rules bears on, by the domains its words name, and how much by likeness. Each different change is
    compared once."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", CHANGES)[0]).alias("t"))
    programs = spark.createDataFrame(PROGRAMS, "program string, domain string, d string")
    named = F.array_compact(F.array(*[F.when(F.col("t").rlike("|".join(some)), F.lit(k)) for k, some in DOMAINS.items()]))
    own = rows.select("t").distinct().select("t", F.explode(named).alias("domain")).join(F.broadcast(programs), "domain").withColumn("r", ratio(F.lower("t"), F.lower("d")))
    level = F.when(F.col("r") > 0.3, "high").when(F.col("r") > 0.15, "medium").otherwise("low")
    return rows.join(own, "t").select("p_partkey", "program", F.round("r", 6).alias("similarity"), level.alias("level"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of changes to programs, one a customer, numbered."""
    o = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return audits.versions(o.select(F.col("o_custkey").alias("program"), "n", F.expr(choice("o_orderkey", ["patch", "minor", "patch", "patch", "major"])[0]).alias("kind")), "program", "n", "kind")


LOG_SQL = """
l AS (SELECT o_custkey AS program, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (['patch', 'minor', 'patch', 'patch', 'major'])[o_orderkey % 5 + 1] AS kind FROM orders),
v AS (SELECT program, 0::BIGINT AS n, '' AS kind, 1 AS a, 0 AS b, 0 AS c, '' AS old FROM (SELECT DISTINCT program FROM l) UNION ALL SELECT l.program, l.n, l.kind, v.a + CASE l.kind WHEN 'major' THEN 1 ELSE 0 END, CASE l.kind WHEN 'major' THEN 0 WHEN 'minor' THEN v.b + 1 ELSE v.b END, CASE l.kind WHEN 'patch' THEN v.c + 1 ELSE 0 END, v.a || '.' || v.b || '.' || v.c FROM v JOIN l ON l.program = v.program AND l.n = v.n + 1),
h AS (SELECT program, n, kind, old AS old_version, a || '.' || b || '.' || c AS new_version FROM v WHERE n > 0)"""


@query(f"WITH RECURSIVE {LOG_SQL} SELECT program, n, kind, old_version, new_version FROM h")
def c_prog_update(spark: SparkSession, sf: str) -> DataFrame:
    """The log of each program's changes, with the version before and after."""
    return _log(spark, sf).select("program", F.col("n").cast("long").alias("n"), "kind", "old_version", "new_version")


@query(f"""
WITH RECURSIVE {LOG_SQL}, t AS (SELECT DISTINCT program, (['1.0.0', '1.0.2', '1.1.0', '2.0.0', '9.9.9'])[program % 5 + 1] AS target FROM h), f AS (SELECT h.program, target, min(n - 1) FILTER (old_version = target) AS o, min(n) FILTER (new_version = target) AS w, arg_max(new_version, n) AS now, count(*) AS k FROM h JOIN t ON t.program = h.program GROUP BY ALL), c AS (SELECT *, CASE WHEN o IS NOT NULL AND (w IS NULL OR o < w) THEN o ELSE w END AS cut FROM f)
SELECT program, CASE WHEN cut IS NULL THEN now ELSE target END AS version, CASE WHEN cut IS NULL THEN k ELSE cut END::BIGINT AS remaining, CASE WHEN cut IS NULL THEN 'unknown_version' ELSE 'success' END AS status FROM c
""")
def c_prog_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Programs taken back to a version: the log is cut there; a version that the log does not know changes nothing."""
    log = _log(spark, sf)
    target = log.select("program").distinct().withColumn("target", F.expr(choice("program", ["1.0.0", "1.0.2", "1.1.0", "2.0.0", "9.9.9"])[0]))
    return audits.rolled_back(log, "program", "n", target)


@query("""
WITH c AS (SELECT c_custkey, (['data is shared with third parties and kept for years', 'we collect personal data and you may delete it', 'we never collect anything, trust us', ''])[c_custkey % 4 + 1] AS t FROM customer),
h AS (SELECT c_custkey, least((contains(t, 'collect')::INT + contains(t, 'personal data')::INT + contains(t, 'shared')::INT + contains(t, 'third')::INT) / 2.0, 1) * 100 AS full_, 100.0 * (contains(t, 'delete')::INT + contains(t, 'years')::INT + contains(t, 'trust')::INT) / 3 AS sub, contains(t, 'never') AS misleading FROM c)
SELECT c_custkey, round(CASE WHEN full_ = 0 THEN 0 ELSE greatest(0, 0.5 * full_ + 0.5 * sub - CASE WHEN misleading THEN 15 ELSE 0 END) END::DOUBLE, 4) AS score, round(sub::DOUBLE, 4) AS coverage FROM h
""")
def c_policy_category(spark: SparkSession, sf: str) -> DataFrame:
    """How a policy covers a category: its words (half of them are enough) and sub-topics, half each, 15 less if misleading."""
    t = F.expr(choice("c_custkey", ["data is shared with third parties and kept for years", "we collect personal data and you may delete it", "we never collect anything, trust us", ""])[0])
    hits = lambda some: sum((t.contains(w).cast("int") for w in some[1:]), t.contains(some[0]).cast("int"))
    full, sub = F.least(hits(["collect", "personal data", "shared", "third"]) / 2.0, F.lit(1.0)) * 100, hits(["delete", "years", "trust"]) / 3.0 * 100
    score = F.when(full == 0, 0.0).otherwise(F.greatest(F.lit(0.0), full * 0.5 + sub * 0.5 - F.when(t.contains("never"), 15).otherwise(0)))
    return table(spark, sf, "customer").select("c_custkey", F.round(score, 4).alias("score"), F.round(sub, 4).alias("coverage"))


@query("""
WITH f AS (SELECT o_custkey AS asset, (o_orderkey % 5)::INT AS level, (o_orderkey * 7 % 100) / 100.0 AS confidence, (['pii', 'finance', 'none'])[o_orderkey % 3 + 1] AS kind FROM orders), h AS (SELECT asset, level, max(confidence) AS top FROM f GROUP BY ALL), b AS (SELECT asset, max(level) AS level, arg_max(top, level) AS top FROM h GROUP BY 1), a AS (SELECT asset, avg(confidence) AS mean, array_to_string(list_sort(list_distinct(list(kind) FILTER (kind <> 'none'))), ',') AS kinds FROM f GROUP BY 1)
SELECT asset, 'L' || level::VARCHAR AS level, round(greatest(mean, top)::DOUBLE, 6) AS score, coalesce(kinds, '') AS kinds FROM a JOIN b USING (asset)
""")
def c_asset_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The level of an asset by its most sensitive field, its score (the mean, or that field's if larger) and the kinds of data in it."""
    k = F.col("o_orderkey")
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("asset"), (k % 5).alias("level"), ((k * 7 % 100) / 100.0).alias("confidence"), F.expr(choice("o_orderkey", ["pii", "finance", None])[0]).alias("kind"))
    a = f.groupBy("asset").agg(F.max(F.struct("level", "confidence")).alias("x"), F.avg("confidence").alias("mean"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return a.select("asset", F.concat(F.lit("L"), F.col("x.level").cast("string")).alias("level"), F.round(F.greatest("mean", "x.confidence"), 6).alias("score"), F.concat_ws(",", "kinds").alias("kinds"))


STANDARDS = [("D1", "revenue", ["revenue", "contract"], "high"), ("D2", "leases", ["lease", "rent"], "medium"), ("D3", "inventory", ["inventory", "stock"], "low")]
TEXTS = ["revenue from contracts with clients", "rent of a lease and stock", "goodwill"]
STD = ", ".join(f"('{t}', '{i}', {sum(w in t for w in some)}, {difflib.SequenceMatcher(None, t, area).ratio()!r}, '{level}')" for t in TEXTS for i, area, some, level in STANDARDS)


@query(f"WITH t AS (SELECT p_partkey, {choice('p_partkey', TEXTS)[1]} AS t FROM part), m AS (SELECT * FROM (VALUES {STD}) AS x(t, difference, hits, r, level)) SELECT p_partkey, difference, hits::INT AS hits, round((hits + 5 * r)::DOUBLE, 6) AS score FROM t JOIN m USING (t) WHERE hits + 5 * r >= 1 OR hits > 0")
def c_std_match(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between standards that a text bears on: its words, and five times its likeness to the area. Each different text is
    compared once."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", TEXTS)[0]).alias("t"))
    known = spark.createDataFrame(STANDARDS, "difference string, area string, words array<string>, level string")
    own = rows.select("t").distinct().crossJoin(F.broadcast(known)).withColumn("hits", F.size(F.filter("words", lambda w: F.col("t").contains(w)))).withColumn("score", F.col("hits") + 5 * ratio("t", "area"))
    return rows.join(own.where("score >= 1 or hits > 0"), "t").select("p_partkey", "difference", "hits", F.round("score", 6).alias("score"))


@query("""
WITH b AS (SELECT c_custkey, (['high', 'medium', 'low', 'other'])[c_custkey % 4 + 1] AS level, abs(c_acctbal) + c_custkey % 1000 AS total, abs(c_acctbal) AS assets, (c_custkey % 1000)::DOUBLE AS debts FROM customer), e AS (SELECT c_custkey, total * CASE level WHEN 'high' THEN 0.12 WHEN 'medium' THEN 0.06 WHEN 'low' THEN 0.03 ELSE 0.05 END AS estimate FROM b)
SELECT c_custkey, unnest(['assets', 'debts']) AS account, unnest(['debit', 'credit']) AS side, round((estimate / 2)::DOUBLE, 7) AS amount FROM e
""")
def c_std_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """The entry that a difference asks for: a share of the balances by its level, split evenly, assets debited and debts credited."""
    k = F.col("c_custkey")
    share = F.when(k % 4 == 0, 0.12).when(k % 4 == 1, 0.06).when(k % 4 == 2, 0.03).otherwise(0.05)
    e = table(spark, sf, "customer").select(k, ((F.abs("c_acctbal") + k % 1000) * share / 2).alias("amount"))
    sides = F.explode(F.array(F.struct(F.lit("assets").alias("account"), F.lit("debit").alias("side")), F.struct(F.lit("debts").alias("account"), F.lit("credit").alias("side"))))
    return e.select(k, "amount", sides.alias("x")).select(k, "x.account", "x.side", F.round("amount", 7).alias("amount"))


@query("""
WITH s AS (SELECT s_suppkey, s_name, (['high', 'medium', 'low'])[s_suppkey % 3 + 1] AS risk FROM supplier)
SELECT s_suppkey, risk, CASE risk WHEN 'high' THEN 'Full audit of ' || s_name || ' until 2024-12-31' WHEN 'medium' THEN 'Review of ' || s_name || ' until 2024-12-31' ELSE 'Letter to ' || s_name || ' until 2024-12-31' END AS text, CASE risk WHEN 'high' THEN 'cash,related,tax' WHEN 'medium' THEN 'related,tax' ELSE 'tax' END AS programs FROM s
""")
def c_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Audit orders for each company: the template of its risk filled in, and the programs from that risk on."""
    s = table(spark, sf, "supplier").withColumn("risk", F.expr(choice("s_suppkey", ["high", "medium", "low"])[0])).withColumn("deadline", F.lit("2024-12-31"))
    text = F.when(F.col("risk") == "high", "Full audit of ${name} until ${deadline}").when(F.col("risk") == "medium", "Review of ${name} until ${deadline}").otherwise("Letter to ${name} until ${deadline}")
    order = {"low": 0, "medium": 1, "high": 2}
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    programs = F.array_compact(F.array(*[F.when(rank >= order[least], F.lit(n)) for n, least in (("cash", "high"), ("related", "medium"), ("tax", "low"))]))
    done = F.replace(F.replace(text, F.lit("${name}"), F.col("s_name")), F.lit("${deadline}"), F.col("deadline"))
    return s.select("s_suppkey", "risk", done.alias("text"), F.concat_ws(",", programs).alias("programs"))


METHODS = [("M1", 90, 0.9, "high", ["high", "medium"], "fraud"), ("M2", 70, 0.8, "low", ["low"], "tax"), ("M3", 80, 0.6, "medium", ["high", "medium", "low"], "cash")]


@query("""
WITH s AS (SELECT c_custkey, (['fraud', 'tax', 'cash', 'other'])[c_custkey % 4 + 1] AS scenario, (['high', 'medium', 'low'])[c_custkey % 3 + 1] AS risk, (['low', 'medium', 'high'])[c_custkey % 5 % 3 + 1] AS resource FROM customer), m AS (SELECT * FROM (VALUES ('M1', 90, 0.9, 'high', ['high', 'medium'], 'fraud'), ('M2', 70, 0.8, 'low', ['low'], 'tax'), ('M3', 80, 0.6, 'medium', ['high', 'medium', 'low'], 'cash')) AS t(method, base, maturity, need, risks, fits)),
x AS (SELECT c_custkey, method, 0.40 * CASE WHEN scenario = fits THEN 0.7 ELSE 0 END + 0.25 * base / 100.0 * maturity + 0.15 * maturity + 0.10 * CASE resource WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.4 END * CASE WHEN need = 'high' THEN 0.8 ELSE 1 END + 0.10 * CASE WHEN list_contains(risks, risk) THEN 1.0 ELSE 0.5 END AS score FROM s, m)
SELECT c_custkey, method, round(score::DOUBLE, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(score::DOUBLE, 9) DESC, method) AS rank FROM x) WHERE rank <= 2
""")
def c_method_rec(spark: SparkSession, sf: str) -> DataFrame:
    """The two methods that suit a case best: scenario .40, effect .25, maturity .15, resources .10, risk .10. Methods are a few rows,
    scored in the case's own row."""
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(k, F.expr(choice("c_custkey", ["fraud", "tax", "cash", "other"])[0]).alias("scenario"), F.expr(choice("c_custkey", ["high", "medium", "low"])[0]).alias("risk"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 5 % 3 + 1).cast("int")).alias("resource"))
    have = F.when(F.col("resource") == "low", 0.9).when(F.col("resource") == "medium", 0.7).otherwise(0.4)

    def score(base, maturity, need, risks, fits):
        return F.when(F.col("scenario") == fits, 0.7).otherwise(0.0) * 0.40 + base / 100 * maturity * 0.25 + maturity * 0.15 + have * (0.8 if need == "high" else 1.0) * 0.10 + F.when(F.col("risk").isin(*risks), 1.0).otherwise(0.5) * 0.10

    options = F.array(*[F.struct((-F.round(score(*rest), 9)).alias("neg"), F.lit(m).alias("method")) for m, *rest in METHODS])
    best = s.select(k, F.posexplode(F.slice(F.array_sort(options), 1, 2)).alias("at", "x"))
    return best.select(k, "x.method", F.round(-F.col("x.neg"), 6).alias("score"), (F.col("at") + 1).alias("rank"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS rules, p_partkey % 3 AS alerts, p_partkey % 4 AS sources, p_partkey % 2 = 0 AS flow, p_partkey % 3 = 1 AS monitor, p_partkey % 7 = 2 AS ml, p_partkey % 6 = 0 AS legal FROM part),
d AS (SELECT p_partkey, 100.0 * ((rules >= 2)::INT + (alerts > 0)::INT + (sources >= 2)::INT) / 3 AS completeness, CASE WHEN monitor OR ml THEN 100.0 ELSE 60.0 END AS consistency, least(50 + 20 * monitor::INT + 15 * ml::INT + 15 * flow::INT, 100) AS feasibility, CASE WHEN monitor OR ml THEN least(rules * 15 + alerts * 8, 100) ELSE greatest(least(rules * 15 + alerts * 8, 100) - 20, 20) END AS effectiveness, 60 + 20 * legal::INT AS compliance FROM p), t AS (SELECT *, 0.2 * (completeness + consistency + feasibility + effectiveness + compliance) AS total FROM d)
SELECT p_partkey, round(total::DOUBLE, 4) AS total, CASE WHEN round(total::DOUBLE, 9) >= 85 THEN 'excellent' WHEN round(total::DOUBLE, 9) >= 70 THEN 'good' WHEN round(total::DOUBLE, 9) >= 60 THEN 'fair' ELSE 'poor' END AS grade FROM t
""")
def c_prog_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A program by completeness, consistency, feasibility, effect and compliance."""
    k = F.col("p_partkey")
    n = lambda test: test.cast("int")
    monitor, ml = k % 3 == 1, k % 7 == 2
    effect = F.least((k % 5) * 15 + (k % 3) * 8, F.lit(100))
    dims = [
        (n(k % 5 >= 2) + n(k % 3 > 0) + n(k % 4 >= 2)) / 3 * 100, F.when(monitor | ml, 100.0).otherwise(60.0), F.least(50 + 20 * n(monitor) + 15 * n(ml) + 15 * n(k % 2 == 0), F.lit(100)),
        F.when(monitor | ml, effect).otherwise(F.greatest(effect - 20, F.lit(20))), 60 + 20 * n(k % 6 == 0),
    ]
    t = table(spark, sf, "part").select("p_partkey", stats.fused([(0.2, d) for d in dims]).alias("t"))
    return t.select("p_partkey", F.round("t", 4).alias("total"), rules.bands(F.round("t", 9), [(85, "excellent"), (70, "good"), (60, "fair")], "poor").alias("grade"))


@query("SELECT p_partkey, ((p_size - p_size % 7) * 12)::BIGINT AS saved_days, round(((p_size - p_size % 7) * 12 * 1.5 * 800)::DOUBLE, 2) AS saved_cost, round((100.0 * (p_size - p_size % 7) / greatest(p_size, 1))::DOUBLE, 4) AS saving_percent FROM part")
def c_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    """Days and money that continuous work saves in a year against the traditional way."""
    old, new = F.col("p_size"), F.col("p_size") % 7
    days = ((old - new) * 12).cast("long")
    return table(spark, sf, "part").select("p_partkey", days.alias("saved_days"), F.round(days * 1.5 * 800, 2).alias("saved_cost"), F.round((old - new) / F.greatest(old, F.lit(1)) * 100, 4).alias("saving_percent"))


SERIES_SQL = f"{INDEX_SQL}, n AS (SELECT *, row_number() OVER w AS i, lag(ndvi) OVER w AS a, lag(ndwi) OVER w AS b_, lag(nbr) OVER w AS c FROM i WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""
WITH {SERIES_SQL}, d AS (SELECT user_id, event_id, unnest(['ndvi', 'ndwi', 'nbr']) AS index, unnest([ndvi - a, ndwi - b_, nbr - c]) AS delta FROM n)
SELECT user_id, event_id, index, round(delta, 6) AS delta, CASE index WHEN 'ndvi' THEN CASE WHEN delta <= -0.15 THEN 'deforestation' WHEN delta <= -0.08 THEN 'degradation' WHEN delta >= 0.08 THEN 'recovery' WHEN delta < 0 THEN 'down' ELSE 'up' END WHEN 'ndwi' THEN CASE WHEN delta <= -0.15 THEN 'drought' WHEN delta <= -0.10 THEN 'pollution_drop' WHEN delta < 0 THEN 'down' ELSE 'up' END ELSE CASE WHEN delta <= -0.20 THEN 'fire' WHEN delta <= -0.10 THEN 'partial_burn' WHEN delta < 0 THEN 'down' ELSE 'up' END END AS label FROM d WHERE abs(delta) > 0.02
""")
def win_prev_slice(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in a region's indices since the slice before, and what such a change is called."""
    got = audits.slice_changes(slices(spark, sf), ["user_id"], ["ts", "event_id"])
    return got.select("user_id", "event_id", "index", F.round("delta", 6).alias("delta"), "label")


@query(f"""
WITH {SERIES_SQL}, e AS (SELECT user_id, first(ndvi ORDER BY i) AS v0, last(ndvi ORDER BY i) AS v1, first(ndwi ORDER BY i) AS w0, last(ndwi ORDER BY i) AS w1 FROM n GROUP BY 1), c AS (SELECT *, user_id % 2 = 0 AS greening, user_id % 3 = 0 AS carbon, user_id % 5 = 0 AS water FROM e),
s AS (SELECT user_id, (greening AND v1 - v0 > 0.05)::INT + 0.5 * (carbon AND v1 - v0 >= 0)::INT + (water AND w1 - w0 >= -0.05)::INT AS good, (greening AND NOT v1 - v0 > 0.05)::INT + 0.5 * (carbon AND NOT v1 - v0 >= 0)::INT + (water AND NOT w1 - w0 >= -0.05)::INT AS bad FROM c)
SELECT user_id, round(coalesce(good / nullif(good + bad, 0), 0.5)::DOUBLE, 6) AS score, CASE WHEN good + bad = 0 THEN 'no_claim_match' WHEN good / (good + bad) < 0.4 THEN 'contradiction' WHEN good / (good + bad) < 0.7 THEN 'weak_support' ELSE 'supported' END AS signal FROM s
""")
def c_greenwash(spark: SparkSession, sf: str) -> DataFrame:
    """Green claims of each region against what its indices did from the first slice to the last."""
    s = slices(spark, sf).groupBy("user_id").agg(F.min_by(F.struct("ndvi", "ndwi"), F.struct("ts", "event_id")).alias("a"), F.max_by(F.struct("ndvi", "ndwi"), F.struct("ts", "event_id")).alias("b"))
    k = F.col("user_id")
    got = audits.greenwash(F.col("a"), F.col("b"), {"greening": k % 2 == 0, "carbon": k % 3 == 0, "water": k % 5 == 0})
    return s.select("user_id", got.alias("x")).select("user_id", F.round("x.score", 6).alias("score"), "x.signal")


@query(f"WITH {SERIES_SQL} SELECT user_id, round(regr_slope(ndvi, i), 8) AS slope, coalesce(regr_slope(ndvi, i) < -0.02, false) AS declining, min(nbr) < 0.3 AS burnt, min(ndwi) < -0.1 AND max(ndwi) > 0.3 AS water_swings FROM n GROUP BY 1 HAVING count(*) >= 3")
def c_env_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    """Regions whose vegetation declines, that burnt, or whose water swings."""
    s = slices(spark, sf)
    line = series.slope(s, ["user_id"], ["ts", "event_id"], "ndvi")
    ends = s.groupBy("user_id").agg(F.min("nbr").alias("nbr"), F.min("ndwi").alias("low"), F.max("ndwi").alias("high"))
    return line.where("n >= 3").join(ends, "user_id").select("user_id", F.round("slope", 8).alias("slope"), F.coalesce(F.col("slope") < -0.02, F.lit(False)).alias("declining"), (F.col("nbr") < 0.3).alias("burnt"), ((F.col("low") < -0.1) & (F.col("high") > 0.3)).alias("water_swings"))


CRED_SQL = """
c AS (SELECT o_orderkey, o_custkey, least(1, (o_orderkey % 4) * 0.4) AS quant, (o_orderkey % 6) / 5.0 AS verifiable, (o_orderkey % 3) / 2.0 AS channel, (o_orderkey % 5) / 10.0 AS fuzzy, o_orderkey % 3 AS sup, (o_orderkey // 3) % 3 AS con FROM orders),
e AS (SELECT *, CASE WHEN sup + con = 0 THEN 0.4 ELSE greatest(0, (sup - con)::DOUBLE / (sup + con)) END AS factor FROM c), r AS (SELECT o_orderkey, o_custkey, factor, least(1, greatest(0, 0.35 * quant + 0.25 * verifiable + 0.20 * factor + 0.10 * channel + 0.10 * (1 - fuzzy))) AS credibility FROM e)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with their credibility: figures .35, checkability .25, evidence .20, channels .10, plain words .10."""
    k = F.col("o_orderkey")
    sup, con = k % 3, F.expr("o_orderkey div 3") % 3
    factor = F.when(sup + con == 0, 0.4).otherwise(F.greatest(F.lit(0.0), F.try_divide((sup - con).cast("double"), (sup + con).cast("double"))))
    parts = [(0.35, F.least(F.lit(1.0), (k % 4) * 0.4)), (0.25, (k % 6) / 5.0), (0.20, factor), (0.10, (k % 3) / 2.0), (0.10, 1 - (k % 5) / 10.0)]
    return table(spark, sf, "orders").select(k, "o_custkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), stats.fused(parts))).alias("credibility"))


@query(f"WITH {CRED_SQL} SELECT o_orderkey, round(credibility::DOUBLE, 6) AS credibility, CASE WHEN round((1 - credibility)::DOUBLE, 9) > 0.6 THEN 'high' WHEN round((1 - credibility)::DOUBLE, 9) > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM r")
def ml_claim_cred(spark: SparkSession, sf: str) -> DataFrame:
    """How credible a claim is, and the risk that is left."""
    risk = F.round(1 - F.col("credibility"), 9)
    return _claims(spark, sf).select("o_orderkey", F.round("credibility", 6).alias("credibility"), F.when(risk > 0.6, "high").when(risk > 0.3, "medium").otherwise("low").alias("risk"))


@query(f"""
WITH {CRED_SQL}, x AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 5 = 0) AS contradictions, count(*) FILTER (o_orderkey % 7 = 0) AS conflicts, avg(1 - credibility) AS mean, max(1 - credibility) AS top FROM r GROUP BY 1), s AS (SELECT o_custkey, least(1, mean + 0.3 * top + least(0.3, contradictions * 0.06) + least(0.2, conflicts * 0.05)) AS score FROM x)
SELECT o_custkey, round(score::DOUBLE, 6) AS score, CASE WHEN round(score::DOUBLE, 9) > 0.7 THEN 'high' WHEN round(score::DOUBLE, 9) > 0.45 THEN 'medium' WHEN round(score::DOUBLE, 9) > 0.25 THEN 'low' ELSE 'very low' END AS level FROM s
""")
def c_claim_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The risk of a company's claims: their mean, .3 of the largest, and penalties for contradictions and conflicts."""
    k, risk = F.col("o_orderkey"), 1 - F.col("credibility")
    x = _claims(spark, sf).groupBy("o_custkey").agg(F.count_if(k % 5 == 0).alias("a"), F.count_if(k % 7 == 0).alias("b"), F.avg(risk).alias("mean"), F.max(risk).alias("top"))
    score = F.least(F.lit(1.0), F.col("mean") + 0.3 * F.col("top") + F.least(F.lit(0.3), F.col("a") * 0.06) + F.least(F.lit(0.2), F.col("b") * 0.05))
    s = F.round(score, 9)
    return x.select("o_custkey", F.round(score, 6).alias("score"), F.when(s > 0.7, "high").when(s > 0.45, "medium").when(s > 0.25, "low").otherwise("very low").alias("level"))


TASK_SQL = """
h AS (SELECT event_type, user_id % 4 + 1 AS severity, avg((event_id % 3 = 0)::INT) AS rate FROM events WHERE event_id % 5 <> 0 AND user_id % 4 <> 3 GROUP BY ALL),
t AS (SELECT event_id, event_type, (user_id % 4 + 1)::INT AS severity, (event_id % 10) / 10.0 AS complexity, (event_id % 7) / 7.0 AS cross_, (event_id % 90)::DOUBLE AS passed, 30.0 + event_id % 60 AS planned FROM events WHERE event_id % 5 = 0),
r AS (SELECT t.*, planned - passed AS remaining, coalesce(rate, 0.5) AS rate FROM t LEFT JOIN h USING (event_type, severity)), k AS (SELECT *, least(1, CASE severity WHEN 1 THEN 0.05 WHEN 2 THEN 0.10 WHEN 3 THEN 0.18 ELSE 0.28 END + complexity * 0.25 + cross_ * 0.15 + CASE WHEN remaining < 0 THEN least(0.30, abs(remaining) / 100) WHEN passed / greatest(planned, 1) > 0.7 AND remaining > 0 THEN 0.05 ELSE 0 END + rate * 0.17) AS risk FROM r)"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Remediation tasks with their risk of failing, history included."""
    e = table(spark, sf, "events").withColumn("severity", (F.col("user_id") % 4 + 1).cast("int"))
    k = F.col("event_id")
    past = e.where("event_id % 5 <> 0 and severity <> 4").groupBy("event_type", "severity").agg(F.avg((k % 3 == 0).cast("int")).alias("rate"))
    t = e.where("event_id % 5 = 0").select(k, "event_type", "severity", ((k % 10) / 10.0).alias("complexity"), ((k % 7) / 7.0).alias("cross"), (k % 90).cast("double").alias("passed"), (30.0 + k % 60).alias("planned"))
    met = t.join(past, ["event_type", "severity"], "left").withColumn("remaining", F.col("planned") - F.col("passed")).withColumn("rate", F.coalesce("rate", F.lit(0.5)))
    return met.withColumn("risk", audits.failure_risk(*[F.col(c) for c in ("severity", "complexity", "cross", "passed", "remaining", "planned", "rate")]))


@query(f"WITH {TASK_SQL} SELECT event_id, round(risk::DOUBLE, 6) AS risk, CASE WHEN round(risk::DOUBLE, 9) > 0.6 THEN 'high' WHEN round(risk::DOUBLE, 9) > 0.3 THEN 'medium' ELSE 'low' END AS level FROM k")
def ml_failure_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The risk that a remediation fails, with the rate at which its kind did before."""
    risk = F.round("risk", 9)
    return _tasks(spark, sf).select("event_id", F.round("risk", 6).alias("risk"), F.when(risk > 0.6, "high").when(risk > 0.3, "medium").otherwise("low").alias("level"))


@query(f"WITH {TASK_SQL} SELECT event_id, round((least(1, passed / greatest(planned, 1)) * CASE WHEN round(risk::DOUBLE, 9) > 0.6 THEN 0.7 WHEN round(risk::DOUBLE, 9) > 0.3 THEN 0.88 ELSE 1 END)::DOUBLE, 6) AS progress FROM k")
def c_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far a remediation is: elapsed over planned time, damped by its risk."""
    return _tasks(spark, sf).select("event_id", F.round(audits.progress(F.col("passed"), F.col("planned"), F.round("risk", 9)), 6).alias("progress"))


@query("""
SELECT s_suppkey, 'Method for ' || s_name || ' (' || (['energy', 'water', 'staff'])[s_suppkey % 3 + 1] || ') in 2024' AS title, (['meters,bills', 'meters', 'payroll,contracts'])[s_suppkey % 3 + 1] AS evidence, (s_suppkey % 3 + 2 + CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END)::INT AS procedures, s_suppkey % 3 * 2 + 6 AS weeks FROM supplier
""")
def c_method_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A methodology for each company from the template of its subject: title, evidence, procedures (one more for large ones), weeks."""
    k = F.col("s_suppkey")
    packs = spark.createDataFrame([(0, "energy", ["meters", "bills"], 2, 6), (1, "water", ["meters"], 3, 8), (2, "staff", ["payroll", "contracts"], 4, 10)], "pack int, subject string, evidence array<string>, steps int, weeks int")
    met = table(spark, sf, "supplier").withColumn("pack", (k % 3).cast("int")).join(F.broadcast(packs), "pack")
    return met.select(k, F.format_string("Method for %s (%s) in 2024", "s_name", "subject").alias("title"), F.concat_ws(",", "evidence").alias("evidence"), (F.col("steps") + F.when(F.col("s_acctbal") > 5000, 1).otherwise(0)).alias("procedures"), F.col("weeks").cast("long").alias("weeks"))


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, unnest(['person', 'company', 'amount', 'date']) AS kind, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 5) END, CASE WHEN o_orderkey % 4 < 3 THEN 'c' || (o_orderkey % 3) END, CASE WHEN o_totalprice > 200000 THEN 'a' || o_orderkey END, CASE WHEN o_orderkey % 7 > 0 THEN 'd' || (o_orderkey % 9) END]) AS v FROM orders), x AS (SELECT * FROM e WHERE v IS NOT NULL),
n AS (SELECT o_custkey, count(DISTINCT kind || v) AS nodes, bool_or(kind = 'person') AS person, bool_or(kind = 'company') AS company, bool_or(kind = 'amount') AS amount, bool_or(kind = 'date') AS date FROM x GROUP BY 1), g AS (SELECT a.o_custkey, count(DISTINCT least(a.kind || a.v, b.kind || b.v) || '|' || greatest(a.kind || a.v, b.kind || b.v)) AS edges FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey AND a.kind < b.kind GROUP BY 1), c AS (SELECT o_custkey, count(*) AS evidence FROM orders GROUP BY 1),
s AS (SELECT c.o_custkey, 100 - CASE WHEN evidence < 3 THEN 30 ELSE 0 END - CASE WHEN coalesce(person, false) THEN 0 ELSE 15 END - CASE WHEN coalesce(company, false) THEN 0 ELSE 15 END - CASE WHEN coalesce(amount, false) THEN 0 ELSE 10 END - CASE WHEN coalesce(date, false) THEN 0 ELSE 10 END - CASE WHEN coalesce(edges, 0) < coalesce(nodes, 0) - 1 THEN 15 ELSE 0 END AS score FROM c LEFT JOIN n USING (o_custkey) LEFT JOIN g USING (o_custkey))
SELECT o_custkey, score, score = 100 AS complete FROM s
""")
def c_chain_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a chain of evidence is complete: enough pieces, persons, companies, amounts and dates, and links between them. Entities of
    one piece are four at most, so their pairs are made within the piece."""
    k = F.col("o_orderkey")
    node = lambda kind, test, v: F.when(test, F.concat(F.lit(kind), F.lit(kind[0]), v.cast("string")))
    made = F.array_sort(F.array_compact(F.array(node("person", k % 3 == 0, k % 5), node("company", k % 4 < 3, k % 3), node("amount", F.col("o_totalprice") > 200_000, k), node("date", k % 7 > 0, k % 9))))
    e = table(spark, sf, "orders").select("o_custkey", made.alias("nodes"))
    count = e.groupBy("o_custkey").agg(F.count("*").alias("evidence"))
    x = e.select("o_custkey", F.explode("nodes").alias("v"))
    has = lambda kind: F.bool_or(F.col("v").startswith(kind)).alias(kind)
    n = x.groupBy("o_custkey").agg(F.countDistinct("v").alias("nodes"), has("person"), has("company"), has("amount"), has("date"))
    pairs = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.concat_ws("|", a, b))))
    g = e.select("o_custkey", F.explode(pairs).alias("p")).groupBy("o_custkey").agg(F.countDistinct("p").alias("edges"))
    met = count.join(n, "o_custkey", "left").join(g, "o_custkey", "left")
    lost = lambda test, m: F.when(F.coalesce(test, F.lit(True)), m).otherwise(0)
    score = 100 - lost(F.col("evidence") < 3, 30) - lost(~F.col("person"), 15) - lost(~F.col("company"), 15) - lost(~F.col("amount"), 10) - lost(~F.col("date"), 10) - lost(F.coalesce("edges", F.lit(0)) < F.coalesce("nodes", F.lit(0)) - 1, 15)
    return met.select("o_custkey", score.alias("score"), (score == 100).alias("complete"))


@query("""
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 100)::INT AS score, s_suppkey % 9 = 0 AS mandatory FROM supplier), q AS (SELECT *, CASE WHEN mandatory OR score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN score >= 75 THEN 4 WHEN score >= 50 THEN 3 ELSE 2 END AS weeks FROM p), t AS (SELECT *, weeks * 40 * CASE WHEN priority = 'low' THEN 1 ELSE 2 END AS hours FROM q)
SELECT s_suppkey, priority, weeks, hours, row_number() OVER (ORDER BY NOT mandatory, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, score DESC, s_suppkey) AS position, round(sum(hours) OVER () / 4800.0, 6) AS utilization FROM t
""")
def c_audit_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The year's plan: mandatory work first, then by priority and score, with hours and how far they use the staff up. Positions come
    from counts of the (few) priorities and scores, so that only rows of one of them are numbered together."""
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(k, (k * 37 % 100).cast("int").alias("score"), (k % 9 == 0).alias("mandatory"))
    priority = F.when(F.col("mandatory") | (F.col("score") >= 75), "high").when(F.col("score") >= 50, "medium").otherwise("low")
    weeks = F.when(F.col("score") >= 75, 4).when(F.col("score") >= 50, 3).otherwise(2)
    t = p.withColumns({"priority": priority, "weeks": weeks})
    t = t.withColumn("hours", F.col("weeks") * 40 * F.when(F.col("priority") == "low", 1).otherwise(2))
    t = t.withColumn("rank", F.when(F.col("mandatory"), 0).otherwise(1) * 1000 + F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2) * 200 + (100 - F.col("score")))
    counts = t.groupBy("rank").agg(F.count("*").alias("n"), F.sum("hours").alias("h"))  # some hundred rows
    first = counts.select("rank", (F.sum("n").over(Window.orderBy("rank")) - F.col("n")).alias("before"), F.sum("h").over(Window.partitionBy()).alias("total"))
    nth = F.row_number().over(Window.partitionBy("rank").orderBy("s_suppkey"))
    return t.withColumn("nth", nth).join(F.broadcast(first), "rank").select(k, "priority", "weeks", "hours", (F.col("before") + F.col("nth")).alias("position"), F.round(F.col("total") / 4800.0, 6).alias("utilization"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def c_alert_list(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred newest alerts of a severity since a day."""
    return table(spark, sf, "events").where("event_type = 'error' and ts >= timestamp'2024-01-20'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "value")


@query("""
WITH t AS (SELECT s_nationkey AS project, s_suppkey AS auditor, ['k' || (s_suppkey % 4), 'k' || (s_suppkey % 3 + 4)] AS ks, [1.0 + s_suppkey % 5, 2.0 + s_suppkey % 3] AS vs, (20 + s_suppkey % 50)::DOUBLE AS hours, (5 + s_suppkey % 10)::DOUBLE AS available, s_suppkey % 4 AS level FROM supplier),
b AS (SELECT project, k, max(v) AS v FROM (SELECT project, unnest(ks) AS k, unnest(vs) AS v FROM t) GROUP BY ALL), r AS (SELECT n_nationkey AS project, unnest(['k' || (n_nationkey % 4), 'k' || (n_nationkey % 3 + 4)]) AS k, unnest([3.0, 2.0]) AS w, n_nationkey % 2 AS min_senior FROM nation),
m AS (SELECT coalesce(b.project, r.project) AS project, coalesce(v, 0) AS v, coalesce(w, 0) AS w FROM b FULL JOIN r ON b.project = r.project AND b.k = r.k), c AS (SELECT project, coalesce(sum(v * w) / nullif(sqrt(sum(v * v)) * sqrt(sum(w * w)), 0), 0) * 100 AS skill FROM m GROUP BY 1),
l AS (SELECT project, avg(hours) AS mean, stddev_pop(hours) AS sd, count(*) FILTER (hours > 4 * available) AS over, count(*) FILTER (level >= 2) AS seniors FROM t GROUP BY 1), y AS (SELECT a.project, avg(len(list_intersect(a.ks, z.ks)) / len(list_distinct(list_concat(a.ks, z.ks)))) AS synergy FROM t a JOIN t z ON a.project = z.project AND a.auditor < z.auditor GROUP BY 1),
f AS (SELECT n_nationkey AS project, coalesce(skill, 0) AS skill, CASE WHEN mean IS NULL THEN 0 ELSE greatest(0, 100 - sd / greatest(mean, 1) * 100) END AS load_, coalesce(synergy * 100, 50) AS synergy, coalesce(over, 0) + CASE WHEN coalesce(seniors, 0) < n_nationkey % 2 THEN 1 ELSE 0 END AS violations FROM nation LEFT JOIN c ON c.project = n_nationkey LEFT JOIN l ON l.project = n_nationkey LEFT JOIN y ON y.project = n_nationkey)
SELECT project, round(skill::DOUBLE, 4) AS skill, round(load_::DOUBLE, 4) AS load, round(synergy::DOUBLE, 4) AS synergy, violations::BIGINT AS violations, round((skill * 0.35 + load_ * 0.20 + synergy * 0.10 - violations * 15)::DOUBLE, 4) AS fitness FROM f
""")
def c_fitness(spark: SparkSession, sf: str) -> DataFrame:
    """How well each team fits its project: skills, balance of hours, synergy, less violations. Cost, development and continuity, which
    need distances, goals and earlier teams, are not derived from the tables and left out."""
    k = F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("k"), n.cast("string"))
    t = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project"), k.alias("auditor"), F.create_map(name(k % 4), 1.0 + k % 5, name(k % 3 + 4), 2.0 + k % 3).alias("skills"), (20 + k % 50).cast("double").alias("hours"), (5 + k % 10).cast("double").alias("available"), (k % 4).alias("level"))
    n = F.col("n_nationkey")
    p = table(spark, sf, "nation").select(n.alias("project"), F.create_map(name(n % 4), F.lit(3.0), name(n % 3 + 4), F.lit(2.0)).alias("required"), (n % 2).alias("min_senior"))
    got = audits.team_fitness(t, p)
    return got.select("project", *[F.round(c, 4).alias(c) for c in ("skill", "load", "synergy")], F.col("violations").cast("long").alias("violations"), F.round("fitness", 4).alias("fitness"))


@query("""
WITH f AS (SELECT o_orderkey, (['slow approval', 'no access control', 'low efficiency', 'other'])[o_orderkey % 4 + 1] AS t, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 200 END AS ref FROM orders), r AS (SELECT o_orderkey, t, CASE WHEN ref = 0 THEN 80 ELSE ref END AS ref FROM f)
SELECT o_orderkey, round(CASE WHEN contains(t, 'approval') THEN ref * 1.5 ELSE ref END::DOUBLE, 1) AS cost_saving, CASE WHEN contains(t, 'approval') THEN 0.4 WHEN contains(t, 'efficiency') THEN 0.55 ELSE 0 END::DOUBLE AS efficiency, CASE WHEN contains(t, 'access') THEN 0.75 ELSE 0 END::DOUBLE AS risk_reduction FROM r
""")
def c_rec_value(spark: SparkSession, sf: str) -> DataFrame:
    """What a recommendation is worth by what the finding speaks of, from a reference value or 80."""
    k, t = F.col("o_orderkey"), F.expr(choice("o_orderkey", ["slow approval", "no access control", "low efficiency", "other"])[0])
    ref = F.when((k % 3 == 0) | (k % 200 == 0), 80.0).otherwise((k % 200).cast("double"))
    saving = F.when(t.contains("approval"), ref * 1.5).otherwise(ref)
    return table(spark, sf, "orders").select(k, F.round(saving, 1).alias("cost_saving"), F.when(t.contains("approval"), 0.4).when(t.contains("efficiency"), 0.55).otherwise(0.0).alias("efficiency"), F.when(t.contains("access"), 0.75).otherwise(0.0).alias("risk_reduction"))


@query("""
WITH m AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, avg(value) FILTER (event_type = 'view') AS rate, avg(value) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT user_id, (0.5 * (done > 5)::INT + 0.3 * coalesce((rate >= 45)::INT, 0) + 0.2 * coalesce((errors <= 50)::INT, 0)) / 1.0 AS score, (1 + (rate IS NOT NULL)::INT + (errors IS NOT NULL)::INT) / 3.0 AS cover, n FROM m)
SELECT user_id, round(score::DOUBLE, 6) AS score, CASE WHEN round(score::DOUBLE, 9) >= 0.8 THEN 'pass' WHEN round(score::DOUBLE, 9) >= 0.6 THEN 'conditional' ELSE 'fail' END AS verdict, round((0.4 * cover + 0.3 * least(1, n / 50.0) + 0.3 * abs(score - 0.5) * 2)::DOUBLE, 6) AS confidence FROM s
""")
def c_verify_score(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted share of checks a remediation passes, the verdict, and how sure it is by data, sample and agreement."""
    v = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    m = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), v("view").alias("rate"), v("error").alias("errors"), F.count("*").alias("n"))
    checks = [("done", 0.5, F.col("done") > 5, F.lit(True)), ("rate", 0.3, F.col("rate") >= 45, F.col("rate").isNotNull()), ("errors", 0.2, F.col("errors") <= 50, F.col("errors").isNotNull())]
    got = audits.verified(m, ["user_id"], checks)
    sure = 0.4 * F.col("coverage") + 0.3 * F.least(F.lit(1.0), F.col("n") / 50.0) + 0.3 * F.abs(F.col("score") - 0.5) * 2
    return got.select("user_id", F.round("score", 6).alias("score"), "verdict", F.round(sure, 6).alias("confidence"))


ACCEL = "SELECT o_orderkey, o_custkey, least(0.95, rpa + ml * (1 - rpa)) AS ratio, hours FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 10) / 10.0 AS rpa, (o_orderkey % 7) / 10.0 AS ml, (o_orderkey % 40)::DOUBLE AS hours FROM orders)"


@query(f"WITH a AS ({ACCEL}) SELECT o_custkey, count(*) FILTER (ratio < 0.5) AS bottlenecks, count(*) FILTER (ratio >= 0.85) AS automatic, round(sum(hours * ratio)::DOUBLE, 4) AS saved, round(coalesce(sum(hours * ratio) / nullif(sum(hours), 0), 0)::DOUBLE, 8) AS overall FROM a GROUP BY 1")
def c_accel(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that automation and models save in each project, tasks that run alone, and bottlenecks."""
    k = F.col("o_orderkey")
    a = table(spark, sf, "orders").select("o_custkey", F.round(audits.acceleration((k % 10) / 10.0, (k % 7) / 10.0), 12).alias("ratio"), (k % 40).cast("double").alias("hours"))
    saved = F.sum(F.col("hours") * F.col("ratio"))
    return a.groupBy("o_custkey").agg(F.count_if(F.col("ratio") < 0.5).alias("bottlenecks"), F.count_if(F.col("ratio") >= 0.85).alias("automatic"), F.round(saved, 4).alias("saved"), F.round(F.coalesce(F.try_divide(saved, F.sum("hours")), F.lit(0.0)), 8).alias("overall"))


@query("""
WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS automated FROM orders GROUP BY 1), f AS (SELECT o_custkey, arg_max(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS paid_in FROM orders GROUP BY 1)
SELECT t.o_custkey, automated, abs(paid_in - CASE WHEN t.o_custkey % 2 = 0 THEN paid_in ELSE c_acctbal END) > 0.01 AS finding FROM t JOIN f USING (o_custkey) JOIN customer ON c_custkey = t.o_custkey
""")
def c_rpa_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks that robots do for each company, and whether its registered capital differs from what it last paid in."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("automated"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("paid"))
    met = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    capital = F.when(F.col("o_custkey") % 2 == 0, F.col("paid")).otherwise(F.col("c_acctbal"))
    return met.select("o_custkey", "automated", (F.abs(F.col("paid") - capital) > 0.01).alias("finding"))


@query("""
WITH a AS (SELECT user_id, stddev_pop(value) AS sd, avg(value) AS m, count(*) AS n FROM events GROUP BY 1), z AS (SELECT user_id, bool_or(n >= 4 AND abs(value - m) > 1.7 * sd) AS outlier FROM events JOIN a USING (user_id) GROUP BY 1), d AS (SELECT user_id, sum(power(coalesce(k, 0) / n - e, 2) / e) AS dev FROM (SELECT user_id, count(*)::DOUBLE AS n FROM events WHERE value >= 1 GROUP BY 1) CROSS JOIN (VALUES """ + ", ".join(f"({d}, {__import__('math').log10(1 + 1 / d)!r})" for d in range(1, 10)) + """) AS b(d, e) LEFT JOIN (SELECT user_id, substr(floor(value)::BIGINT::VARCHAR, 1, 1)::INT AS d, count(*) AS k FROM events WHERE value >= 1 GROUP BY ALL) c USING (user_id, d) GROUP BY 1)
SELECT user_id, CASE WHEN dev > 0.5 THEN 'flagged' ELSE 'passed' END AS benford, CASE WHEN outlier THEN 'flagged' ELSE 'passed' END AS outlier FROM z JOIN d USING (user_id)
""")
def c_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints of each series: first digits beyond a deviation, and any outlier, are flagged."""
    e = table(spark, sf, "events")
    dev = stats.benford(e.where("value >= 1"), "value", ["user_id"]).groupBy("user_id").agg((F.sum("chi2") / F.max("total")).alias("dev"))
    m = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low"))
    # the ends are the farthest from the mean
    far = (F.col("n") >= 4) & (F.greatest(F.col("top") - F.col("m"), F.col("m") - F.col("low")) > 1.7 * F.col("sd"))
    flag = lambda test: F.when(test, "flagged").otherwise("passed")
    return m.join(dev, "user_id").select("user_id", flag(F.col("dev") > 0.5).alias("benford"), flag(far).alias("outlier"))


@query("""
WITH q AS (SELECT o_orderkey, (['why did revenue fall', 'is the tax right', 'who owns it'])[o_orderkey % 3 + 1] AS q, (['revenue did fall as data and procedure show', 'the tax is right', 'see the register'])[o_custkey % 3 + 1] AS r FROM orders), t AS (SELECT o_orderkey, r, list_distinct(string_split(q, ' ')) AS a, list_distinct(string_split(r, ' ')) AS b FROM q)
SELECT o_orderkey, round((least(1, 1.5 * len(list_intersect(a, b)) / len(a)) * 0.3 + 0.85 * 0.25 + CASE WHEN contains(r, 'data') AND contains(r, 'procedure') THEN 0.8 ELSE 0.4 END * 0.25 + CASE WHEN o_orderkey % 4 > 0 THEN 0.7 ELSE 0.4 END * 0.2)::DOUBLE, 6) AS quality FROM t
""")
def c_reply_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How good a reply is: the question's words it answers, structure, cases, and a constant."""
    q = F.expr(choice("o_orderkey", ["why did revenue fall", "is the tax right", "who owns it"])[0])
    r = F.expr(choice("o_custkey", ["revenue did fall as data and procedure show", "the tax is right", "see the register"])[0])
    return table(spark, sf, "orders").select("o_orderkey", F.round(audits.quality_of_reply(q, r, F.col("o_orderkey") % 4 > 0, r.contains("data") & r.contains("procedure")), 6).alias("quality"))


@query("""
WITH f AS (SELECT s_suppkey, unnest(['margin', 'turnover', 'debt']) AS metric, unnest([(s_suppkey * 13 % 60) / 100.0, (s_suppkey * 17 % 90) / 10.0, (s_suppkey * 19 % 95) / 100.0]) AS own, unnest([0.25, 5.0, 0.55]) AS bench FROM supplier), d AS (SELECT *, (own - bench) / bench AS dev FROM f)
SELECT s_suppkey, metric, round((dev * 100)::DOUBLE, 4) AS deviation, CASE WHEN dev > 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN round(abs(dev)::DOUBLE, 9) > 0.5 THEN 'alert' WHEN round(abs(dev)::DOUBLE, 9) > 0.3 THEN 'warn' ELSE 'ok' END AS flag FROM d
""")
def c_benchmark_dev(spark: SparkSession, sf: str) -> DataFrame:
    """Each figure of a company against its industry's: alert from half, warning from three tenths."""
    k = F.col("s_suppkey")
    rows = [("margin", (k * 13 % 60) / 100.0, 0.25), ("turnover", (k * 17 % 90) / 10.0, 5.0), ("debt", (k * 19 % 95) / 100.0, 0.55)]
    f = table(spark, sf, "supplier").select(k, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), ((v - b) / b).alias("dev")) for n, v, b in rows])).alias("x")).select(k, "x.*")
    size = F.round(F.abs("dev"), 9)
    return f.select(k, "metric", F.round(F.col("dev") * 100, 4).alias("deviation"), F.when(F.col("dev") > 0, "up").otherwise("down").alias("direction"), F.when(size > 0.5, "alert").when(size > 0.3, "warn").otherwise("ok").alias("flag"))


@query("""
WITH s AS (SELECT c_custkey, (['high', 'medium', 'low'])[c_custkey % 3 + 1] AS sev, (['low', 'high', 'medium'])[c_custkey % 5 % 3 + 1] AS urg, (c_custkey % 11) / 10.0 AS success, (['easy', 'medium', 'high'])[c_custkey % 7 % 3 + 1] AS hard FROM customer), r AS (SELECT c_custkey, 0.3 * CASE sev WHEN 'high' THEN 90 WHEN 'medium' THEN 60 ELSE 30 END + 0.25 * CASE urg WHEN 'high' THEN 90 WHEN 'medium' THEN 60 ELSE 30 END + 0.3 * success * 100 + 0.15 * (50 - CASE hard WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 0 END) AS raw FROM s), f AS (SELECT c_custkey, floor(round(greatest(0, least(100, raw))::DOUBLE, 9))::INT AS score FROM r)
SELECT c_custkey, score, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'recommended' WHEN score >= 50 THEN 'optional' ELSE 'no' END AS grade FROM f
""")
def c_solution_score(spark: SparkSession, sf: str) -> DataFrame:
    """A solution by severity, urgency, chance and difficulty, whole, with its grade."""
    k = F.col("c_custkey")
    at = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (n + 1).cast("int"))
    score = audits.solution_score(at(["high", "medium", "low"], k % 3), at(["low", "high", "medium"], k % 5 % 3), (k % 11) / 10.0, at(["easy", "medium", "high"], k % 7 % 3))
    return table(spark, sf, "customer").select(k, score.alias("score")).withColumn("grade", audits.solution_grade(F.col("score")))


@query("""
WITH a AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1), z AS (SELECT user_id, count(*) FILTER (abs(value - m) > 2.2 * sd) AS high, count(*) FILTER (abs(value - m) > 1.8 * sd AND abs(value - m) <= 2.2 * sd) AS medium, count(*) FILTER (abs(value - m) > 1.7 * sd AND abs(value - m) <= 1.8 * sd) AS low, any_value(coalesce(sd / m, 0)) AS cv FROM events JOIN a USING (user_id) GROUP BY 1)
SELECT user_id, round(CASE WHEN high + medium + low = 0 THEN greatest(0, 0.3 - least(cv, 0.3)) ELSE least(1, high * 0.4 + medium * 0.2 + low * 0.05 + least(0.2, (high + medium + low) * 0.02) + least(0.2, cv * 0.5)) END::DOUBLE, 6) AS risk FROM z
""")
def c_spc_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The risk of a controlled process by its anomalies of three severities and its variation."""
    e = table(spark, sf, "events")
    a = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    d = e.join(a, "user_id").withColumn("d", F.abs(F.col("value") - F.col("m")) / F.col("sd"))
    z = d.groupBy("user_id").agg(F.count_if(F.col("d") > 2.2).alias("high"), F.count_if((F.col("d") > 1.8) & (F.col("d") <= 2.2)).alias("medium"), F.count_if((F.col("d") > 1.7) & (F.col("d") <= 1.8)).alias("low"), F.max(F.coalesce(F.try_divide("sd", "m"), F.lit(0.0))).alias("cv"))
    return z.select("user_id", F.round(audits.spc_risk(*[F.col(c) for c in ("high", "medium", "low", "cv")]), 6).alias("risk"))


@query("""
WITH f AS (SELECT p_partkey % 200 AS file, (['injection', 'xss', 'secrets', 'path', 'crypto', 'race'])[p_size % 6 + 1] AS kind, (['high', 'medium', 'low'])[p_partkey % 3 + 1] AS severity FROM part WHERE p_size > 10), t AS (SELECT kind, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(DISTINCT file) AS files FROM f GROUP BY 1)
SELECT kind, n, high, files FROM t ORDER BY n DESC, kind LIMIT 5
""")
def c_vuln_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The five kinds of vulnerability found most, with how many are severe and in how many files."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["injection", "xss", "secrets", "path", "crypto", "race"])), (F.col("p_size") % 6 + 1).cast("int"))
    t = table(spark, sf, "part").where("p_size > 10").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(k % 3 == 0).alias("high"), F.countDistinct(k % 200).alias("files"))
    return t.orderBy(F.desc("n"), "kind").limit(5)


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS tx, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS block FROM orders), n AS (SELECT o_custkey, max(block) AS last FROM h GROUP BY 1)
SELECT o_orderkey, 'CERT-' || left(md5(tx || block::VARCHAR), 10) AS certificate, block::VARCHAR || '/' || last::VARCHAR AS position, tx FROM h JOIN n USING (o_custkey)
""")
def c_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """A certificate for each transaction: its number, digest and place in the chain."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    h = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("tx"), F.floor((F.row_number().over(by) - 1) / 4).alias("block"))
    last = h.groupBy("o_custkey").agg(F.max("block").alias("last"))
    name = F.concat(F.lit("CERT-"), F.left(F.md5(F.concat(F.col("tx"), F.col("block").cast("string")).cast("binary")), F.lit(10)))
    return h.join(last, "o_custkey").select("o_orderkey", name.alias("certificate"), F.concat_ws("/", F.col("block").cast("string"), F.col("last").cast("string")).alias("position"), "tx")


@query("""
WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT event_type, avg(v) AS mean, stddev_pop(v) AS sd FROM m GROUP BY 1), s AS (SELECT user_id, avg(least(1, abs(v - mean) / sd / 3)) AS score FROM m JOIN b USING (event_type) GROUP BY 1)
SELECT user_id, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.45 THEN 'red' WHEN round(score, 9) >= 0.35 THEN 'orange' WHEN round(score, 9) >= 0.25 THEN 'yellow' ELSE 'normal' END AS level FROM s
""")
def c_supplier_alert(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of a supplier's metric scores, and the first level it reaches."""
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    b = m.groupBy("event_type").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    s = m.join(F.broadcast(b), "event_type").groupBy("user_id").agg(F.avg(F.least(F.lit(1.0), F.abs(F.col("v") - F.col("mean")) / F.col("sd") / 3)).alias("score"))  # one row a metric
    return s.select("user_id", F.round("score", 6).alias("score"), rules.bands(F.round("score", 9), [(0.45, "red"), (0.35, "orange"), (0.25, "yellow")], "normal").alias("level"))


@query("""
WITH e AS (SELECT n_nationkey, count(s_suppkey) AS comparables FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), s AS (SELECT n_nationkey, 100 - CASE WHEN comparables < 5 THEN 20 ELSE 0 END - CASE WHEN n_nationkey % 4 < 2 THEN 15 ELSE 0 END - CASE WHEN n_nationkey % 6 = 0 THEN 15 ELSE 0 END AS score FROM e)
SELECT n_nationkey, score::INT AS score, CASE WHEN score >= 70 THEN 'compliant' ELSE 'improve' END AS status FROM s
""")
def c_pli_compliance(spark: SparkSession, sf: str) -> DataFrame:
    """A transfer-pricing file: fewer than five comparables, fewer than two indicators, a missing name."""
    n = table(spark, sf, "nation").join(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("comparables")), "n_nationkey", "left")
    k = F.col("n_nationkey")
    lost = lambda test, m: F.when(test, m).otherwise(0)
    score = F.greatest(F.lit(0), 100 - lost(F.coalesce("comparables", F.lit(0)) < 5, 20) - lost(k % 4 < 2, 15) - lost(k % 6 == 0, 15))
    return n.select(k, score.alias("score"), F.when(score >= 70, "compliant").otherwise("improve").alias("status"))


@query("""
WITH f AS (SELECT s_suppkey, unnest(['functions', 'assets', 'risks']) AS dim, unnest([s_suppkey % 6, s_suppkey % 5, s_suppkey % 4])::INT AS chosen, unnest([5, 4, 4]) AS options FROM supplier), s AS (SELECT s_suppkey, dim, least(chosen, options) / greatest(options, 1) AS share FROM f)
SELECT s_suppkey, dim, round(share::DOUBLE, 4) AS share, CASE WHEN round(share::DOUBLE, 9) >= 0.6 THEN 'high' WHEN round(share::DOUBLE, 9) >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM s
""")
def c_func_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The share of functions, assets and risks that a company bears, in bands."""
    k = F.col("s_suppkey")
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.array_distinct(F.when(k % m > 0, F.sequence(F.lit(1), F.least((k % m).cast("int"), F.lit(o)))).otherwise(F.array().cast("array<int>"))).alias("chosen"), F.lit(o).alias("options")) for n, m, o in (("functions", 6, 5), ("assets", 5, 4), ("risks", 4, 4))])
    f = table(spark, sf, "supplier").select(k, F.explode(dims).alias("x")).select(k, "x.dim", (F.size("x.chosen") / F.greatest("x.options", F.lit(1))).alias("share"))
    return f.select(k, "dim", F.round("share", 4).alias("share"), rules.bands(F.round("share", 9), [(0.6, "high"), (0.3, "medium")], "low").alias("level"))


PLAN_SQL = """
WITH h AS (SELECT n_nationkey AS project, unnest(['k' || (n_nationkey % 4), 'k' || (n_nationkey % 3 + 4)]) AS k, unnest([3.0, 2.0]) AS w FROM nation),
p AS (SELECT n_nationkey AS project, n_nationkey % 4 + 1 AS weeks, 100000.0 * (n_nationkey % 3 + 1) AS budget, n_nationkey % 2 AS need, n_nationkey * 1.5 AS lat2, n_nationkey * 3.0 AS lon2, 'i' || (n_nationkey % 5) AS industry, 'c' || (n_nationkey % 2) AS cluster FROM nation),
a AS (SELECT s_suppkey AS auditor, s_nationkey AS home, ['k' || (s_suppkey % 4), 'k' || (s_suppkey % 3 + 4)] AS ks, [1.0 + s_suppkey % 5, 2.0 + s_suppkey % 3] AS vs, 5 + s_suppkey % 10 AS available, 50.0 + s_suppkey % 20 AS rate, (s_suppkey % 40)::DOUBLE AS lat, (s_suppkey % 60)::DOUBLE AS lon, ['i' || (s_suppkey % 7), 'c' || (s_suppkey % 3), 'k' || (s_suppkey % 5)] AS goals, s_suppkey % 4 AS level FROM supplier),
y AS (SELECT home AS project, auditor FROM a WHERE auditor % 4 = 0 AND home % 5 <> 0), z AS (SELECT project, count(*) AS past FROM y GROUP BY 1),
m AS (SELECT r_regionkey AS plan, p.project, a.*, p.* EXCLUDE (project) FROM a, region JOIN p ON p.project = (home + r_regionkey * (auditor % 3)) % 25 WHERE (auditor + r_regionkey) % 6 <> 0),
u AS (SELECT plan, auditor, sum(weeks * 10) AS hours, first(available) AS available FROM m GROUP BY ALL), l AS (SELECT plan, avg(hours) AS mean, stddev_pop(hours) AS sd, count(*) FILTER (hours > 4 * available) AS over FROM u GROUP BY 1),
d AS (SELECT m.*, hours, 6371 * 2 * asin(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))) AS km, list_has_any(goals, [industry, cluster]) AS aims, len(list_intersect(goals, ['k' || (m.project % 4), 'k' || (m.project % 3 + 4)])) AS learns, y.auditor IS NOT NULL AS back FROM m JOIN u USING (plan, auditor) LEFT JOIN y ON y.project = m.project AND y.auditor = m.auditor),
t AS (SELECT plan, project, count(*) AS n, sum(1.5 * km + hours * rate) AS spent, avg(CASE WHEN aims THEN 30 ELSE 0 END + 20 * learns + CASE WHEN level > 0 AND need > 0 THEN 20 ELSE 0 END) AS grows, count(*) FILTER (level >= 2) AS seniors, count(*) FILTER (back) AS back FROM d GROUP BY ALL),
b AS (SELECT plan, project, k, max(v) AS v FROM (SELECT plan, project, unnest(ks) AS k, unnest(vs) AS v FROM m) GROUP BY ALL),
s AS (SELECT plan, b.project, sum(v * coalesce(w, 0)) / (sqrt(sum(v * v)) * sqrt(13)) AS skill FROM b LEFT JOIN h ON h.project = b.project AND h.k = b.k GROUP BY ALL),
g AS (SELECT x.plan, x.project, avg(len(list_intersect(x.ks, o.ks)) / len(list_distinct(list_concat(x.ks, o.ks)))) * 100 AS synergy FROM m x JOIN m o ON x.plan = o.plan AND x.project = o.project AND x.auditor < o.auditor GROUP BY ALL),
e AS (SELECT plan, p.project, p.need, coalesce(spent, 0) AS spent, coalesce(grows, 0) AS grows, coalesce(seniors, 0) < p.need AS unled, coalesce(skill, 0) AS skill, coalesce(synergy, 50) AS synergy, CASE WHEN past IS NULL THEN 50 ELSE 100 * coalesce(back, 0) / past END AS kept FROM (SELECT DISTINCT plan FROM m) CROSS JOIN p LEFT JOIN t USING (plan, project) LEFT JOIN s USING (plan, project) LEFT JOIN g USING (plan, project) LEFT JOIN z ON z.project = p.project),
f AS (SELECT plan, avg(skill) * 100 AS skill, greatest(0, 100 - any_value(sd) / greatest(any_value(mean), 1) * 100) AS load, greatest(0, 100 - sum(spent) / (SELECT sum(budget) FROM p) * 100) AS cost, avg(grows) AS development, avg(synergy) AS synergy, avg(kept) AS continuity, any_value(over) + count(*) FILTER (unled) AS violations FROM e JOIN l USING (plan) GROUP BY 1)
SELECT plan, round(skill::DOUBLE, 4) AS skill, round(load::DOUBLE, 4) AS load, round(cost::DOUBLE, 4) AS cost, round(development::DOUBLE, 4) AS development, round(synergy::DOUBLE, 4) AS synergy, round(continuity::DOUBLE, 4) AS continuity, violations::BIGINT AS violations, round((0.35 * skill + 0.20 * load + 0.15 * cost + 0.15 * development + 0.10 * synergy + 0.05 * continuity - 15 * violations)::DOUBLE, 4) AS fitness FROM f
"""


@query(PLAN_SQL)
def c_plan_fitness(spark: SparkSession, sf: str) -> DataFrame:
    """How good each plan is that sends suppliers' auditors to the nations' projects: skills, balance of hours, cost of travel and hours,
    development, synergy and continuity, less 15 for each violation."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    name = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    s = table(spark, sf, "supplier")
    auditors = s.select(k.alias("auditor"), F.create_map(name("k", k % 4), 1.0 + k % 5, name("k", k % 3 + 4), 2.0 + k % 3).alias("skills"), (5 + k % 10).alias("available"), (50.0 + k % 20).alias("rate"), (k % 40).cast("double").alias("lat"), (k % 60).cast("double").alias("lon"), F.array(name("i", k % 7), name("c", k % 3), name("k", k % 5)).alias("goals"), (k % 4).alias("level"))
    projects = table(spark, sf, "nation").select(n.alias("project"), F.create_map(name("k", n % 4), F.lit(3.0), name("k", n % 3 + 4), F.lit(2.0)).alias("required"), (n % 4 + 1).alias("weeks"), (100000.0 * (n % 3 + 1)).alias("budget"), (n % 2).alias("min_senior"), (n * 1.5).alias("lat"), (n * 3.0).alias("lon"), name("i", n % 5).alias("industry"), name("c", n % 2).alias("cluster"))
    plans = s.crossJoin(F.broadcast(table(spark, sf, "region").select(F.col("r_regionkey").alias("plan"))))  # five rows
    assigned = plans.where((k + F.col("plan")) % 6 != 0).select("plan", k.alias("auditor"), ((F.col("s_nationkey") + F.col("plan") * (k % 3)) % 25).alias("project"))
    history = s.where((k % 4 == 0) & (F.col("s_nationkey") % 5 != 0)).select(F.col("s_nationkey").alias("project"), k.alias("auditor"))
    got = audits.plan_fitness(assigned, auditors, projects, history)
    return got.select("plan", *[F.round(c, 4).alias(c) for c in audits.PLAN_PARTS], F.col("violations").cast("long").alias("violations"), F.round("fitness", 4).alias("fitness"))
