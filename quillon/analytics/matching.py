"""Joins that match records, parties, texts and reference data, each beside its SQL."""

from __future__ import annotations

import difflib
import functools
import itertools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.derive import choice
from quillon.analytics.registry import query, table
from quillon.functions import numbers, texts
from quillon.functions.similar import field_map, ratio
from quillon.operators import graphs, joins


def _ratio_values(names: list[str]) -> str:
    """The likeness of all pairs of a few names, as rows for the SQL beside a query."""
    one = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)}, {one(a, b)!r})" for a, b in itertools.product(names, names))


FACTORS = [("view", "co2", 0.2, 1.0), ("view", "ch4", 0.01, 28.0), ("click", "co2", 0.5, 1.0), ("purchase", "co2", 2.7, 1.0), ("purchase", "n2o", 0.002, 265.0), ("signup", "co2", 0.1, 1.0)]


@query("""
WITH f AS (SELECT * FROM (VALUES """ + ", ".join(map(str, FACTORS)) + """) AS t(kind, gas, factor, gwp))
SELECT event_id, CASE WHEN count(factor) = 0 THEN 'unknown' ELSE 'known' END AS status, round(coalesce(sum(value * factor * gwp), 0)::DOUBLE, 6) AS kg FROM events LEFT JOIN f ON event_type = kind GROUP BY event_id
""")
def join_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Activities against emission factors and warming potentials; unknown kinds stay, with nothing. The factors of a kind are
    summed first, so an activity meets one row and needs no group of its own."""
    factors = spark.createDataFrame(FACTORS, "event_type string, gas string, factor double, gwp double").groupBy("event_type").agg(F.sum(F.col("factor") * F.col("gwp")).alias("per_unit"))
    met = table(spark, sf, "events").join(F.broadcast(factors), "event_type", "left")  # a row a kind
    return met.select("event_id", F.when(F.col("per_unit").isNull(), "unknown").otherwise("known").alias("status"), F.round(F.coalesce(F.col("value") * F.col("per_unit"), F.lit(0.0)), 6).alias("kg"))


GRADES = [("A", 0.02, 0.2), ("B", 0.05, 0.5), ("C", 0.12, 1.0), ("D", 0.99, 1.5)]


@query("""
WITH l AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'land' WHEN 1 THEN 'goods' WHEN 2 THEN 'none' ELSE 'art' END AS collateral, least(0.99, greatest(0.001, (c_custkey * 37 % 200) / 1000.0)) AS pd, abs(c_acctbal) AS ead FROM customer),
g AS (SELECT l.*, coalesce(lgd, 0.6) AS loss, coalesce(mult, 1.0) AS mult_, CASE WHEN pd <= 0.02 THEN 'A' WHEN pd <= 0.05 THEN 'B' WHEN pd <= 0.12 THEN 'C' ELSE 'D' END AS grade FROM l LEFT JOIN (VALUES ('land', 0.35), ('goods', 0.5), ('none', 0.75)) AS a(collateral, lgd) USING (collateral) LEFT JOIN (VALUES ('BUILDING', 1.2), ('MACHINERY', 0.9)) AS m(c_mktsegment, mult) USING (c_mktsegment))
SELECT c_custkey, grade, round((pd * loss * ead)::DOUBLE, 7) AS expected_loss, round((ead * CASE grade WHEN 'A' THEN 0.2 WHEN 'B' THEN 0.5 WHEN 'C' THEN 1.0 ELSE 1.5 END * mult_)::DOUBLE, 7) AS rwa FROM g
""")
def join_dim_credit(spark: SparkSession, sf: str) -> DataFrame:
    """Loans against loss by collateral (.6 if unknown), factor by industry (1) and weight by grade."""
    collateral = F.element_at(F.array(*map(F.lit, ["land", "goods", "none", "art"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    pd_ = F.least(F.lit(0.99), F.greatest(F.lit(0.001), (F.col("c_custkey") * 37 % 200) / 1000.0))
    loans = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", collateral.alias("collateral"), pd_.alias("pd"), F.abs("c_acctbal").alias("ead"))
    lgd = spark.createDataFrame([("land", 0.35), ("goods", 0.5), ("none", 0.75)], "collateral string, lgd double")
    mult = spark.createDataFrame([("BUILDING", 1.2), ("MACHINERY", 0.9)], "c_mktsegment string, mult double")
    weight = spark.createDataFrame([(g, w) for g, _, w in GRADES], "grade string, weight double")
    grade = F.when(F.col("pd") <= 0.02, "A").when(F.col("pd") <= 0.05, "B").when(F.col("pd") <= 0.12, "C").otherwise("D")
    met = loans.withColumn("grade", grade).join(F.broadcast(lgd), "collateral", "left").join(F.broadcast(mult), "c_mktsegment", "left").join(F.broadcast(weight), "grade")
    loss = F.coalesce("lgd", F.lit(0.6)) * F.col("pd") * F.col("ead")
    return met.select("c_custkey", "grade", F.round(loss, 7).alias("expected_loss"), F.round(F.col("ead") * F.col("weight") * F.coalesce("mult", F.lit(1.0)), 7).alias("rwa"))


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1001' WHEN 1 THEN '1002' WHEN 2 THEN NULL WHEN 3 THEN '6601' WHEN 4 THEN ' 9999 ' ELSE '' END AS code, CASE WHEN o_orderkey % 12 = 3 THEN 'own name' END AS given FROM orders),
c AS (SELECT o_orderkey, nullif(trim(code), '') AS code, given FROM v)
SELECT o_orderkey, coalesce(given, m.name) AS name, CASE WHEN c.code IS NULL THEN 'null_account_code' WHEN given IS NULL AND m.name IS NULL THEN 'account_not_in_master' END AS flag FROM c LEFT JOIN (VALUES ('1001', 'cash'), ('1002', 'bank'), ('6601', 'selling expenses')) AS m(code, name) ON c.code = m.code
""")
def join_account_master(spark: SparkSession, sf: str) -> DataFrame:
    """Vouchers against the chart of accounts: a missing name is looked up, and what is not found is flagged."""
    code = F.expr("element_at(array('1001', '1002', null, '6601', ' 9999 ', ''), cast(o_orderkey % 6 as int) + 1)")
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.trim(code), F.lit("")).alias("code"), F.when(F.col("o_orderkey") % 12 == 3, "own name").alias("given"))
    master = spark.createDataFrame([("1001", "cash"), ("1002", "bank"), ("6601", "selling expenses")], "code string, name string")
    met = rows.join(F.broadcast(master), "code", "left").withColumn("name", F.coalesce("given", "name"))
    return met.select("o_orderkey", "name", F.when(F.col("code").isNull(), "null_account_code").when(F.col("name").isNull(), "account_not_in_master").alias("flag"))


@query("""
WITH v AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), w AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS w FROM lineitem GROUP BY 1)
SELECT k, round(v - w, 4) AS diff FROM v JOIN w USING (k) WHERE abs(v - w) > 0.01
""")
def join_voucher(spark: SparkSession, sf: str) -> DataFrame:
    """Vouchers against the sums of their working papers, those that differ."""
    w = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("w"))
    met = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")).join(w, "k")
    return met.where(F.abs(F.col("v") - F.col("w")) > 0.01).select("k", F.round(F.col("v") - F.col("w"), 4).alias("diff"))


TRANSFERS = "t AS (SELECT o_orderkey AS id, o_custkey % 50 AS src, (o_custkey * 7 + o_orderkey) % 50 AS dst, o_totalprice AS amount FROM orders)"


@query(f"""
WITH {TRANSFERS}, m AS (SELECT a.id, min(b.id) AS back FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src AND b.amount >= 0.8 * a.amount AND b.id > a.id WHERE a.src <> a.dst GROUP BY a.id)
SELECT id, back FROM m
""")
def join_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """For each transfer the first later one that goes back with 80 % of it or more.

    The transfers of a pair and direction are the leaves of a tree of maxima, in which each question climbs and descends.
    """
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 50).alias("dst"), F.col("o_totalprice").alias("amount"))
    return joins.first_returns(t.where("src <> dst"), "id", "src", "dst", "amount", 0.8)


PARTIES = "p AS (SELECT c_custkey AS id, 'a' || (c_custkey * 7 % 400)::VARCHAR AS address, 't' || (c_custkey * 11 % 700)::VARCHAR AS phone, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'r' || (c_custkey % 900)::VARCHAR END AS legal_rep FROM customer)"


def _parties(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    say = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return table(spark, sf, "customer").select(k.alias("id"), say("a", k * 7 % 400).alias("address"), say("t", k * 11 % 700).alias("phone"), F.when(k % 3 != 0, say("r", k % 900)).alias("legal_rep"))


@query(f"""
WITH {PARTIES}, l AS (SELECT id, 'address' AS kind, address AS value FROM p UNION ALL SELECT id, 'phone', phone FROM p UNION ALL SELECT id, 'legal_rep', legal_rep FROM p WHERE legal_rep IS NOT NULL),
s AS (SELECT kind, value FROM l GROUP BY ALL HAVING count(DISTINCT id) >= 2), h AS (SELECT DISTINCT id FROM l JOIN s USING (kind, value))
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT id FROM h)
""")
def join_shared_attr(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions of parties that share an address, a telephone or a legal representative with another: a semi-join back."""
    p = _parties(spark, sf)
    long = p.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.col(a).alias("value")) for a in ("address", "phone", "legal_rep")])).alias("x")).select("id", "x.kind", "x.value").where("value is not null")
    shared = long.groupBy("kind", "value").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("kind", "value")
    hidden = long.join(shared, ["kind", "value"]).select(F.col("id").alias("o_custkey")).distinct()
    return table(spark, sf, "orders").join(hidden, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


RELATIONS = "r AS (SELECT DISTINCT c_custkey % 300 AS src, (c_custkey * 13 + 7) % 300 AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'shareholder' ELSE 'guarantee' END AS kind FROM customer UNION SELECT (c_custkey * 13 + 7) % 300, c_custkey % 300, CASE WHEN c_custkey % 4 = 0 THEN 'shareholder' ELSE 'guarantee' END FROM customer WHERE c_custkey % 6 < 4)"


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    there = c.select((k % 300).alias("src"), ((k * 13 + 7) % 300).alias("dst"), F.when(k % 2 == 0, "shareholder").otherwise("guarantee").alias("kind"))
    back = c.where(k % 6 < 4).select(((k * 13 + 7) % 300).alias("src"), (k % 300).alias("dst"), F.when(k % 4 == 0, "shareholder").otherwise("guarantee").alias("kind"))
    return there.union(back).distinct()


@query(f"""
WITH {RELATIONS} SELECT DISTINCT least(a.src, a.dst) AS a, greatest(a.src, a.dst) AS b, CASE a.kind WHEN 'shareholder' THEN 'circular_shareholding' ELSE 'cross_guarantee' END AS type FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src AND a.kind = b.kind WHERE a.src < a.dst
""")
def join_mutual(spark: SparkSession, sf: str) -> DataFrame:
    """Parties that hold or guarantee each other. Both directions fold onto one key: an aggregate, no self-join."""
    r = _relations(spark, sf).where("src <> dst")
    both = r.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").agg(F.bool_or(F.col("src") < F.col("dst")).alias("out"), F.bool_or(F.col("src") > F.col("dst")).alias("back"))
    return both.where("out and back").select("a", "b", F.when(F.col("kind") == "shareholder", "circular_shareholding").otherwise("cross_guarantee").alias("type"))


STEMS = ["acme works", "acme work", "blue sky trading", "bluesky trade", "north steel", "omega foods", "sunny"]
PAPERS = "SELECT s_suppkey AS id, n.stem AS name, 1000.0 + s_suppkey * 37 % 5000 AS incl, (1000.0 + s_suppkey * 37 % 5000) / 1.13 AS excl, (1000.0 + s_suppkey * 37 % 5000) * 0.13 / 1.13 AS tax, (s_suppkey % 40)::DOUBLE AS quantity, DATE '2024-01-01' + (s_suppkey % 60)::INT AS date FROM supplier JOIN n ON n.i = s_suppkey % 7"
SIDE = "SELECT id, names[(id + {s}) % 7 + 1] AS name, incl * (1 + ((id * {p}) % 9 - 4) / 200.0) AS incl, excl * (1 + ((id * {p}) % 7 - 3) / 200.0) AS excl, tax, quantity + {s} AS quantity, date + {d} AS date FROM base WHERE id % {m} <> 0"
SIDES = {"orders": (0, 5, 3, 5), "receipts": (1, 7, 9, 4), "payments": (7, 3, 20, 3)}
N_SQL = "n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(STEMS)) + ") AS t(i, stem)), names AS (SELECT list(stem ORDER BY i) AS names FROM n), like_ AS (SELECT * FROM (VALUES " + _ratio_values(STEMS) + ") AS t(x, y, r)), inv AS (" + PAPERS + "), base AS (SELECT * FROM inv, names)"


def _papers(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Invoices derived from suppliers, and orders, receipts and payments that resemble them."""
    k = F.col("s_suppkey")
    name = lambda shift=0, key=k: F.element_at(F.array(*map(F.lit, STEMS)), ((key + shift) % 7 + 1).cast("int"))
    incl = 1000.0 + k * 37 % 5000
    inv = table(spark, sf, "supplier").select(k.alias("id"), name().alias("name"), incl.alias("incl"), (incl / 1.13).alias("excl"), (incl * 0.13 / 1.13).alias("tax"), (k % 40).cast("double").alias("quantity"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("date"))
    i = F.col("id")
    sides = {n: inv.where(i % m != 0).select("id", name(s, i).alias("name"), (F.col("incl") * (1 + (i * p % 9 - 4) / 200.0)).alias("incl"), (F.col("excl") * (1 + (i * p % 7 - 3) / 200.0)).alias("excl"), "tax", (F.col("quantity") + s).alias("quantity"), F.date_add("date", d).alias("date")) for n, (s, p, d, m) in SIDES.items()}
    return inv, sides


def _score_sql(a: str, b: str) -> str:
    part = lambda c, w, t: f"{w} * CASE WHEN {a}.{c} > 0 AND {b}.{c} > 0 THEN greatest(0, 1 - abs({a}.{c} - {b}.{c}) / {a}.{c} / {max(2 * t, 0.01)}) ELSE 0 END"
    total = " + ".join(part(c, w, t) for c, (w, t) in joins.RECORD_PARTS.items())
    weight = " + ".join(f"CASE WHEN {a}.{c} > 0 AND {b}.{c} > 0 THEN {w} ELSE 0 END" for c, (w, _) in joins.RECORD_PARTS.items())
    return f"(0.2 * r + {total} + 0.1 * greatest(0, 1 - abs({a}.date - {b}.date) / 30.0)) / (0.3 + {weight})"


@query(f"WITH {N_SQL}, o AS ({SIDE.format(s=0, p=5, d=3, m=5)}) SELECT inv.id, round(({_score_sql('inv', 'o')})::DOUBLE, 6) AS score FROM inv JOIN o ON inv.id = o.id JOIN like_ ON x = inv.name AND y = o.name")
def c_record_sim(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of each invoice and its own order: amounts, tax, quantity, dates and names, over the weights of what both have."""
    inv, sides = _papers(spark, sf)
    met = inv.select(*[F.col(c).alias("a_" + c) for c in inv.columns]).join(sides["orders"].select(*[F.col(c).alias("b_" + c) for c in inv.columns]), F.col("a_id") == F.col("b_id"))
    return met.select(F.col("a_id").alias("id"), F.round(joins.record_score("a_", "b_", ratio("a_name", "b_name")), 6).alias("score"))


def _best_sql(side: str) -> str:
    s, p, d, m = SIDES[side]
    return f"{side}_ AS ({SIDE.format(s=s, p=p, d=d, m=m)}), {side}_m AS (SELECT inv.id, o.id AS match, ({_score_sql('inv', 'o')})::DOUBLE AS score FROM inv CROSS JOIN {side}_ o JOIN like_ ON x = inv.name AND y = o.name WHERE abs(inv.incl - o.incl) <= 0.05 * inv.incl), {side}_b AS (SELECT id, match, score FROM {side}_m WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, match) = 1)"


@query("WITH " + N_SQL + ", " + ", ".join(map(_best_sql, SIDES)) + """
SELECT inv.id, orders_b.match AS order_id, receipts_b.match AS receipt_id, payments_b.match AS payment_id, (orders_b.id IS NOT NULL)::INT + (receipts_b.id IS NOT NULL)::INT + (payments_b.id IS NOT NULL)::INT AS matched,
round(coalesce((coalesce(orders_b.score, 0) + coalesce(receipts_b.score, 0) + coalesce(payments_b.score, 0)) / nullif((orders_b.id IS NOT NULL)::INT + (receipts_b.id IS NOT NULL)::INT + (payments_b.id IS NOT NULL)::INT, 0), 0), 4) AS confidence
FROM inv LEFT JOIN orders_b USING (id) LEFT JOIN receipts_b USING (id) LEFT JOIN payments_b USING (id)
""")
def join_4way(spark: SparkSession, sf: str) -> DataFrame:
    """Each invoice with its best order, receipt and payment, independently of each other, and the mean of their scores."""
    inv, sides = _papers(spark, sf)
    columns = {"orders": "order", "receipts": "receipt", "payments": "payment"}
    papers = functools.reduce(DataFrame.unionByName, [sides[side].withColumn("side", F.lit(side)) for side in columns])
    asked = inv.withColumn("side", F.explode(F.array(*map(F.lit, columns))))
    best = joins.record_matches(asked, papers, by=("side",))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = best.groupBy("id").agg(*[of(side, c).alias(f"{column}_{end}") for side, column in columns.items() for c, end in (("match", "id"), ("score", "score"))])
    out = inv.select("id").join(out, "id", "left")
    found = sum((F.col(f"{c}_id").isNotNull().cast("int") for c in ("receipt", "payment")), F.col("order_id").isNotNull().cast("int"))
    total = F.coalesce("order_score", F.lit(0.0)) + F.coalesce("receipt_score", F.lit(0.0)) + F.coalesce("payment_score", F.lit(0.0))
    return out.select("id", "order_id", "receipt_id", "payment_id", found.alias("matched"), F.round(F.coalesce(F.try_divide(total, found), F.lit(0.0)), 4).alias("confidence"))


def _valid_code(body: str) -> str:
    total = sum(numbers.CREDIT_CODE_CHARS.index(c) * w for c, w in zip(body, numbers.CREDIT_CODE_WEIGHTS, strict=True))
    return body + numbers.CREDIT_CODE_CHARS[(31 - total % 31) % 31]


CODES = [_valid_code("91110000MA0001XYT"), _valid_code("91310000MA0002QRT"), "911100001234567890"]
TITLES = ["Acme Works Co., Ltd", "ACME Work Inc", "Blue-Sky Trading LLC", "Bluesky Trade", "North (East) Steel Inc", "Omega Foods Limited", "Sunny GmbH", "Harbour Lines", "Quartz Mining Corp", "Velvet Press"]
TITLE, CODE = choice("s_suppkey", TITLES), choice("s_suppkey * 3", [*CODES, None, None, None, None])


def _stem(name: str) -> str:
    clean = re.sub(" +", " ", re.sub("[^0-9a-z]+", " ", name.lower())).strip()
    return re.sub(" ?(incorporated|corporation|limited|company|corp|gmbh|inc|ltd|llc|co)$", "", clean).strip()


ENTITY_SQL = f"""
e AS (SELECT s_suppkey AS id, nullif(CASE WHEN s_suppkey % 4 = 0 THEN {CODE[1]} END, '{CODES[2]}') AS code, s.stem FROM supplier JOIN (VALUES {', '.join(f"('{t}', '{_stem(t)}')" for t in TITLES)}) AS s(title, stem) ON s.title = {TITLE[1]}),
like_ AS (SELECT * FROM (VALUES {_ratio_values([_stem(t) for t in TITLES])}) AS t(x, y, r)),
l AS (SELECT a.id AS a, b.id AS b, coalesce(a.code = b.code, false) AS hard, r FROM e a JOIN e b ON a.id <> b.id JOIN like_ ON x = least(a.stem, b.stem) AND y = greatest(a.stem, b.stem) WHERE coalesce(a.code = b.code, false) OR r > 0.75)
"""
CLOSURE_SQL = "RECURSIVE_ AS (SELECT id AS v, id AS c FROM e UNION SELECT l.b, x.c FROM RECURSIVE_ x JOIN l ON l.a = x.v WHERE x.c < l.b)"


def _entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parties (id, code, stem) and the links between them."""
    code = F.expr(f"case when s_suppkey % 4 = 0 then {CODE[0]} end")
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(numbers.credit_code(code), code).alias("code"), texts.company_stem(F.expr(TITLE[0])).alias("stem"))
    return p, graphs.cut(joins.entity_links(p, "id", "code", "stem"))


@query(f"WITH RECURSIVE {ENTITY_SQL}, {CLOSURE_SQL.replace('RECURSIVE_', 'rc')} SELECT v AS id, min(c) AS entity FROM rc GROUP BY 1")
def join_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Parties that are one entity: the same valid credit code, or names above .75 alike without their legal suffix, closed over
    chains. An entity is named by its smallest party. Codes that fail their check link nothing."""
    p, links = _entities(spark, sf)
    parts = graphs.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return p.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("entity"))


CONFIDENCE_SQL = f"{ENTITY_SQL}, {CLOSURE_SQL.replace('RECURSIVE_', 'rc')}, m AS (SELECT v AS id, min(c) AS entity FROM rc GROUP BY 1), s AS (SELECT entity, max(CASE WHEN hard THEN 1.0 ELSE r END) AS top FROM m JOIN l ON l.a = m.id GROUP BY 1), q AS (SELECT m.entity, count(*) AS members, coalesce(max(top), 1.0) AS confidence FROM m LEFT JOIN s USING (entity) GROUP BY 1)"


@query(f"WITH RECURSIVE {CONFIDENCE_SQL} SELECT entity, members, round(confidence::DOUBLE, 6) AS confidence FROM q")
def c_entity_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How sure an entity is: 1 for a single party or any hard link, else its best likeness."""
    p, links = _entities(spark, sf)
    parts = graphs.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    of = p.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("entity"))
    top = links.join(of.withColumnRenamed("id", "a"), "a").groupBy("entity").agg(F.max("score").alias("top"))
    return of.groupBy("entity").agg(F.count("*").alias("members")).join(top, "entity", "left").select("entity", "members", F.round(F.coalesce("top", F.lit(1.0)), 6).alias("confidence"))


@query(f"WITH RECURSIVE {ENTITY_SQL}, {CLOSURE_SQL.replace('RECURSIVE_', 'rc')}, m AS (SELECT v AS id, min(c) AS entity FROM rc GROUP BY 1) SELECT (SELECT count(DISTINCT entity) FROM m) AS entities_aligned, (SELECT count(*) FROM events) AS times_aligned, (SELECT count(DISTINCT conv_id) FROM conversations) AS modalities_fused")
def c_align_all(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, times and modalities aligned one after the other, with the report of how many came out."""
    from quillon.analytics import values

    entities = join_entity(spark, sf).agg(F.countDistinct("entity").alias("entities_aligned"))
    times = values.d_align(spark, sf).agg(F.count("event_time").alias("times_aligned"))
    fused = values.agg_merge_modal(spark, sf).agg(F.count("*").alias("modalities_fused"))
    return entities.crossJoin(times).crossJoin(fused)  # one row each


DICTIONARY = [("amount", "amount"), ("amount", "total amount"), ("company", "company name"), ("company", "enterprise"), ("period", "accounting period"), ("period", "month"), ("account", "account code"), ("account", "subject code")]
FIELDS = ["Total_Amount", "amount!", "Company-Name", "acct code", "periods", "zzz", "account  code", "enterprize"]


def _field_sql() -> str:
    clean = lambda s: re.sub(" +", " ", re.sub("[^0-9a-z]+", " ", s.lower())).strip()
    rows = [(f, std, difflib.SequenceMatcher(None, clean(f), clean(syn)).ratio()) for f in FIELDS for std, syn in DICTIONARY]
    return ", ".join(f"('{f}', '{s}', {r!r})" for f, s, r in rows)


@query(f"""
WITH f AS (SELECT DISTINCT {choice('p_partkey', FIELDS)[1]} AS field FROM part), m AS (SELECT field, standard, max(r) AS score FROM f JOIN (VALUES {_field_sql()}) AS t(field, standard, r) USING (field) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, standard) AS rank FROM m WHERE score >= 0.4) SELECT field, standard, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 3
""")
def join_field_map(spark: SparkSession, sf: str) -> DataFrame:
    """Fields against a dictionary of synonyms: the three standards most alike, from .4."""
    fields = table(spark, sf, "part").select(F.expr(choice("p_partkey", FIELDS)[0]).alias("field"))
    got = field_map(fields, spark.createDataFrame(DICTIONARY, "standard string, synonym string"))
    return got.select("field", "standard", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


DISCLOSED = "The group declares sales to acme works and blue sky trading. A loan of 5000 was granted; services to omega foods."
DECLARED = ["acme works", "blue sky trading", "omega foods", "north steel"]
_NEAR = sorted(n for n in STEMS if any(difflib.SequenceMatcher(None, n, d).ratio() > 0.7 and d in DISCLOSED for d in DECLARED))


@query(f"""
WITH t AS (SELECT o_orderkey, {choice('o_orderkey', STEMS)[1]} AS party, {choice('o_custkey', ['loan', 'sale', 'lease'])[1]} AS kind, CASE WHEN o_orderkey % 11 = 0 THEN 5000.0 ELSE o_totalprice END AS amount FROM orders)
SELECT o_orderkey, contains('{DISCLOSED}', party) OR party IN ({', '.join(f"'{n}'" for n in _NEAR)}) OR (contains('{DISCLOSED}', kind) AND contains('{DISCLOSED}', round(amount, 0)::BIGINT::VARCHAR)) AS disclosed FROM t
""")
def join_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a transaction is disclosed: the party is named, or much like a declared party that is, or its kind and amount are."""
    party = F.expr(choice("o_orderkey", STEMS)[0])
    t = table(spark, sf, "orders").select("o_orderkey", party.alias("party"), F.expr(choice("o_custkey", ["loan", "sale", "lease"])[0]).alias("kind"), F.when(F.col("o_orderkey") % 11 == 0, 5000.0).otherwise(F.col("o_totalprice")).alias("amount"))
    text = F.lit(DISCLOSED)
    # names are compared once, not once a transaction
    declared = spark.createDataFrame([(d,) for d in DECLARED if d in DISCLOSED], "declared string")
    near = t.select("party").distinct().crossJoin(F.broadcast(declared)).where(ratio("party", "declared") > 0.7).select("party").distinct().withColumn("near", F.lit(True))
    met = t.join(near, "party", "left")
    named = text.contains(F.col("party")) | F.coalesce("near", F.lit(False))
    return met.select("o_orderkey", (named | (text.contains(F.col("kind")) & text.contains(F.round("amount", 0).cast("long").cast("string")))).alias("disclosed"))


OLD_RULES = [(1, "Rules on related party sales"), (2, "Rules on guarantees"), (3, "Notice on tax of services")]
NEW_TITLES = ["Rules on sales to related parties", "Rules on guarantees (revised)", "Notice on tax of digital services", "Measures for ships"]


def _titles_sql() -> str:
    return ", ".join(f"('{n}', {k}, {difflib.SequenceMatcher(None, n, t).ratio()!r})" for n in NEW_TITLES for k, t in OLD_RULES)


@query(f"""
WITH r AS (SELECT p_partkey, {choice('p_partkey', NEW_TITLES)[1]} AS title FROM part), b AS (SELECT title, old, r AS score FROM (VALUES {_titles_sql()}) AS t(title, old, r) QUALIFY row_number() OVER (PARTITION BY title ORDER BY r DESC, old) = 1)
SELECT p_partkey, CASE WHEN score >= 0.5 THEN old END AS old, round(score, 6) AS score FROM r JOIN b USING (title)
""")
def join_old_new(spark: SparkSession, sf: str) -> DataFrame:
    """New rules with the old one of the most similar title, from .5; titles are compared once each, not once a rule."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", NEW_TITLES)[0]).alias("title"))
    old = spark.createDataFrame(OLD_RULES, "old int, old_title string")
    scored = rows.select("title").distinct().crossJoin(F.broadcast(old)).withColumn("score", ratio("title", "old_title"))
    best = scored.groupBy("title").agg(F.max(F.struct("score", (-F.col("old")).alias("o"))).alias("b"))
    return rows.join(best, "title").select("p_partkey", F.when(F.col("b.score") >= 0.5, -F.col("b.o")).alias("old"), F.round("b.score", 6).alias("score"))


SOLUTIONS = [("S1", ["tax", "related"], ["default"], ["high"], 0.9), ("S2", ["tax"], ["BUILDING"], ["high", "medium"], 0.7), ("S3", ["cash"], ["MACHINERY", "default"], ["low"], 0.8)]


@query("""
WITH i AS (SELECT c_custkey, c_mktsegment AS industry, (['tax', 'cash', 'related', 'other'])[c_custkey % 4 + 1] AS kind, (['high', 'medium', 'low'])[c_custkey % 3 + 1] AS severity FROM customer),
s AS (SELECT * FROM (VALUES ('S1', ['tax', 'related'], ['default'], ['high'], 0.9), ('S2', ['tax'], ['BUILDING'], ['high', 'medium'], 0.7), ('S3', ['cash'], ['MACHINERY', 'default'], ['low'], 0.8)) AS t(id, kinds, industries, severities, success)),
x AS (SELECT c_custkey, id, CASE WHEN list_contains(kinds, kind) THEN 0.45 ELSE 0.1 END + CASE WHEN list_contains(industries, industry) OR list_contains(industries, 'default') THEN 0.25 ELSE 0 END + CASE WHEN list_contains(severities, severity) THEN 0.2 ELSE 0.05 END + success * 0.1 AS score FROM i, s)
SELECT c_custkey, id AS solution, round(score::DOUBLE, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, id) = 1
""")
def join_solution(spark: SparkSession, sf: str) -> DataFrame:
    """Each issue with the solution that scores best by kind, industry, severity and success. The solutions are a few rows, folded
    into one array, so an issue is scored in its own row."""
    c = table(spark, sf, "customer")
    pick = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (F.col("c_custkey") % n + 1).cast("int"))
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("industry"), pick(["tax", "cash", "related", "other"], 4).alias("kind"), pick(["high", "medium", "low"], 3).alias("severity"))

    def score(kinds, industries, severities, success):
        fits = F.when(F.col("industry").isin(*industries) | F.lit("default" in industries), 0.25).otherwise(0.0)
        return F.when(F.col("kind").isin(*kinds), 0.45).otherwise(0.1) + fits + F.when(F.col("severity").isin(*severities), 0.2).otherwise(0.05) + success * 0.1

    made = F.array(*[F.struct(F.round(score(k, i, s, p), 9).alias("score"), F.lit(-n).alias("o"), F.lit(name).alias("solution")) for n, (name, k, i, s, p) in enumerate(SOLUTIONS)])
    return rows.select("c_custkey", F.array_max(made).alias("b")).select("c_custkey", "b.solution", F.round("b.score", 6).alias("score"))


CLAIMS = choice("o_orderkey", ["we planted trees and restored the forest", "emissions fell by ten percent", "water use is lower", "staff are happy"])
EVIDENCE = [("E0", "satellite shows forest restored", "trees"), ("E1", "meter reads emissions fell", "emissions"), ("E2", "press says staff are many", "people")]
MARKS = {"trees": "tree|forest", "emissions": "emission|carbon", "water": "water", "staff": "staff"}


def _kind_of(text) -> str:
    return next((k for k, p in MARKS.items() if re.search(p, text)), "other")


@query(f"""
WITH c AS (SELECT o_orderkey, {CLAIMS[1]} AS t FROM orders), k AS (SELECT o_orderkey, t, CASE WHEN regexp_matches(t, 'tree|forest') THEN 'tree|forest' WHEN regexp_matches(t, 'emission|carbon') THEN 'emission|carbon' WHEN contains(t, 'water') THEN 'water' WHEN contains(t, 'staff') THEN 'staff' END AS p FROM c),
e AS (SELECT * FROM (VALUES ('E0', 'satellite shows forest restored', 'trees'), ('E1', 'meter reads emissions fell', 'emissions'), ('E2', 'press says staff are many', 'people')) AS t(id, d, m)),
s AS (SELECT o_orderkey, id, CASE WHEN regexp_matches(d, p) OR regexp_matches(m, p) THEN 0.4 ELSE 0 END + least(0.6, 0.1 * len(list_intersect(list_distinct(regexp_extract_all(t, '\\w+')), list_distinct(regexp_extract_all(d || ' ' || m, '\\w+'))))) AS score FROM k, e)
SELECT o_orderkey, id AS evidence, round(score::DOUBLE, 6) AS score FROM s WHERE score > 0.2
""")
def join_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with the evidence that speaks of them: .4 for the category's words, .1 a common word up to .6, above .2."""
    t = F.expr(CLAIMS[0])
    rows = table(spark, sf, "orders").select("o_orderkey", F.array_distinct(F.regexp_extract_all(t, F.lit("\\w+"), F.lit(0))).alias("words"), F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for k, p in MARKS.items()]).alias("kind"))
    evidence = spark.createDataFrame([(i, sorted(set(re.findall(r"\w+", d + " " + m))), [k for k, p in MARKS.items() if re.search(p, d) or re.search(p, m)]) for i, d, m in EVIDENCE], "evidence string, own array<string>, kinds array<string>")
    met = rows.crossJoin(F.broadcast(evidence))  # a few rows of evidence
    score = F.when(F.array_contains("kinds", F.col("kind")), 0.4).otherwise(0.0) + F.least(F.lit(0.6), 0.1 * F.size(F.array_intersect("words", "own")))
    return met.withColumn("score", F.round(score, 9)).where("score > 0.2").select("o_orderkey", "evidence", F.round("score", 6).alias("score"))


TEMPLATES = [("T1", ["cash", "bank deposits"]), ("T2", ["receivables"]), ("T3", ["selling expenses", "expenses"])]
SUBJECTS = choice("p_partkey", ["cash", "bank", "other receivables", "expenses", "selling expenses of ships", "", "goodwill"])


@query(f"""
WITH s AS (SELECT p_partkey, {SUBJECTS[1]} AS name FROM part), t AS (SELECT * FROM (VALUES ('T1', 'cash'), ('T1', 'bank deposits'), ('T2', 'receivables'), ('T3', 'selling expenses'), ('T3', 'expenses')) AS t(template, k))
SELECT DISTINCT p_partkey, template FROM s JOIN t ON k = name OR contains(name, k) OR contains(k, name)
""")
def join_template(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with every template whose name or alias equals, holds or lies in theirs; each template once."""
    name = F.col("name")
    rows = table(spark, sf, "part").select("p_partkey", F.expr(SUBJECTS[0]).alias("name"))
    hit = lambda keys: sum((name.contains(k) | F.lit(k).contains(name) for k in keys[1:]), name.contains(keys[0]) | F.lit(keys[0]).contains(name)) if len(keys) == 1 else None

    def any_of(keys):
        out = F.lit(False)
        for k in keys:
            out = out | name.contains(k) | F.lit(k).contains(name)
        return out

    return rows.select("p_partkey", F.explode(F.array_compact(F.array(*[F.when(any_of(keys), F.lit(t)) for t, keys in TEMPLATES]))).alias("template"))


SCENARIOS = {"tax_exempted": (["farm", "exempt"], None), "simple_taxation": (["simple"], None), "welfare": (["gift", "canteen"], 1.0), "abnormal_loss": (["fire", "theft"], 0.5)}
CONTENT = choice("l_partkey", ["farm tools", "canteen food gift", "simple works", "stock lost in a fire", "steel", "exempt seeds by theft"])
SALES = (1000.0, 150.0, 100.0)  # total, exempt, simple


def _transfers(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, l_linenumber, scenario, tax, ratio) of every line and scenario that a keyword brings together."""
    text = F.expr(CONTENT[0])
    share = (SALES[1] + SALES[2]) / SALES[0]
    found = []
    for scenario, (words, fixed) in SCENARIOS.items():
        found.append(F.when(text.rlike("|".join(words)), F.struct(F.lit(scenario).alias("scenario"), F.lit(share if fixed is None else fixed).alias("ratio"))))
    tax = F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tax.alias("tax"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("l_orderkey", "l_linenumber", "tax", "x.*")


SCENARIO_SQL = f"i AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * l_tax AS tax, {CONTENT[1]} AS t FROM lineitem), s AS (SELECT * FROM (VALUES ('tax_exempted', 'farm|exempt', 0.25), ('simple_taxation', 'simple', 0.25), ('welfare', 'gift|canteen', 1.0), ('abnormal_loss', 'fire|theft', 0.5)) AS t(scenario, p, ratio))"


@query(f"WITH {SCENARIO_SQL} SELECT l_orderkey, l_linenumber, scenario, ratio::DOUBLE AS ratio FROM i JOIN s ON regexp_matches(t, p)")
def join_keyword_scenario(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines with every tax scenario that one of its keywords names."""
    return _transfers(spark, sf).select("l_orderkey", "l_linenumber", "scenario", "ratio")


@query(f"WITH {SCENARIO_SQL}, r AS (SELECT scenario, tax * ratio AS transfer FROM i JOIN s ON regexp_matches(t, p)) SELECT scenario, count(*) AS n, round(sum(transfer), 2) AS total FROM r GROUP BY 1")
def c_tax_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Input tax to be transferred out by scenario: the share of sales that bear no tax, or the scenario's own ratio."""
    return _transfers(spark, sf).groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.sum(F.col("tax") * F.col("ratio")), 2).alias("total"))


SUBSCRIPTIONS = [("R1", ["tax", "trade"], "ALL", "all"), ("R2", ["tax"], "CN", "building"), ("R3", ["data"], "US", "all"), ("R4", ["data", "trade"], "ALL", "machinery")]


@query("""
WITH d AS (SELECT c_custkey, (['tax', 'trade', 'data', 'labour'])[c_custkey % 4 + 1] AS category, (['CN', 'US', 'DE'])[c_custkey % 3 + 1] AS country, lower(c_mktsegment) AS industry FROM customer),
r AS (SELECT * FROM (VALUES ('R1', ['tax', 'trade'], 'ALL', 'all'), ('R2', ['tax'], 'CN', 'building'), ('R3', ['data'], 'US', 'all'), ('R4', ['data', 'trade'], 'ALL', 'machinery')) AS t(rule, categories, where_, industry_))
SELECT c_custkey, rule FROM d JOIN r ON list_contains(categories, category) AND (where_ = 'ALL' OR where_ = country) AND (industry_ = 'all' OR industry_ = industry)
""")
def join_subscription(spark: SparkSession, sf: str) -> DataFrame:
    """Regulations with the subscriptions they concern: category in the list, country and industry equal or all."""
    pick = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (F.col("c_custkey") % n + 1).cast("int"))
    d = table(spark, sf, "customer").select("c_custkey", pick(["tax", "trade", "data", "labour"], 4).alias("category"), pick(["CN", "US", "DE"], 3).alias("country"), F.lower("c_mktsegment").alias("industry"))
    r = F.broadcast(spark.createDataFrame(SUBSCRIPTIONS, "rule string, categories array<string>, place string, trade string"))
    fits = F.array_contains("categories", F.col("category")) & F.col("place").isin("ALL") | (F.array_contains("categories", F.col("category")) & (F.col("place") == F.col("country")))
    return d.crossJoin(r).where(fits & ((F.col("trade") == "all") | (F.col("trade") == F.col("industry")))).select("c_custkey", "rule")  # a few rules


@query("""
WITH h AS (SELECT event_type AS kind, user_id % 4 + 1 AS severity, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0 END) AS rate FROM events WHERE event_id % 5 <> 0 AND user_id % 4 <> 3 GROUP BY ALL)
SELECT event_id, round(coalesce(rate, 0.5), 6) AS fail_rate FROM events LEFT JOIN h ON kind = event_type AND severity = user_id % 4 + 1 WHERE event_id % 5 = 0
""")
def join_history(spark: SparkSession, sf: str) -> DataFrame:
    """Open cases with the rate at which past cases of their kind and severity failed, a half where there was none."""
    e = table(spark, sf, "events").withColumn("severity", F.col("user_id") % 4 + 1)
    past = e.where("event_id % 5 <> 0 and severity <> 4").groupBy("event_type", "severity").agg(F.avg(F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0)).alias("rate"))
    return e.where("event_id % 5 = 0").join(past, ["event_type", "severity"], "left").select("event_id", F.round(F.coalesce("rate", F.lit(0.5)), 6).alias("fail_rate"))


@query("""
WITH w AS (SELECT p_partkey AS wp, p_size AS tpl, (p_size * 3 + 1) % 60 AS ref FROM part), f AS (SELECT tpl, min(wp) AS first_wp FROM w GROUP BY 1)
SELECT wp, ref, first_wp AS to_wp, CASE WHEN first_wp IS NULL THEN 'broken' ELSE 'linked' END AS status FROM w LEFT JOIN f ON f.tpl = ref
""")
def anti_broken_ref(spark: SparkSession, sf: str) -> DataFrame:
    """References between working papers: to the first paper of the template, or broken where there is none."""
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("wp"), F.col("p_size").alias("tpl"), ((F.col("p_size") * 3 + 1) % 60).alias("ref"))
    first = w.groupBy(F.col("tpl").alias("ref")).agg(F.min("wp").alias("to_wp"))
    return w.join(first, "ref", "left").select("wp", "ref", "to_wp", F.when(F.col("to_wp").isNull(), "broken").otherwise("linked").alias("status"))


@query("""
WITH n AS (SELECT DISTINCT id FROM (SELECT o_custkey % 1700 AS id FROM orders UNION ALL SELECT o_orderkey % 1900 FROM orders)) SELECT coalesce(n.id, c_custkey) AS id, coalesce(c_name, 'unknown-' || n.id::VARCHAR) AS name, c_custkey IS NULL AS placeholder FROM n FULL JOIN customer ON n.id = c_custkey
""")
def outer_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All parties and all ends of edges; an end that is no known party gets a placeholder."""
    o = table(spark, sf, "orders")
    ends = o.select(F.explode(F.array(F.col("o_custkey") % 1700, F.col("o_orderkey") % 1900)).alias("id")).distinct()
    met = ends.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "id", "full")
    return met.select("id", F.coalesce("c_name", F.concat(F.lit("unknown-"), F.col("id").cast("string"))).alias("name"), F.col("c_name").isNull().alias("placeholder"))


RATES = [0.0, 0.03, 0.06, 0.09, 0.13]


@query("SELECT l_orderkey, l_linenumber, (SELECT first(r ORDER BY abs(r - l_tax), r) FROM (SELECT unnest([0.0, 0.03, 0.06, 0.09, 0.13]) AS r))::DOUBLE AS nearest FROM lineitem")
def join_nearest_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The standard tax rate nearest to each line's, the lower on ties."""
    best = F.array_min(F.transform(F.array(*map(F.lit, RATES)), lambda r: F.struct(F.abs(r - F.col("l_tax")).alias("d"), r.alias("r"))))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", best["r"].alias("nearest"))
