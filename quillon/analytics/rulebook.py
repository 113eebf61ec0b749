"""Rules and scores by dimension over the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.analytics.derive import doubles
from quillon.analytics.registry import query, table
from quillon.operators import rules

RULES = [
    ("late", 0.3, {"hour_outside": (6, 22)}),
    ("round_end", 0.2, {"multiple_of": 10, "day_min": 25}),
    ("first_nine", 0.25, {"first_digit": 9, "amount_min": 9}),
    ("buy_early", 0.4, {"type_in": ["purchase", "signup"], "hour_max": 5, "related_party": True}),
    ("january", 0.1, {"month_in": [1, 2], "integer": True}),
    ("nothing", 1.0, {}),
]
RULE_SQL = {
    "late": "(hour(ts) < 6 OR hour(ts) > 22)",
    "round_end": "floor(value)::BIGINT % 10 = 0 AND floor(value) > 0 AND day(ts) >= 25",
    "first_nine": "substr(floor(value)::BIGINT::VARCHAR, 1, 1) = '9' AND value >= 9",
    "buy_early": "event_type IN ('purchase', 'signup') AND hour(ts) <= 5 AND user_id % 2 = 0",
    "january": "month(ts) IN (1, 2) AND value = floor(value)",
    "nothing": "false",
}


def _ruled(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    made = [(n, w, rules.pattern(c, F.col("value"), F.col("ts"), F.col("event_type"), F.col("user_id") % 2 == 0)) for n, w, c in RULES]
    return table(spark, sf, "events"), made


@query("SELECT event_id, " + ", ".join(f"{c} AS {n}" for n, c in RULE_SQL.items()) + " FROM events")
def rule_conj(spark: SparkSession, sf: str) -> DataFrame:
    """Conjunctions of conditions on time, amount, kind and relation; a rule without conditions holds for nothing."""
    e, made = _ruled(spark, sf)
    return e.select("event_id", *[c.alias(n) for n, _, c in made])


@query("""
WITH r AS (SELECT event_id, """ + ", ".join(f"{c} AS {n}" for n, c in RULE_SQL.items()) + """ FROM events)
SELECT event_id, concat_ws(',', CASE WHEN late THEN 'late' END, CASE WHEN round_end THEN 'round_end' END, CASE WHEN first_nine THEN 'first_nine' END, CASE WHEN buy_early THEN 'buy_early' END, CASE WHEN january THEN 'january' END) AS rules,
round(CASE WHEN late THEN 0.3 ELSE 0 END + CASE WHEN round_end THEN 0.2 ELSE 0 END + CASE WHEN first_nine THEN 0.25 ELSE 0 END + CASE WHEN buy_early THEN 0.4 ELSE 0 END + CASE WHEN january THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM r WHERE late OR round_end OR first_nine OR buy_early OR january
""")
def rule_apply_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule on every event: those that match, and the sum of their weights."""
    e, made = _ruled(spark, sf)
    return rules.apply_rules(e, made).where(F.size("rules") > 0).select("event_id", F.concat_ws(",", "rules").alias("rules"), F.round("score", 6).alias("score"))


@query("SELECT event_id, value > 60 AS gt, value >= 60 AS ge, value < 60 AS lt, value <= 60 AS le, value = 60 AS eq, value <> 60 AS ne FROM events")
def rule_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Each comparison of a value with a bound."""
    names = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}
    return table(spark, sf, "events").select("event_id", *[rules.compare(F.col("value"), op, 60).alias(n) for n, op in names.items()])


@query("SELECT event_id, value AS amount, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS day_of_week, 0::DOUBLE AS other, coalesce(try_cast(event_type AS DOUBLE), 0)::DOUBLE AS event_type FROM events")
def rule_metric(spark: SparkSession, sf: str) -> DataFrame:
    """A metric of an event by its name; unknown names and texts are 0."""
    e = table(spark, sf, "events")
    return e.select("event_id", *[rules.metric(n, e.columns).alias(n) for n in ("amount", "hour", "day_of_week", "other", "event_type")])


CONDITIONS = [("is_click", {"metric": "event_type", "value": "click"}), ("at_noon", {"metric": "hour", "op": "==", "value": 12}), ("large", {"op": ">=", "threshold": 90}), ("text", {"op": ">", "value": "many"}), ("user", {"metric": "user_id", "value": 7})]


@query("SELECT event_id, event_type = 'click' AS is_click, hour(ts) = 12 AS at_noon, value >= 90 AS large, false AS text, user_id = 7 AS user FROM events")
def rule_cond(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions on metrics, numbers or texts; a comparison with what is no number is false."""
    e = table(spark, sf, "events")
    return e.select("event_id", *[rules.condition(c, e.columns).alias(n) for n, c in CONDITIONS])


TYPED = {
    "over": {"type": "threshold", "op": ">", "threshold": 95},
    "rate": {"type": "rate", "metric": "value", "threshold": 80},
    "rising": {"type": "trend", "metric": "value", "consecutive": 3},
    "falling": {"type": "trend", "metric": "value", "consecutive": 2, "direction": "down"},
    "both": {"type": "combo", "conditions": [{"metric": "event_type", "value": "error"}, {"op": ">", "threshold": 50}]},
    "either": {"type": "combo", "logic": "OR", "conditions": [{"metric": "hour", "op": "<", "value": 2}, {"op": ">", "threshold": 99}]},
}


@query("""
WITH b AS (SELECT avg(value) AS mean FROM events), e AS (SELECT *, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, value > 95 AS over, (value / greatest(mean, 1) > 2.4 OR value > 80) AS rate, coalesce(value > a AND a > e.b AND e.b > c, false) AS rising, coalesce(value < a AND a < e.b, false) AS falling, event_type = 'error' AND value > 50 AS both, hour(ts) < 2 OR value > 99 AS either FROM e, b
""")
def rule_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold, rate against a baseline, trend and combined rules on every event; trends run within a user."""
    e = table(spark, sf, "events")
    mean = e.agg(F.avg("value").alias("_mean"))  # one row
    met = e.crossJoin(F.broadcast(mean))
    return met.select("event_id", *[rules.typed(r, e.columns, ["user_id"], ["ts", "event_id"], baselines={"value": F.col("_mean")}).alias(n) for n, r in TYPED.items()])


@query("""
SELECT l_orderkey, l_linenumber, abs(l_extendedprice * (1 + l_tax) - (l_extendedprice + l_extendedprice * l_tax)) < 0.01 AS gross, l_quantity <= 2 * 20 AS small, abs(l_extendedprice - l_quantity * 3000) < 0.01 AS flat FROM lineitem
""")
def rule_expr(spark: SparkSession, sf: str) -> DataFrame:
    """Identities between accounts, written as text, within a tolerance."""
    from quillon.operators.checks import identity

    columns = ["l_extendedprice", "l_tax", "l_quantity"]
    made = {"gross": "l_extendedprice * (1 + l_tax) == l_extendedprice + l_extendedprice * l_tax", "small": "l_quantity <= 2 * 20", "flat": "l_extendedprice == l_quantity * 3000"}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[identity(t, columns).alias(n) for n, t in made.items()])


#: Figures of a company, derived from its key; null where the key says so.
FIGURES = {
    "rev_yoy": "(s_suppkey * 37 % 100) / 100.0 - 0.3", "ar_turnover": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey * 17 % 90) / 10.0 END", "ocf_to_net_profit": "(s_suppkey * 29 % 200) / 100.0 - 0.4",
    "gross_margin": "(s_suppkey * 13 % 60) / 100.0", "inv_turnover": "(s_suppkey * 23 % 80) / 10.0", "related_party_ratio": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey * 31 % 70) / 100.0 END",
    "tax_rate": "(s_suppkey * 7 % 30) / 100.0", "debt_ratio": "(s_suppkey * 19 % 95) / 100.0",
}
BENCHMARK = {"ar_turnover": 5.0, "gross_margin": 0.25, "inv_turnover": 5.0, "debt_ratio": 0.55}
FIGURE_SQL = "f AS (SELECT s_suppkey, s_nationkey, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in FIGURES.items()) + " FROM supplier)"


def figures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", *[F.expr(f"cast({doubles(e)} as double)").alias(n) for n, e in FIGURES.items()])


def diagnosed(df: DataFrame, bench: dict[str, float]) -> DataFrame:
    """``patterns``: which of nine financial problems a row of figures shows; a missing figure shows none."""
    c = F.col
    known = [
        ("FP-001", (F.coalesce("rev_yoy", F.lit(0.0)) > 0.3) & (F.coalesce("ar_turnover", F.lit(99.0)) < bench["ar_turnover"] * 0.8)), ("FP-002", c("ocf_to_net_profit") < 0.7), ("FP-003", c("gross_margin") > bench["gross_margin"] * 1.5),
        ("FP-005", c("ar_turnover") < bench["ar_turnover"] * 0.7), ("FP-006", c("inv_turnover") < bench["inv_turnover"] * 0.7), ("FP-007", c("ocf_to_net_profit") < 0), ("FP-008", c("related_party_ratio") > 0.3), ("FP-009", c("tax_rate") < 0.05), ("FP-010", c("debt_ratio") > bench["debt_ratio"] * 1.2),
    ]
    return df.withColumn("patterns", F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in known])))


@query(f"""
WITH {FIGURE_SQL}, r AS (SELECT s_suppkey, unnest([CASE WHEN rev_yoy > 0.3 AND coalesce(ar_turnover, 99) < 4 THEN 'FP-001' END, CASE WHEN ocf_to_net_profit < 0.7 THEN 'FP-002' END, CASE WHEN gross_margin > 0.25 * 1.5 THEN 'FP-003' END, CASE WHEN ar_turnover < 5 * 0.7 THEN 'FP-005' END, CASE WHEN inv_turnover < 5 * 0.7 THEN 'FP-006' END, CASE WHEN ocf_to_net_profit < 0 THEN 'FP-007' END, CASE WHEN related_party_ratio > 0.3 THEN 'FP-008' END, CASE WHEN tax_rate < 0.05 THEN 'FP-009' END, CASE WHEN debt_ratio > 0.55 * 1.2 THEN 'FP-010' END]) AS pattern FROM f)
SELECT s_suppkey, pattern FROM r WHERE pattern IS NOT NULL
""")
def rule_diag(spark: SparkSession, sf: str) -> DataFrame:
    """Nine patterns of financial trouble against an industry's benchmarks, a row for each that a company shows."""
    return diagnosed(figures(spark, sf), BENCHMARK).select("s_suppkey", F.explode("patterns").alias("pattern"))


CORPORATE = {"total": "100 + event_id % 3 - 1", "price": "50 + event_id % 60", "net_asset": "60 + event_id % 7", "kind": "CASE event_id % 4 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' WHEN 2 THEN 'restructuring' ELSE 'transfer' END", "resolved": "event_id % 5 <> 0", "notice": "event_id % 6 <> 1"}
BREACHES = {"CR-01": ("fail", "abs(total - 100) >= 1 AND event_id % 9 = 0"), "CR-03": ("warning", "abs(price - net_asset) / net_asset > 0.5"), "CR-04": ("fail", "kind = 'increase' AND NOT resolved"), "CR-05": ("fail", "kind = 'decrease' AND NOT notice"), "CR-06": ("info", "kind = 'restructuring'")}


def compliance_of(events: DataFrame, company: str, order: list[str], id_: str, rules_: dict[str, tuple[str, str]]) -> DataFrame:
    """(company, rule, status, event): pass, or the rule's status and the last event that breaks it."""
    last = [F.max(F.when(F.expr(test), F.struct(*order, id_))).alias(n) for n, (_, test) in rules_.items()]
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.when(F.col(f"`{n}`").isNull(), "pass").otherwise(status).alias("status"), F.col(f"`{n}`")[id_].alias("event")) for n, (status, _) in rules_.items()])
    return events.groupBy(company).agg(*last).select(company, F.explode(each).alias("x")).select(company, "x.*")


@query("""
WITH e AS (SELECT event_id, user_id, ts, """ + ", ".join(f"{x} AS {n}" for n, x in CORPORATE.items()) + """ FROM events),
b AS (""" + " UNION ALL ".join(f"SELECT user_id, '{n}' AS rule, '{s}' AS status, event_id AS event, ts FROM e WHERE {t}" for n, (s, t) in BREACHES.items()) + """),
l AS (SELECT user_id, rule, status, event, row_number() OVER (PARTITION BY user_id, rule ORDER BY ts DESC, event DESC) AS i FROM b), r AS (SELECT DISTINCT user_id, rule FROM events, (SELECT unnest(['CR-01', 'CR-03', 'CR-04', 'CR-05', 'CR-06']) AS rule))
SELECT r.user_id, r.rule, coalesce(status, 'pass') AS status, event FROM r LEFT JOIN l ON r.user_id = l.user_id AND r.rule = l.rule AND i = 1
""")
def rule_compliance_events(spark: SparkSession, sf: str) -> DataFrame:
    """Five rules on a company's history: each passes, or has the status of the last event that breaks it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", *[F.expr(doubles(x)).alias(n) for n, x in CORPORATE.items()])
    return compliance_of(e, "user_id", ["ts"], "event_id", BREACHES)


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND n_chars = 100 OR lang = 'de'")
def filter_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Equality filters on metadata, those that are not set left out."""
    d = table(spark, sf, "documents")
    both = {"lang": "en", "source": None, "n_chars": 100}
    return rules.filtered(d, both).unionByName(rules.filtered(d, {"lang": "de", "source": None})).select("doc_id", "lang", "source")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'P0' WHEN c_acctbal >= 6000 THEN 'P1' WHEN c_acctbal >= 4000 THEN 'P2' ELSE 'P3' END AS band FROM customer")
def grade_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in bands, the highest bound reached."""
    return table(spark, sf, "customer").select("c_custkey", rules.bands(F.col("c_acctbal"), [(8000, "P0"), (6000, "P1"), (4000, "P2")], "P3").alias("band"))


PROFILE = {
    "capital": "(s_suppkey * 7919 % 900) * 100000.0", "years": "(s_suppkey * 31 % 150) / 10.0", "status": "CASE s_suppkey % 5 WHEN 0 THEN 'existing' WHEN 1 THEN 'operating' WHEN 2 THEN 'revoked' ELSE 'other' END", "changes": "s_suppkey * 3 % 8",
    "cases": "s_suppkey * 5 % 13", "executed": "s_suppkey % 3", "dishonest": "CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END", "hits": "s_suppkey % 11", "revenue": "s_acctbal * 100", "debt": "(s_suppkey * 11 % 100) / 100.0", "current": "(s_suppkey * 13 % 30) / 10.0", "cash": "s_acctbal * (s_suppkey % 9 - 1)",
    "penalties": "s_suppkey % 4", "insured": "CASE s_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END", "tax": "s_suppkey * 7 % 3", "bad": "s_suppkey * 3 % 7", "good": "s_suppkey * 2 % 5", "news": "s_suppkey * 9 % 14",
}


DIMENSION_SQL = """
WITH p AS (SELECT s_suppkey, """ + ", ".join(f"{x} AS {n}" for n, x in PROFILE.items()) + """ FROM supplier), s AS (SELECT s_suppkey,
0.30 * CASE WHEN capital >= 5e7 THEN greatest(0, least(100, 10 * (log10(5e7) / greatest(log10(capital), 1)) - 8)) WHEN capital >= 5e6 THEN 10 WHEN capital >= 1e6 THEN 25 WHEN capital >= 1e5 THEN 50 ELSE 80 END + 0.30 * CASE WHEN years >= 10 THEN 5 WHEN years >= 5 THEN 15 WHEN years >= 3 THEN 30 WHEN years >= 1 THEN 50 ELSE 80 END + 0.25 * CASE status WHEN 'revoked' THEN 100 WHEN 'existing' THEN 0 WHEN 'operating' THEN 5 ELSE 40 END + 0.15 * CASE WHEN changes >= 6 THEN 50 WHEN changes >= 3 THEN 30 WHEN changes >= 1 THEN 15 ELSE 0 END AS business,
0.30 * CASE WHEN cases >= 10 THEN 85 WHEN cases >= 4 THEN 60 WHEN cases >= 1 THEN 30 ELSE 0 END + 0.25 * CASE WHEN executed >= 2 THEN 80 WHEN executed = 1 THEN 50 ELSE 0 END + 0.30 * CASE WHEN dishonest >= 1 THEN 100 ELSE 0 END + 0.15 * least(hits * 5, 40) AS litigation,
0.40 * CASE WHEN debt <= 0 THEN 50 WHEN debt >= 0.8 THEN 85 WHEN debt >= 0.6 THEN 50 WHEN debt >= 0.4 THEN 20 ELSE 5 END + 0.30 * CASE WHEN current <= 0 THEN 60 WHEN current < 1 THEN 80 WHEN current < 1.5 THEN 40 WHEN current < 2 THEN 20 ELSE 5 END + 0.30 * CASE WHEN cash < 0 THEN 80 WHEN cash = 0 THEN 60 WHEN revenue > 0 AND cash < revenue * 0.05 THEN 30 ELSE 5 END AS financial,
0.30 * CASE WHEN penalties >= 2 THEN 80 WHEN penalties = 1 THEN 50 ELSE 0 END + 0.30 * CASE insured WHEN 'no' THEN 70 WHEN 'yes' THEN 0 ELSE 30 END + 0.30 * CASE WHEN tax >= 2 THEN 85 WHEN tax = 1 THEN 60 ELSE 0 END + 0.10 * least(hits * 5, 30) AS esg,
0.50 * CASE WHEN news >= 10 THEN 85 WHEN news >= 4 THEN 60 WHEN news >= 1 THEN 30 ELSE 0 END + 0.50 * CASE WHEN bad + good = 0 THEN CASE WHEN news > 0 THEN 30 ELSE 10 END ELSE 100.0 * bad / (bad + good) END AS sentiment FROM p)
"""


@query(DIMENSION_SQL + """SELECT s_suppkey, round(business::DOUBLE, 6) AS business, round(litigation::DOUBLE, 6) AS litigation, round(financial::DOUBLE, 6) AS financial, round(esg::DOUBLE, 6) AS esg, round(sentiment::DOUBLE, 6) AS sentiment FROM s
""")
def dim_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Five dimensions of a supplier's risk, each a weighted sum of steps."""
    return scored(spark, sf).select("s_suppkey", *[F.round(n, 6).alias(n) for n in DIMENSIONS])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, one column a dimension)."""
    p = table(spark, sf, "supplier").select("s_suppkey", *[F.expr(doubles(x)).alias(n) for n, x in PROFILE.items()])
    c = lambda n: F.col(n) if n in ("status", "insured") else F.col(n).cast("double")
    made = {
        "business": rules.business_risk(c("capital"), c("years"), c("status"), c("changes")), "litigation": rules.litigation_risk(c("cases"), c("executed"), c("dishonest"), c("hits")),
        "financial": rules.financial_risk(c("revenue"), c("debt"), c("current"), c("cash")), "esg": rules.esg_risk(c("penalties"), c("insured"), c("tax"), c("hits")), "sentiment": rules.sentiment_risk(c("news"), c("bad"), c("good")),
    }
    return p.select("s_suppkey", *[x.alias(n) for n, x in made.items()])


DIMENSIONS = {"business": 0.2, "litigation": 0.25, "financial": 0.25, "esg": 0.15, "sentiment": 0.15}


@query(DIMENSION_SQL + ", w AS (SELECT s_suppkey, greatest(0, least(100, " + " + ".join(f"{w} * {n}" for n, w in DIMENSIONS.items()) + "))::DOUBLE AS score FROM s) SELECT s_suppkey, round(score, 6) AS score, CASE WHEN round(score, 9) >= 60 THEN 'high' WHEN round(score, 9) >= 35 THEN 'medium' ELSE 'low' END AS level FROM w")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """The five dimensions of a supplier's risk weighted, between 0 and 100, and its level."""
    d = scored(spark, sf)
    y = d.withColumn("raw", rules.weighted([(w, F.col(n)) for n, w in DIMENSIONS.items()]))
    return y.select("s_suppkey", F.round("raw", 6).alias("score"), rules.bands(F.round("raw", 9), [(60, "high"), (35, "medium")], "low").alias("level"))


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderkey % 5 WHEN 0 THEN 'smurfing' WHEN 1 THEN 'round_trip' WHEN 2 THEN 'high_risk_region' ELSE 'other' END AS pattern, 'high' AS level FROM orders),
c AS (SELECT o_custkey, bool_or(pattern = 'smurfing') AND bool_or(pattern = 'round_trip') AS layering FROM a GROUP BY 1)
SELECT o_orderkey, o_totalprice > 50000 AS need_review, pattern = 'high_risk_region' AS cross_border, CASE WHEN pattern = 'high_risk_region' THEN 'critical' ELSE level END AS level, layering AS organized FROM a JOIN c USING (o_custkey)
""")
def custom_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Rules laid over finished alerts: large amounts go to review, risky regions are critical, customers with both splitting
    and round trips are marked. The marks are an aggregate joined back, so that a customer of any size stays spread out."""
    pattern = F.element_at(F.array(*map(F.lit, ["smurfing", "round_trip", "high_risk_region", "other", "other"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    alerts = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", pattern.alias("pattern"), F.lit("high").alias("level"))
    return rules.overlay(alerts, "o_custkey", "o_totalprice").select("o_orderkey", "need_review", "cross_border", "level", "organized")
