"""Dates, amounts, indices and hashes over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.analytics.derive import choice, doubles
from quillon.analytics.registry import query, table
from quillon.functions import numbers, texts, times
from quillon.operators import checks, rules, stats

DAY = "o_orderdate::DATE"
LATER = "(o_orderdate + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT))"


@query(f"""
SELECT o_orderkey, strftime(CASE o_orderkey % 10 WHEN 0 THEN {LATER} WHEN 1 THEN {DAY} - INTERVAL 8 HOUR WHEN 2 THEN date_trunc('month', {DAY}) - INTERVAL 8 HOUR WHEN 3 THEN date_trunc('month', {DAY}) - INTERVAL 8 HOUR WHEN 4 THEN date_trunc('month', {DAY}) - INTERVAL 8 HOUR WHEN 5 THEN {DAY} - INTERVAL 8 HOUR WHEN 6 THEN {LATER} - INTERVAL 2 HOUR WHEN 7 THEN CASE WHEN epoch({LATER}) >= 1000000000 THEN date_trunc('second', {LATER}) END WHEN 8 THEN {LATER} - INTERVAL 8 HOUR ELSE NULL END, '%Y-%m-%d %H:%M:%S') AS moment FROM orders
""")
def d_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Times written in ten ways by turns, among them Chinese dates, months, zones and epoch seconds, read into UTC; what names
    no zone is Shanghai time."""
    later = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    kinds = [
        F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("o_orderdate", "yyyy年M月d日"), F.date_format("o_orderdate", "yyyy年M月"), F.date_format("o_orderdate", "yyyy-MM"),
        F.date_format("o_orderdate", "yyyyMM"), F.date_format("o_orderdate", "yyyy.MM.dd"), F.concat(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        F.unix_seconds(later.cast("timestamp")).cast("string"), F.date_format(later, "yyyy/MM/dd HH:mm"), F.lit("soon"),
    ]
    text = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(times.parse_moment(text), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""
SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS day, strftime(date_trunc('week', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS quarter, strftime(date_trunc('year', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS year FROM events
""")
def d_trunc(spark: SparkSession, sf: str) -> DataFrame:
    """Times cut to the day, week, month, quarter and year that they have in Shanghai."""
    grains = ["day", "week", "month", "quarter", "year"]
    moment = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", *[F.date_format(times.truncated(moment, g), "yyyy-MM-dd").alias(g) for g in grains])


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, strftime(ts + INTERVAL 8 HOUR, '%Y-%m') AS period FROM events
""")
def d_align(spark: SparkSession, sf: str) -> DataFrame:
    """Records with times in two ways of writing brought to UTC, and the month they fall in by Shanghai time."""
    moment = F.col("ts").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), moment)
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(local, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    read = times.parse_moment(text)
    return table(spark, sf, "events").select("event_id", F.date_format(read, "yyyy-MM-dd HH:mm:ss").alias("event_time"), times.period(times.truncated(read, "month"), "month").alias("period"))


PERIODS = choice("o_orderkey", ["202601", "2026/1", "2026-1", "2025.11", "Q1", ""])


@query(f"""
WITH p AS (SELECT o_orderkey, {PERIODS[1]} AS p FROM orders) SELECT o_orderkey, CASE p WHEN '202601' THEN '2026-01' WHEN '2026/1' THEN '2026-01' WHEN '2026-1' THEN '2026-01' WHEN '2025.11' THEN '2025-11' END AS period FROM p
""")
def d_norm_period(spark: SparkSession, sf: str) -> DataFrame:
    """Accounting periods in one form, null where there is none."""
    return table(spark, sf, "orders").select("o_orderkey", times.norm_period(F.expr(PERIODS[0])).alias("period"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def d_parse_date(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in four formats, and texts that are none."""
    d = F.col("o_orderdate")
    text = F.element_at(F.array(F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(d, "yyyy.MM.dd"), F.lit("n/a")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", times.parse_date(text).cast("string").alias("day"))


HOURS = choice("o_orderkey", ["7", "09:30", "23:59:59", "2024-05-01T04:10:00", "noon", None])


@query(f"WITH h AS (SELECT o_orderkey, {HOURS[1]} AS h FROM orders) SELECT o_orderkey, CASE h WHEN '7' THEN 7 WHEN '09:30' THEN 9 WHEN '23:59:59' THEN 23 WHEN '2024-05-01T04:10:00' THEN 4 ELSE 12 END AS hour FROM h")
def d_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The hour of a number, a clock or an ISO time; twelve where there is none."""
    return table(spark, sf, "orders").select("o_orderkey", times.parse_hour(F.expr(HOURS[0])).alias("hour"))


@query("SELECT l_orderkey, l_linenumber, round(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0, 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def d_days(spark: SparkSession, sf: str) -> DataFrame:
    """Fractional days from order to shipment."""
    met = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", F.round(times.days_between(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("days"))


@query("""
WITH h AS (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 3600000000.0 AS h FROM events)
SELECT event_id, CASE WHEN h >= 168 THEN 'director' WHEN h >= 72 THEN 'manager' WHEN h >= 24 THEN 'reminder' END AS level, round(h, 4) AS hours FROM h
""")
def d_escalate(spark: SparkSession, sf: str) -> DataFrame:
    """The step of the ladder that an unanswered confirmation has reached by its age in hours."""
    h = times.hours_since(F.col("ts"), F.lit("2024-01-31").cast("timestamp"))
    rows = table(spark, sf, "events").select("event_id", h.alias("h"))
    return rows.select("event_id", rules.bands(F.col("h"), [(168, "director"), (72, "manager"), (24, "reminder")], None).alias("level"), F.round("h", 4).alias("hours"))


AMOUNTS = choice("o_orderkey", ["¥1,234.50", "3.5万", "n/a", "-", "2亿", "abc", "  87 ", ""])


@query(f"""
WITH a AS (SELECT o_orderkey, {AMOUNTS[1]} AS a FROM orders) SELECT o_orderkey, CASE a WHEN '¥1,234.50' THEN 1234.5 WHEN '3.5万' THEN 35000 WHEN '2亿' THEN 200000000 WHEN '  87 ' THEN 87 END::DOUBLE AS amount, a NOT IN ('¥1,234.50', '3.5万', '2亿', '  87 ') AS defaulted FROM a
""")
def n_parse_amount_null(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, null where a text stands for none, with the flag that a default was put in."""
    amount = numbers.amount_or_null(F.expr(AMOUNTS[0]))
    return table(spark, sf, "orders").select("o_orderkey", amount.alias("amount"), amount.isNull().alias("defaulted"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY 1")
def n_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by linear interpolation between ranks."""
    points = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    got = stats.percentiles(table(spark, sf, "part"), ["p_brand"], "p_retailprice", points)
    return got.select("p_brand", *[F.round(n, 6).alias(n) for n in points])


@query("SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal - 4500) / 1500)), 8) AS p FROM customer")
def n_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    """The logistic function of a standardised balance."""
    return table(spark, sf, "customer").select("c_custkey", F.round(numbers.sigmoid((F.col("c_acctbal") - 4500) / 1500), 8).alias("p"))


@query("""
WITH z AS (SELECT c_custkey, -3 + 2.5 * (c_custkey % 10) / 10.0 - c_acctbal / 10000 AS z, (c_custkey % 36)::DOUBLE AS h FROM customer)
SELECT c_custkey, round(least(0.99, greatest(0.001, 1 / (1 + exp(-z)) * (1 + greatest(0, 1 - h / 24) * 0.3))), 8) AS pd FROM z
""")
def n_pd(spark: SparkSession, sf: str) -> DataFrame:
    """Default probability of a loan from its ratios and its months of payments."""
    key = F.col("c_custkey")
    z = -3 + 2.5 * (key % 10) / 10.0 - F.col("c_acctbal") / 10000
    return table(spark, sf, "customer").select("c_custkey", F.round(numbers.default_probability(z, (key % 36).cast("double")), 8).alias("pd"))


BANDS = {"red": "(event_id % 97) / 100.0", "nir": "(event_id % 89) / 90.0", "blue": "(event_id % 83) / 200.0", "green": "(event_id % 79) / 110.0", "swir": "(event_id % 73) / 120.0", "swir2": "(event_id % 71) / 130.0"}
BAND_SQL = ", ".join(f"({e})::DOUBLE AS {b}" for b, e in BANDS.items())
INDEX_SQL = f"""
b AS (SELECT event_id, user_id, ts, {BAND_SQL} FROM events), i AS (SELECT *, coalesce((nir - red) / nullif(nir + red, 0), 0) AS ndvi, coalesce(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0), 0) AS evi, coalesce((green - nir) / nullif(green + nir, 0), 0) AS ndwi, coalesce((nir - swir) / nullif(nir + swir, 0), 0) AS ndmi, coalesce((nir - swir2) / nullif(nir + swir2, 0), 0) AS nbr FROM b)
"""


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Satellite bands derived from the events, with their indices."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", *[F.expr(f"cast({doubles(e)} as double)").alias(b) for b, e in BANDS.items()])
    made = numbers.vegetation(*[F.col(b) for b in ("red", "nir", "blue", "green", "swir", "swir2")])
    return rows.select("event_id", "user_id", "ts", "nir", *[c.alias(k) for k, c in made.items()])


@query(f"WITH {INDEX_SQL} SELECT event_id, round(ndvi, 6) AS ndvi, round(evi, 6) AS evi, round(ndwi, 6) AS ndwi, round(ndmi, 6) AS ndmi, round(nbr, 6) AS nbr, round(ndvi * nir, 6) AS nirv FROM i")
def n_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Six indices of satellite bands, 0 where a denominator is."""
    return slices(spark, sf).select("event_id", *[F.round(k, 6).alias(k) for k in ("ndvi", "evi", "ndwi", "ndmi", "nbr", "nirv")])


LAND_SQL = "CASE WHEN ndwi > 0.15 THEN 'water' WHEN nbr < 0.05 AND ndvi < 0.3 THEN 'burnt' WHEN ndvi < 0.15 THEN 'bare' WHEN ndvi < 0.35 THEN 'fields' WHEN ndmi < 0.05 THEN 'shrubs' WHEN ndvi < 0.65 THEN 'mixed forest' ELSE 'dense forest' END"


@query(f"WITH {INDEX_SQL} SELECT event_id, {LAND_SQL} AS land FROM i")
def n_land_use(spark: SparkSession, sf: str) -> DataFrame:
    """The class of land by its indices, the first that fits."""
    return slices(spark, sf).select("event_id", numbers.land_use(*[F.col(k) for k in ("ndvi", "ndwi", "nbr", "ndmi")]).alias("land"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def h_sha256(spark: SparkSession, sf: str) -> DataFrame:
    """Hex digests of whole texts."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


VECTOR_SQL = """
w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations),
p AS (SELECT conv_id, ((strpos('0123456789abcdef', substr(md5(w), 31, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(w), 32, 1)) - 1) % 32 AS p FROM w),
c AS (SELECT conv_id, p, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT conv_id, sqrt(sum(n * n)) AS s FROM c GROUP BY 1)
"""


@query(f"WITH {VECTOR_SQL} SELECT conv_id, p::INT AS place, round(n / s, 8) AS share FROM c JOIN s USING (conv_id)")
def h_hash_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a conversation's words, each counted at its md5 modulo 32, brought to length one; places that are not 0."""
    # counted by groups, so that no conversation's text has to fit in a row
    words = table(spark, sf, "conversations").select("conv_id", F.explode(texts.words(F.col("text"))).alias("w"))
    counts = words.groupBy("conv_id", checks.hash_place(F.col("w"), 32).alias("place")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("conv_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("s"))
    return counts.join(norm, "conv_id").select("conv_id", "place", F.round(F.col("n") / F.col("s"), 8).alias("share"))


@query(f"WITH m AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS modalities, sha256(string_agg(text, ' ' ORDER BY turn)) AS merged FROM conversations GROUP BY 1), {VECTOR_SQL}, v AS (SELECT conv_id, max(n / s) AS top FROM c JOIN s USING (conv_id) GROUP BY 1) SELECT conv_id, m.n, modalities, merged, round(top, 8) AS top FROM m JOIN v USING (conv_id)")
def agg_merge_modal(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one subject fused: their number, modalities, the merged text (as its digest) and the largest entry of its hashed vector."""
    rows = table(spark, sf, "conversations")
    merged = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("modalities"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.concat_ws(" ", F.transform("t", lambda s: s["text"]))
    top = h_hash_vector(spark, sf).groupBy("conv_id").agg(F.max("share").alias("top"))
    return merged.select("conv_id", "n", "modalities", F.sha2(text, 256).alias("merged")).join(top, "conv_id")
