"""Zoned tables, quality, dedup, dense matrices, and text analytics over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.registry import query, table
from quillon.functions import numbers, texts, times
from quillon.operators import retrieval, stats


@query("""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_orderpriority) AS sources, array_to_string(list_sort(list(o_orderkey)), ',') AS ids FROM orders GROUP BY ALL
""")
def agg_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by entity and period with the ids they come from."""
    g = table(spark, sf, "orders").groupBy("o_custkey", times.period(F.col("o_orderdate"), "month").alias("period"))
    return g.agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("sources"), F.concat_ws(",", F.sort_array(F.collect_list("o_orderkey"))).alias("ids"))


@query("""
SELECT round(avg(CASE WHEN text IS NOT NULL AND text <> '' AND lang IS NOT NULL THEN 1 ELSE 0 END), 6) AS completeness, round(count(DISTINCT sha256(text)) / count(*)::DOUBLE, 6) AS uniqueness, round(avg(CASE WHEN n_chars = length(text) THEN 1 ELSE 0 END), 6) AS consistency FROM documents
""")
def agg_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ok = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return d.agg(ok((F.col("text") != "") & F.col("lang").isNotNull()).alias("completeness"), F.round(F.countDistinct(F.sha2("text", 256)) / F.count("*"), 6).alias("uniqueness"), ok(F.col("n_chars") == F.char_length("text")).alias("consistency"))


@query("""
SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def dup_content(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that occur more than once (h_sha256)."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey AS kept, n - 1 AS merged FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each key wins, by partial minima rather than a window."""
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("one"), F.count("*").alias("n"))
    return g.select("o_custkey", "o_orderpriority", F.col("one.o_orderkey").alias("kept"), (F.col("n") - 1).alias("merged"))


@query("""
SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer
""")
def union_parties(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return s.union(table(spark, sf, "customer").select("c_nationkey", F.lit("customer"))).distinct()


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL)
SELECT a.c_nationkey, b.c_mktsegment, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM (SELECT DISTINCT c_nationkey FROM customer) a CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) b LEFT JOIN g USING (c_nationkey, c_mktsegment)
""")
def agg_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Nation by segment, empty cells included."""
    got = stats.dense_matrix(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return got.select("c_nationkey", "c_mktsegment", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS share FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))
""")
def agg_case_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    got = o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    return got.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("share"))


@query("""
WITH u AS (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)
SELECT nation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM u GROUP BY 1
""")
def agg_distribution(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionAll(table(spark, sf, "supplier").select("s_nationkey"))
    n = u.groupBy("nation").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("nation", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("percent"))


@query("""
SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean, round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS cv, round(max(p_retailprice) - min(p_retailprice), 6) AS range, count(DISTINCT p_type) AS sources FROM part GROUP BY 1
""")
def agg_weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    v, w = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.sum(v * w) / F.sum(w), 6).alias("mean"), F.round(F.stddev_samp(v) / F.avg(v), 6).alias("cv"), F.round(F.max(v) - F.min(v), 6).alias("range"), F.countDistinct("p_type").alias("sources"))


@query("""
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_open, (SELECT round(sum(o_totalprice), 2) FROM orders) AS value, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors, (SELECT count(DISTINCT user_id) FROM events) AS n_users, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n_debtors
""")
def agg_kpi(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts over three tables."""
    o = table(spark, sf, "orders").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    e = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.countDistinct("user_id").alias("n_users"))
    c = table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("n_debtors"))
    return o.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))


WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""
WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), p AS (SELECT DISTINCT doc_id, term FROM t), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln((n + 1)::DOUBLE / (count(*) + 1)) + 1, 6) AS idf FROM p, n GROUP BY term, n
""")
def agg_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies and smoothed weights of all terms."""
    d = table(spark, sf, "documents")
    index = retrieval.postings(d, "doc_id", F.col("text"))
    return retrieval.idf(index, d.agg(F.count("*").alias("n")), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""
WITH q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS term FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS len FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), a AS (SELECT count(*) AS n, avg(len) AS m FROM l),
i AS (SELECT term, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM t, a WHERE term IN (SELECT term FROM q) GROUP BY term, n),
s AS (SELECT query, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score, count(*) AS matched FROM q JOIN t USING (term) JOIN i USING (term) JOIN l USING (doc_id), a GROUP BY ALL)
SELECT query, doc_id, rank, matched, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3
""")
def t_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents for each benchmark item."""
    d = table(spark, sf, "documents")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(texts.words(F.col("text")))).alias("term"))
    lengths = d.select("doc_id", F.size(texts.words(F.col("text"))).alias("len"))
    got = retrieval.bm25(retrieval.asked_postings(d, "doc_id", F.col("text"), queries), queries, lengths, "doc_id").withColumn("order", F.round("score", 9))
    return stats.ranked(got, ["query"], "order", "doc_id", 3).select("query", "doc_id", "rank", "matched", F.round("score", 4).alias("score"))


LEXICON = {"function": ["the", "of", "and"], "licence": ["license", "licensed", "released"], "verbs": ["is", "are", "was"]}


@query("""
WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(the|of|and)\\b')) AS a, len(regexp_extract_all(text, '(?i)\\b(license|licensed|released)\\b')) AS b, len(regexp_extract_all(text, '(?i)\\b(is|are|was)\\b')) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a = greatest(a, b, c) THEN 'function' WHEN b = greatest(a, b, c) THEN 'licence' ELSE 'verbs' END AS label, greatest(a, b, c)::INT AS hits, round(coalesce(greatest(a, b, c)::DOUBLE / nullif(a + b + c, 0), 0), 6) AS confidence FROM h
""")
def t_tfidf_class(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword classes."""
    got = retrieval.keyword_class(table(spark, sf, "documents"), "doc_id", F.col("text"), LEXICON)
    return got.select("doc_id", "label", "hits", F.round("confidence", 6).alias("confidence"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::INT AS email, len(regexp_extract_all(text, '\\b[0-9]{17}[0-9Xx]\\b'))::INT AS id18, len(regexp_extract_all(text, '\\b[0-9]{16,19}\\b'))::INT AS card, len(regexp_extract_all(text, '\\b1[3-9][0-9]{9}\\b'))::INT AS mobile, len(regexp_extract_all(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b'))::INT AS ip FROM documents
""")
def s_pii_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data by kind."""
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in texts.personal_counts(F.col("text")).items()])


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS text, length(html) AS n FROM pages
""")
def s_strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", texts.strip_html(F.col("html")).alias("text"), F.char_length("html").cast("long").alias("n"))


@query("""
SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', ' ', 'g'), ' +', ' ', 'g')) AS clean, left(s_name, 2) || repeat('*', length(s_name) - 4) || right(s_name, 2) AS masked, 'TK-' || upper(left(sha256('salt' || s_name), 16)) AS token FROM supplier
""")
def s_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, masked and pseudonymous names."""
    n = F.col("s_name")
    return table(spark, sf, "supplier").select("s_suppkey", texts.clean_field(n).alias("clean"), texts.mask(n).alias("masked"), texts.token(n, "salt").alias("token"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM w)
SELECT conv_id, turn, round(coalesce(len(list_intersect(w, q))::DOUBLE / nullif(len(list_distinct(list_concat(w, q))), 0), 0), 6) AS overlap FROM p WHERE q IS NOT NULL
""")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Word overlap of each turn with the one before."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(texts.words(F.col("text"))).alias("w"))
    p = w.withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q is not null")
    return p.select("conv_id", "turn", F.round(texts.jaccard(F.col("w"), F.col("q")), 6).alias("overlap"))


@query("""
SELECT a.vec_id, round(coalesce(list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 0), 0), 5) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) c
""")
def n_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every vector to vector 0."""
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("c")).limit(1)
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, isoyear(o_orderdate) || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders
""")
def d_period(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of a day."""
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", times.period(d, "quarter").alias("quarter"), times.period(d, "week").alias("week"), F.date_format(F.date_trunc("week", d), "yyyy-MM-dd").alias("monday"))
