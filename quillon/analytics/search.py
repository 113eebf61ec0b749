"""Retrieval and readings of texts, each beside its SQL."""

from __future__ import annotations

import difflib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.analytics.derive import choice
from quillon.analytics.lake import WORDS
from quillon.analytics.registry import query, table
from quillon.functions import texts
from quillon.functions.similar import ratio
from quillon.operators import inverted, retrieval, stats
from quillon.sources.scratch import shared_dir


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(texts.words(F.col("text")))).alias("term"))


@query(f"""
WITH q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS term FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS len FROM d), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), a AS (SELECT avg(len) AS m FROM l),
s AS (SELECT query, doc_id, sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score FROM q JOIN t USING (term) JOIN l USING (doc_id), a GROUP BY ALL)
SELECT query, doc_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3
""")
def t_bm25_noidf(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents for each item by term frequencies and lengths alone."""
    d, queries = table(spark, sf, "documents"), _asked(spark, sf)
    lengths = d.select("doc_id", F.size(texts.words(F.col("text"))).alias("len"))
    got = retrieval.bm25(retrieval.asked_postings(d, "doc_id", F.col("text"), queries), queries, lengths, "doc_id", weigh=False).withColumn("order", F.round("score", 9))
    return stats.ranked(got, ["query"], "order", "doc_id", 3).select("query", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(f"""
WITH q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS term FROM benchmark), z AS (SELECT query, count(*) AS size FROM q GROUP BY 1), t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents)), n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT term, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM t, n GROUP BY term, n), s AS (SELECT query, doc_id, sum(idf) AS score, count(*) AS hits FROM q JOIN t USING (term) JOIN i USING (term) GROUP BY ALL)
SELECT query, doc_id, rank, round(score, 4) AS score, round(hits / size, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) JOIN z USING (query) WHERE rank <= 3
""")
def t_idf_sum(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents for each item by the summed weights of the terms they share, with the share of the item's terms."""
    got = retrieval.idf_sum(table(spark, sf, "documents"), "doc_id", F.col("text"), _asked(spark, sf)).withColumn("order", F.round("score", 9))
    return stats.ranked(got, ["query"], "order", "doc_id", 3).select("query", "doc_id", "rank", F.round("score", 4).alias("score"), F.round("overlap", 6).alias("overlap"))


INDEX_SQL = f"""
WITH q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS term FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS len FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), a AS (SELECT count(*) AS n, avg(len) AS m FROM l),
i AS (SELECT term, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM t, a GROUP BY term, n),
s AS (SELECT query, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score, count(*) AS matched FROM q JOIN t USING (term) JOIN i USING (term) JOIN l USING (doc_id), a GROUP BY ALL)
SELECT query, doc_id, rank::INT AS rank, matched, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5
"""


@query(INDEX_SQL)
def t_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents for each item from a stored inverted index, whose blocks that cannot matter are skipped."""
    at = f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}"
    inverted.build(table(spark, sf, "documents"), "doc_id", F.col("text"), at)
    found, _ = inverted.best(spark, at, _asked(spark, sf), 5)
    return found.select("query", F.col("doc").alias("doc_id"), "rank", "matched", F.round("score", 4).alias("score"))


# Fixed values of these queries: a few regulations, cases, questions and a glossary.
REGULATIONS = [("R1", "EU", "data", "data protection rules for personal data"), ("R2", "US", "data", "privacy act on personal records"), ("R3", "EU", "tax", "value added tax directive"), ("R4", "CN", "tax", "value added tax law and invoices"), ("R5", "US", "trade", "export control of goods")]
QUESTIONS = ["personal data rules", "value added tax invoices", "export of goods", "labour law"]


def _ratios(left: list[str], right: list[str]) -> str:
    return ", ".join(f"('{a}', '{b}', {difflib.SequenceMatcher(None, a, b).ratio()!r})" for a in left for b in right)


@query(f"""
WITH q AS (SELECT p_partkey, {choice('p_partkey', QUESTIONS)[1]} AS q, {choice('p_size', ['EU', 'US', '', ''])[1]} AS place FROM part), r AS (SELECT * FROM (VALUES {', '.join(map(str, REGULATIONS))}) AS t(id, place_, kind, d)), l AS (SELECT * FROM (VALUES {_ratios(QUESTIONS, [r[3] for r in REGULATIONS])}) AS t(q, d, r)),
m AS (SELECT p_partkey, id, len(list_intersect(string_split(q.q, ' '), string_split(r.d, ' '))) AS hits, len(list_distinct(list_concat(string_split(q.q, ' '), string_split(r.d, ' ')))) AS all_, l.r AS likeness FROM q JOIN r ON (place = '' OR place = place_) JOIN l ON l.q = q.q AND l.d = r.d), s AS (SELECT *, 2 * hits + hits / all_ + 3 * likeness AS score FROM m WHERE hits > 0)
SELECT p_partkey, id, hits::INT AS hits, round(score::DOUBLE, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score::DOUBLE, 9) DESC, id) AS rank FROM s) WHERE rank <= 2
""")
def t_search_boolean(spark: SparkSession, sf: str) -> DataFrame:
    """Regulations for each query by words in common, Jaccard and likeness, within its jurisdiction if it names one, the two best.
    Queries are few; they are searched once each and their answers meet the rows."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", QUESTIONS)[0]).alias("q"), F.expr(choice("p_size", ["EU", "US", "", ""])[0]).alias("place"))
    regs = spark.createDataFrame(REGULATIONS, "id string, place_ string, kind string, d string")
    asked = rows.select("q", "place").distinct()
    met = asked.crossJoin(F.broadcast(regs)).where("place = '' or place = place_")
    a, b = F.split("q", " "), F.split("d", " ")
    hits = F.size(F.array_intersect(a, b))
    scored = met.withColumn("hits", hits).where("hits > 0").withColumn("score", 2 * F.col("hits") + texts.jaccard(a, b) + 3 * ratio("q", "d"))
    best = stats.ranked(scored.withColumn("order", F.round("score", 9)), ["q", "place"], "order", "id", 2)
    return rows.join(best, ["q", "place"]).select("p_partkey", "id", "hits", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query()
def t_search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents for each benchmark item by words in common, Jaccard and likeness; two items in three ask in one language."""
    place = F.when(F.col("item_id") % 3 == 0, F.lit("en")).when(F.col("item_id") % 3 == 1, F.lit("de"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text", place.alias("place"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("place"))
    got = retrieval.searched(queries, docs)
    return got.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "hits", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


CASES = [("C1", "steel", "main", "revenue", "revenue recognition and customer checks"), ("C2", "retail", "growth", "revenue", "online sales revenue and returns"), ("C3", "steel", "growth", "related", "related party sales and prices"), ("C4", "retail", "main", "tax", "tax rates and refunds")]
INQUIRIES = ["how is revenue recognition done", "are related party prices fair", "why did tax refunds grow"]


@query(f"""
WITH q AS (SELECT p_partkey, {choice('p_partkey', INQUIRIES)[1]} AS q, {choice('p_partkey', ['steel', 'retail'])[1]} AS industry, {choice('p_size', ['main', 'growth', ''])[1]} AS board FROM part), c AS (SELECT * FROM (VALUES {', '.join(map(str, CASES))}) AS t(id, industry_, board_, kind, d)), l AS (SELECT * FROM (VALUES {_ratios(INQUIRIES, [c[4] for c in CASES])}) AS t(q, d, r)),
w AS (SELECT id, unnest(string_split(d, ' ')) AS t FROM c), tf AS (SELECT id, t, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT id, count(*) AS dl FROM w GROUP BY 1), df AS (SELECT t, ln((4 + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1), qs AS (SELECT q, t FROM (SELECT DISTINCT q, unnest(list_distinct(string_split(q, ' '))) AS t FROM q)),
b AS (SELECT q, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS bm, count(*) AS hits FROM qs JOIN tf USING (t) JOIN df USING (t) JOIN dl USING (id) GROUP BY ALL), z AS (SELECT q, count(*) AS n FROM qs GROUP BY 1),
s AS (SELECT p_partkey, c.id, 0.4 * coalesce(bm, 0) + 0.25 * l.r + 0.25 * coalesce(hits, 0) / z.n + CASE WHEN industry = industry_ THEN 0.3 ELSE 0 END + CASE WHEN board = board_ THEN 0.2 ELSE 0 END AS score FROM q CROSS JOIN c JOIN l ON l.q = q.q AND l.d = c.d JOIN z ON z.q = q.q LEFT JOIN b ON b.q = q.q AND b.id = c.id)
SELECT p_partkey, id, round(score::DOUBLE, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score::DOUBLE, 9) DESC, id) AS rank FROM s) WHERE rank <= 3
""")
def t_hybrid_case(spark: SparkSession, sf: str) -> DataFrame:
    """The three cases nearest to each inquiry: .4 BM25, .25 likeness, .25 share of its words, and more for the same industry and
    board. Each different inquiry is searched once."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", INQUIRIES)[0]).alias("q"), F.expr(choice("p_partkey", ["steel", "retail"])[0]).alias("industry"), F.expr(choice("p_size", ["main", "growth", ""])[0]).alias("board"))
    cases = spark.createDataFrame(CASES, "id string, industry_ string, board_ string, kind string, d string")
    asked = rows.select("q", "industry", "board").distinct()
    queries = asked.select(F.col("q").alias("query")).distinct().select("query", F.explode(F.array_distinct(F.split("query", " "))).alias("term"))
    lengths = cases.select("id", F.size(F.split("d", " ")).alias("len"))
    bm = retrieval.bm25(retrieval.postings(cases, "id", F.col("d")), queries, lengths, "id").select(F.col("query").alias("q"), "id", F.col("score").alias("bm"), "matched")
    met = asked.crossJoin(F.broadcast(cases)).join(bm, ["q", "id"], "left")
    words = F.size(F.array_distinct(F.split("q", " ")))
    same = F.when(F.col("industry") == F.col("industry_"), 0.3).otherwise(0.0) + F.when(F.col("board") == F.col("board_"), 0.2).otherwise(0.0)
    score = 0.4 * F.coalesce("bm", F.lit(0.0)) + 0.25 * ratio("q", "d") + 0.25 * F.coalesce("matched", F.lit(0)) / words + same
    best = stats.ranked(met.withColumn("score", score).withColumn("order", F.round("score", 9)), ["q", "industry", "board"], "order", "id", 3)
    return rows.join(best, ["q", "industry", "board"]).select("p_partkey", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


GLOSSARY = [{"en": "tax", "fr": "impôt", "de": "steuer"}, {"en": "audit", "fr": "contrôle", "de": "prüfung"}, {"en": "data", "fr": "données", "de": "daten"}]
REPORTS = [("D1", "en", "tax audit of the year"), ("D2", "de", "steuer und prüfung der daten"), ("D3", "fr", "le contrôle des données"), ("D4", "en", "ships and sails")]
SEARCHES = ["tax audit", "daten", "sails", "contrôle rapide"]


def _expanded(q: str) -> list[str]:
    more = [w for e in GLOSSARY for lang in sorted(e) if e[lang] in q for other, t in sorted(e.items()) if other != lang for w in t.split()]
    return list(dict.fromkeys([w for w in q.split(" ") if w] + more))


@query(f"""
WITH q AS (SELECT p_partkey, {choice('p_partkey', SEARCHES)[1]} AS q FROM part), h AS (SELECT * FROM (VALUES {', '.join(f"('{q}', '{d[0]}', {sum(w in d[2] for w in _expanded(q))}, {difflib.SequenceMatcher(None, q, d[2]).ratio()!r})" for q in SEARCHES for d in REPORTS)}) AS t(q, id, hits, r)), s AS (SELECT p_partkey, id, hits, hits + 2 * r AS score FROM q JOIN h USING (q) WHERE hits > 0)
SELECT p_partkey, id, hits::INT AS hits, round(score::DOUBLE, 6) AS score FROM s
""")
def t_cross_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Reports in any language for each search: its words and what a glossary has for them, and its likeness, twice."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(choice("p_partkey", SEARCHES)[0]).alias("q"))
    docs = spark.createDataFrame(REPORTS, "id string, lang string, d string")
    asked = rows.select("q").distinct().withColumn("words", retrieval.expanded(F.col("q"), GLOSSARY))
    met = asked.crossJoin(F.broadcast(docs)).withColumn("hits", F.size(F.filter("words", lambda w: F.col("d").contains(w)))).where("hits > 0")
    scored = met.withColumn("score", F.col("hits") + 2 * ratio("q", "d"))
    return rows.join(scored, "q").select("p_partkey", "id", "hits", F.round("score", 6).alias("score"))


STOP = ["the", "of", "and", "is", "in", "to", "le", "la", "de", "der", "die", "und"]


@query(f"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[。！？\\n.!?;；]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations), e AS (SELECT conv_id, turn, unnest(s) AS s, unnest(range(0, len(s))) AS pos FROM s),
t AS (SELECT conv_id, turn, pos, unnest(list_filter(regexp_extract_all(s, '[a-zA-Z]+|[0-9]+(?:\\.[0-9]+)?|[\\x{{4e00}}-\\x{{9fff}}]'), lambda w: lower(w) NOT IN ({', '.join(f"'{w}'" for w in STOP)}) AND (length(w) > 1 OR regexp_matches(w, '[\\x{{4e00}}-\\x{{9fff}}]')))) AS w FROM e),
f AS (SELECT conv_id, turn, w, count(*) AS f FROM t GROUP BY ALL), c AS (SELECT conv_id, turn, pos, sum(f) / count(*) AS score FROM t JOIN f USING (conv_id, turn, w) GROUP BY ALL), a AS (SELECT e.conv_id, e.turn, e.pos, coalesce(score, 0) AS score FROM e LEFT JOIN c USING (conv_id, turn, pos))
SELECT conv_id, turn, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, pos) AS k FROM a) WHERE k <= 2
""")
def t_textrank(spark: SparkSession, sf: str) -> DataFrame:
    """The two sentences of each turn whose words are the most frequent in it on average."""
    got = retrieval.ranked_sentences(table(spark, sf, "conversations"), ["conv_id", "turn"], F.col("text"), STOP)
    return got.select("conv_id", "turn", F.col("at").cast("long").alias("pos"), F.round("score", 6).alias("score"))


NEWS = choice("o_orderkey", ["fraud and lawsuit at the group", "record growth and an award", "a delay, then a complaint", "nothing new", "bankruptcy, fraud, lawsuit and penalty after growth"])
MOODS = [(-3.0, ["fraud", "bankruptcy"]), (-1.5, ["lawsuit", "penalty"]), (-0.5, ["delay", "complaint"]), (1.0, ["growth", "award"])]


@query(f"WITH n AS (SELECT o_orderkey, {NEWS[1]} AS t FROM orders) SELECT o_orderkey, greatest(-5, least(5, " + " + ".join(f"CASE WHEN contains(t, '{w}') THEN {k} ELSE 0 END" for k, some in MOODS for w in some) + "))::DOUBLE AS mood FROM n")
def t_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """The mood of a text: -3, -1.5 and -.5 for words by their weight, 1 for good ones, between -5 and 5."""
    return table(spark, sf, "orders").select("o_orderkey", retrieval.lexicon_score(F.expr(NEWS[0]), MOODS).alias("mood"))


@query(f"WITH n AS (SELECT o_orderkey, {NEWS[1]} AS t FROM orders), c AS (SELECT o_orderkey, len(regexp_extract_all(t, '\\b(growth|award)\\b')) AS p, len(regexp_extract_all(t, '\\b(fraud|lawsuit|bankruptcy)\\b')) AS n FROM n) SELECT o_orderkey, round(coalesce((p - n)::DOUBLE / nullif(p + n, 0), 0), 6) AS mood FROM c")
def t_sentiment_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Good words less bad ones, over both."""
    return table(spark, sf, "orders").select("o_orderkey", F.round(texts.lexicon_sentiment(F.expr(NEWS[0]), ["growth", "award"], ["fraud", "lawsuit", "bankruptcy"]), 6).alias("mood"))


POLICY = "All staff must report gifts. Personal data must be kept in the vault. Invoices shall be paid in thirty days."
DUTIES = ["Staff must report gifts.", "Ships must carry flags.", "Personal data shall be kept for ten years in the vault.", "Invoices may be late."]


def _words_of(t: str) -> set[str]:
    return set(re.findall(r"[一-鿿]{2,}|[A-Za-z]{3,}", t))


def _gaps() -> str:
    rows = [(d, len(_words_of(d) & _words_of(POLICY)) / max(len(_words_of(d)), 1), difflib.SequenceMatcher(None, d.lower(), POLICY.lower()).ratio()) for d in DUTIES]
    return ", ".join(f"('{d}', {c!r}, {r!r})" for d, c, r in rows)


@query(f"""
WITH d AS (SELECT o_orderkey, {choice('o_orderkey', DUTIES)[1]} AS d FROM orders), g AS (SELECT * FROM (VALUES {_gaps()}) AS t(d, coverage, r))
SELECT o_orderkey, round(coverage::DOUBLE, 6) AS coverage, CASE WHEN coverage < 0.1 AND r < 0.1 THEN 'missing' WHEN coverage < 0.5 OR r < 0.3 THEN 'partial' ELSE 'covered' END AS gap FROM d JOIN g USING (d) WHERE regexp_matches(d, 'must|shall')
""")
def t_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Duties against the policies in force: the share of their words that policies have, and whether they are covered. Each different
    duty is compared once."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(choice("o_orderkey", DUTIES)[0]).alias("d"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]{2,}|[A-Za-z]{3,}"), F.lit(0)))
    own = rows.select("d").distinct().where(texts.clause_kind(F.col("d")) == "obligation")
    share = F.size(F.array_intersect(words(F.col("d")), words(F.lit(POLICY)))) / F.greatest(F.size(words(F.col("d"))), F.lit(1))
    known = own.withColumn("coverage", share).withColumn("gap", retrieval.gap(F.col("coverage"), ratio(F.lower("d"), F.lower(F.lit(POLICY)))))
    return rows.join(known, "d").select("o_orderkey", F.round("coverage", 6).alias("coverage"), "gap")


STATEMENTS = choice("o_orderkey", ["we cut emissions", "output rose and emissions rose", "no waste at all", "waste was found", "all is well"])
AGAINST = [("cut emissions", "emissions rose"), ("no waste", "waste was found|spill")]


@query(f"""
WITH c AS (SELECT o_custkey, o_orderkey, {STATEMENTS[1]} AS t FROM orders), r AS (SELECT * FROM (VALUES (0, 'cut emissions', 'emissions rose'), (1, 'no waste', 'waste was found|spill')) AS t(rule, yes, no))
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, rule FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey CROSS JOIN r WHERE (regexp_matches(a.t, yes) AND regexp_matches(b.t, no)) OR (regexp_matches(b.t, yes) AND regexp_matches(a.t, no))
""")
def t_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of one customer that say opposite things by a rule's words."""
    c = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(STATEMENTS[0]).alias("t"))
    return retrieval.contradictions(c, "o_custkey", "o_orderkey", F.col("t"), AGAINST)


ASKED = choice("o_orderkey", ["What is fair value?", "steps to audit cash", "IFRS versus GAAP", "an example please", "is it required", "hello"])


@query(f"WITH q AS (SELECT o_orderkey, lower({ASKED[1]}) AS q FROM orders) SELECT o_orderkey, CASE " + " ".join(f"WHEN regexp_matches(q, '{m}') THEN '{n}'" for n, m in retrieval.INTENTS) + " ELSE 'general' END AS intent FROM q")
def t_intent(spark: SparkSession, sf: str) -> DataFrame:
    """What a question is after, by its words."""
    return table(spark, sf, "orders").select("o_orderkey", retrieval.intent(F.expr(ASKED[0])).alias("intent"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations), q AS (SELECT conv_id, w AS q FROM w WHERE turn = 0)
SELECT conv_id, turn, round(len(list_intersect(w, q)) / greatest(len(q), 1), 6) AS score FROM w JOIN q USING (conv_id) WHERE turn > 0 AND len(list_intersect(w, q)) > 0
""")
def t_cross_modal(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a store by the share of a query's words they hold; here a conversation's first turn asks for its others."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(texts.words(F.col("text"))).alias("w"))
    q = w.where("turn = 0").select("conv_id", F.col("w").alias("q"))
    both = F.size(F.array_intersect("w", "q"))
    return w.where("turn > 0").join(q, "conv_id").where(both > 0).select("conv_id", "turn", F.round(both / F.greatest(F.size("q"), F.lit(1)), 6).alias("score"))
