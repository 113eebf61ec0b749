"""Retrieval over a postings table (doc, term, tf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.similar import ratio
from quillon.functions.texts import words
from quillon.operators.stats import ranked as top
from quillon.sources.scratch import cut


def postings(docs: DataFrame, id_: str, text: Column) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_, F.explode(words(text)).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("tf"))


def idf(index: DataFrame, n: DataFrame, id_: str) -> DataFrame:
    """(term, df, idf) with ln((n + 1) / (df + 1)) + 1; ``n`` is one row with a column n."""
    return index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def bm25(index: DataFrame, queries: DataFrame, lengths: DataFrame, id_: str, k1: float = 1.5, b: float = 0.75, weigh: bool = True) -> DataFrame:
    """(query, id, score, matched) of every document with a query term. ``queries`` is (query, term); ``lengths`` (id, len);
    ``index`` best comes from ``asked_postings``, which lets other words go before the shuffle."""
    about = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    met = index.join(queries, "term")
    weights = idf(met.select(id_, "term").distinct(), about.select("n"), id_).select("term", "idf")
    met = met.join(weights, "term").join(lengths, id_).crossJoin(F.broadcast(about.select("mean_len")))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return met.groupBy("query", id_).agg(F.sum(part * F.col("idf") if weigh else part).alias("score"), F.count("*").alias("matched"))


def searched(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query, id, hits, score, rank): the ``k`` documents (id, text, place) with the highest 2 hits + Jaccard + 3 likeness for each of
    ``queries`` (query, text, place), ties by id; hits are different words in common, one at least. A query with a place asks for
    documents of that place only, one without (null) for all. A null text has no words. Exact.

    The first two terms come from words that meet by key. The likeness is at most twice the shorter length over both, which bounds
    what a document can still reach; texts are only fetched and compared where that is not below the k-th sum known for sure.
    """
    texts_of = lambda df: F.array_distinct(words(F.coalesce("text", F.lit(""))))
    asked = queries.select("query", "place", F.char_length("text").alias("_ql"), texts_of(queries).alias("_w")).withColumn("_qn", F.size("_w"))
    terms = asked.select("query", F.col("place").alias("_place"), "_ql", "_qn", F.explode("_w").alias("term"))
    own = docs.select("id", "place", F.char_length("text").alias("_dl"), texts_of(docs).alias("_w")).withColumn("_dn", F.size("_w"))
    wanted = terms.select("term").distinct()
    few = wanted.limit(TERMS + 1).count() <= TERMS
    held = own.select("id", "place", "_dl", "_dn", F.explode("_w").alias("term")).join(F.broadcast(wanted) if few else wanted, "term")
    met = held.join(terms, "term").where(F.col("_place").isNull() | (F.col("_place") == F.col("place")))
    pairs = met.groupBy("query", "id", "_ql", "_qn", "_dl", "_dn").agg(F.count("*").cast("int").alias("hits"))
    sure = 2 * F.col("hits") + F.col("hits") / (F.col("_qn") + F.col("_dn") - F.col("hits"))
    most = 6 * F.least("_ql", "_dl") / (F.col("_ql") + F.col("_dl"))
    pairs = cut(pairs.select("query", "id", "hits", sure.alias("_sure"), (sure + most + 1e-9).alias("_most")))
    kth = top(pairs, ["query"], "_sure", "id", k).groupBy("query").agg(F.min("_sure").alias("_kth"), F.count("*").alias("_n"))
    open_ = pairs.join(kth, "query").where((F.col("_most") >= F.col("_kth")) | (F.col("_n") < k)).select("query", "id", "hits", "_sure")
    both = open_.join(docs.select("id", F.col("text").alias("_d")), "id").join(queries.select("query", F.col("text").alias("_q")), "query")
    scored = both.select("query", "id", "hits", (F.col("_sure") + 3 * ratio("_q", "_d")).alias("score")).withColumn("_order", F.round("score", 9))
    return top(scored, ["query"], "_order", "id", k).drop("_order")


def keyword_class(docs: DataFrame, id_: str, text: Column, lexicon: dict[str, list[str]]) -> DataFrame:
    """(id, label, hits, confidence): the class with most keyword hits (ties: first by name), and its share of all hits."""
    names = sorted(lexicon)
    hits = [F.regexp_count(text, F.lit("(?i)\\b(" + "|".join(lexicon[c]) + ")\\b")).alias(f"h{k}") for k, c in enumerate(names)]
    rows = docs.select(id_, *hits)
    cols = [F.col(f"h{k}") for k in range(len(names))]
    top, total = F.greatest(*cols), sum(cols[1:], cols[0])
    label = F.coalesce(*[F.when((top > 0) & (c == top), F.lit(n)) for c, n in zip(cols, names, strict=True)], F.lit("none"))
    return rows.select(id_, label.alias("label"), top.alias("hits"), F.coalesce(F.try_divide(top.cast("double"), total.cast("double")), F.lit(0.0)).alias("confidence"))


#: Terms of queries up to which they are broadcast; each takes some hundred bytes.
TERMS = 500_000


def asked_postings(docs: DataFrame, id_: str, text: Column, queries: DataFrame) -> DataFrame:
    """(id, term, tf) of the terms that ``queries`` (query, term) ask for: other words leave before anything is shuffled, as long as
    the terms are no more than TERMS; beyond it the same join shuffles."""
    terms = queries.select("term").distinct()
    few = terms.limit(TERMS + 1).count() <= TERMS
    return docs.select(id_, F.explode(words(text)).alias("term")).join(F.broadcast(terms) if few else terms, "term").groupBy(id_, "term").agg(F.count("*").alias("tf"))


def idf_sum(docs: DataFrame, id_: str, text: Column, queries: DataFrame) -> DataFrame:
    """(query, id, score, overlap): the sum of the weights of the query's terms that a document holds, and their share of the query."""
    index = asked_postings(docs, id_, text, queries)
    weights = idf(index, docs.agg(F.count("*").alias("n")), id_).select("term", "idf")
    sizes = queries.groupBy("query").agg(F.countDistinct("term").alias("_size"))
    met = index.join(queries.distinct(), "term").join(weights, "term").groupBy("query", id_).agg(F.sum("idf").alias("score"), F.count("*").alias("_hits"))
    return met.join(sizes, "query").select("query", id_, "score", (F.col("_hits") / F.col("_size")).alias("overlap"))


def expanded(query: Column, glossary: list[dict[str, str]]) -> Column:
    """The words of a query, with what a glossary has for its terms in other languages."""
    more = [F.when(F.lower(query).contains(entry[lang]), F.array(*[F.lit(w) for other, t in sorted(entry.items()) if other != lang for w in t.split()])) for entry in glossary for lang in sorted(entry)]
    own = F.filter(F.split(F.lower(query), " "), lambda w: w != "")
    return F.array_distinct(F.concat(own, *[F.coalesce(m, F.array().cast("array<string>")) for m in more]))


def ranked_sentences(docs: DataFrame, keys: list[str], text: Column, stop: list[str], k: int = 2) -> DataFrame:
    """(keys, at, score) of the ``k`` sentences of each text with the largest mean frequency of their words, ties to the first; at
    counts from 0. Single Latin letters and digits and stop words are left out."""
    parts = F.filter(F.transform(F.split(text, "[。！？\\n.!?;；]+"), lambda x: F.trim(x)), lambda s: s != "")
    sentences = docs.select(*keys, F.posexplode(parts).alias("at", "s"))
    token = F.regexp_extract_all("s", F.lit("[a-zA-Z]+|[0-9]+(?:\\.[0-9]+)?|[\\u4e00-\\u9fff]"), F.lit(0))
    keep = F.filter(token, lambda t: ~F.lower(t).isin(*stop) & ((F.char_length(t) > 1) | t.rlike("[\\u4e00-\\u9fff]")))
    tokens = sentences.select(*keys, "at", F.explode_outer(keep).alias("t"))
    freq = tokens.where("t is not null").groupBy(*keys, "t").agg(F.count("*").alias("f"))
    scored = tokens.join(freq, [*keys, "t"], "left").groupBy(*keys, "at").agg((F.coalesce(F.sum("f"), F.lit(0)) / F.greatest(F.count("t"), F.lit(1))).alias("score"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "at"))
    return scored.withColumn("_k", nth).where(F.col("_k") <= k).drop("_k")


def contradictions(claims: DataFrame, subject: str, id_: str, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """(subject, a, b, rule): claims of a subject of which one has a rule's word and the other a word against it. Only claims with
    such words meet."""
    flags = [F.struct(F.lit(k).alias("rule"), text.rlike(yes).alias("has"), text.rlike(no).alias("not")) for k, (yes, no) in enumerate(rules)]
    long = claims.select(subject, id_, F.explode(F.array(*flags)).alias("x")).select(subject, id_, "x.*").where("has or `not`")
    left = long.where("has").select(subject, "rule", F.col(id_).alias("x"))
    right = long.where("`not`").select(subject, "rule", F.col(id_).alias("y"))
    return left.join(right, [subject, "rule"]).where("x <> y").select(subject, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "rule").distinct()


def gap(coverage: Column, likeness: Column) -> Column:
    """Missing, partial or covered, by the share of its words that policies have and its likeness to them."""
    return F.when((coverage < 0.1) & (likeness < 0.1), "missing").when((coverage < 0.5) | (likeness < 0.3), "partial").otherwise("covered")


INTENTS = [("comparison", "difference|versus|better|对比|区别"), ("procedure", "steps|how to|procedure|如何|步骤"), ("definition", "what is|define|meaning|什么是|定义"), ("case", "case|example|案例"), ("standard", "standard|must|required|规定|标准")]


def intent(query: Column) -> Column:
    """The first intent whose words a query has, else general."""
    out = F.lit("general")
    for name, marks in reversed(INTENTS):
        out = F.when(F.lower(query).rlike(marks), name).otherwise(out)
    return out


def lexicon_score(text: Column, levels: list[tuple[float, list[str]]], low: float = -5.0, high: float = 5.0) -> Column:
    """The weights of the words that a text holds, each once, clamped."""
    total = F.lit(0.0)
    for weight, some in levels:
        for w in some:
            total = total + F.when(F.lower(text).contains(w), weight).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(low)), F.lit(high))
