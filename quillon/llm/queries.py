"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, licences, minhash, paragraphs, prefixes, quality, radix, rules, sharding, suffixes, toxicity, whitening
from quillon.llm.common import crc_fold, documents


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


def op6_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_duplicates(documents(spark, sf_dir))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cps, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY cps DESC, doc_id)
"""


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encoded(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    both = bpe.decoded(tokens, path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(documents(spark, sf_dir), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_fold("doc_id", 4) == 2
    return _judged(toxicity.scored(docs, toxicity.fitted(docs, labels, ~held_out)), held_out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_fold("doc_id", 5) == 0
    return _judged(quality.scored(docs, quality.fitted(docs, labels, ~held_out)), held_out)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = """
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win), g AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n
"""


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_strings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.repeated_paragraphs(documents(spark, sf_dir))
    return found.select("doc_id", "n_paragraphs", F.size("spans").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"]))).alias("spans"), "repeats", F.sha2("kept", 256).alias("kept_sha256"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(documents(spark, sf_dir))
    return found.withColumn("families", F.concat_ws(",", "families"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.ruled(docs, rules.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefixes.prefix_trie(*prefixes.rebuilt(turns))


# paths as lists of turns' digests; a node is a distinct list, h a CRC-32 folded byte by byte
OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT c, list(g ORDER BY p) AS gs, list(n ORDER BY p) AS ns FROM t GROUP BY c
), h AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), list_transform(range(8), lambda z: z::BIGINT)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295::BIGINT) % 9 AS h FROM l
), r AS (
  SELECT h.c, CASE WHEN h.c = base THEN l.gs ELSE list_slice(coalesce(b.gs, []), 1, h) || list_slice(l.gs, h + 1, len(l.gs)) END AS gs,
         CASE WHEN h.c = base THEN l.ns ELSE list_slice(coalesce(b.ns, []), 1, h) || list_slice(l.ns, h + 1, len(l.ns)) END AS ns
  FROM h JOIN l ON l.c = h.c LEFT JOIN l b ON b.c = h.base
), o AS (
  SELECT c, d, array_to_string(list_slice(gs, 1, d), '') AS k, CASE WHEN d > 0 THEN array_to_string(list_slice(gs, 1, d - 1), '') END AS pk,
         CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(gs) AS last
  FROM (SELECT c, gs, ns, unnest(range(0, len(gs) + 1)) AS d FROM r)
), m AS (
  SELECT d, k, min(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM o GROUP BY d, k
), ch AS (SELECT pk, count(*) AS n_children FROM m WHERE d > 0 GROUP BY pk
), x AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch ON ch.pk = m.k
), s AS (
  SELECT u.k, sum((v.n_convs - 1) * v.n)::BIGINT AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT u.k, v.k AS vk FROM o u JOIN o v ON u.c = v.c AND v.d >= u.d) u JOIN x v ON v.k = u.vk GROUP BY u.k
)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON s.k = x.k LEFT JOIN m p ON p.k = x.pk
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert": op1_hilbert,
    "op2_bpe": op2_bpe,
    "op3_minhash": op3_minhash,
    "op4_paragraphs": op4_paragraphs,
    "op5_toxicity": op5_toxicity,
    "op6_radix": op6_radix,
    "op7_decontaminate": op7_decontaminate,
    "op8_licences": op8_licences,
    "op9_quality": op9_quality,
    "op10_suffixes": op10_suffixes,
    "op11_rules": op11_rules,
    "op12_prefixes": op12_prefixes,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {"op3_minhash": OP3_SQL, "op6_radix": OP6_SQL, "op7_decontaminate": OP7_SQL, "op12_prefixes": OP12_SQL}
