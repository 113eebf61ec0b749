"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all that the stage before it
kept. All but the last return the columns of documents; the last returns each document's tokens.

Rows are told apart by id and text: of rows that share both, a filtering stage keeps one at most where it removes copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, minhash, quality, radix
from quillon.llm.common import crc_fold, documents, forget, ids_serve, marked, stored, swept

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def _of(uids: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of ``uids`` whose key is in ``kept``, without the key."""
    return uids.join(kept.select(key), key, "left_semi").select([c for c in uids.columns if c != key])


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own, under a name that no column has; all its columns ride along."""
    key = "uid"
    while key in {c.lower() for c in docs.columns}:
        key = "_" + key
    if ids_serve(docs, "doc_id"):
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return stored(docs.withColumn(key, F.monotonically_increasing_id())), key


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled rows outside the held-out fold."""
    uids, key = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fitted(docs, labels, crc_fold("doc_id", 5) != 0)
    scores = quality.scored(uids, model, key)
    return _of(uids, key, scores.where(F.col("score") >= LEAST_QUALITY))


def by_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    uids, key = _numbered(docs)
    return _of(uids, key, radix.exact_duplicates(uids, key).where("kept"))


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    uids, key = _numbered(docs)
    return _of(uids, key, minhash.near_duplicates(uids, key).where("kept"))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    uids, key = _numbered(docs)
    found = decontaminate.contaminated(uids, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return _of(uids, key, found.where("n_hit = 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", by_quality), ("exact_dedup", by_copies), ("near_dedup", by_near_copies), ("decontamination", by_benchmark), ("bpe", tokens)]

#: The classifier, the components and the tokens are not expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote on its way is deleted once its result is stored."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        mark = marked()
        after = stored(stage(spark, docs, sf_dir))
        swept(mark, after)
        if k:
            forget(docs)
        docs = after
    return docs
