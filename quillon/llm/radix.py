"""Exact duplicates by distributed MSD radix partitioning.

A group is what rows have in common so far: at first nothing, then the first bytes of the blank-free text, then the bytes
after those. Each round splits every group by its next block of raw bytes and drops the groups of one; a row whose text
ends inside the block is done. The blocks widen sixteenfold a round up to 1 GB, so that even the longest texts take a few
rounds. Groups are compared byte for byte: digests are never compared, and text_sha256 is only reported.

Split counts are partial aggregates, never windows over a group, and are stored before the rows meet them: the join's sides
are then plain shuffles, whose large partitions adaptive execution splits, so a group of any size can be spread out.

Cases. Null text counts as empty, and so do blanks alone; all empty texts are one group. A null id ranks last among equals.
Repeated rows (same id, same text) all count in group_size, and exactly one of them has kept = true. Very long texts are
compared whole. An empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, stored

#: Bytes of the first block, how many times wider each next one is, and the widest (a position is a 32-bit number).
FIRST_BYTES, WIDER, WIDEST = 256, 16, 1 << 30


def normalised(text_col: str):
    """The text without blanks, as UTF-8 bytes."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary")


def _split(active: DataFrame, width: int) -> DataFrame:
    """Each row with its next block, what follows, and whether nothing does."""
    block = active.select("uid", "gid", F.substring("rest", 1, width).alias("block"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
    return block.withColumn("ended", F.octet_length("rest") == 0)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n"), normalised(text_col).alias("rest"))
    head = F.substring("rest", 1, FIRST_BYTES)
    shared = stored(rows.groupBy(head.alias("head")).agg(F.count("*").alias("m")).where("m > 1").select("head"))
    # the first round: texts that nobody shares the first bytes with need no further look
    first = rows.withColumn("head", head).join(shared.withColumn("hit", F.lit(True)), "head", "left")
    first = first.select(F.monotonically_increasing_id().alias("uid"), "id", "n", F.sha2("rest", 256).alias("text_sha256"), F.when(F.col("hit"), F.col("rest")).alias("rest"))
    base = stored(first)
    active = base.where("rest is not null").select("uid", F.lit(0).cast("long").alias("gid"), "rest")
    width, done = FIRST_BYTES, []
    while True:
        parts = _split(active, width)
        groups = stored(parts.groupBy("gid", "block", "ended").agg(F.min("uid").alias("next"), F.count("*").alias("m")).where("m > 1").drop("m"))
        kept = stored(parts.join(groups, ["gid", "block", "ended"]).select("uid", F.col("next").alias("gid"), "ended", "rest"))
        forget(groups)
        done.append(kept.where("ended").select("uid", "gid"))
        active = kept.where("not ended").select("uid", "gid", "rest")
        if active.isEmpty():
            break
        width = min(width * WIDER, WIDEST)
    members = done[0]
    for more in done[1:]:
        members = members.unionAll(more)
    members = members.join(base.select("uid", "id", "n"), "uid")
    best = members.groupBy("gid").agg(F.count("*").alias("group_size"), F.max(F.struct(F.col("n"), (-F.col("id")).alias("neg"), (-F.col("uid")).alias("neg_uid"))).alias("best"))
    best = best.select("gid", "group_size", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.neg_uid")).alias("keep_uid"))
    found = members.select("uid", "gid").join(best, "gid").select("uid", "group_size", "keep_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))
    out = base.select("uid", "id", "text_sha256").join(found, "uid", "left")
    alone = F.col("group_size").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"), "text_sha256")
