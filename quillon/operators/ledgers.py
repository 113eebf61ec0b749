"""Hash ledgers: Merkle roots, blocks, verification."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType


def merkle(hashes: Column, levels: int) -> Column:
    """Root of an array of hashes of at most 2**levels: neighbours are hashed together, an odd last one with itself."""
    pair = lambda a: F.transform(F.sequence(F.lit(0), F.greatest((F.size(a) - 1), F.lit(0)), F.lit(2)), lambda i: F.sha2(F.concat(F.get(a, i), F.coalesce(F.get(a, i + 1), F.get(a, i))), 256))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), hashes, lambda a, _: F.when(F.size(a) > 1, pair(a)).otherwise(a)), 1)


def blocks(df: DataFrame, keys: list[str], order: list[str], content: Column, size: int) -> DataFrame:
    """Blocks of ``size`` rows of each series: keys, block, n, root."""
    rows = df.withColumn("_h", F.sha2(content, 256)).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    got = rows.groupBy(*keys, F.expr(f"(_i - 1) div {size}").alias("block")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda s: s["_h"]).alias("_hs"))
    return got.select(*keys, "block", "n", merkle(F.col("_hs"), max(1, (size - 1).bit_length())).alias("root"))


def linked(df: DataFrame, keys: list[str], order: list[str], root: str) -> DataFrame:
    """Each row with the hash of its predecessor's root and its own, and the link's hash."""
    before = F.lag(root).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("link", F.sha2(F.concat(F.coalesce(before, F.lit("")), F.col(root)), 256))


def broken(df: DataFrame, keys: list[str], order: list[str], root: str, link: str = "link") -> DataFrame:
    """Rows whose link does not follow from their root and the row before."""
    before = F.lag(root).over(Window.partitionBy(*keys).orderBy(*order))
    wanted = F.sha2(F.concat(F.coalesce(before, F.lit("")), F.col(root)), 256)
    return df.withColumn("_w", wanted).where(F.col(link) != F.col("_w")).drop("_w")


def mined(df: DataFrame, content: str, zeros: int = 2, most: int = 100_000) -> DataFrame:
    """``nonce`` and ``hash``: the first nonce whose hash begins with ``zeros`` zeros; nulls if there is none below ``most``.

    A search with no bound on its steps has no column expression; rows go through in Arrow batches.
    """

    @pandas_udf(StructType([StructField("nonce", LongType()), StructField("hash", StringType())]))
    def search(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = (None, None)
            for nonce in range(most if text is not None else 0):
                h = hashlib.sha256(f"{text}{nonce}".encode()).hexdigest()
                if h.startswith("0" * zeros):
                    found = (nonce, h)
                    break
            out.append(found)
        return pd.DataFrame(out, columns=["nonce", "hash"]).astype({"nonce": "Int64"})

    return df.withColumn("_m", search(content)).withColumns({"nonce": F.col("_m.nonce"), "hash": F.col("_m.hash")}).drop("_m")


def audited(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chain by chain: its blocks, those whose ``root`` is not their content's (``own``), and those whose ``link`` does not follow
    from the contents of theirs and the block before."""
    before = F.lag("own").over(Window.partitionBy(*keys).orderBy(*order))
    wanted = F.sha2(F.concat(F.coalesce(before, F.lit("")), F.col("own")), 256)
    seen = df.select(*keys, (F.col("root") != F.col("own")).alias("_r"), (F.col("link") != wanted).alias("_l"))
    return seen.groupBy(*keys).agg(F.count("*").alias("blocks"), F.count_if("_r").alias("bad_roots"), F.count_if("_l").alias("bad_links"))
