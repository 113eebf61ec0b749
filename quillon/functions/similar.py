"""Matching-blocks similarity of two texts, which no built-in expresses: Arrow batches, for pairs that are already blocked."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths; 1 for two empty texts, 0 if either is null."""
    known: dict[tuple, float] = {}

    def one(x, y) -> float:
        if x is None or y is None:
            return 0.0
        if x == y:
            return 1.0
        if (x, y) not in known:
            known[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def field_map(fields: DataFrame, dictionary: DataFrame, field: str = "field", k: int = 3, floor: float = 0.4) -> DataFrame:
    """(field, standard, score, rank): the ``k`` standards whose synonyms (standard, synonym; a small table) are most like a field's name."""
    from quillon.functions.texts import clean_field

    left = fields.select(field, clean_field(F.col(field)).alias("_c")).distinct()
    # the ratio is at most 2 min / (a + b) of the lengths, so most pairs need no look
    n, m = F.char_length("_c"), F.char_length("_s")
    met = left.crossJoin(F.broadcast(dictionary.select("standard", clean_field(F.col("synonym")).alias("_s")))).where(2 * F.least(n, m) >= floor * (n + m))
    best = met.withColumn("score", ratio("_c", "_s")).groupBy(field, "standard").agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(field).orderBy(F.desc("score"), "standard"))).where(F.col("rank") <= k)
