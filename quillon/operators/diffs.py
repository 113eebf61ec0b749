"""What changed between two texts, line by line."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.diffs import hunks

HUNKS = "hunk int, a_from int, a_to int, b_from int, b_to int, gone array<string>, come array<string>"


def _diffed(n: int):
    def work(batches):
        for batch in batches:
            out, rows = [], []
            for r, (a, b) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                for k, (i, j, p, q) in enumerate(hunks(a or [], b or [])):
                    rows.append(r)
                    out.append((k, i, j, p, q, a[i:j] if a else [], b[p:q] if b else []))
            kinds = [pa.int32()] * 5 + [pa.list_(pa.string())] * 2
            columns = list(zip(*out, strict=True)) or [[]] * 7
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(n)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [*batch.schema.names[:n], "hunk", "a_from", "a_to", "b_from", "b_to", "gone", "come"])

    return work


def line_diff(pairs: DataFrame, keys: list[str], a: str, b: str, apart: str = "\n") -> DataFrame:
    """(keys, hunk, a_from, a_to, b_from, b_to, gone, come): the hunks of a shortest script from text ``a`` to text ``b``, lines counted
    from 0. Equal texts, nearly always many, have no hunks and reach no Python. A null text has no lines."""
    lines = lambda c: F.when(F.col(c).isNotNull(), F.split(F.col(c), apart))
    rows = pairs.where(~F.col(a).eqNullSafe(F.col(b))).select(*keys, lines(a).alias("_a"), lines(b).alias("_b"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(_diffed(len(keys)), f"{kinds}, {HUNKS}")
