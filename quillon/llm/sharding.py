"""Sharding along a Hilbert curve, in DataFrame operations alone.

Source, language and size are quantised to a few bits each, in their own order: a category's slot is its place among cuts
through the sorted values (of at most CATEGORIES values, those with the smallest hashes), so that up to 2**BITS values have a
slot each and more share one with their neighbours. The curve's index orders the cells, so that rows alike in all three lie
together and a file's minima and maxima prune on any of them. The order is cut into runs whose row counts differ
by one at most (law ``rows``).

Places in the order come without a global sort: a histogram over (cell, slice of the text's crc32, slice of the id's hash)
is at most 2**(3 * BITS + 8) rows whatever the data; its running sum gives each bin's first place, and rows are numbered
inside their bin, where they are already together: the bins' places meet them without another shuffle. A cell that holds a third of all rows is spread over 256 bins, equal texts over 16.

Cases. Null text: size 1, crc32 of no bytes. Null source or language: a value of its own. Repeated rows lie side by side
(those with the same id in any order). Very long texts count whole. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

BITS, CATEGORIES, FILE_BYTES = 4, 4096, 256 << 20


def curve(bits: int, dims: int) -> list[int]:
    """Hilbert index of every cell, the cell's number being its coordinates' bits one after another."""
    table = []
    for cell in range(1 << (bits * dims)):
        x = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:  # undo the turns of each subcube, largest first
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | (v >> b & 1)
        table.append(index)
    return table


def _category(docs: DataFrame, name: str, bits: int) -> Column:
    """The slot of a category: how many of the cuts through the sorted values are not above it. Null is the lowest."""
    value = F.coalesce(F.col(name).cast("string"), F.lit("\0"))
    # at most CATEGORIES values are collected
    values = sorted(r[0] for r in docs.select(value.alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(CATEGORIES).collect())
    slots = min(1 << bits, len(values))
    return sum((F.when(value >= values[len(values) * i // slots], 1).otherwise(0) for i in range(1, slots)), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, str] = ("source", "lang"), bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, curve index, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    log_size = F.least(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit(2 ** (bits + 1) - 1))
    parts = [*(_category(docs, c, bits) for c in category_cols), F.shiftright(log_size, 1)]
    cell = parts[0]
    for part in parts[1:]:
        cell = cell * (1 << bits) + part
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("cell"), F.xxhash64(F.col(id_col)).alias("mix"))
    table = F.array(*[F.lit(i) for i in curve(bits, 1 + len(category_cols))])
    bin_ = [F.element_at(table, F.col("cell") + 1).alias("index"), F.shiftright("text_crc32", 28).cast("int").alias("slice"), F.shiftrightunsigned("mix", 60).cast("int").alias("part")]
    rows = stored(rows.select("id", "size", "text_crc32", "mix", *bin_))
    counts = rows.groupBy("index", "slice", "part").agg(F.count("*").alias("m"))
    bins = ["index", "slice", "part"]
    # at most 2**20 rows, by the number of bins: cells first, then the bins of each cell
    cells = counts.groupBy("index").agg(F.sum("m").alias("cm"))
    upto = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("index", F.coalesce(F.sum("cm").over(upto), F.lit(0)).alias("cell_first"), F.sum("cm").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("index").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(F.broadcast(cells), "index").select(*bins, (F.col("cell_first") + F.coalesce(F.sum("m").over(inside), F.lit(0))).alias("first"), "total")
    own = Window.partitionBy(*bins).orderBy("text_crc32", "mix", "id")
    placed = rows.withColumn("nth", F.row_number().over(own)).join(firsts.hint("merge"), bins)
    place = F.col("first") + F.col("nth") - 1
    placed = placed.withColumn("place", place).withColumn("shard", F.expr(f"int(place * {shards} div total)"))
    slot = F.expr(f"place - (shard * total + {shards - 1}) div {shards}")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("index").alias("curve_index"), "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", file_bytes: int = FILE_BYTES, **how) -> None:
    """The rows of ``docs``, unique by id, as one folder a shard, in files of some ``file_bytes`` of text, each a run of the curve."""
    placed = hilbert_shards(docs, shards, id_col, **how)
    total = placed.agg(F.sum("size")).first()[0] or 0
    placed = placed.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = docs.join(placed, docs[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    out = out.repartitionByRange(max(shards, -(-total // file_bytes)), "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out.drop("_slot").write.partitionBy("_shard").parquet(path)
