"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

The sets to be contained are the items' windows of consecutive words. Words are ordered by rarity over the whole corpus; a
window lies in a text only if the text has the window's rarest word, which is the whole prefix that containment at 100 %
needs. The corpus's words meet those prefix words in one join; a match fixes where the window would begin, length and
position bound it, and the words there must equal the window's. A window with a word that the corpus lacks is out at once.

Benchmark tables are broadcast after their bytes have been summed and found within ``broadcast_bytes``. Beyond that the joins
shuffle: words travel without their text, and only places that fit by word and position meet their text again.

Cases. Null or empty texts have no words and are not contaminated; null or empty items have no window. An item with a null
id marks words but is not listed. Items with one id count once. Repeated rows give equal results. Texts are read whole.
Empty tables on either side give no hits. Columns besides ids and texts are not read, so their names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored

APART = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` does just that where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, APART), "")


def _bounded(table: DataFrame, size: Column, most: int) -> tuple[DataFrame, bool]:
    """``table``, to be broadcast if its rows are within ``most`` bytes, and whether they are."""
    total = table.agg(F.sum(size + 64)).first()[0] or 0
    return (F.broadcast(table), True) if total <= most else (table, False)


def windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(window, item_ids) of every distinct window of ``n`` words; of a shorter item, all its words."""
    words = items.select(F.col(id_col).cast("string").alias("item"), _words(lowered(F.col(text_col).cast("string"))).alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(begins, lambda i: F.slice("words", i, n))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, item_ids (sorted), and spans, the hit words as a sorted array."""
    text = F.col(text_col).cast("string")
    key = [F.col(id_col).alias("id"), F.xxhash64(text).alias("h")]
    wanted = windows(items, item_col, item_text_col, n)
    vocabulary, bounded = _bounded(wanted.select(F.explode("window").alias("word")).distinct(), F.octet_length("word"), broadcast_bytes)
    corpus = docs.select(F.explode_outer(_words(lowered(text))).alias("word"))
    counts = corpus.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("times"))
    # one row a word of the vocabulary, so within the same bound
    ranked = wanted.select("window", "items", F.posexplode("window").alias("off", "word")).join(F.broadcast(counts) if bounded else counts, "word", "left")
    ranked = ranked.groupBy("window", "items").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "off")).alias("rare")).where("rare.times > 0")
    # read once more below; small, and each read would count the corpus again
    ranked = stored(ranked.select(F.col("rare.word").alias("prefix"), F.col("rare.off").alias("off"), F.size("window").alias("n"), "window", "items"))
    joined, bounded = _bounded(ranked, F.expr("octet_length(concat_ws(' ', window)) + 24 * size(window) + 32 * size(items)"), broadcast_bytes)
    texts = docs.select(*key, _words(lowered(text)).alias("words"))
    begin = F.col("pos") - F.col("off")
    inside = (F.col("word") == F.col("prefix")) & (begin >= 0) & (begin + F.col("n") <= F.col("size"))
    same = F.slice("words", F.when(begin < 0, 1).otherwise(begin + 1), F.col("n")) == F.col("window")
    if bounded:
        placed = texts.select("id", "h", "words", F.size("words").alias("size"), F.posexplode("words").alias("pos", "word"))
        hits = placed.join(joined, inside & same)
    else:  # words travel without their text; what fits its position meets the text's words again
        placed = texts.select("id", "h", F.size("words").alias("size"), F.posexplode("words").alias("pos", "word"))
        near = placed.join(joined, inside).select(F.col("id").alias("nid"), F.col("h").alias("nh"), "pos", "off", "n", "window", "items").distinct()
        hits = texts.join(near, F.col("id").eqNullSafe(F.col("nid")) & F.col("h").eqNullSafe(F.col("nh"))).where(same)
    hits = hits.select("id", "h", F.sequence(begin, begin + F.col("n") - 1).alias("span"), "items")
    found = hits.groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("span")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    found = found.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "spans", "item_ids")
    sizes = docs.select(*key, F.coalesce(F.size(_words(text)), F.lit(0)).cast("long").alias("n_words"))
    sizes = sizes.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    out = sizes.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce(F.size("spans"), F.lit(0)).alias("size"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans")).select(id_col, "n_words", F.greatest("size", F.lit(0)).cast("long").alias("n_hit"), "item_ids", "spans")
