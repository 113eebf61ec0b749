"""Substring dedup by a prefix filter on the shingles of paragraphs.

A text's paragraphs are its lines; a line longer than LONGEST words is cut at sentence ends into pieces of CUT words or
more. Paragraphs of LEAST words or more enter: equal word sequences are one class. Classes meet by the smallest fifth of the
hashes of their five-word shingles: sets at the threshold of 0.8 share one of those, so no pair is missed, and sets have fewer
of them than bands that would miss next to none. Pairs are verified by exact Jaccard, and components are clusters of one
passage. Of a cluster the first occurrence (smallest document id, then place) stays; the others are removed.

A passage spliced into the middle of other text is no paragraph of its own, and its surroundings keep the Jaccard of the
whole low. So every run of RUN words or more that occurred before, wherever it stands, is removed to its full length, word
by word: a word goes if one of the windows of RUN words around it is not the first of its kind (by document id, then
place). Each window chooses the least by hash of its seeds (stretches of SEED words), so equal windows meet at equal seeds,
and no run is missed whatever its marks and surroundings. Only windows at seeds that stand in unlike surroundings are
compared one by one. Words are equal by their letters, lower-cased; runs may cross lines. Shorter runs stay, however often
they occur. Of a text that repeats itself within a window, one period stays.

Cases. Null or empty text has no paragraph and is returned as it is (null as empty). Shorter paragraphs always stay. Repeats
inside one document count. Repeated rows are documents of their own: ids that repeat or are null still give one row each.
Very long texts are read whole. An empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Ranges, chunks, firsts, forget, mixed, small_batches, stored, utf8, with_uid, words_of
from quillon.llm.minhash import _prefixer, classes_of, repeated_classes

LEAST, LONGEST, CUT = 20, 200, 40
SHINGLE, PERCENT = 5, 80
#: Words of the shortest run that counts, and of a seed; a run holds RUN - SEED + 1 seeds or more, and the least is chosen.
RUN, SEED = 25, 13

_SENTENCE = np.zeros(256, bool)
_SENTENCE[list(b".!?")] = True


def pieces(data: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(row, begin byte, end byte, begin, end by code points in the row) of every paragraph with ``least`` words or more."""
    begin, end, row = words_of(data, at)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 5
    line = np.cumsum(data == 10)[begin]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(begin)))
    cuts = [first]
    for f, n in zip(first[size > LONGEST].tolist(), size[size > LONGEST].tolist(), strict=True):
        ends = np.flatnonzero(_SENTENCE[data[end[f : f + n] - 1]]) + 1
        own, last = [], 0
        for k in ends[(ends >= CUT) & (n - ends >= CUT)].tolist():
            if k - last >= CUT:
                own.append(f + k)
                last = k
        cuts.append(np.array(own, np.int64))
    first = np.sort(np.concatenate(cuts))
    last = np.append(first[1:], len(begin)) - 1
    full = last - first + 1 >= least
    a, b = begin[first[full]], end[last[full]]
    point = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
    own = row[first[full]]
    start = np.where(at[own] > 0, point[at[own] - 1], 0)
    return own, a, b, point[a] - 1 - start, point[b - 1] - start


def _cutter(least: int):
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            uids = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                own = data[offsets[i] : offsets[j]]
                row, a, b, begin, end = pieces(own, offsets[i : j + 1] - offsets[i], least)
                if len(row):
                    whole = own.tobytes()
                    text = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][row]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string())], ["uid", "begin", "end", "text"])

    return cut


def _least_of(v: np.ndarray, n: int) -> np.ndarray:
    """Where the (first) least of ``v[i : i + n]`` is, for every i."""
    at, width = np.arange(len(v)), 1
    while width < n:
        step = min(width, n - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(v[left] <= v[right], left, right)
        width += step
    return at


def _read_words(data: np.ndarray, at: np.ndarray):
    """Of the bytes of some texts: word hashes, rows, each word's number in its row, begins and ends by code points."""
    own = LOWER[data]
    begin, end, row = words_of(own, at)
    if not len(begin):
        return None
    point = np.cumsum((own & 0xC0) != 0x80) - 1  # code point of each byte
    start = point[at[:-1].clip(max=len(own) - 1)]
    first = np.searchsorted(row, np.arange(len(at)))
    return Ranges(own).of(begin, end), row, np.arange(len(begin)) - first[row], point[begin] - start[row], point[end - 1] + 1 - start[row]


def _leads(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Whether each value is the first of its kind in its row."""
    new, order = firsts(row, values, n)
    lead = np.zeros(len(row), bool)
    lead[order[new]] = True
    return pa.array(lead)


_SEED = "uid long, w int, n int, begin int, end int, key long, whole long, lead boolean, own boolean"


def _seeder(batches):
    """Of every seed (key) and the n words from w of all windows that choose it: _SEED; lead and own say whether it is its
    document's first with that key, and with that key and whole."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        uids = batch.column(0).to_numpy()
        for i, j in chunks(offsets):
            read = _read_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if read is None or len(read[0]) < RUN:
                continue
            h, row, nth, begin, end = read
            ranges = Ranges(mixed(h))
            chosen = _least_of(seeds := ranges.every(SEED), RUN - SEED + 1)
            inside = row[: len(chosen)] == row[RUN - 1 :]
            windows = np.flatnonzero(inside)
            if not len(windows):
                continue
            seed = chosen[windows]
            new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (np.diff(windows) != 1)]))
            low, high = windows[new], windows[np.append(new[1:], len(windows)) - 1] + RUN
            seed = seed[new]
            with np.errstate(over="ignore"):
                whole = mixed(ranges.of(low, high) + (seed - low).astype(np.uint64))
                key = seeds[seed]
                both = mixed(key) + whole
            r = row[low]
            leads = [_leads(r, key, j - i), _leads(r, both, j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][r]), pa.array(nth[low].astype(np.int32)), pa.array((high - low).astype(np.int32)), pa.array(begin[low].astype(np.int32)), pa.array(end[high - 1].astype(np.int32)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), *leads], ["uid", "w", "n", "begin", "end", "key", "whole", "lead", "own"])


def _windower(batches):
    """(uid, w, n, begin, end, key, half, lead) of every window of RUN words in the ranges asked for; two identifiers, of all
    its words and of its first half, tell windows apart; lead says whether it is its document's first."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        uids, asked = batch.column(0).to_numpy(), batch.column(2)
        for i, j in chunks(offsets):
            read = _read_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if read is None:
                continue
            h, row, nth, begin, end = read
            first = np.searchsorted(row, np.arange(j - i))
            at = [np.arange(first[r] + x["w"], first[r] + x["w"] + x["n"] - RUN + 1) for r, own in enumerate(asked.slice(i, j - i).to_pylist()) for x in own]
            at = np.sort(np.concatenate(at))
            of = Ranges(mixed(h)).of
            key, half = of(at, at + RUN), of(at, at + RUN // 2)
            with np.errstate(over="ignore"):
                lead = _leads(row[at], mixed(key) + half, j - i)
            yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][row[at]]), pa.array(nth[at].astype(np.int32)), pa.array(np.full(len(at), RUN, np.int32)), pa.array(begin[at].astype(np.int32)), pa.array(end[at + RUN - 1].astype(np.int32)), pa.array(key.view(np.int64)), pa.array(half.view(np.int64)), lead], ["uid", "w", "n", "begin", "end", "key", "half", "lead"])


def _marked(rows: DataFrame, *keys: str) -> DataFrame:
    """Those of ``rows`` whose keys occur again, and whether each is ``first`` of them."""
    one = stored(rows.groupBy(*keys).agg(F.count("*").alias("m"), F.min("uid").alias("one")).where("m > 1").select(*keys, "one"))
    return rows.join(one.hint("shuffle_hash"), [*keys]).withColumn("first", (F.col("uid") == F.col("one")) & F.col("lead")).drop("one")


def _spliced(texts: DataFrame) -> DataFrame:
    """(uid, begin, end, first) of the runs that windows of RUN words make which occurred before; where ``first``, no run
    but a text that holds the first occurrence of such a window."""
    seeds = stored(texts.mapInArrow(_seeder, _SEED))
    # what repeats is stored before the rows meet it: a seed that many texts share can then be split over tasks; the first of
    # a kind is its smallest document's own first, so sums of plain numbers tell it, without sorting structs
    again = stored(seeds.groupBy("key").agg(F.count("*").alias("m"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.min("uid").alias("one")).where("m > 1").select("key", F.expr("low = high").alias("alike"), "one"))
    first = ((F.col("uid") == F.col("one")) & F.col("lead")).alias("first")
    met = stored(seeds.join(again.hint("shuffle_hash"), "key").select("uid", "w", "n", "begin", "end", "key", "whole", "own", "alike", first))
    for used in (seeds, again):
        forget(used)
    span = ["uid", "w", "n", "begin", "end", "first"]
    same = met.where("alike").select(span)
    # a seed in unlike surroundings: what is alike as a whole is settled, and one of each kind is read window by window
    unlike = met.where("not alike").select("uid", "w", "n", "begin", "end", "key", "whole", "own")
    least = F.when(F.col("own"), F.col("uid"))
    kinds = stored(unlike.groupBy("key", "whole").agg(F.count("*").alias("m"), F.min("uid").alias("one"), F.min_by("w", least).alias("w"), F.min_by("n", least).alias("n")))
    several = kinds.where("m > 1").select("key", "whole", "one")
    copies = unlike.join(several.hint("shuffle_hash"), ["key", "whole"]).withColumn("first", (F.col("uid") == F.col("one")) & F.col("own")).select(span)
    asked = kinds.select(F.col("one").alias("uid"), "w", "n").groupBy("uid").agg(F.collect_list(F.struct("w", "n")).alias("asked"))
    windows = stored(texts.join(asked.hint("shuffle_hash"), "uid").select("uid", "text", "asked").mapInArrow(_windower, "uid long, w int, n int, begin int, end int, key long, half long, lead boolean"))
    every = stored(same.unionAll(copies).unionAll(_marked(windows, "key", "half").select(span)))
    by = Window.partitionBy("uid").orderBy("w", "n")
    before = F.max(F.col("w") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = every.where("not first").withColumn("new", F.when(F.col("w") <= before, 0).otherwise(1))
    islands = new.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("uid", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("uid", "begin", "end", F.lit(False).alias("first"))
    none = F.lit(None).cast("int")
    runs = stored(runs.unionAll(every.where("first").select("uid").distinct().select("uid", none.alias("begin"), none.alias("end"), F.lit(True).alias("first"))))
    for used in (met, kinds, windows, every):
        forget(used)
    return runs


def _remover(batches):
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            out, at, text = [], 0, text or ""
            for s in sorted(spans, key=lambda s: s["begin"]):
                if s["begin"] > at or not out:
                    out.append(text[at : s["begin"]])
                at = max(at, s["end"])
            kept.append("".join([*out, text[at:]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(kept, pa.string())], [*batch.schema.names[1:], "kept"])


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: id, n_paragraphs, spans (removed, by code points; they may overlap), clusters (of
    its paragraphs that repeat), repeats (whether it holds a passage that repeats, kept or removed), kept (the text that stays)."""
    small_batches(docs.sparkSession)
    rows = with_uid(docs, id_col, text_col)
    parts = rows.select("uid", "text").mapInArrow(_cutter(least), "uid long, begin int, end int, text string")
    # a paragraph's number says its place: documents by uid, then places by begin
    numbered = stored(parts.select("uid", "begin", "end", "text", F.monotonically_increasing_id().alias("id")))
    signed, classes, reps = classes_of(numbered.select("id", "text"), _prefixer(SHINGLE, PERCENT))
    links = repeated_classes(numbered.select("id", "text"), classes, reps, SHINGLE, PERCENT)
    places = stored(numbered.select("id", "uid", "begin", "end"))
    forget(numbered)
    placed = stored(signed.join(links.hint("shuffle_hash"), "words_key").join(places, "id").select("uid", "begin", "end", F.col("component").alias("cluster")))
    first = stored(placed.groupBy("cluster").agg(F.min(F.struct("uid", "begin")).alias("one")))
    several = placed.join(first, "cluster").select("uid", "begin", "end", "cluster", ((F.col("uid") == F.col("one.uid")) & (F.col("begin") == F.col("one.begin"))).alias("first"))
    runs = _spliced(rows.select("uid", "text")).select("uid", "begin", "end", F.lit(None).cast("long").alias("cluster"), "first")
    every = several.unionAll(runs)
    gone = F.when(~F.col("first"), F.struct("begin", "end"))
    spans = every.groupBy("uid").agg(F.array_sort(F.array_distinct(F.collect_list(gone))).alias("spans"), F.array_sort(F.collect_set("cluster")).alias("clusters"), F.lit(True).alias("repeats"))
    counts = places.groupBy("uid").agg(F.count("*").alias("n_paragraphs"))
    about = stored(counts.join(spans, "uid", "full"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    # all that is known of a document goes with its text, which so is dealt once
    met = rows.join(about.hint("shuffle_hash"), "uid", "left").select("text", F.col("id").alias(id_col), F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("spans", none).alias("spans"), F.coalesce("clusters", F.array().cast("array<long>")).alias("clusters"), F.coalesce("repeats", F.lit(False)).alias("repeats"))
    return met.mapInArrow(_remover, f"`{id_col}` long, n_paragraphs long, spans array<struct<begin:int,end:int>>, clusters array<long>, repeats boolean, kept string")
