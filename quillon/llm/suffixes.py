"""Removal of repeated byte strings: buckets of anchored q-grams, refined by hashes of the bytes at further offsets.

This keeps the bucket-pointer idea only in part: pointers stand for one anchor in about 60 positions, not for every byte, and
a refinement hashes bytes instead of sorting on the bucket identifiers of later offsets.

Bucket pointers. A string's bucket is named by the identifiers of q-grams, and a bucket is refined by the identifiers of what
stands at further offsets around the same q-gram. An identifier is a hash of the bytes, so buckets need no central numbering.

Initial buckets. A string of ``length`` bytes has length - q + 1 q-grams; the one with the least hash (leftmost on ties) is its
anchor. Equal strings have equal anchors at equal offsets, so only anchors need pointers, some 1 position in 70, and a string
whose anchor's bucket holds one position is unique. Neighbouring strings with one anchor make a run.

Refinement. The strings of a run differ in how many bytes they take left and right of the anchor. Ranges of such strings are
sorted into buckets by the bytes that all strings of the range have in common; a bucket of one is unique and leaves. Members
that are equal in all bytes of the range are repeated whole and go on as one. A bucket with members that are not is refined:
its ranges are cut into FAN parts, whose common bytes reach further, and these are sorted into buckets again, down to single
strings. Each step works on what the step before left undecided, and reads bytes only of one run of each kind.

Identifiers have 61 bits; two strings are taken for equal if their anchor's and their own agree, some 122 bits. Counts are
partial aggregates, stored before rows meet them, so a bucket of any size can be split over tasks.

Cases. Null text is empty: no bytes, none removed. Texts shorter than ``length`` keep all. Repeated rows are texts that occur
twice, and each is removed where it repeats; each row is judged alone even if ids repeat or are null. Very long texts are read
whole, up to the 2 GB of a string. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Ranges, chunks, forget, mixed, small_batches, stored, utf8, with_uid

_U = np.uint64
LENGTH, GRAM = 200, 64
#: Parts of a range of strings at each refinement.
FAN = 5
_PLACE = _U(31)  # bits for a position below a truncated hash


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams the position of the least, leftmost on ties."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64)
    key = (grams >> _PLACE << _PLACE) | np.arange(n, dtype=_U)
    padded = np.full(-(-n // width) * width, ~_U(0), _U)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(up[:m], down[width - 1 : width - 1 + m]) & ((_U(1) << _PLACE) - _U(1))).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, begin, strings, offset of the anchor, bucket, class) of every run of strings with one anchor."""
    n = len(data)
    size = np.diff(offsets)
    if n < length or not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(_U), z.astype(_U)
    of = Ranges(data)
    grams = of.every(gram)
    anchor = anchors(grams, length - gram + 1)
    row = np.repeat(np.arange(len(size)), size)
    begin = np.arange(len(anchor))
    own = row[: len(anchor)]
    valid = begin + length <= offsets[own + 1]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    last_of = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True))
    a = anchor[first]
    strings, off = last_of - first + 1, a - first
    with np.errstate(over="ignore"):
        whole = mixed(of.of(first, last_of + length) + off.astype(_U) * _U(0x9E3779B97F4A7C15))
    return own[first], first, strings, off, grams[a], whole


def _runner(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                row, begin, n, off, bucket, whole = runs(data[offsets[i] : offsets[j]], at, length, gram)
                columns = [pa.array(ids[i:j][row]), pa.array((begin - at[row]).astype(np.int32)), pa.array(n.astype(np.int16 if length < 2**15 else np.int32)), pa.array(off.astype(np.int16 if length < 2**15 else np.int32)), pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64))]
                yield pa.RecordBatch.from_arrays([c if k not in (2, 3) else c.cast(pa.int32()) for k, c in enumerate(columns)], ["uid", "pos", "n", "off", "bucket", "class"])

    return run


def _cutter(length: int, gram: int):
    """Of each text the bytes of the runs listed with it, whose ranges at first are all their strings."""

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            inner = lists.flatten()
            pos, n = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "n"))
            begin = offsets[row] + pos
            whole = data.tobytes()
            ends = begin + n - 1 + length
            for k in range(0, len(row), 4096):
                strings = [whole[a:b] for a, b in zip(begin[k : k + 4096].tolist(), ends[k : k + 4096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([inner.field(c).slice(k, 4096) for c in ("cid", "n", "off", "bucket")] + [batch.column(0).take(pa.array(row[k : k + 4096])), inner.field("pos").slice(k, 4096), pa.array(strings, pa.binary())], ["cid", "n", "off", "bucket", "uid", "pos", "bytes"])

    return cut


def widths(length: int, gram: int) -> list[int]:
    """How many offsets a range spans at each step; the last spans one."""
    out, left = [], length - gram + 1
    while left > 1:
        left = -(-left // FAN)
        out.append(left)
    return out or [1]


def _refiner(length: int, gram: int, width: int, before: int):
    """(cid, part, bucket, whole, begin, end) of the parts, ``width`` offsets wide, of the ranges that are undecided.

    A string takes j bytes left of its anchor. Part k has the strings with k * width <= j < (k + 1) * width that the run
    holds; ``bucket`` names the bytes that all strings of the part would have in common, ``whole`` all bytes of those held.
    """
    least = length - gram

    def refine(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("bytes")))
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            off, n, pos = (column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("off", "n", "pos"))
            seed, cid, uid = column("bucket").to_numpy(zero_copy_only=False).view(np.uint64), column("cid"), column("uid")
            lists = column("parts")
            if lists.null_count:  # the first step: every part
                row = np.repeat(np.arange(len(off)), least // width + 1)
                part = np.tile(np.arange(least // width + 1), len(off))
            else:
                each = np.repeat(np.arange(len(off)), np.diff(np.asarray(lists.offsets)))
                old = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first, last = old * before // width, ((old + 1) * before - 1) // width
                size = last - first + 1
                row, part = np.repeat(each, size), np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                both = row * (least // width + 2) + part
                _, one = np.unique(both, return_index=True)
                row, part = row[one], part[one]
            low, high = part * width, np.minimum((part + 1) * width - 1, least)
            # strings of the run: j from off - n + 1 to off
            own_low, own_high = np.maximum(low, off[row] - n[row] + 1), np.minimum(high, off[row])
            held = own_low <= own_high
            row, part, low, high, own_low, own_high = (x[held] for x in (row, part, low, high, own_low, own_high))
            of = Ranges(data)
            at = offsets[row] + off[row]  # the anchor
            common = of.of(at - low, at + length - high)
            every = of.of(at - own_high, at + length - own_low)
            with np.errstate(over="ignore"):
                bucket = mixed(common + seed[row] * _U(0xD6E8FEB86659FD93) + part.astype(_U) * _U(0xA0761D6478BD642F))
                every = mixed(every + (own_low * 65536 + own_high).astype(_U) * _U(0x9E3779B97F4A7C15))
            take = pa.array(row)
            begin = pos[row] + off[row] - own_high
            end = pos[row] + off[row] - own_low + length
            yield pa.RecordBatch.from_arrays([cid.take(take), pa.array(part.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(every.view(np.int64)), uid.take(take), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["cid", "part", "bucket", "whole", "uid", "begin", "end"])

    return refine


def _remover(batches):
    for batch in batches:
        texts, lists = batch.column(2), batch.column(3)
        data, offsets = utf8(texts)
        where = np.asarray(lists.offsets)
        inner = lists.flatten()
        begin, end = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("begin", "end"))
        spans, kept = [], []
        for r in range(len(texts)):
            text = data[offsets[r] : offsets[r + 1]]
            # null lists have no width
            b, e = begin[where[r] - where[0] : where[r + 1] - where[0]], end[where[r] - where[0] : where[r + 1] - where[0]]
            if not len(b):
                spans.append([])
                kept.append(text.tobytes())
                continue
            order = np.argsort(b, kind="stable")
            b, e = b[order], np.maximum.accumulate(e[order])
            new = np.concatenate([[True], b[1:] > e[:-1]])
            b, e = b[new], np.concatenate([e[:-1][new[1:]], e[-1:]])
            spans.append([{"begin": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)])
            gone = np.zeros(len(text) + 1, np.int32)
            np.add.at(gone, b, 1)
            np.add.at(gone, e, -1)
            kept.append(text[np.cumsum(gone[:-1]) == 0].tobytes())
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["uid", "id", "n_bytes", "spans", "kept"])


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, spans (maximal removed runs of bytes), kept (the bytes that stay)."""
    if not gram <= length:
        raise ValueError("gram must be at most length")
    small_batches(docs.sparkSession)
    rows = with_uid(docs, id_col, text_col)
    texts = rows.select("uid", "text")
    found = stored(texts.mapInArrow(_runner(length, gram), "uid long, pos int, n int, off int, bucket long, class long"))
    full = stored(found.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"))
    live = stored(found.join(full, "bucket"))
    for used in (found, full):
        forget(used)
    kind = ["bucket", "off", "n", "class"]
    classes = stored(live.groupBy(*kind).agg(F.count("*").alias("m"), F.min(F.struct("uid", "pos")).alias("one")))
    several = stored(classes.where("m > 1").select(*kind))
    spans = [stored(live.join(several, kind).select("uid", F.col("pos").alias("begin"), (F.col("pos") + F.col("n") + (length - 1)).alias("end")))]
    for used in (live, several):
        forget(used)
    # buckets of several kinds, one of them a run that no other equals: one run of each kind is refined
    edge = stored(classes.groupBy("bucket").agg(F.count("*").alias("c"), F.min("m").alias("least")).where("c > 1 and least = 1").select("bucket"))
    edges = stored(classes.join(edge, "bucket").select(F.col("one.uid").alias("uid"), F.struct(F.monotonically_increasing_id().alias("cid"), "off", "bucket", F.col("one.pos").alias("pos"), "n").alias("edge")))
    lists = edges.groupBy("uid").agg(F.collect_list("edge").alias("edges"))
    cut = stored(texts.join(lists, "uid").select("uid", "text", "edges").mapInArrow(_cutter(length, gram), "cid long, n int, off int, bucket long, uid long, pos int, bytes binary"))
    for used in (classes, edge, edges):
        forget(used)
    undecided, before = cut.withColumn("parts", F.lit(None).cast("array<int>")), 0
    steps = widths(length, gram)
    for width in steps:
        parts = stored(undecided.mapInArrow(_refiner(length, gram, width, before), "cid long, part int, bucket long, whole long, uid long, begin int, end int"))
        kinds = stored(parts.groupBy("bucket", "whole").agg(F.count("*").alias("m"), F.min(F.struct("cid", "part")).alias("one")))
        twice = stored(kinds.where("m > 1").select("bucket", "whole"))
        spans.append(stored(parts.join(twice, ["bucket", "whole"]).select("uid", "begin", "end")))
        mixed_ = stored(kinds.groupBy("bucket").agg(F.count("*").alias("c"), F.min("m").alias("least")).where("c > 1 and least = 1").select("bucket"))
        left = stored(kinds.join(mixed_, "bucket").select("one.cid", "one.part").groupBy("cid").agg(F.collect_list("part").alias("parts")))
        for used in (parts, kinds, twice, mixed_):
            forget(used)
        undecided, before = cut.join(left, "cid"), width
        if width == 1 or left.isEmpty():
            break
    every = spans[0]
    for more in spans[1:]:
        every = every.unionAll(more)
    every = stored(every.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("list")))
    for used in (cut, *spans):
        forget(used)
    spans = every
    out = rows.join(spans, "uid", "left").select("uid", "id", "text", F.coalesce("list", F.array().cast("array<struct<begin:int,end:int>>")).alias("list"))
    out = out.mapInArrow(_remover, "uid long, id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")
