"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of byte pairs, folded to 1024 terms, and of terms for its shape (share of distinct words, repeated neighbours,
repeated lines, blanks, capitals, digits, punctuation, length). Log counts times inverse document frequency, brought to
length one, are projected on the leading singular directions of a labelled sample; the sample's own vectors, SAMPLE x DIMS
floats at most, are broadcast. Every text then gets its exact cosines to all of them, a block of texts at a time, and the
NEIGHBOURS most alike vote with the power SHARPNESS of their cosine.

The sample is bounded: of the labelled rows allowed for learning, those with the SAMPLE smallest hashes of the id, half of
each label where there are that many.

Cases. Null and empty texts have shape terms only and get a score like any other. Null labels are not learnt from. With
nothing to learn from, every score is PRIOR. Repeated rows get equal scores. Very long texts count whole. An empty table
gives an empty result. Id, language and source are not features; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Ranges, chunks, released, small_batches, utf8, words_of

SAMPLE, TERMS, DIMS, NEIGHBOURS, SHARPNESS = 4096, 1024, 48, 15, 8
PRIOR = 0.5
SHAPES, STEPS = 8, 12
WIDTH = TERMS + SHAPES * STEPS

_FOLD = (np.arange(65536, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
assert _FOLD.max() < TERMS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts, one row for each text, from all its bytes."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    row = np.repeat(np.arange(n), size)
    if len(data) > 1:
        same = row[1:] == row[:-1]
        pair = _FOLD[data[:-1].astype(np.int64) * 256 + data[1:]]
        out[:, :TERMS] = np.bincount((row[:-1] * TERMS + pair)[same], minlength=n * TERMS).reshape(n, TERMS)
    begin, end, word_row = words_of(data, offsets)
    words = np.bincount(word_row, minlength=n)
    per = np.maximum(words, 1)
    h = Ranges(data).of(begin, end)
    first = np.concatenate([[0], np.cumsum(words)])
    distinct = np.array([len(np.unique(h[first[r] : first[r + 1]])) for r in range(n)], np.int64)
    twice = np.bincount(word_row[1:][(h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])], minlength=n) if len(h) else np.zeros(n)
    lines = np.bincount(row[data == 10], minlength=n) + 1
    line_apart = np.zeros(256, bool)
    line_apart[10] = True
    lb, le, lr = words_of(data, offsets, line_apart)
    lh, nl = Ranges(data).of(lb, le), np.bincount(lr, minlength=n)
    lf = np.concatenate([[0], np.cumsum(nl)])
    lines_twice = nl - np.array([len(np.unique(lh[lf[r] : lf[r + 1]])) for r in range(n)], np.int64)
    of = lambda low, high: np.bincount(row[(data >= low) & (data <= high)], minlength=n)
    per_byte = np.maximum(size, 1)
    marks = of(33, 47) + of(58, 64) + of(91, 96) + of(123, 126)
    shares = [
        1 - distinct / per, twice / per, lines_twice / np.maximum(nl, 1), marks / per_byte,
        of(65, 90) / per_byte, of(48, 57) / per_byte, np.log1p(size) / 16, lines / per,
    ]
    at = np.arange(n)
    for k, share in enumerate(shares):
        out[at, TERMS + k * STEPS + np.minimum((np.sqrt(np.clip(share, 0, 1)) * STEPS).astype(int), STEPS - 1)] = 1
    return out


class Model:
    """What is broadcast: weights of terms, directions, the sample's vectors and its labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        seen = (counts > 0).sum(0)
        self.weight = (np.log((1 + len(counts)) / (1 + seen)) + 0.1).astype(np.float32)
        self.weight[TERMS:] += 3
        x = self.weighted(counts)
        _, v = np.linalg.eigh(x.T.astype(np.float64) @ x)
        self.directions = np.ascontiguousarray(v[:, ::-1][:, :DIMS].astype(np.float32))
        self.vectors = self.placed(counts)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weight
        for part in (slice(0, TERMS), slice(TERMS, WIDTH)):  # text and shape weigh the same
            x[:, part] /= np.maximum(np.sqrt((x[:, part] ** 2).sum(1, keepdims=True)), 1e-6)
        return x

    def placed(self, counts: np.ndarray) -> np.ndarray:
        y = self.weighted(counts) @ self.directions
        return y / np.maximum(np.sqrt((y**2).sum(1, keepdims=True)), 1e-6)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), PRIOR)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(counts), 512):
            cosine = self.placed(counts[i : i + 512]) @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            vote = np.clip(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3, 1) ** SHARPNESS
            out[i : i + 512] = (vote * self.labels[near]).sum(1) / vote.sum(1)
        return np.clip(out, 0, 1)


def _counted(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in chunks(offsets):
            counts = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = [np.minimum(r, 65535).astype("<u2").tobytes() for r in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "counts"])


def sampled(labels: DataFrame, learn, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` (id, label) of labelled rows for which ``learn`` holds, half of each label where there are so many."""
    ranked = labels.where(learn).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    halves = [ranked.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(bound // 2) for k in (0, 1)]
    return halves[0].unionAll(halves[1])


def fitted(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows for which the column ``learn`` holds. What is collected is ``sample`` rows of fixed width."""
    small_batches(docs.sparkSession)
    chosen = F.broadcast(sampled(labels, learn, id_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")
    found = rows.mapInArrow(_counted, "id long, label int, counts binary").groupBy("id", "label").agg(F.min("counts").alias("counts")).toArrow().sort_by("id")
    counts = np.array([np.frombuffer(x, "<u2") for x in found["counts"].to_pylist()], np.float32).reshape(-1, WIDTH)
    return Model(counts, np.array(found["label"].to_pylist(), np.float32))


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                scores = model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(scores)], ["id", "score"])
        released()

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score, from 0 to 1, of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, score double").withColumnRenamed("id", id_col)
