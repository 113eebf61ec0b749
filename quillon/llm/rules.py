"""Quality rules: counts of a text, and a verdict from hashed word and character n-grams.

The counts are exact: words (runs between blanks), their code points, symbols, lines equal to an earlier line, words inside
three-word windows that the text holds twice. The verdict is a logistic regression on hashed n-grams of bytes (two to four)
and of words (one and two): log counts, each kind brought to length one, CHARS + WORDS weights. It learns from a bounded
sample of labelled rows, SAMPLE at most, half of each label where there are so many. Its log odds are calibrated by Platt's
line on predictions for rows that a model had not seen (FOLDS folds by the id's crc32), and moved from the sample's share of
good rows to the share in all labelled rows. Texts are then scored in Arrow batches; a row is kept if it passes the rules and
its probability reaches LEAST.

Texts longer than PIECE bytes are read piece by piece, cut at blanks, so memory follows the number of words (some 40 bytes
each), not sixty times the text. Windows of words are compared by hashes of 61 bits (a word of PIECE bytes or more by
BLAKE2); lines as they are.

Cases. Null and empty texts have no words and fail the rules, with a probability like any other text's. Null labels and ids
are not learnt from; an id with several labels learns the smallest, an id with several texts one of them. With labels of one kind or none the probability is PRIOR,
so the rules alone decide. Repeated rows get equal results. An empty table gives an empty result. Id, language and source
are never read as features, other columns not at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BLANK, Ranges, chunks, mixed, released, small_batches, utf8, words_of
from quillon.llm.quality import sampled

SAMPLE, CHARS, WORDS = 4096, 2048, 2048
WIDTH = CHARS + WORDS
#: Bytes of a text read at once, rows counted at once.
PIECE, ROWS = 1 << 20, 256
FOLDS, STEPS, RIDGE = 4, 200, 1e-4
PRIOR, LEAST = 1.0, 0.3
FEWEST_WORDS, MOST_REPEATED = 50, 50

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_WORD_POINT = _LEAD & ~BLANK
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def pieces(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a text after blanks, PIECE bytes each at most; a longer piece is one word and the blank behind it."""
    i, n = 0, len(text)
    while i < n:
        j = min(i + PIECE, n)
        if j < n:
            blanks = np.flatnonzero(BLANK[text[i:j]])
            while not len(blanks) and j < n:
                at = j
                j = min(j + PIECE, n)
                later = np.flatnonzero(BLANK[text[at:j]])
                if len(later):
                    j = at + int(later[0]) + 1
                    break
            if len(blanks):
                j = i + int(blanks[-1]) + 1
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    if len(data) <= PIECE:
        begin, end, row = words_of(data, offsets)
        return Ranges(data).of(begin, end), row
    found, rows = [], []
    for r in range(len(offsets) - 1):
        text = data[offsets[r] : offsets[r + 1]]
        for i, j in pieces(text):
            if j - i > PIECE:  # one word, however long
                word = text[i:j][: j - i - int(BLANK[text[j - 1]])]
                own = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), _U)
            else:
                begin, end, _ = words_of(text[i:j], np.array([0, j - i]))
                own = Ranges(text[i:j]).of(begin, end)
            found.append(own)
            rows.append(np.full(len(own), r, np.int64))
    return np.concatenate(found), np.concatenate(rows)


def _repeated(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row inside three-word windows that the row holds twice or more."""
    if len(h) < 3:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        key = mixed(h[:-2] + _U(0x9E3779B97F4A7C15) * mixed(h[1:-1] + _U(0xC2B2AE3D27D4EB4F) * mixed(h[2:] + row[2:].astype(_U))))
    within = np.flatnonzero(row[:-2] == row[2:])
    order = within[np.argsort(key[within])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[order[twice] + k] = True
    return np.bincount(row[covered], minlength=n)


def _repeated_lines(text: np.ndarray) -> int:
    """Lines with a word that equal an earlier line."""
    whole, at, seen, n = text.tobytes(), 0, set(), 0
    while at < len(whole):
        to = whole.find(b"\n", at)
        to = len(whole) if to < 0 else to
        line = whole[at:to]
        if line.strip():
            n += 1
            seen.add(line)
        at = to + 1
    return n - len(seen)


def _grams(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
    """Adds the n-grams of bytes that lie in one row."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    code = data.astype(np.uint32)
    for size in (2, 3, 4):
        if len(data) < size:
            return
        code = code[:-1] | (data[size - 1 :].astype(np.uint32) << np.uint32(8 * (size - 1)))
        at = np.flatnonzero(row[: len(code)] == row[size - 1 :])
        bucket = ((code[at] ^ np.uint32(size * 0x5BD1)) * np.uint32(2654435761)) >> np.uint32(21)
        counts[:, :CHARS] += np.bincount(row[at] * CHARS + bucket, minlength=n * CHARS).reshape(n, CHARS)


def _word_grams(h: np.ndarray, row: np.ndarray, counts: np.ndarray) -> None:
    n = len(counts)
    bucket = lambda x: (mixed(x) >> _U(53)).astype(np.int64)
    counts[:, CHARS:] += np.bincount(row * WORDS + bucket(h), minlength=n * WORDS).reshape(n, WORDS)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            pair = bucket(h[:-1] * _U(3) + mixed(h[1:]))
        same = row[1:] == row[:-1]
        counts[:, CHARS:] += np.bincount((row[1:] * WORDS + pair)[same], minlength=n * WORDS).reshape(n, WORDS)


def measured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MEASURES of each text and its counts of n-grams, from all its bytes."""
    n = len(offsets) - 1
    h, row = word_hashes(data, offsets)
    counts = np.zeros((n, WIDTH), np.int64)
    points, symbols = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, (i, j) in ([(0, (i, j)) for i, j in chunked(len(data))] if n == 1 else [(None, (0, len(data)))]):
        part = data[i:j]
        own = np.array([0, len(part)]) if r == 0 else offsets
        bytes_row = np.repeat(np.arange(n), np.diff(own))
        points += np.bincount(bytes_row[_WORD_POINT[part]], minlength=n)
        symbols += np.bincount(bytes_row[_SYMBOL[part]], minlength=n)
        _grams(part, own, counts)
    if n == 1:
        _joints(data, counts)
    _word_grams(h, row, counts)
    lines = np.array([_repeated_lines(data[offsets[r] : offsets[r + 1]]) for r in range(n)], np.int64)
    return np.stack([np.bincount(row, minlength=n), points, symbols, lines, _repeated(h, row, n)], 1), np.minimum(counts, 65535)


def chunked(n: int) -> list[tuple[int, int]]:
    return [(i, min(i + PIECE, n)) for i in range(0, n, PIECE)]


def _joints(data: np.ndarray, counts: np.ndarray) -> None:
    """Adds the n-grams of bytes that lie across the cuts of one long text."""
    for cut in range(PIECE, len(data), PIECE):
        for size in (2, 3, 4):
            for i in range(max(0, cut - size + 1), min(cut, len(data) - size + 1)):
                code = np.uint32(int.from_bytes(data[i : i + size].tobytes(), "little"))
                with np.errstate(over="ignore"):
                    bucket = ((code ^ np.uint32(size * 0x5BD1)) * np.uint32(2654435761)) >> np.uint32(21)
                counts[0, int(bucket)] += 1


def weighed(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32)
    for part in (slice(0, CHARS), slice(CHARS, WIDTH)):
        x[:, part] /= np.maximum(np.sqrt((x[:, part] ** 2).sum(1, keepdims=True)), 1e-6)
    return x


def regressed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the bias last, by accelerated gradient steps; rows are of length sqrt(3) at most, which bounds the step."""
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    step = 1 / (0.25 * 3 + RIDGE)
    for k in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(np.float32) + v[-1], -30, 30)))
        g = np.append((x.T @ (p - y).astype(np.float32)).astype(float), (p - y).sum()) / len(y)
        g[:-1] += RIDGE * v[:-1]
        after = v - step * g
        v = after + (k - 1) / (k + 2) * (after - w)
        w = after
    return w


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn log odds into probabilities, against smoothed labels."""
    good = y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        g = np.array([((p - target) * odds).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * odds * odds).sum() + 1e-3, (s * odds).sum()], [(s * odds).sum(), s.sum()]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    return max(a, 1e-3), b


class Model:
    """What is broadcast: one weight a bucket, the calibration's line."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, fold: np.ndarray, share: float) -> None:
        self.weights = None
        good = labels.sum()
        if not 0 < good < len(labels):
            return
        x, odds, seen = weighed(counts), np.zeros(len(labels)), np.zeros(len(labels), bool)
        for k in range(FOLDS):
            out, rest = fold == k, fold != k
            if out.any() and 0 < labels[rest].sum() < rest.sum():
                w = regressed(x[rest], labels[rest])
                odds[out], seen[out] = x[out] @ w[:-1] + w[-1], True
        self.weights = regressed(x, labels)
        self.slope, self.offset = platt(odds[seen], labels[seen]) if 0 < labels[seen].sum() < seen.sum() else (1.0, 0.0)
        drawn = good / len(labels)
        self.offset += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), PRIOR)
        odds = weighed(counts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -30, 30)))


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j and what is measured of them; a text beyond a chunk stands alone."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets, PIECE):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, *measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _counted(batches):
    for batch in batches:
        for i, j, _, counts in _blocks(batch.column(2)):
            rows = [r.astype("<u2").tobytes() for r in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "counts"])
    released()


def fitted(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows for which the column ``learn`` holds (all, if none). ``sample`` rows of fixed width are
    collected."""
    small_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    known = labels.where(F.col(id_col).isNotNull()).where(learn).where(F.col(label_col).isin(0, 1))
    share = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    chosen = F.broadcast(sampled(labels.where(F.col(id_col).isNotNull()), learn, id_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")
    found = rows.mapInArrow(_counted, "id long, label int, counts binary").groupBy("id", "label").agg(F.min("counts").alias("counts"))
    found = found.withColumn("fold", (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).cast("int")).toArrow().sort_by("id")
    counts = np.array([np.frombuffer(x, "<u2") for x in found["counts"].to_pylist()], np.float32).reshape(-1, WIDTH)
    return Model(counts, np.array(found["label"].to_pylist(), float), np.array(found["fold"].to_pylist(), int), share or 0.0)


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            for i, j, base, counts in _blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *[pa.array(base[:, k]) for k in range(len(MEASURES))], pa.array(model.score(counts))], ["id", *MEASURES, "score"])
        released()

    return score


def ruled(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the MEASURES, score, base_failed and kept of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", score double")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= LEAST)).withColumnRenamed("id", id_col)
