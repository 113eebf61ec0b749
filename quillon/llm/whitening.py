"""Embedding whitening from an exact covariance, by digit-slice products.

Entries become integers, floor(256 c). The fit list holds each distinct vector once. Its vectors, times their number n and
less the sums, are integers too: centred before anything is multiplied. They are cut into signed limbs of LIMB bits, so that
a product of two limb matrices over ROWS vectors stays below 2**53 and comes out of float64 BLAS exactly. Limb products are put
together as big integers in each task, leave it in base 2**32, and are summed there by Spark, entry by entry. What the driver
gets is one big integer for each pair of dimensions: the covariance without any rounding.

Its leading directions are refined on the exact matrix: each is corrected against its exact residual in fixed point of BITS
bits and taken out before the next is sought, so that a component far smaller than the first keeps its digits.

Cases. Rows whose vector is null or holds a null or a non-finite entry are dropped; so are vectors of another length than most
distinct vectors have (of equally frequent lengths the longer counts). A null id stays a row. Repeated rows get equal results
and count once in the fit. Entries beyond a long are its ends. Components without variance are left out, so a single distinct
vector, or none, gives no rows. Equal eigenvalues have any directions of their plane, the same for all rows. ``deviation`` is
exact to 38 digits, and null beyond them. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored

#: Bits of a signed limb, vectors multiplied at once: 2 * (LIMB - 1) + log2(ROWS) is 52.
LIMB, ROWS = 21, 4096
#: Bits behind the point when directions are refined.
BITS = 256
_DIGIT = 32
_SMALL = 1 << 62


def grid(vector):
    """The integers of a vector."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def usable(vector):
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """float64 matrices of signed limbs, the lowest first; y is int64, or object for wider integers."""
    out, half = [], 1 << (LIMB - 1)
    for _ in range(count - 1):
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return [*out, y.astype(np.float64)]


def limb_count(bits: int) -> int:
    """Limbs for integers whose size is below 2**bits: the last takes what is left and stays within its bound."""
    return max(1, -(-(bits + 1) // (LIMB - 1)))


class Products:
    """Sums of outer products of integer vectors, exact."""

    def __init__(self, d: int, bits: int) -> None:
        self.d, self.count = d, limb_count(bits)
        self.open, self.blocks = {}, 0
        self.total = np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        for i in range(0, len(y), ROWS):
            part = limbs(y[i : i + ROWS], self.count)
            for p in range(self.count):
                for q in range(p, self.count):
                    own = (part[p].T @ part[q]).astype(np.int64)
                    at = self.open.get(p + q)
                    own = own if p == q else own + own.T
                    self.open[p + q] = own if at is None else at + own
            self.blocks += 1
            if self.blocks * self.count >= 256:  # 2**53 * 2**8 fits
                self.close()

    def close(self) -> np.ndarray:
        for place, own in self.open.items():
            self.total = self.total + own.astype(object) * (1 << (LIMB * place))
        self.open, self.blocks = {}, 0
        return self.total


def digits(value: int, count: int) -> list[int]:
    """Base 2**32, the lowest first; the last carries the sign."""
    return [*[(value >> (_DIGIT * k)) & 0xFFFFFFFF for k in range(count - 1)], value >> (_DIGIT * (count - 1))]


class Space:
    """Length, number and sums of the fit list, and bounds of its entries."""

    def __init__(self, d: int, n: int, sums: list[int], low: list[int], high: list[int]) -> None:
        self.d, self.n, self.sums = d, n, sums
        # the whole number next to the mean is taken off first: n * (x - near) - rest, with rest at most n / 2
        self.near = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.near, strict=True)]
        self.widest = max(max(abs(a - c), abs(b - c)) for a, b, c in zip(low, high, self.near, strict=True))
        self.bits = (n * self.widest + n).bit_length()

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x less the near whole mean: int64 where that is certain to fit, else big integers."""
        near = np.array(self.near, object)
        if max(map(abs, self.near)) + self.widest < _SMALL:
            return x - near.astype(np.int64)
        return x.astype(object) - near

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums."""
        y, rest = self.offsets(x), np.array(self.rest, object)
        if self.bits < 62 and y.dtype != object:
            return y * np.int64(self.n) - rest.astype(np.int64)
        return y.astype(object) * self.n - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The squared length of each row of n * x - sums."""
        y = self.offsets(x)
        if 2 * self.widest.bit_length() + self.d.bit_length() < 62 and y.dtype != object:
            squares = (y * y).sum(1)
        else:
            squares = (y.astype(object) ** 2).sum(1)
        rest = np.array(self.rest, object)
        if self.widest.bit_length() + self.n.bit_length() + self.d.bit_length() < 62 and y.dtype != object:
            across = y @ rest.astype(np.int64)
        else:
            across = y.astype(object) @ rest
        own = sum(r * r for r in self.rest)
        return [self.n * (self.n * int(s) - 2 * int(a)) + own for s, a in zip(squares, across, strict=True)]


def _summed(d: int):
    def work(batches):
        n, high, low, least, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), None, None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0), d)
                n += len(x)
                high += (x >> _DIGIT).sum(0)
                low += (x & 0xFFFFFFFF).sum(0)
                least = x.min(0) if least is None else np.minimum(least, x.min(0))
                most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *[pa.array(a) for a in (high, low, least, most)]], ["dim", "n", "high", "low", "least", "most"])

    return work


def _multiplied(shared, count: int):
    def work(batches):
        space = shared.value
        products = Products(space.d, space.bits)
        seen = False
        for batch in batches:
            if len(batch):
                seen = True
                products.add(space.centred(matrix(batch.column(0), space.d)))
        if seen:
            total = products.close()
            at = [(i, j) for i in range(space.d) for j in range(i, space.d)]
            split = [digits(int(total[i, j]), count) for i, j in at]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), *[pa.array([s[k] for s in split], pa.int64()) for k in range(count)]], ["i", "j", *[f"d{k}" for k in range(count)]])

    return work


def fit_list(rows: DataFrame) -> tuple[DataFrame, Space | None]:
    """The distinct vectors of the column ``x``, stored, and what they sum to."""
    own = stored(rows.select("x").distinct())
    sizes = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes[0]:
        return own, None
    d = sizes[0]
    own = own.where(F.size("x") == d)
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = own.mapInArrow(_summed(d), "dim int, n long, high long, low long, least long, most long").groupBy("dim")
    got = found.agg(F.sum("n").alias("n"), big("high").alias("high"), big("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    return own, Space(d, got[0].n, [(int(r.high) << _DIGIT) + int(r.low) for r in got], [r.least for r in got], [r.most for r in got])


def covariance(own: DataFrame, space: Space) -> np.ndarray:
    """n ** 3 times the covariance of the fit list, as integers."""
    count = -(-(2 * space.bits + space.n.bit_length() + 2) // _DIGIT)
    shared = own.sparkSession.sparkContext.broadcast(space)
    names = [f"d{k}" for k in range(count)]
    found = own.mapInArrow(_multiplied(shared, count), "i int, j int, " + ", ".join(f"{c} long" for c in names))
    merged = found.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
    out = np.zeros((space.d, space.d), object)
    for r in merged:
        out[r.i, r.j] = out[r.j, r.i] = sum(int(r[c]) << (_DIGIT * k) for k, c in enumerate(names))
    return out


def _fixed(v: np.ndarray) -> np.ndarray:
    """Fixed point of BITS bits of floats of size about one."""
    return np.array([int(math.ldexp(float(x), 60)) << (BITS - 60) for x in v], object)


def _normed(v: np.ndarray) -> np.ndarray:
    size = math.isqrt(sum(int(x) * int(x) for x in v))
    return np.array([(int(x) << BITS) // size for x in v], object)


def leading(gram: np.ndarray, most: int) -> tuple[list[float], np.ndarray]:
    """Eigenvalues, as shares of the trace, and unit eigenvectors (columns) of an integer matrix: ``most`` at most, falling, only
    those above zero."""
    d, trace = len(gram), int(np.trace(gram))
    values, vectors = [], []
    if trace <= 0:
        return values, np.zeros((d, 0))
    shift = max(0, BITS - trace.bit_length())
    a, scale = gram * (1 << shift), trace << shift
    for _ in range(min(most, d)):
        own = int(np.trace(a))
        if own <= scale >> (BITS // 2):
            break
        w, q = np.linalg.eigh(np.array([[x / own for x in row] for row in a], float))
        v, gaps = _normed(_fixed(q[:, -1])), w[-1] - w
        sure = gaps > 1e-12
        for _ in range(24):
            av = np.array([int(x) >> BITS for x in a @ v], object)
            value = sum(int(x) * int(y) for x, y in zip(v, av, strict=True)) >> BITS
            off = np.array([int(x) - ((value * int(y)) >> BITS) for x, y in zip(av, v, strict=True)], object)
            largest = max(abs(int(x)) for x in off)
            if largest.bit_length() + 120 < own.bit_length() or not largest:
                break
            # the residual by directions, each over its distance to the value: the first-order correction
            part = np.array([int(x) / largest for x in off], float) @ q
            fix = q @ np.where(sure, part / np.where(sure, gaps, 1), 0)
            size = np.abs(fix).max()
            if not size:
                break
            ratio = (int(math.ldexp(size, 60)) * largest << (BITS - 60)) // own
            v = _normed(v + np.array([(int(math.ldexp(x / size, 60)) * ratio) >> 60 for x in fix], object))
        values.append(value / scale)
        vectors.append(np.array([int(x) / (1 << BITS) for x in v]))
        # (1 - v v') a (1 - v v'), rounded in the last of BITS bits
        av = np.array([int(x) >> BITS for x in a @ v], object)
        value = sum(int(x) * int(y) for x, y in zip(v, av, strict=True)) >> BITS
        across = np.array([[(int(x) * int(y)) >> BITS for y in v] for x in av], object)
        along = np.array([[((value * ((int(x) * int(y)) >> BITS)) >> BITS) for y in v] for x in v], object)
        a = a - across - across.T + along
    return values, np.array(vectors).reshape(-1, d).T


class Whitening:
    """What is broadcast: the space, and a direction over its deviation for each component."""

    def __init__(self, space: Space, values: list[float], vectors: np.ndarray, trace: int) -> None:
        self.space, self.explained = space, values
        # eigenvalues of the covariance: shares of its trace, which is the integers' trace over n ** 3
        spread = [math.sqrt(v * (trace / space.n**3)) for v in values]
        self.directions = vectors / np.array(spread) if values else vectors
        self.part = np.array([r / space.n for r in space.rest])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (self.space.offsets(x).astype(np.float64) - self.part) @ self.directions


def _squared(shared, k: int):
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def work(batches):
        model = shared.value
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = model.of(matrix(batch.column(0), model.space.d))
                first += w.sum(0)
                second += w.T @ w
        flat = [*first, *[second[i, j] for i, j in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in flat], [f"s{i}" for i in range(len(flat))])

    return work


def identity_error(own: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, from the values themselves."""
    k, n = len(model.explained), model.space.n
    width = k + k * (k + 1) // 2
    names = [f"s{i}" for i in range(width)]
    shared = own.sparkSession.sparkContext.broadcast(model)
    got = own.mapInArrow(_squared(shared, k), ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    mean, at, worst = [got[i] / n for i in range(k)], k, 0.0
    for i in range(k):
        for j in range(i, k):
            worst = max(worst, abs(got[at] / n - mean[i] * mean[j] - (i == j)))
            at += 1
    return worst


def _whitened(shared, k: int):
    def work(batches):
        model, most = shared.value, 10**38
        space = model.space
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = matrix(batch.column(1), space.d)
            ids = batch.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            off = np.repeat(np.array([str(v) if v < most else None for v in space.deviations(x)], object), k)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(off, pa.string()), pa.array(model.of(x).reshape(-1)), pa.array(np.tile(model.explained, n))], ["id", "component", "deviation", "whitened", "explained"])

    return work


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """For each usable row and component: id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark = rows.sparkSession
    own = rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), grid(F.col(vector_col)).alias("x"))
    fit, space = fit_list(own)
    model = None
    if space is not None:
        gram = covariance(fit, space)
        values, vectors = leading(gram, components)
        model = Whitening(space, values, vectors, int(np.trace(gram)))
    shape = "id long, component int, deviation string, whitened double, explained double"
    if model is None or not model.explained:
        found, n, error = spark.createDataFrame([], shape), 0, 0.0
    else:
        n, error = space.n, identity_error(fit, model)
        found = own.where(F.size("x") == space.d).mapInArrow(_whitened(spark.sparkContext.broadcast(model), len(model.explained)), shape)
    return found.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
