"""Near-duplicate documents by min-max hashing.

Every permutation keeps both its smallest and its largest value. Bands of two permutations (four values) bring candidates
together; there are as many bands as keep the chance that a pair at the threshold is missed, (1 - threshold**4)**bands,
below MISSED: 20 at 0.85, 28 at 0.80. Links are confirmed on the full sets of shingles, whatever the signatures say.

Identical word sequences are one class and enter the bands once. In a bucket the members are held against its smallest one
first, which links most of a group without its pairs. Members of one component need no further check: it cannot change it.
Members of buckets that still hold several components are paired across components by a prefix filter on their rarest
shingles, which is exact, and confirmed too.

``repeated_classes`` needs no bands: classes meet by the smallest hashes of their sets, which misses no link at all.

Cases. Null or empty text, or blanks alone: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence
is the one shingle. Very long texts are read whole. An empty table gives an empty result. Repeated rows and rows with one id
or none are documents of their own; a component is named by its smallest id (null if it has none) and keeps just one row.
Only the id and the text column are read; others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, LOWER_BYTES, Ranges, chunks, firsts, forget, mixed, small_batches, stored, utf8, with_uid, words_of
from quillon.llm.graph import components

_U = np.uint64
PERMUTATIONS, BAND_PERMUTATIONS, MISSED = 40, 2, 4e-7
#: Bands whose buckets are on the move at a time.
BANDS_AT_ONCE = 7
#: Parts, by hash, in which the smallest hashes of sets are on the move.
PARTS = 2
#: Sets of a bucket, beside its smallest, up to which all its pairs are met.
FEW = 64

_SIGNED = "id long, n_shingles long, words_key binary, bands array<long>"


def permutations_for(percent: int, per_band: int = BAND_PERMUTATIONS) -> int:
    """How many permutations miss a pair at the threshold with a chance below MISSED."""
    same = (percent / 100) ** (2 * per_band)
    return per_band * (math.ceil(math.log(MISSED) / math.log1p(-same)) if same < 1 else 1)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20260101))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with the row of each, and the lower-cased words joined by blanks with row offsets."""
    data = LOWER[data]
    begin, end, row = words_of(data, offsets)
    word = Ranges(data).of(begin, end)
    n_rows = len(offsets) - 1
    counts = np.bincount(row, minlength=n_rows)
    with np.errstate(over="ignore"):
        if len(word) >= k:
            h = np.zeros(len(word) - k + 1, _U)
            for i in range(k):
                h = h * _U(0x9E3779B97F4A7C15) + word[i : len(word) - k + 1 + i]
            full = row[: len(h)] == row[k - 1 :]
            hashes, rows = mixed(h[full]), row[: len(h)][full]
        else:
            hashes, rows = np.zeros(0, _U), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            first = np.concatenate([[0], np.cumsum(counts)])
            own = np.array([np.bitwise_xor.reduce(mixed(word[first[r] : first[r + 1]] + np.arange(1, counts[r] + 1, dtype=_U))) for r in short], _U)
            hashes, rows = np.concatenate([hashes, mixed(own + _U(7))]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
    # the words of each row, one blank between
    keep = np.zeros(len(data) + 1, np.int8)
    keep[begin] += 1  # no two words begin or end at one place
    keep[end] -= 1
    inside = np.cumsum(keep[:-1]).astype(bool)
    joint = end[:-1][row[:-1] == row[1:]] if len(row) else end
    inside[joint] = True
    data[joint] = 32
    return hashes, rows, (data[inside], np.concatenate([[0], np.cumsum(inside)])[offsets])


def _signer(k: int, n_bands: int, values: int):
    """Signs texts: a band holds ``values`` of the smallest and largest values of the permutations, taken in turn."""

    def sign(batches):
        permutations = -(-n_bands * values // 2)
        a, b = _coefficients(permutations)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in chunks(offsets):
                hashes, rows, (words, at) = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = j - i
                sizes = np.bincount(rows, minlength=n)
                first = np.concatenate([[0], np.cumsum(sizes)])
                full = np.flatnonzero(sizes)
                bands = np.zeros((n_bands, n), np.int64)
                if len(full):
                    keys = [np.full(len(full), band + 1, _U) for band in range(n_bands)]
                    with np.errstate(over="ignore"):
                        for p in range(permutations):
                            v = hashes * a[p] + b[p]
                            v ^= v >> _U(29)
                            v *= a[p]
                            for place, end in ((2 * p, np.minimum), (2 * p + 1, np.maximum)):
                                if (band := place // values) < n_bands:
                                    keys[band] = mixed(keys[band] + end.reduceat(v, first[full]))
                    for band in range(n_bands):
                        bands[band, full] = keys[band].view(np.int64)
                distinct = [len(np.unique(hashes[first[r] : first[r + 1]])) for r in range(n)]
                digests = [hashlib.sha256(words[at[r] : at[r + 1]]).digest() for r in range(n)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32)), pa.array(bands.T.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, n).cast(pa.int64()), pa.array(distinct, pa.int64()), pa.array(digests, pa.binary()), flat], ["id", "n_shingles", "words_key", "bands"])

    return sign


def _prefixer(k: int, percent: int):
    """Signs texts by the smallest hashes of their sets, so many that sets at the threshold have one of them in common."""

    def sign(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in chunks(offsets):
                hashes, rows, (words, at) = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = j - i
                new, order = firsts(rows, hashes, n)
                h, rows = hashes[order][new], rows[order][new]
                sizes = np.bincount(rows, minlength=n)
                # linked sets share percent of the larger one's size at least
                size = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
                first = np.cumsum(sizes) - sizes
                own = np.arange(len(h)) - first[rows] < size[rows]
                digests = [hashlib.sha256(words[at[r] : at[r + 1]]).digest() for r in range(n)]
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[own].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, n).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), flat], ["id", "n_shingles", "words_key", "bands"])

    return sign


def _set(text: str | None, k: int) -> set:
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _verifier(k: int, percent: int):
    def verify(batches):
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            good, last, held = [], None, set()
            for x, t, u in zip(a, left, right, strict=True):
                if x != last:  # rows of a pivot often follow each other
                    last, held = x, _set(t, k)
                own = _set(u, k)
                both = len(held & own)
                good.append(both > 0 and 100 * both >= percent * (len(held) + len(own) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(_verifier(k, percent), "a long, b long")


def _shingles(k: int):
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                hashes, rows, _ = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                first = np.searchsorted(rows, np.arange(j - i + 1))
                own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], [len(x) for x in own])), pa.array(np.concatenate(own).view(np.int64))], ["id", "s"])

    return cut


def _prefixed(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the ids in ``left`` (id, n, c) that lie in different components c and may reach the threshold.

    Shingles are ordered by rarity among these ids. Two sets at the threshold share one of their first few, and at their
    first common shingle what is left of both must still suffice; both bounds are necessary, so no link is lost. Rows of a
    shingle's largest component meet only the others, never each other.
    """
    cut = stored(texts.join(left.select("id"), "id").select("id", "text").mapInArrow(_shingles(k), "id long, s long"))
    # shingles of one set only are the rarest and no token; the others are stored, so that a frequent one can be split over tasks
    times = stored(cut.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("id")
    ranked = cut.join(times, "s").join(left, "id").withColumn("i", F.row_number().over(own.orderBy("df", "s")) - 1 + F.col("n") - F.count("*").over(own))
    tokens = stored(ranked.where(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")).select("s", "id", "n", "c", "i"))
    by_part = tokens.groupBy("s", "c").agg(F.count("*").alias("m")).groupBy("s").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("cs")).where("cs > 1").select("s", F.col("most.c").alias("most"))
    few = tokens.join(by_part, "s").where("c <> most").select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("i").alias("ia"))
    other = tokens.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("i").alias("ib"))
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    pairs = few.join(other, "s").where(F.col("ca") != F.col("cb")).where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for used in (cut, times):
        forget(used)
    return pairs


def classes_of(rows: DataFrame, signer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text), stored: (id, n_shingles, words_key); (words_key, rep, m), the smallest id of each class with words
    and its rows; and (id, n, bands) of the representatives, as ``signer`` gives them."""
    signed = stored(rows.mapInArrow(signer, _SIGNED))
    classes = stored(signed.where("n_shingles > 0").groupBy("words_key").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    own = signed.select("id", F.col("n_shingles").alias("n"), "bands")
    reps = stored(own.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"))
    narrow = stored(signed.select("id", "n_shingles", "words_key"))
    forget(signed)
    return narrow, classes, reps


def _members(reps: DataFrame, n_bands: int) -> DataFrame:
    """(key, id, n, head) of every representative in a bucket of two or more; head is the bucket's smallest id.

    A few bands at a time, so that what is on the move stays a fraction of the texts. The buckets of two or more are stored
    before they meet the rows: a bucket with many rows can then be split over tasks.
    """
    found = None
    for low in range(0, n_bands, BANDS_AT_ONCE):
        part = reps.select("id", "n", F.explode(F.slice("bands", low + 1, BANDS_AT_ONCE)).alias("key"))
        heads = stored(part.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head"))
        own = stored(part.join(heads, "key").select("key", "id", "n", "head"))
        forget(heads)
        found = own if found is None else found.unionAll(own)
    return found


def _prefix_members(reps: DataFrame) -> DataFrame:
    """``_members`` of the hashes that ``_prefixer`` gives, with the place i of each in its set; dealt by hash, a part at a time."""
    found = None
    for part in range(PARTS):
        own = reps.select("id", "n", F.posexplode("bands").alias("i", "key")).where(F.pmod("key", F.lit(PARTS)) == part)
        heads = stored(own.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head"))
        own = stored(own.join(heads.hint("shuffle_hash"), "key").select("key", "id", "n", "i", "head"))
        forget(heads)
        found = own if found is None else found.unionAll(own)
    return found


def _parts(rows: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, component) of every class that is linked: pairs in buckets confirmed, components taken; component is an id."""
    # the sizes of two linked sets are in this bound
    fits = F.col("na") * 100 >= F.col("nb") * percent
    fits = fits & (F.col("nb") * 100 >= F.col("na") * percent)
    own = ["n"]
    if "i" in members.columns:  # what is left of both from their first common hash must suffice
        own = ["n", "i"]
        fits = fits & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= percent * (F.col("na") + F.col("nb")))

    first = stored(members.where("id = head").select("key", F.col("id").alias("a"), *(F.col(c).alias(f"{c}a") for c in own)))
    star = members.where("id > head").select("key", F.col("id").alias("b"), *(F.col(c).alias(f"{c}b") for c in own)).join(first, "key").where(fits).select("a", "b").distinct()
    wanted = stored(members.select("id").distinct())
    texts = stored(rows.join(wanted.hint("shuffle_hash") if "i" in own else wanted, "id"))
    links = stored(_linked(star, texts, shingle, percent))
    placed = stored(members.where("id > head").join(components(links), "id", "left").select("key", "id", *own, F.coalesce("component", "id").alias("c")))
    apart = stored(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high").select("key", "m"))
    if "i" in own:  # in a bucket of a few all pairs are met
        few = stored(placed.join(apart.where(F.col("m") <= FEW).select("key").hint("shuffle_hash"), "key"))
        one, other = (few.select("key", F.col("id").alias(x), F.col("c").alias(f"c{x}"), *(F.col(c).alias(f"{c}{x}") for c in own)) for x in "ab")
        links = stored(links.unionAll(_linked(one.join(other, "key").where("a < b and ca <> cb").where(fits).select("a", "b").distinct(), texts, shingle, percent)))
        apart = apart.where(F.col("m") > FEW)
    left = stored(placed.join(apart.select("key"), "key").select("id", "n", "c").distinct())
    if not left.isEmpty():
        links = stored(links.unionAll(_linked(_prefixed(left, texts, shingle, percent), texts, shingle, percent)))
    parts = stored(components(links).select(F.col("id").alias("rep"), "component"))
    for used in (first, wanted, texts, placed, left):
        forget(used)
    return parts


def linked_classes(rows: DataFrame, classes: DataFrame, reps: DataFrame, n_bands: int, shingle: int, percent: int) -> DataFrame:
    """(words_key, component) of every class: banded, pairs confirmed, components taken; component is an id."""
    members = _members(reps, n_bands)
    forget(reps)
    parts = _parts(rows, members, shingle, percent)
    return classes.join(parts, "rep", "left").select("words_key", F.coalesce("component", "rep").alias("component"))


def repeated_classes(rows: DataFrame, classes: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(words_key, component) of the classes with several rows or links, from all sets that share one of their smallest
    hashes (``_prefixer``): no link is missed."""
    members = _prefix_members(reps)
    forget(reps)
    parts = _parts(rows, members, shingle, percent)
    return classes.join(parts, "rep", "left").where("m > 1 or component is not null").select("words_key", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, permutations: int | None = None, per_band: int = BAND_PERMUTATIONS) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    uids = with_uid(docs, id_col, text_col)
    rows = uids.select(F.col("uid").alias("id"), "text")
    n_bands = (permutations or permutations_for(percent, per_band)) // per_band
    signed, classes, reps = classes_of(rows, _signer(shingle, n_bands, 2 * per_band))
    of_class = linked_classes(rows, classes, reps, n_bands, shingle, percent)
    out = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("words_key")).alias("words_key")).join(of_class, "words_key", "left")
    out = out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    if not hasattr(uids, "_quillon_path"):  # ids serve as uids
        return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    out = out.join(uids.select(F.col("uid").alias("id"), F.col("id").alias("own")), "id")
    first = out.groupBy("component").agg(F.min(F.when(F.col("own").isNotNull(), F.struct("own", "id"))).alias("first"), F.min("id").alias("least"))
    out = out.join(first, "component")
    return out.select(F.col("own").alias(id_col), "n_shingles", F.col("first.own").alias("component_id"), (F.col("id") == F.coalesce("first.id", "least")).alias("kept"))
