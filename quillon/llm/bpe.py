"""Byte-level BPE by a segment tree over byte positions.

A leaf stands for the byte at which a token begins and holds the rank of the pair it makes with the next token, with its own
position below it in the same integer; the root is then the least rank, leftmost first. A merge changes three leaves (the
merged token, the one that vanishes, the live neighbour before) and walks up from them: logarithmic work a merge, whatever
the length. Pieces of like length go through their trees together, one numpy row each; longer pieces have a tree of lists.

Distinct pieces are encoded once and remembered, up to CACHE pieces a worker; then the memory is emptied.

Cases. Null text is empty and has no ids. Any text encodes, since every byte is a token; ids that are not in the vocabulary
make decoding fail. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import released, small_batches

CACHE = 200_000
#: Longest piece, in bytes, whose tree is a numpy row.
WIDE = 128
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20

NONE = (1 << 62) - 1


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens merge into which."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        size = max(self.ranks.values()) + 1
        self.size = size
        self.bytes_at = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = r
        self.pairs = pairs
        # open addressing, so that a whole array of pairs is looked up at once
        self.bits = max(4, (4 * len(pairs)).bit_length())
        slots = np.full(1 << self.bits, -1, np.int64)
        value = np.full(1 << self.bits, NONE, np.int64)
        mask = (1 << self.bits) - 1
        at = self._slot(np.fromiter(pairs, np.int64, len(pairs))).tolist()
        self.probes = 1
        for k, h in zip(pairs, at, strict=True):
            n = 1
            while slots[h] >= 0:
                h = (h + 1) & mask
                n += 1
            slots[h], value[h] = k, pairs[k]
            self.probes = max(self.probes, n)
        self.slots, self.value = slots, value
        self.known: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where they do not merge."""
        key = a * self.size + b
        h = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            seen = self.slots[h[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.value[h[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
            if not len(open_):
                break
            h[open_] = (h[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_wide(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids, as little-endian bytes, of pieces of 2 to ``size`` bytes; ``size`` is a power of two."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        text = np.zeros((n, size), np.uint8)
        text[np.arange(size) < lens[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.bytes_at[text]
        token[np.arange(size) >= lens[:, None]] = -1
        shift = size.bit_length() - 1
        none = NONE << 0
        tree = np.full((n, 2 * size), none, np.int64)
        r, c = np.nonzero(np.arange(size) + 1 < lens[:, None])
        rank = self.merged(token[r, c], token[r, c + 1])
        ok = rank != NONE
        tree[r[ok], size + c[ok]] = (rank[ok] << shift) + c[ok]
        for level in range(shift - 1, -1, -1):
            k = 1 << level
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        live = np.arange(n)

        def put(rows: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = what
            for _ in range(shift):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            out = np.full(len(rows), none, np.int64)
            both = np.flatnonzero(nxt < lens[rows])
            rank = self.merged(token[rows[both], at[both]], token[rows[both], nxt[both]])
            ok = rank != NONE
            out[both[ok]] = (rank[ok] << shift) + at[both[ok]]
            return out

        while True:
            root = tree[live, 1]
            live, root = live[root != none], root[root != none]
            if not len(live):
                break
            at = root & (size - 1)
            gone = after[live, at]
            nxt = after[live, gone]
            token[live, at] = root >> shift
            token[live, gone] = -1
            after[live, at] = nxt
            inner = nxt < size
            before[live[inner], nxt[inner]] = at[inner]
            put(live, gone, np.full(len(live), none, np.int64))
            put(live, at, pair(live, at, nxt))
            prev = before[live, at]
            has = prev >= 0
            put(live[has], prev[has], pair(live[has], prev[has], at[has]))
        kept = token >= 0
        flat = token[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_long(self, piece: bytes) -> bytes:
        """The same over lists, for one piece of any length."""
        n = len(piece)
        shift = max(1, (n - 1).bit_length())
        size = 1 << shift
        token = self.bytes_at[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, width = self.pairs.get, self.size
        tree = [NONE] * (2 * size)

        def pair(p: int) -> int:
            q = after[p]
            r = get(token[p] * width + token[q]) if q < n else None
            return NONE if r is None else (r << shift) + p

        for p in range(n):
            tree[size + p] = pair(p)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(p: int, what: int) -> None:
            k = size + p
            tree[k] = what
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                best = a if a < b else b
                if tree[k] == best:
                    break
                tree[k] = best

        while tree[1] != NONE:
            p = tree[1] & (size - 1)
            token[p] = tree[1] >> shift
            gone = after[p]
            nxt = after[p] = after[gone]
            token[gone] = -1
            if nxt < n:
                before[nxt] = p
            put(gone, NONE)
            put(p, pair(p))
            if before[p] >= 0:
                put(before[p], pair(before[p]))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)  # a piece that is a token as it stands
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[i] = self.encode_long(p)
            else:
                by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, at in by_size.items():
            step = max(64, (1 << 18) // size)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                for i, ids in zip(some, self.encode_wide([pieces[i] for i in some], size), strict=True):
                    out[i] = ids
        return out


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Vocabulary(shared.value)
    return _loaded[shared.id]


class _Shared:
    """A broadcast and the id it is remembered by."""

    def __init__(self, spark, path: str) -> None:
        lines = open(path, "rb").read()
        if len(lines) > VOCABULARY_BYTES:
            raise ValueError(f"vocabulary of {len(lines)} bytes is over {VOCABULARY_BYTES}")
        self.broadcast, self.id = spark.sparkContext.broadcast(lines), path

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _encoder(shared: _Shared, pattern: str):
    def encode(batches):
        vocabulary, find = _vocabulary(shared), regex.compile(pattern).findall
        known = vocabulary.known
        for batch in batches:
            out, texts, k = [], batch.column(batch.num_columns - 1).to_pylist(), 0
            while k < len(texts):  # a few MB of text at a time
                some, size = [], 0
                while k < len(texts) and size < 1 << 20:
                    some.append(find(texts[k] or ""))
                    size += len(texts[k] or "")
                    k += 1
                if len(known) > CACHE:
                    known.clear()
                fresh = list(set().union(*some).difference(known))
                known.update(zip(fresh, vocabulary.encode_pieces([p.encode() for p in fresh]), strict=True))
                out += [b"".join(map(known.__getitem__, pieces)) for pieces in some]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "ids"])
        released()

    return encode


def _decoder(shared: _Shared):
    def decode(batches):
        tokens = {int(b): base64.b64decode(a) for a, b in (x.split() for x in shared.value.splitlines() if x)}
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])
        released()

    return decode


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(_Shared(docs.sparkSession, path), pattern), "id long, ids binary").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Id, ``ids`` and ``decoded``, the bytes that the ids stand for."""
    small_batches(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).cast("long").alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decoder(_Shared(tokens.sparkSession, path)), "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)
