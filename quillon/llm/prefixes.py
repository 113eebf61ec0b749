"""A trie of conversation prefixes by smallest-member ownership.

A conversation is a path of turns; a node is a distinct run of first turns, owned by the smallest conversation that begins
with it. If a conversation owns a node it owns all deeper ones of its path, so owned nodes are suffixes of paths. Windows over
a path's places mark them. Every occurrence of a node then knows, from sums along its path, the tokens from it to the path's
end less those of owned nodes, and the owned leaves among them. One group-by on the node sums both: each node below is owned
once by one of the members, so the sums are the subtree's saved tokens and its leaves. No trie is built and no subtree is
gathered.

Places along a conversation, and sums along a path, are found in two levels: rows are dealt by range, so a conversation of
any length lies in several pieces, and pieces carry what came before; paths are cut in blocks of BLOCK turns. Nodes are known
by depth and two 64-bit lanes of what their turns' SHA-256 digests give at each depth; an error needs two of N nodes to agree
in 128 bits. Digests of many ids are taken from runs of ids, joined where they lie, so the one task that a SHA-256 needs reads
a row for every few thousand ids, in order, and holds one.

Cases. A null role or text is empty. Turns go by number, null first; of one number by the first 32 characters of the role, the
first 64 of the text, then by digest; equal rows are turns of their own. A row without a conversation id belongs to none and is
left out. A conversation of any length, and any number of equal ones, is spread over tasks. An empty table has no root. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import forget, stored

#: Turns of a path that one window holds.
BLOCK = 1024
NODE = ["depth", "a", "b"]
_BEFORE = (Window.unboundedPreceding, -1)
_HERE = (Window.unboundedPreceding, 0)


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, own, digest, n_bytes), stored: every turn's place in its conversation, from 1, and that one's turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("r"), text.alias("t"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256))
    turns = turns.select("conv", "turn", F.substring("r", 1, 32).alias("r"), F.substring("t", 1, 64).alias("t"), digest.alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))
    order = ["conv", F.col("turn").asc_nulls_first(), "r", "t", "digest", "n"]
    turns = turns.withColumn("n", F.monotonically_increasing_id())  # parts rows that are equal in all else
    dealt = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")))
    piece = F.shiftright("at", 33).alias("piece")
    pieces = dealt.groupBy("conv", piece).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    by = Window.partitionBy("conv")
    pieces = pieces.withColumn("before", F.coalesce(F.sum("k").over(by.orderBy("piece").rowsBetween(*_BEFORE)), F.lit(0))).withColumn("own", F.sum("k").over(by))
    out = stored(dealt.withColumn("piece", piece).join(pieces, ["conv", "piece"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "own", "digest", "n_bytes"))
    forget(dealt)
    return out


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their group: paths (conv, depth, digest, n_bytes, total) and
    (conv, total), of ``turns`` as ``numbered`` gives them.

    Conversation c takes the first h turns of c - c % group, and keeps its own after its first h; h is crc32(c) % heads.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.where("place = 1").select("conv", "own", h, (F.col("conv") - F.col("conv") % group).alias("base"))
    firsts = turns.where(F.col("place") < heads).groupBy(F.col("conv").alias("base")).agg(F.max("own").alias("base_own"), F.array_sort(F.collect_list(F.struct("place", "digest", "n_bytes"))).alias("first"))
    self = F.col("conv") == F.col("base")
    taken = F.when(self, 0).otherwise(F.least("h", F.coalesce("base_own", F.lit(0)))).cast("long")
    convs = convs.join(firsts, "base", "left").withColumn("taken", taken)
    convs = convs.withColumn("total", F.when(self, F.col("own")).otherwise(F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    given = convs.where("taken > 0").select("conv", F.explode(F.slice("first", 1, F.col("taken").cast("int"))).alias("x"), "total").select("conv", F.col("x.place").alias("depth"), "x.digest", "x.n_bytes", "total")
    skip = F.when(self, 0).otherwise(F.col("h"))
    own = turns.join(convs.select("conv", skip.alias("skip"), "taken", "total"), "conv").where(F.col("place") > F.col("skip"))
    own = own.select("conv", (F.col("place") - F.col("skip") + F.col("taken")).alias("depth"), "digest", "n_bytes", "total")
    return own.unionAll(given), convs.select("conv", "total")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the form of ``rebuilt``."""
    return turns.select("conv", F.col("place").alias("depth"), "digest", "n_bytes", F.col("own").alias("total")), turns.where("place = 1").select("conv", F.col("own").alias("total"))


def _block(depth: str) -> Column:
    return F.floor((F.greatest(F.col(depth), F.lit(1)) - 1) / BLOCK).cast("long")


def occurrences(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of every path, root included, stored: (conv, depth, a, b, pa, pb, n_bytes, total)."""
    lane = lambda k: F.xxhash64(F.lit(k), F.col("depth"), F.col("digest"))
    rows = paths.select("conv", "depth", lane(1).alias("la"), lane(2).alias("lb"), "n_bytes", "total").withColumn("block", _block("depth"))
    along = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(*_HERE)
    runs = rows.select("*", F.bit_xor("la").over(along).alias("a"), F.bit_xor("lb").over(along).alias("b"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(*_BEFORE)
    blocks = rows.where(F.col("total") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("la").alias("xa"), F.bit_xor("lb").alias("xb"))
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("xa", "xb")])
    runs = runs.join(blocks, ["conv", "block"], "left")
    for c in ("a", "b"):
        runs = runs.withColumn(c, F.col(c).bitwiseXOR(F.coalesce(F.col("x" + c), F.lit(0))))
    none = F.lit(None).cast("long")
    nodes = runs.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("la")).alias("pa"), F.col("b").bitwiseXOR(F.col("lb")).alias("pb"), "n_bytes", "total")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("n_bytes"), "total")
    return stored(nodes.unionAll(root))


def marked(occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """Occurrences with whether they are their node's owner's, and if so whether the node is a leaf."""
    no = F.lit(0)
    rows = occ.select("conv", "depth", "a", "b", "n_bytes", "total", no.alias("owns"), no.alias("leaf"))
    owners = nodes.select(F.col("conv_id").alias("conv"), "depth", "a", "b", "n_bytes", "total", F.lit(1).alias("owns"), F.col("leaf").cast("int").alias("leaf"))
    both = rows.withColumn("from", no).unionByName(owners.withColumn("from", F.lit(1))).withColumn("block", _block("depth"))
    place = Window.partitionBy("conv", "block", "depth")
    return both.withColumn("owns", F.max("owns").over(place)).withColumn("leaf", F.max("leaf").over(place)).where("from = 0").drop("from")


def summed(occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, saved_tokens, n_leaves) of every node."""
    tokens, leaves = F.col("n_bytes") * (1 - F.col("owns")), F.col("leaf").cast("long")
    rows = marked(occ, nodes).select("conv", "block", *NODE, tokens.alias("tokens"), leaves.alias("leaves"))
    onward = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(*_HERE)
    rows = rows.withColumn("tokens", F.sum("tokens").over(onward)).withColumn("leaves", F.sum("leaves").over(onward))
    long_ = F.col("total") > BLOCK
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(*_BEFORE)
    blocks = marked(occ.where(long_), nodes.where(long_)).groupBy("conv", "block").agg(F.sum(tokens).alias("t"), F.sum(leaves).alias("l"))
    blocks = blocks.select("conv", "block", F.sum("t").over(later).alias("more_tokens"), F.sum("l").over(later).alias("more_leaves"))
    rows = rows.join(blocks, ["conv", "block"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce("more_" + c, F.lit(0)))
    return rows.groupBy(*NODE).agg(total("tokens").alias("saved_tokens"), total("leaves").alias("n_leaves"))


def _runs(batches):
    """Ids that follow each other in one node, joined by commas."""
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
        ids, out, at = batch.column(3).to_pylist(), [], 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            out.append((*keys[at], ids[at], ",".join(map(str, ids[at:to]))))
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)] if out else [pa.array([], t) for t in [pa.int64()] * 4 + [pa.string()]], [*NODE, "first", "ids"])


def _digested(batches):
    """SHA-256 of each node's runs, in order, joined by commas; nodes may go on in the next batch."""
    key, sha = None, None

    def table(done):
        columns = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *at, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
            if at != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield table(done)
    if key is not None:
        yield table([(*key, sha.hexdigest())])


def ends(occ: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end."""
    key = ", ".join(f"{c} long" for c in NODE)
    last = occ.where("depth = total").select(*NODE, "conv")
    runs = last.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_runs, f"{key}, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digested, f"{key}, ends_sha256 string")


def prefix_trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node, of paths and conversations as ``rebuilt`` or ``whole`` give them: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    occ = occurrences(paths, convs)
    nodes = occ.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.min_by("total", "conv").alias("total"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), (F.max(F.col("total") - F.col("depth")) == 0).alias("leaf"),
    )
    nodes = stored(nodes)
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(summed(occ, nodes), NODE).join(children, NODE, "left").join(ends(occ), NODE, "left").join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
