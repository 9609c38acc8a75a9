"""A trie of conversations that share their first turns, with totals of every subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tree_sums import subtree_sums

#: Turns of a conversation that one window holds; longer conversations are cut into such blocks.
BLOCK = 4096
#: Bytes of spelled ids in a row on their way to a digest.
CHUNK = 1 << 20


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation counted from 1.

    They are ordered by turn, null first, then role and text; a null role or text
    is empty, repeated rows are turns of their own, and rows without a
    conversation are left out. All turns are sorted as one range, and what a
    conversation has in earlier parts of the range is added to the numbers inside
    a part, so a conversation with a third of all rows is spread over tasks.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    # rows that are equal in all else are told apart by where they were read, so that they can be cut too
    rows = rows.where("conv_id is not null").withColumn("_read", F.monotonically_increasing_id())
    order = ["turn", "role", "text"]
    dealt = materialize(rows.repartitionByRange("conv_id", *order, "_read").drop("_read").withColumn("slice", F.spark_partition_id()), "trie-turns")
    sizes = dealt.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", before).where("before > 0").drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(offsets, ["conv_id", "slice"], "left").select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("_inside")).alias("place"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, up1, up2, chars): for each turn a 128-bit name of the turns up to it and of those before it.

    A name is the exclusive or of one hash for each place and turn, so that the
    name of a block of turns can be carried to the next block.
    """
    one, two = F.xxhash64("role", "text"), F.xxhash64(F.lit(2), F.col("text"), F.col("role"))
    rows = turns.select("conv_id", F.col("place").alias("depth"), F.xxhash64("place", one, two).alias("h1"), F.xxhash64("place", two, one).alias("h2"), F.length("text").cast("long").alias("chars"))
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    whole = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumn("c1", F.bit_xor("b1").over(earlier)).withColumn("c2", F.bit_xor("b2").over(earlier)).where("block > 0").select("conv_id", "block", "c1", "c2")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.bit_xor("h1").over(inside)).withColumn("r2", F.bit_xor("h2").over(inside)).join(carried, ["conv_id", "block"], "left")
    rows = rows.withColumn("p1", F.col("r1").bitwiseXOR(F.coalesce("c1", F.lit(0)))).withColumn("p2", F.col("r2").bitwiseXOR(F.coalesce("c2", F.lit(0))))
    return rows.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("up2"), "chars")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node and id, spelled out in pieces of one node."""
    node, first, ids, size = None, 0, [], 0
    for batch in batches:
        out = []
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or size >= CHUNK):
                out.append((node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["node", "first", "ids"])
    if ids:
        yield pa.record_batch([pa.array([node]), pa.array([first]), pa.array([",".join(ids)])], names=["node", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id, digested one after the other; one piece is held."""
    node, digest = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                digest.update(b",")
            else:
                if digest:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["node", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def digest_of_ids(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending ids of each node, in decimals and joined by commas.

    The ids are sorted as one range and spelled out in pieces of about a megabyte
    by all tasks; a node's pieces then meet in one task, which streams through
    them, as the digest has to read all of its bytes in order.
    """
    pieces = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_spelled, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` are (conv_id, place, role, text) with places from 1 on, as `ordered`
    gives them; `conversations` (conv_id) adds those without turns. A node of
    depth d is a distinct sequence of first d turns (two are equal if 128 hash
    bits are), the root that of none. It is named by its smallest member and its
    depth, and its last turn is that member's turn d. n_leaves and saved_tokens
    (the last text's code points for every member but one) are summed over the
    node's subtree, itself included; ends_sha256 is of the members that end here.

    Null texts and roles are expected as empty ones. Without conversations there
    is no node. Nodes with a third of all conversations or children are summed
    with partial aggregates.
    """
    named = prefixes(turns)
    zero = F.lit(0).cast("long")
    everyone = turns.select("conv_id") if conversations is None else turns.select("conv_id").unionByName(conversations.select(F.col("conv_id").cast("long")))
    roots = everyone.distinct().select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), zero.alias("chars"))
    members = materialize(named.unionByName(roots), "trie-members")
    key = ["depth", "p1", "p2"]
    nodes = members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("up1").alias("up1"), F.first("up2").alias("up2"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(above, ["depth", "up1", "up2"], "left").select("node", "parent", *key, "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    linked = materialize(linked, "trie-linked")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    grown = materialize(linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-grown")
    totals = subtree_sums(grown.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")), ["n_leaves", "saved_tokens"], "trie")
    # a conversation ends at its deepest node
    ends = members.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("k")).select("conv_id", *[F.col(f"k.{c}").alias(c) for c in key])
    ends = digest_of_ids(ends.join(nodes.select(*key, "node"), key).select("node", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        grown.join(totals, "node")
        .join(ends, "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )
