"""The trie of all conversations' turns, node by node.

A turn (role, text) has an id of 16 bytes, two hashes of 64 bits, big-endian; a conversation is the string of its ids. Such
strings go into adaptive radix trees (``radix``), and only depths at whole turns are nodes. A node's key is the exclusive or
of two 64-bit hashes of (id, position) over its turns, so that a key does not need the whole string.

No conversation and no group of them is gathered: strings are cut into pieces of PIECE turns, each of which knows the key of the
node it hangs from; pieces are sorted by that key and their bytes and dealt out by range, and a task builds a tree of at most
TREE_PIECES pieces at a time. A tree holds a part of the trie; the parts of one node are added up by its key. A popular first
turn is so a part of many trees and one row of each.

What a subtree adds up comes from weights of conversations. A node belongs to its smallest member. A conversation's weight is
the sum over the nodes that belong to it; the sum of a node's members' weights, less what its own member has above the node, is
the sum over its subtree: members other than its own have all their nodes below it. Leaves likewise. So a second run of the
same trees over the weights gives n_leaves and saved_tokens, without a walk from leaf to root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ship, text_of, words_of
from plumbline.llm.radix import Tree
from plumbline.operators.groups import join_groups
from plumbline.sources.tables import ROW

PIECE = 64
TREE_PIECES = 4096
CHAIN = 4096
WIDTH = 16
FAMILY, MOST_BORROWED = 20, 4
_LOW = (1 << 33) - 1  # the running number within a partition in a monotonic id
PARTS = "depth bigint, k0 bigint, k1 bigint, above0 bigint, above1 bigint, words bigint, conv bigint, n bigint, weight bigint, leaves bigint"


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with r, their place in their conversation from 0 (by turn, null first, then role and text): c, part, r, i0, i1, words.

    All turns are sorted by range, so a long conversation spans many partitions; a place is the running number in its
    partition, plus the conversation's turns in those before. Random numbers only deal out equal turns, whose order is
    of no effect.
    """
    role, text = text_of(F.col("role").cast("string")), text_of(F.col("text").cast("string"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("t"), role.alias("role"), text.alias("text"), F.rand(13).alias("deal"))
    order = ["c", F.col("t").asc_nulls_first(), "role", "text", "deal"]
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = rows.select(
        "c",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)).alias("at"),
        F.xxhash64("role", F.lit(0), "text").alias("i0"),
        F.xxhash64(F.lit(1), "role", F.lit(0), "text").alias("i1"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("words"),
    )
    placed = cut(placed)
    runs = placed.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return cut(placed.join(runs, ["c", "part"]).select("c", "part", (F.col("at") - F.col("first") + F.col("before")).alias("r"), "i0", "i1", "words"))


def borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_BORROWED


def rebuilt(turns: DataFrame, lend: bool = True) -> tuple[DataFrame, DataFrame]:
    """All conversations (c, len) and their turns (c, pos, i0, i1, words) after the exchange of first turns (or as they are)."""
    numbered = _numbered(turns)
    runs = numbered.groupBy("c", "part").agg(F.count("*").alias("n"))
    sizes = cut(runs.groupBy("c").agg(F.sum("n").alias("n")))
    if not lend:
        return sizes.withColumnRenamed("n", "len"), numbered.withColumnRenamed("r", "pos").drop("part")
    needs = sizes.withColumns({"h": borrowed(F.col("c")), "lender": F.col("c") - F.col("c") % FAMILY})
    lenders = sizes.select(F.col("c").alias("lender"), F.col("n").alias("has"))
    given = F.least("h", F.coalesce("has", F.lit(0)))
    convs = needs.join(lenders, "lender", "left").select("c", "n", "h", "lender", given.alias("given"))
    convs = cut(convs.withColumn("len", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = numbered.join(runs.select("c", "part").join(convs.select("c", "h", "given"), "c"), ["c", "part"]).where("r >= h")
    own = own.select("c", (F.col("r") - F.col("h") + F.col("given")).alias("pos"), "i0", "i1", "words")
    first = numbered.where((F.col("c") % FAMILY == 0) & (F.col("r") < MOST_BORROWED)).withColumnRenamed("c", "lender")
    lent = convs.select("c", "h", "lender").join(first, "lender").where("r < h").select("c", F.col("r").alias("pos"), "i0", "i1", "words")
    return convs.select("c", "len"), own.union(lent)


def pieces(turns: DataFrame, length: int = PIECE) -> DataFrame:
    """Strings cut into pieces: c, piece (number from 0), s0, s1 (key of the node above), turns (i0, i1, x0, x1, words in order), path."""
    x0, x1 = F.xxhash64("i0", "i1", "pos"), F.xxhash64("pos", "i0", "i1")
    parts = (
        turns.select("c", F.floor(F.col("pos") / length).cast("bigint").alias("piece"), F.struct("pos", "i0", "i1", x0.alias("x0"), x1.alias("x1"), "words").alias("turn"))
        .groupBy("c", "piece")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.x0").alias("y0"), F.bit_xor("turn.x1").alias("y1"))
    )
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.bit_xor(f"y{i}").over(before), F.lit(0)).cast("bigint").alias(f"s{i}") for i in (0, 1)]
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.concat(F.lpad(F.hex(t["i0"]), 16, "0"), F.lpad(F.hex(t["i1"]), 16, "0"))), ""))
    return parts.select("c", "piece", *above, "turns", path.alias("path"))


def _trees(batches: Iterator[pd.DataFrame], length: int, limit: int) -> Iterator[pd.DataFrame]:
    """Sorted pieces with weights to parts of nodes, a tree for every ``limit`` or fewer under one node."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    held: list[tuple] = []

    def flush() -> pd.DataFrame:
        number, s0, s1 = held[0][1:4]
        tree, out = Tree(), []
        of = {}
        for c, _, _, _, turns, path, weight, leaf in held:
            of[c] = turns
            tree.add(bytes(path), c, [1, int(weight), int(leaf)])
        keys: dict[int, list[tuple[int, int]]] = {}
        for ids, (c, n, weight, leaves) in tree.totals(WIDTH):
            if not ids:
                continue  # the node above
            if c not in keys:
                run = [(s0, s1)]
                for t in of[c]:
                    run.append((run[-1][0] ^ t["x0"], run[-1][1] ^ t["x1"]))
                keys[c] = run
            run = keys[c]
            out.append((number * length + ids, *run[ids], *run[ids - 1], of[c][ids - 1]["words"], c, n, weight, leaves))
        held.clear()
        return pd.DataFrame(out, columns=names)

    for batch in batches:
        for row in zip(*[batch[c] for c in ("c", "piece", "s0", "s1", "turns", "path", "weight", "leaf")]):
            if held and (row[1:4] != held[0][1:4] or len(held) >= limit):
                yield flush()
            held.append(row)
    if held:
        yield flush()


def _grown(cutup: DataFrame, convs: DataFrame, length: int, limit: int) -> DataFrame:
    """Nodes with turns, added up over all trees: PARTS. ``convs`` has the weight and leaf of conversations."""
    order = ["piece", "s0", "s1", "path", "c"]
    partitions = int(cutup.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = convs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - 1) / length).cast("bigint"))))
    weighed = cutup.join(every.select("c", "piece", "weight", "leaf"), ["c", "piece"])
    dealt = weighed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    key = ["depth", "k0", "k1"]
    sums = [F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("leaves").alias("leaves")]
    one = [F.first(c).alias(c) for c in ("above0", "above1", "words")]
    return dealt.mapInPandas(lambda batches: _trees(batches, length, limit), PARTS).groupBy(*key).agg(*one, *sums)


def _before(nodes: DataFrame) -> DataFrame:
    """(depth, k0, k1, head): the value that a node's own member has in nodes above it. A long chain is added up in blocks."""
    chain = nodes.select("depth", "k0", "k1", "conv", "value", F.floor(F.col("depth") / CHAIN).alias("block"))
    sums = chain.groupBy("conv", "block").agg(F.sum("value").alias("all"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("before") + F.coalesce(F.sum("value").over(inside), F.lit(0))
    return chain.join(sums, ["conv", "block"]).select("depth", "k0", "k1", head.alias("head"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members that end at a node, in order, to one digest per node; only the digest under way is held."""
    now, digest = None, None
    for batch in batches:
        out = []
        for depth, k0, k1, c in zip(*[batch[x] for x in ("depth", "k0", "k1", "c")]):
            if now == (depth, k0, k1):
                digest.update(b",%d" % c)
                continue
            if now is not None:
                out.append((*now, digest.hexdigest()))
            now, digest = (depth, k0, k1), hashlib.sha256(b"%d" % c)
        yield pd.DataFrame(out, columns=["depth", "k0", "k1", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=["depth", "k0", "k1", "ends_sha256"])


def prefix_trie(conversations: DataFrame, lend: bool = True, length: int = PIECE, limit: int = TREE_PIECES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in order of turn (null first), then role and text; a null role or text is empty. Rows equal in all of these
    are turns of their own. Rows without conv_id belong to no conversation and are left out. ``lend=False`` leaves
    conversations as they are. An empty table has no nodes, not even a root; other columns are not read.
    """
    ship(conversations.sparkSession)
    convs, turns = rebuilt(conversations, lend)
    convs = cut(convs)
    cutup = cut(pieces(turns, length))
    key = ["depth", "k0", "k1"]
    plain = convs.where("len > 0").select("c", "len", F.lit(0).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("leaf"))
    zero = F.lit(0).cast("bigint")
    root = convs.groupBy().agg(F.min("c").alias("conv"), F.count("*").alias("n")).where("n > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), zero.alias("above0"), zero.alias("above1"), zero.alias("words"), "conv", "n"
    )
    nodes = _grown(cutup, plain, length, limit).drop("weight", "leaves")
    nodes = cut(root.unionByName(nodes).withColumn("value", (F.col("n") - 1) * F.col("words")))

    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above0").alias("k0"), F.col("above1").alias("k1"))
    children = cut(below.agg(F.count("*").alias("n_children")))
    counted = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    counted = cut(counted)
    weights = counted.groupBy(F.col("conv").alias("c")).agg(F.sum("value").alias("weight"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    weighed = convs.join(weights, "c", "left").select(
        "c", "len", F.coalesce("weight", F.lit(0).cast("bigint")).alias("weight"), F.coalesce("leaf", zero).alias("leaf")
    )
    weighed = cut(weighed)
    sums = _grown(cutup, weighed.where("len > 0"), length, limit).select(*key, "weight", "leaves")
    whole = weighed.groupBy().agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaves"))
    sums = sums.union(whole.where("leaves IS NOT NULL").select(zero, zero, zero, "weight", "leaves"))

    # A parent may have very many children, so they are dealt out before they meet it.
    rows = counted.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above0").alias("k0"), F.col("above1").alias("k1"), F.struct("k0", "k1").alias(ROW))
    parents = counted.where("n_children > 0").select(*key, F.col("n_children").alias("n"), F.col("conv").alias("parent"))
    named = join_groups(rows, parents, counted.count()).select((F.col("depth") + 1).alias("depth"), F.col(ROW)["k0"].alias("k0"), F.col(ROW)["k1"].alias("k1"), "parent")

    ends = _ends(convs, cutup, length)
    return (
        counted.join(sums, key)
        .join(_before(counted), key)
        .join(named, key, "left")
        .join(ends, key, "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            F.col("leaves").alias("n_leaves"),
            (F.col("weight") - F.col("head")).cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def _ends(convs: DataFrame, cutup: DataFrame, length: int) -> DataFrame:
    """The digest of the members that end at a node, for nodes that have any."""
    folded = [F.expr(f"aggregate(turns, s{i}, (a, t) -> a ^ t.x{i})").alias(f"k{i}") for i in (0, 1)]
    last = cutup.join(convs.where("len > 0").select("c", "len", F.floor((F.col("len") - 1) / length).cast("bigint").alias("piece")), ["c", "piece"])
    zero = F.lit(0).cast("bigint")
    at = last.select(F.col("len").alias("depth"), *folded, "c").union(convs.where("len = 0").select(zero, zero, zero, "c"))
    key = ["depth", "k0", "k1"]
    return at.repartition(*key).sortWithinPartitions(*key, "c").mapInPandas(_digests, "depth bigint, k0 bigint, k1 bigint, ends_sha256 string")
