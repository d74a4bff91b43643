"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 120-bit key: 60 bits of a hash of the text, so that equal texts stand together, then 60 bits of a
hash of the whole row and a number that tells equal rows apart, which splits a text that many documents share. Equal rows
can be swapped, so those that occur more than once are counted and written out again with their numbers. The splitters between shards are found by counting: each
round counts exact bytes per key interval across all partitions, keeps for every splitter the interval its target falls
into and refines only that one, until the splitter is within tolerance of its target or the key is used up. Then rows are
exchanged once.

Slots inside a shard follow the row hash: a shard is cut into intervals of it small enough to be sorted by a task
each, and counts of the intervals give where each begins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import cut, text_of, unused
from plumbline.operators.bloom import bloom, marked

SHARDS = 40
OVERHEAD = 16
BITS = 60  # of each half of the key
FIRST, STEP = 12, 8  # bits that a round refines
TOLERANCE = 0.002  # of a shard's bytes
ROWS_PER_SLOT_BIN = 5_000  # what one task sorts at most, on average
SPREAD = 1_000  # equal rows written out by a task


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and a fixed overhead per row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def _keys(text: Column) -> tuple[Column, Column]:
    """The halves of the key of a row with its hash h0 and its number copy."""
    high = F.shiftrightunsigned(F.xxhash64(text_of(text)), 64 - BITS)
    low = F.shiftrightunsigned(F.xxhash64("h0", "copy"), 64 - BITS)
    return high, low


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs``, columns c0, c1, ..., with h0, a hash of the whole row, and copy, a number among equal rows from 0."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    cells = []
    for name, field in zip(own, docs.schema.fields, strict=True):
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        cells += [F.to_json(F.struct(name)) if nested else F.col(name), F.col(name).isNull()]
    hashed = docs.toDF(*own).select(*own, F.xxhash64(*cells).alias("k0"), F.xxhash64(F.lit(1), *cells).alias("k1"))
    repeated = cut(hashed.groupBy("k0", "k1").agg(F.count("*").alias("n")).filter("n > 1").select("k0", "k1"))
    if repeated.isEmpty():
        return hashed.select(*own, F.col("k0").alias("h0"), F.lit(0).cast("bigint").alias("copy"))
    split = marked(hashed, cut(bloom(repeated)), "hit")
    once = split.filter("NOT hit").select(*own, F.col("k0").alias("h0"), F.lit(0).cast("bigint").alias("copy"))
    groups = split.filter("hit").groupBy("k0", "k1").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in own])
    # Numbers are dealt out in two steps, so that a row that occurs very often is not written out by one task.
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SPREAD)))
    dealt = groups.select("k0", "n", *own, chunk.alias("chunk")).repartition("k0", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * SPREAD) - 1
    again = dealt.select(*own, F.col("k0").alias("h0"), F.explode(F.sequence(F.col("chunk") * SPREAD, last)).alias("copy"))
    return once.union(again)


def _prefix(used: int) -> tuple[Column, Column]:
    """The first ``used`` bits of the key: of the high half, and of the low half where the high one is used up."""
    high = F.shiftright("high", max(BITS - used, 0))
    low = F.lit(0).cast("bigint") if used <= BITS else F.shiftright("low", 2 * BITS - used)
    return high, low


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Key boundaries (high, low): shard i holds the keys from boundary i - 1 on and below boundary i.

    ``keys`` has columns high, low, size. The driver gets one row per refined interval: at most
    2**FIRST, then shards * 2**STEP a round.
    """
    bounds: dict[int, tuple[int, int]] = {}
    open_at: dict[int, tuple[int, int, int]] = {}  # splitter -> prefix (high, low), bytes before it
    used, width, total = 0, FIRST, None
    while total is None or open_at:
        outer_high, outer_low = _prefix(used)
        inner_high, inner_low = _prefix(used + width)
        rows = keys
        if total is not None:
            wanted = sorted({(h, low) for h, low, _ in open_at.values()})
            within = reduce(or_, [(outer_high == h) & (outer_low == low) for h, low in wanted])
            rows = rows.filter(within)
        counted = rows.groupBy(inner_high.alias("h"), inner_low.alias("l")).agg(F.sum("size").alias("n"))
        counted = sorted((r.h, r.l, r.n) for r in counted.collect())
        used += width
        if total is None:
            total = sum(n for *_, n in counted)
            open_at = {i: (0, 0, 0) for i in range(1, shards)}
        share = total / shards
        inside: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        back = width  # bits that lead from an interval to the one that was refined
        for h, low, n in counted:
            if used == width:
                outer = (0, 0)
            elif used <= BITS:
                outer = (h >> back, 0)
            else:
                outer = (h, low >> back)
            inside.setdefault(outer, []).append((h, low, n))
        after: dict[int, tuple[int, int, int]] = {}
        for i, (h, low, before) in open_at.items():
            target, seen = i * share, before
            rows_in = inside.get((h, low), [])
            at = None
            for ih, il, n in rows_in:
                if seen + n > target:
                    at = (ih, il, n)
                    break
                seen += n
            if at is None:  # nothing left to divide: the boundary is the interval's end
                at = (rows_in[-1][0], rows_in[-1][1], 0) if rows_in else (h, low, 0)
                bounds[i] = _edge(at, used, 1)
            elif target - seen <= tolerance * share:
                bounds[i] = _edge(at, used, 0)
            elif seen + at[2] - target <= tolerance * share:
                bounds[i] = _edge(at, used, 1)
            elif used >= 2 * BITS:
                bounds[i] = _edge(at, used, int(seen + at[2] - target < target - seen))
            else:
                after[i] = (at[0], at[1], seen)
        open_at = after
        if used < BITS:
            width = min(STEP, BITS - used)
        else:
            width = min(STEP, 2 * BITS - used)
    return [bounds[i] for i in range(1, shards)]


def _edge(interval: tuple[int, int, int], used: int, end: int) -> tuple[int, int]:
    """The first key of an interval, or the first behind it."""
    h, low, _ = interval
    if used <= BITS:
        return (h + end) << (BITS - used), 0
    return h, (low + end) << (2 * BITS - used)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with columns shard and slot (0, 1, ... in each shard), exchanged once.

    Shard sizes differ from equal shares by the tolerance, or by a row where one row is larger than that, equal rows and
    rows without doc_id included. A null text counts as empty, a null doc_id is a value like any other. All columns are kept; names that clash get underscores behind them. An empty table gives no rows.
    """
    if docs.isEmpty():
        return docs.select("*", F.lit(0).alias(unused("shard", docs)), F.lit(0).cast("bigint").alias(unused("slot", docs)))
    rows, text = _numbered(docs), F.col(f"c{docs.columns.index('text')}")
    high, low = _keys(text)
    keys = cut(rows.select(high.alias("high"), low.alias("low"), size_of(text).alias("size")))
    edges = splitters(keys, shards)
    rows_in_all = keys.count()
    bins = 1
    while bins * ROWS_PER_SLOT_BIN * shards < rows_in_all:
        bins *= 2
    shift = BITS - (bins.bit_length() - 1)

    def shard_of(h: Column, low: Column) -> Column:
        passed = [((h > eh) | ((h == eh) & (low >= el))).cast("int") for eh, el in edges]
        total = F.lit(0)
        for p in passed:
            total = total + p
        return total

    counted = keys.groupBy(shard_of(F.col("high"), F.col("low")).alias("s"), F.shiftright("low", shift).alias("b")).agg(F.count("*").alias("n"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    placed = rows.select(*own, high.alias("high"), low.alias("low"))
    placed = placed.select(*own, "high", "low", shard_of(F.col("high"), F.col("low")).alias("s"), F.shiftright("low", shift).alias("b"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = cut(counted.select("s", "b", before.alias("begin")))
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("low", "high"))
    ranked = placed.withColumn("rank", rank)
    result = ranked.join(begins, ["s", "b"]).select(*own, "s", (F.col("begin") + F.col("rank") - 1).cast("bigint").alias("slot"))
    return result.toDF(*docs.columns, unused("shard", docs), unused("slot", docs))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns of every document."""
    out = sharded(docs, shards)
    *_, shard, slot = out.columns
    return out.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col(f"`{shard}`").cast("int").alias("shard"),
        F.col(f"`{slot}`").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
