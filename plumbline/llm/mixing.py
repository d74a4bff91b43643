"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should have; the whole part is
given, the fraction has to be rounded. Rounding documents on their own would let the total drift with the square root of
their number. Pivotal rounding takes two documents with open fractions and moves mass between them, weighted by their
sizes so that the words of the two together stay the same, until one is 0 or 1; which of the two ways it goes is drawn so
that every document keeps its expected number of copies. What stays open after a block is one document, and blocks are
combined by a reduction tree: the open document of each of FAN blocks goes into one block of the next level, until one
is left per source, which goes to the nearer side. A source's words so differ from its target by half a document at most.

Rows equal in doc_id, source and text are one unit of several rows: the whole part of their common mass is given to as
many of them, and what remains is the fraction of one document, so that a unit is never rounded as a lump.

Blocks hold about BLOCK_ROWS units of one source, chosen by a hash, so a source with a third of all rows has as
many more blocks. Draws are hashes of the unit and level: another run, or a repeated task, draws the same.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ship, text_of, words_of
from plumbline.llm.textnum import U, mix
from plumbline.operators.groups import times

SHARE = 1.5  # of all sizes
MOST = 2  # copies of a document
WEIGHTS = (3, 1, 2)
BLOCK_ROWS = 20_000
FAN = 256


def targets(sizes: DataFrame) -> DataFrame:
    """Sources (source, n_rows, source_size) with their target: shares by weight, none above MOST times its size.

    Resharing the excess by weight until none is above ends where every source has min(MOST * size, level * weight);
    the level follows from one running sum over the sources in the order in which they reach their limit. The table has
    a row per source and the running sums pass through one task: sources, unlike documents, are few.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    limited = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * float(MOST))
    order = [F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    given = F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * SHARE - given) / left
    stepped = limited.withColumn("level", level)
    # The sources before the first that does not reach its limit are full; the level at that one holds for all.
    open_level = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "level"))).over(everything)
    final = F.coalesce(open_level["level"], F.lit(float("inf")))
    return stepped.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("limit"), final * F.col("weight")))).select(
        "source", "n_rows", "source_size", "target"
    )


def _draw(rows: np.ndarray, level: int) -> np.ndarray:
    """Uniform numbers in [0, 1), fixed by row and level."""
    return (mix(mix(rows.view(U) + U(0x5851F42D)) + U(level + 1)) >> U(11)).astype(np.float64) / float(1 << 53)


def settle_block(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding along a block: all of ``p`` become 0 or 1 but one, and sum(size * p) stays.

    Sizes are positive and all of ``p`` are strictly between 0 and 1.
    """
    p = p.copy()
    i = 0
    for j in range(1, len(p)):
        a, b, x, y = size[i], size[j], p[i], p[j]
        up = min(1 - x, y * b / a)  # what i can gain from j
        down = min(x, (1 - y) * b / a)  # what i can give to j
        if draws[j] * (up + down) < down:  # i gains with probability down / (up + down): its mean stays
            x, y = x + up, y - up * a / b
        else:
            x, y = x - down, y + down * a / b
        for k, v in ((i, x), (j, y)):
            p[k] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        if p[i] in (0.0, 1.0):
            i = j
    return p


def _round(level: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        draws = _draw(block["row"].to_numpy(), level)
        order = np.lexsort((block["row"].to_numpy(), draws))
        block, draws = block.iloc[order].reset_index(drop=True), draws[order]
        p, size = block["p"].to_numpy(), block["size"].to_numpy().astype(float)
        live = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
        again = _draw(block["row"].to_numpy(), level + 1000)
        p = p.copy()
        p[live] = settle_block(size[live], p[live], again[live])
        rest = (p > 0) & (p < 1)
        if last:
            p = np.where(rest, np.round(p), p)
        block["p"] = p
        return block

    return run


UNIT = ["doc_id", "source", "t0", "t1", "size"]


def _unit(doc_id: Column, source: Column, text: Column) -> list[Column]:
    text = text_of(text.cast("string"))
    return [
        doc_id.cast("bigint").alias("doc_id"), source.cast("string").alias("source"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"),
        F.size(words_of(text)).cast("bigint").alias("size"),
    ]


def _decisions(docs: DataFrame) -> DataFrame:
    """Copies of every unit: its columns, times (its rows), source_size, target, whole (copies of each row) and extra (rows that
    get one more)."""
    ship(docs.sparkSession)
    rows = docs.select(*_unit(F.col("doc_id"), F.col("source"), F.col("text")))
    units = cut(rows.groupBy(*UNIT).agg(F.count("*").alias("times")))
    sizes = units.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.col("size") * F.col("times")).alias("source_size"))
    named = targets(sizes).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    named = cut(named.withColumnRenamed("source", "name"))
    mass = F.when(F.col("size") > 0, (F.col("rate") - F.floor("rate")) * F.col("times")).otherwise(0.0)
    rate = units.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        *UNIT, "times", "source_size", "target",
        F.floor("rate").cast("int").alias("whole"),
        F.floor(mass).cast("bigint").alias("extra"),
        (mass - F.floor(mass)).alias("p"),
        F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("bigint").alias("blocks"),
    )
    row = F.xxhash64("doc_id", "t0", "size")
    block = F.pmod(F.shiftrightunsigned(row, 8), F.greatest("blocks", F.lit(1)))
    level_rows = rate.withColumns({"row": row, "block": block})
    fixed = "doc_id bigint, source string, t0 bigint, t1 bigint, size bigint, times bigint, source_size bigint, target double, whole int, extra bigint, p double, row bigint, block bigint"
    level_rows = level_rows.select(*[c.split()[0] for c in fixed.split(", ")])
    most = named.agg(F.max(F.ceil(F.col("n_rows") / BLOCK_ROWS))).head()[0] or 1
    done = [level_rows.filter("p = 0")]
    level_rows, level = level_rows.filter("p > 0"), 0
    while True:
        rounded = cut(level_rows.groupBy("source", "block").applyInPandas(_round(level, most <= 1), fixed))
        done.append(rounded.filter("p = 0 OR p = 1"))
        if most <= 1:
            break
        most, level = -(-most // FAN), level + 1
        level_rows = rounded.filter("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / FAN))
    settled = reduce(DataFrame.union, done)
    return settled.withColumn("extra", F.col("extra") + F.col("p").cast("bigint")).drop("p", "row", "block")


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken.

    Size is the number of words, a null text has none and takes nothing. A null source is a source of its own, the
    last. Rows without doc_id, or with one that others have too, are rounded like any other. Other columns are not read; an empty table gives no rows.
    """
    units = _decisions(docs)
    parts = F.inline(F.array(
        F.struct((F.col("whole") + 1).alias("copies"), F.col("extra").alias("n")),
        F.struct(F.col("whole").alias("copies"), (F.col("times") - F.col("extra")).alias("n")),
    ))
    rows = units.select("doc_id", "size", "source_size", "target", parts).filter("n > 0")
    taken = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "n")
    return times(taken, "n")


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix: every document as many times as it was taken, with the columns of ``docs``.

    Of rows equal in doc_id, source and text, those with one copy more are drawn by chance, so a source with n of them may
    take the square root of n documents more or less.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    key = _unit(*[F.col(own[docs.columns.index(n)]) for n in ("doc_id", "source", "text")])
    taken = _decisions(docs).filter("whole > 0 OR extra > 0").select(*[F.col(c).alias(f"u_{c}") for c in UNIT], "times", "whole", "extra")
    rows = docs.toDF(*own).select(*own, *key)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in UNIT])
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.col("times")) < F.col("extra")
    rows = rows.join(cut(taken), same).withColumn("copies", F.col("whole") + drawn.cast("int")).filter("copies > 0")
    return rows.select(*own, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*own).toDF(*docs.columns)
