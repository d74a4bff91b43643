"""A Bloom filter made of rows, so that a large table can be thinned out before it is shuffled.

The filter is a table of 64-bit words, WORDS of them at most whatever goes in, so it may be broadcast. A key (two 64-bit hashes)
sets one bit by each hash; rows keep a key if both its bits are set. No key that went in is lost; of others a few stay, more
as the filter fills up, so the caller checks what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18  # 2^24 bits; 4 MB of words and their numbers


def _word(hash_: str) -> Column:
    return F.pmod(F.col(hash_), F.lit(WORDS)).cast("int")


def _bit(hash_: str) -> Column:
    """A word with one bit set, chosen by bits of the hash that don't choose the word."""
    return F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({hash_}, 40) & 63 AS INT))")


def bloom(keys: DataFrame) -> DataFrame:
    """(word, bits) of the keys k0, k1."""
    both = F.inline(F.array(*[F.struct(_word(k).alias("word"), _bit(k).alias("bit")) for k in ("k0", "k1")]))
    return keys.select(both).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, filter_: DataFrame, name: str) -> DataFrame:
    """The rows with a flag ``name``: may their k0, k1 be in the filter?"""
    hit = F.lit(True)
    for i, k in enumerate(("k0", "k1")):
        probe = F.broadcast(filter_.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}")))
        rows = rows.join(probe, _word(k) == F.col(f"word{i}"), "left")
        hit &= F.coalesce(F.col(f"bits{i}").bitwiseAND(_bit(k)) != 0, F.lit(False))
    return rows.withColumn(name, hit).drop("word0", "word1", "bits0", "bits1")


def thinned(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """The rows whose k0, k1 may be in the filter."""
    for i, k in enumerate(("k0", "k1")):
        probe = F.broadcast(filter_.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}")))
        hit = (_word(k) == F.col(f"word{i}")) & (F.col(f"bits{i}").bitwiseAND(_bit(k)) != 0)
        rows = rows.join(probe, hit).drop(f"word{i}", f"bits{i}")
    return rows
