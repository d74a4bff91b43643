"""Detection quality: detected issues against a known answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["row_index", "column", "issue_type"]


def issue_set(issues: DataFrame) -> DataFrame:
    """Distinct (row, column, type)."""
    return issues.select(*[F.col(k).cast("string").alias(k) for k in KEYS]).distinct()


def precision_recall(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per issue type and OVERALL.

    Both sets are stacked and grouped by their key: one shuffle, duplicates and NULL keys included,
    with no join, and one rollup gives types and total. An empty denominator counts as 1.
    """
    sides = []
    for frame, is_expected in ((expected, True), (detected, False)):
        keys = [F.col(k).cast("string").alias(k) for k in KEYS]
        sides.append(frame.select(*keys, F.lit(is_expected).alias("e"), F.lit(not is_expected).alias("d")))
    no_key = [F.lit(None).cast("string").alias(k) for k in KEYS]
    nothing = expected.sparkSession.range(1).select(*no_key, F.lit(False).alias("e"), F.lit(False).alias("d"))  # a total also for empty sets
    seen = sides[0].unionByName(sides[1]).unionByName(nothing).groupBy(*KEYS).agg(F.bool_or("e").alias("e"), F.bool_or("d").alias("d"))
    e, d = F.col("e"), F.col("d")
    sums = (F.count_if(e & d).alias("tp"), F.count_if(d & ~e).alias("fp"), F.count_if(e & ~d).alias("fn"))
    levels = seen.rollup("issue_type").agg(F.grouping("issue_type").alias("all"), *sums)
    levels = levels.where("all = 1 OR tp + fp + fn > 0")  # every real key counts in one of the three
    per_type = levels.select(F.when(F.col("all") == 1, "OVERALL").otherwise(F.col("issue_type")).alias("issue_type"), "tp", "fp", "fn")
    tp = F.col("tp")
    p, r = F.col("precision"), F.col("recall")
    return (
        per_type.withColumn("precision", F.coalesce(F.try_divide(tp, tp + F.col("fp")), F.lit(1.0)))
        .withColumn("recall", F.coalesce(F.try_divide(tp, tp + F.col("fn")), F.lit(1.0)))
        .withColumn("f1", F.coalesce(F.try_divide(2 * (p * r), p + r), F.lit(0.0)))
    )
