"""Readiness score: issue counts rolled up to five dimensions and one figure from 0 to 100.

Input is a tally (one row per check at most), so nothing here grows with the data. Counts are kept as
integers until the last step, which makes the result independent of row order and partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default weights, penalties per severity, and the dimension of each issue type.
DEFAULT_WEIGHTS = {
    "COMPLETENESS": 0.25,
    "VALIDITY": 0.25,
    "CONSISTENCY": 0.20,
    "UNIQUENESS": 0.15,
    "RULE_COMPLIANCE": 0.15,
}
PENALTIES = {"INFO": 0.0, "LOW": 0.1, "MEDIUM": 0.5, "HIGH": 1.0, "CRITICAL": 5.0}
DIMENSION_TYPES = {
    "COMPLETENESS": ("MISSING_VALUE", "BLANK_VALUE"),
    "VALIDITY": ("INVALID_EMAIL", "INVALID_DATE", "INVALID_NUMERIC", "INVALID_CATEGORY", "OUT_OF_RANGE"),
    "CONSISTENCY": ("CONSISTENCY_VIOLATION", "comparison"),
    "UNIQUENESS": ("DUPLICATE_ROW", "DUPLICATE_ID", "uniqueness"),
    "RULE_COMPLIANCE": ("required_column", "range", "allowed_values", "referential_integrity"),
}
# Lowest score of each grade, status and letter.
GRADES = (
    (90.0, "Excellent", "READY"),
    (75.0, "Good", "READY_WITH_WARNINGS"),
    (60.0, "Needs Improvement", "REVIEW_REQUIRED"),
    (40.0, "Poor", "NOT_READY"),
)
LETTERS = ((90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D"))


def _pick(value: Column, cases: list[tuple[Column, object]], otherwise: object) -> Column:
    out = F.lit(otherwise)
    for test, result in reversed(cases):
        out = F.when(test, F.lit(result)).otherwise(out)
    return out


def dimension_of(issue_type: Column, source: Column) -> Column:
    known = [(issue_type.isin(*types), d) for d, types in DIMENSION_TYPES.items()]
    return _pick(issue_type, known + [(source == "business_rule", "RULE_COMPLIANCE")], "VALIDITY")


def penalty_of(severity: Column) -> Column:
    return _pick(severity, [(severity == s, p) for s, p in PENALTIES.items()], PENALTIES["MEDIUM"])


def check_weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    weights = dict(DEFAULT_WEIGHTS if weights is None else weights)
    if not set(DEFAULT_WEIGHTS) <= set(weights):
        raise ValueError("Weights dictionary must contain all 5 dimensions.")
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("Weights must sum to 1.0.")
    return weights


def _dimensions(spark: SparkSession, weights: Mapping[str, float], rules_configured: bool) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(d).alias("dimension"),
            F.lit(d.title()).alias("title"),
            F.lit(float(weights[d])).alias("weight"),
            F.lit(d != "RULE_COMPLIANCE" or rules_configured).alias("used"),
        )
        for i, d in enumerate(DEFAULT_WEIGHTS)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def score_dimensions(
    tally: DataFrame,
    total_rows: int,
    total_columns: int,
    weights: Mapping[str, float] | None = None,
    rules_configured: bool = True,
) -> DataFrame:
    """One row per dimension with its score, penalties and explanation."""
    weights = check_weights(weights)
    empty = total_rows == 0 or total_columns == 0
    n, row_level = F.col("n"), F.col("row_level")
    weighted = n * penalty_of(F.col("severity"))
    rolled = (
        tally.withColumn("dimension", dimension_of(F.col("issue_type"), F.col("source")))
        .groupBy("dimension", "severity", "row_level")
        .agg(F.sum("n").alias("n"))
        .groupBy("dimension")
        .agg(
            F.sum("n").alias("issue_count"),
            F.sum(F.when(row_level, n).otherwise(0)).alias("row_issue_count"),
            F.sum(F.when(row_level, weighted).otherwise(0.0)).alias("row_penalty"),
            F.sum(F.when(~row_level, weighted).otherwise(0.0)).alias("dataset_penalty"),
        )
    )
    if empty:
        rolled = rolled.limit(0)
    filled = (
        _dimensions(tally.sparkSession, weights, rules_configured)
        .join(F.broadcast(rolled), "dimension", "left")
        .na.fill(0, ["issue_count", "row_issue_count", "row_penalty", "dataset_penalty"])
    )
    defect_rate = F.col("row_penalty") / F.lit(float(max(total_rows, 1))) + F.col("dataset_penalty")
    applicable = F.lit(not empty) & F.col("used")
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("defect_rate") * 100.0))
    title = F.col("title")
    # The sentences of the explanations, here and in the functions below.
    reason = (
        F.when(F.lit(empty), F.lit("Empty dataset"))
        .when(~F.col("used"), F.format_string("%s is not applicable (no business rules configured).", title))
        .when(F.col("issue_count") == 0, F.format_string("Perfect %s score. No issues detected.", title))
        .otherwise(
            F.format_string(
                "%s score is %.1f because %d issues caused a defect rate of %.4f.",
                title, F.col("score"), F.col("issue_count"), F.col("defect_rate"),
            )
        )
    )
    counted = F.format_string(
        "%d row-level and %d dataset-level issues.", F.col("row_issue_count"), F.col("dataset_issue_count")
    )
    return (
        filled.withColumn("dataset_issue_count", F.col("issue_count") - F.col("row_issue_count"))
        .withColumn("defect_rate", defect_rate)
        .withColumn("is_applicable", applicable)
        .withColumn("score", F.when(applicable, raw).otherwise(100.0))
        .withColumn("reason", reason)
        .withColumn("evidence", F.when(F.lit(empty), F.lit("No data")).otherwise(counted))
        .orderBy("position")
        .select(
            "dimension", "weight", "score", "is_applicable", "issue_count", "row_issue_count",
            "dataset_issue_count", "row_penalty", "dataset_penalty", "defect_rate", "reason", "evidence",
        )
    )


def score_overall(dimensions: DataFrame, total_rows: int, total_columns: int) -> DataFrame:
    """One row: the weighted score over applicable dimensions, its grade, status and letter."""
    counted = F.when(F.col("is_applicable"), F.col("weight"))
    weight, weighted = F.sum(counted), F.sum(counted * F.col("score"))
    overall = F.coalesce(F.try_divide(weighted, weight), F.lit(100.0))
    score = F.col("overall_score")
    issues = F.col("total_issues")
    return (
        dimensions.coalesce(1)
        .agg(overall.alias("overall_score"), F.sum("issue_count").alias("total_issues"))
        .select(
            "overall_score",
            _pick(score, [(score >= cut, g) for cut, g, _ in GRADES], "Critical").alias("grade"),
            _pick(score, [(score >= cut, s) for cut, _, s in GRADES], "NOT_READY").alias("status"),
            _pick(score, [(score >= cut, x) for cut, x in LETTERS], "F").alias("letter_grade"),
            F.lit(total_rows).cast("bigint").alias("total_rows"),
            F.lit(total_columns).cast("bigint").alias("total_columns"),
            "total_issues",
            F.format_string(
                "Overall score is %.1f. Evaluated %d issues across %d rows.",
                score, issues, F.lit(total_rows).cast("bigint"),
            ).alias("explanation"),
        )
    )


def score_recommendations(
    tally: DataFrame, total_rows: int, total_columns: int, rules_configured: bool = True
) -> DataFrame:
    """Up to three texts: the advice for the most frequent issue types, or a remark on clean data."""
    if total_rows == 0 or total_columns == 0:
        tally = tally.limit(0)
        remark = "Dataset is empty. Provide a valid dataset."
    elif rules_configured:
        remark = "Dataset is clean and ready for analysis."
    else:
        remark = "Dataset is technically clean. Consider adding business rules."
    top = (
        tally.groupBy("issue_type")
        .agg(F.sum("n").alias("n"), F.min("recommendation").alias("advice"))
        .orderBy(F.desc("n"), "issue_type")
        .limit(3)
        .select("n", "issue_type", F.format_string("(%d issues) %s", "n", "advice").alias("recommendation"))
    )
    # Types may share one advice and count; such a line is given once, in the place of the first.
    lines = top.groupBy("recommendation").agg(F.max("n").alias("n"), F.min("issue_type").alias("issue_type"))
    line = {"n": F.lit(0).cast("bigint"), "issue_type": F.lit(""), "recommendation": F.lit(remark)}
    clean = F.array(F.struct(*[v.alias(k) for k, v in line.items()]))
    gathered = lines.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "issue_type", "recommendation"))).alias("found")
    )
    chosen = F.when(F.size("found") == 0, clean).otherwise(F.col("found"))
    return gathered.select(F.posexplode(chosen).alias("i", "line")).select(
        (F.col("i") + 1).alias("rank"), "line.recommendation"
    )
