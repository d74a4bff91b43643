"""Browsing result tables: search, filters, column choice, counts and headline figures."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import quote
from plumbline.rules import SEVERITIES

SUMMARY_GROUPS = ("severity", "issue_type", "source", "column")


def search(frame: DataFrame, term: str) -> DataFrame:
    """Rows with the term, as plain text in any letter case, in any column."""
    if not term:
        return frame
    needle = F.lit(term.lower())
    hits = [F.coalesce(F.lower(F.col(quote(c)).cast("string")).contains(needle), F.lit(False)) for c in frame.columns]
    return frame.where(reduce(operator.or_, hits))


def select_rows(frame: DataFrame, chosen: Mapping[str, Iterable[Any]]) -> DataFrame:
    """Rows that have one of the chosen values in every column that has a choice."""
    for column, values in chosen.items():
        values = list(values)
        if values:
            frame = frame.where(F.col(quote(column)).isin(*values))
    return frame


def visible_columns(available: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, or the first five."""
    return [c for c in wanted if c in available] or list(available[:5])


def pick_columns(frame: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return frame.select(*[F.col(quote(c)) for c in visible_columns(frame.columns, wanted)])


def count_by(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(F.col(quote(column))).agg(F.count(F.lit(1)).alias("n"))


def severity_counts(tally: DataFrame) -> DataFrame:
    """Issues per severity, zeros included, most severe first."""
    found = tally.groupBy("severity").agg(F.sum("n").alias("n"))
    ranked = enumerate(reversed(SEVERITIES))
    levels = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(s).alias("severity")) for i, s in ranked])
    return (
        tally.sparkSession.range(1, numPartitions=1)
        .select(F.inline(levels))
        .join(F.broadcast(found), "severity", "left")
        .orderBy("p")
        .select("severity", F.coalesce("n", F.lit(0)).alias("n"))
    )


def summary_long(tally: DataFrame) -> DataFrame:
    """(grouping, key, n): the total and the counts by severity, type, source and column."""
    options = [
        F.struct(F.lit(g).alias("grouping"), F.col(g).alias("key")) for g in SUMMARY_GROUPS
    ] + [F.struct(F.lit("total").alias("grouping"), F.lit("all").alias("key"))]
    return (
        tally.select("n", F.inline(F.array(*options)))
        .where(F.col("key").isNotNull())
        .groupBy("grouping", "key")
        .agg(F.sum("n").alias("n"))
    )


def summary_wide(tally: DataFrame) -> DataFrame:
    """One row: total and, per grouping, a map of counts."""
    long = summary_long(tally)

    def counts_of(grouping: str):
        entry = F.when(F.col("grouping") == grouping, F.struct("key", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    names = {"severity": "severity", "issue_type": "type", "source": "source", "column": "column"}
    return long.agg(
        F.coalesce(F.sum(F.when(F.col("grouping") == "total", F.col("n"))), F.lit(0)).alias("total_issues"),
        *[counts_of(g).alias(f"issues_by_{label}") for g, label in names.items()],
    )


def headline(
    overall: DataFrame, kpis: DataFrame, measures: DataFrame
) -> DataFrame:
    """One row of headline figures; the inputs are one or a few rows each."""
    available = F.count_if(F.col("status") != "UNAVAILABLE")
    k = kpis.agg(available.alias("kpis_available"))
    m = measures.agg(F.count(F.lit(1)).alias("measures"))
    parts = [f.withColumn("one", F.lit(1)) for f in (overall, k, m)]
    joined = parts[0].join(F.broadcast(parts[1]), "one").join(F.broadcast(parts[2]), "one")
    return joined.select(
        "total_rows", "total_columns", "overall_score", "letter_grade", "total_issues", "kpis_available", "measures"
    )
