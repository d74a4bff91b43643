"""Reconciliation: metric values somebody claims, compared with values recomputed from the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import scalars as S
from plumbline.operators import groups as G
from plumbline.operators.kpi import Kpi
from plumbline.operators.measures import measure_values
from plumbline.operators.profile import Profile
from plumbline.sources.tables import Table

METRIC_SCHEMA = "metric string, actual string, available boolean"
TOLERANCE = 1e-5


@dataclass(frozen=True)
class Metric:
    """``kind`` is missing, blank, duplicate_rows, duplicate_ids, range or kpi."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    kpi: Kpi | None = None

    @property
    def name(self) -> str:
        label = {
            "missing": "Missing Values",
            "blank": "Blank Values",
            "duplicate_ids": "Duplicate IDs",
            "range": "Range Violation",
        }.get(self.kind)
        if label:
            return f"{label} ({self.column})"
        return "Duplicate Rows" if self.kind == "duplicate_rows" else self.kpi.kpi_name


def default_metrics(profiled: Profile, duplicate_rows: int, kpis: Sequence[Kpi]) -> list[Metric]:
    """Missing counts of columns that have any, duplicate rows if any, and every KPI that is available."""
    out = [Metric("missing", c.name) for c in profiled.columns if c.null_count]
    out += [Metric("duplicate_rows")] if duplicate_rows else []
    return out + [Metric("kpi", kpi=k) for k in kpis if k.status != "UNAVAILABLE"]


def _counted(table: Table, m: Metric) -> Column:
    c = table.find(m.column)
    if m.kind == "missing":
        return F.count_if(c.cell.isNull())
    if m.kind == "blank":
        return F.expr(f"count_if({S.strip(f'CAST({c.ref} AS STRING)')} = '')")
    if isinstance(c.dtype, (T.IntegralType, T.DecimalType)):
        return F.expr(f"count_if({c.ref} < {Decimal(repr(m.low)):f}BD OR {c.ref} > {Decimal(repr(m.high)):f}BD)")
    n = F.expr(S.to_number(c.ref, c.dtype))
    return F.count_if((n < m.low) | (n > m.high))


def _other_fingerprint(columns) -> list[Column]:
    """Hashes with seeds of their own, so that a count here owes nothing to those of the issue rows."""
    parts = [part for c in columns for part in (G.hashable(c), c.cell.isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(k) for k, seed in (("k0", 20), ("k1", 21))]


def _exact_copies(table: Table) -> int:
    """Later copies counted over the cells themselves, where the issue rows go by hashes of them."""
    return G.compared_copies_count(table, _other_fingerprint).first()[0]


def actual_metrics(
    table: Table, metrics: Sequence[Metric], known_distinct: dict[str, int] | None = None
) -> DataFrame:
    """(metric, actual, available). Row-local counts share one aggregate; duplicate counts come from
    group sizes, apart from how the issue rows are found. Grouped KPIs are reconciled per group with
    reconcile_grouped and are not available here."""
    found: dict[str, object] = {}
    local = [m for m in metrics if m.kind in ("missing", "blank", "range")]
    if local:
        found |= dict(zip([m.name for m in local], table.df.agg(*[_counted(table, m) for m in local]).first()))
    for m in metrics:
        if m.kind == "duplicate_rows":
            found[m.name] = _exact_copies(table)
        elif m.kind == "duplicate_ids":
            found[m.name] = G.repeated_values_count(table, table.find(m.column)).first()[0]
    scalar = {
        m.name: m.kpi.measure
        for m in metrics
        if m.kind == "kpi" and m.kpi.status != "UNAVAILABLE" and m.kpi.measure.group_by is None
    }
    found |= measure_values(table, scalar, known_distinct)
    rows = [
        (m.name, None if found.get(m.name) is None else repr(found[m.name]), m.name in found) for m in metrics
    ]
    return table.spark.createDataFrame(rows, METRIC_SCHEMA)


def compare_values(claimed: Column, actual: Column) -> tuple[Column, Column]:
    """(match, difference). Two NULLs match; numbers match within 1e-5, relative or absolute; anything
    else must be the same text."""
    a, b = _number(claimed), _number(actual)
    numeric = a.isNotNull() & b.isNotNull()
    both_nan = F.isnan(a) & F.isnan(b)
    gap = F.when(a == b, 0.0).otherwise(F.abs(a - b))
    close = gap <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))
    close = (a == b) | (close & ~F.isnan(gap) & (gap != float("inf")))
    same_text = claimed.cast("string") == actual.cast("string")
    match = (
        F.when(claimed.isNull() & actual.isNull(), True)
        .when(claimed.isNull() | actual.isNull(), False)
        .when(numeric, both_nan | close)
        .otherwise(same_text)
    )
    difference = F.when(claimed.isNull() & actual.isNull(), 0.0).when(numeric & both_nan, 0.0).when(numeric, gap)
    return match, difference


def _number(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(f"(?i)^[+-]?nan$|{S.NUMBER}"), text.try_cast("double"))


def _status(frame: DataFrame, keys: list[str], available: Column) -> DataFrame:
    match, difference = compare_values(F.col("claimed"), F.col("actual"))
    status = (
        F.when(~available, F.lit("NOT_AVAILABLE")).when(match, F.lit("MATCH")).otherwise(F.lit("MISMATCH"))
    )
    return frame.select(
        *keys, "claimed", "actual", F.when(available, difference).alias("difference"), status.alias("match_status")
    )


def reconcile(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """``claimed`` is (metric, claimed). A metric on one side only shows with NULL on the other. A ratio
    recomputed as NULL (division by zero) with nothing claimed is NOT_AVAILABLE rather than a match."""
    claims = claimed.select("metric", F.col("claimed").cast("string").alias("claimed"))
    both = claims.join(actual, "metric", "full_outer")
    available = F.coalesce(F.col("available"), F.lit(True)) & ~(
        F.col("claimed").isNull() & F.col("actual").isNull()
    )
    return _status(both, ["metric"], available)


def reconcile_grouped(claimed: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per-group values against claimed ones; both frames are ``keys`` plus claimed / actual. Groups are
    brought together by one shuffle of already aggregated rows, so NULL keys meet as well."""
    left = claimed.select(*keys, F.col("claimed").cast("string"))
    right = actual.select(*keys, F.col("actual").cast("string"))
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*keys)
    both = both.agg(F.max("claimed").alias("claimed"), F.max("actual").alias("actual"))
    return _status(both, keys, F.lit(True))
