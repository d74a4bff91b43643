"""Measures: sums, averages, distinct counts and ratios of columns, alone or grouped.

A measure is a small description compiled straight to an aggregate; its text form is for display only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import to_number, to_timestamp
from plumbline.operators.groups import distinct_counts
from plumbline.sources.tables import ColumnInfo, Table


@dataclass(frozen=True)
class Aggregate:
    function: str  # SUM, AVERAGE or DISTINCTCOUNT
    column: str

    @property
    def text(self) -> str:
        return f"{self.function}({self.column})"


@dataclass(frozen=True)
class Measure:
    top: Aggregate
    bottom: Aggregate | None = None
    group_by: str | None = None

    @property
    def parts(self) -> list[Aggregate]:
        return [self.top] + ([self.bottom] if self.bottom else [])

    @property
    def text(self) -> str:
        text = " / ".join(a.text for a in self.parts)
        return f"{text} grouped by {self.group_by}" if self.group_by else text


def _number(c: ColumnInfo) -> Column:
    """Decimals are summed as decimals, which is exact whatever the order of partitions."""
    return c.cell if isinstance(c.dtype, (T.DecimalType, T.IntegralType)) else F.expr(to_number(c.ref, c.dtype))


def aggregate(table: Table, a: Aggregate) -> Column:
    c = table.find(a.column)
    if a.function == "SUM":
        return F.coalesce(F.try_sum(_number(c)).cast("double"), F.lit(0.0))
    if a.function == "AVERAGE":
        return F.avg(_number(c)).cast("double")
    return F.count_distinct(c.cell)


def measure_values(
    table: Table, measures: dict[str, Measure], known_distinct: dict[str, int] | None = None
) -> dict[str, float | int | None]:
    """Value of each ungrouped measure. Sums and averages come from one shuffle-free aggregate;
    distinct counts are taken from a profile when given, else counted together in one shuffle."""
    needed = {a for m in measures.values() for a in m.parts if table.find(a.column)}
    simple = [a for a in needed if a.function != "DISTINCTCOUNT"]
    got: dict[Aggregate, float | int | None] = {}
    if simple:
        got |= dict(zip(simple, table.df.agg(*[aggregate(table, a) for a in simple]).first()))
    distinct = [a for a in needed if a.function == "DISTINCTCOUNT"]
    known = dict(known_distinct or {})
    missing = [table.find(a.column) for a in distinct if a.column not in known]
    if missing:
        found = {r.ordinal: r.unique_count for r in distinct_counts(table, missing).collect()}
        known |= {c.name: found.get(table.columns.index(c), 0) for c in missing}
    got |= {a: known[a.column] for a in distinct}

    out: dict[str, float | int | None] = {}
    for name, m in measures.items():
        top = got.get(m.top)
        if m.bottom is None:
            out[name] = top
        else:
            bottom = got.get(m.bottom)
            out[name] = None if top is None or not bottom else top / bottom
    return out


def ratio(table: Table, m: Measure) -> Column:
    top = aggregate(table, m.top)
    return F.try_divide(top, aggregate(table, m.bottom)) if m.bottom else top


def measures_by_column(table: Table, measures: dict[str, Measure], column: str) -> DataFrame:
    """Several measures per value of a column, one output column each, from one aggregation; partial aggregation keeps a
    hot value from one task."""
    c = table.find(column)
    return table.df.groupBy(c.cell.alias(c.name)).agg(*[ratio(table, m).alias(name) for name, m in measures.items()])


def measure_by_column(table: Table, m: Measure, value_name: str = "value") -> DataFrame:
    """A measure per value of ``m.group_by``."""
    return measures_by_column(table, {value_name: m}, m.group_by)


def measure_by_time(
    table: Table, m: Measure, grain: str = "month", patterns: Mapping[str, str | None] | None = None, value_name: str = "value"
) -> DataFrame:
    """A measure per period of the date column ``m.group_by``. A text column is read with the layout that its profile
    fixed (``patterns``, by column); it is asked for, because without it 1/2 and 13/2 would fall into different layouts."""
    c = table.find(m.group_by)
    if c.kind == "text" and c.name not in (patterns or {}):
        raise ValueError(f"the date layout of text column '{c.name}' is needed: pass a profile's date_patterns")
    period = F.date_trunc(grain, F.expr(to_timestamp(c.ref, c.dtype, (patterns or {}).get(c.name)))).cast("timestamp_ntz")
    return table.df.groupBy(period.alias(c.name)).agg(ratio(table, m).alias(value_name))
