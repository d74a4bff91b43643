"""The whole analysis of one table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from plumbline.operators import checks as C
from plumbline.operators.detect import TypeDetection, detect_types, detections_frame
from plumbline.operators.kpi import Kpi, defect_rates, grouped_measures, kpis_frame, measure_table, recommend_kpis
from plumbline.operators.profile import Profile, profile
from plumbline.operators.reconcile import Metric, actual_metrics, default_metrics
from plumbline.operators.score import score_dimensions, score_overall, score_recommendations
from plumbline.sources.tables import Table, as_table, dataset_profile, key_faults


@dataclass
class Report:
    """Result tables. All but ``issues`` are schema-sized; ``issues`` is a plan that runs when written
    or queried, and scores do not depend on it."""

    table: Table
    profiled: Profile
    detections: list[TypeDetection]
    kpi_list: list[Kpi]
    issue_count: int
    dataset: DataFrame
    profile: DataFrame
    types: DataFrame
    issues: DataFrame
    tally: DataFrame
    dimensions: DataFrame
    overall: DataFrame
    recommendations: DataFrame
    kpis: DataFrame
    measures: DataFrame
    key_faults: DataFrame
    grouped: DataFrame

    def close(self) -> None:
        """Free the table kept in memory; the result tables stay usable."""
        self.table.release()

    def default_metrics(self) -> list[Metric]:
        copies = self.tally.where("issue_type = 'DUPLICATE_ROW'").agg({"n": "sum"}).first()[0] or 0
        return default_metrics(self.profiled, copies, self.kpi_list)

    def actual_metrics(self, metrics: Sequence[Metric] | None = None) -> DataFrame:
        distinct = {c.name: c.unique_count for c in self.profiled.columns}
        return actual_metrics(self.table, self.default_metrics() if metrics is None else metrics, distinct)


def compiled_checks(
    table: Table, profiled: Profile, types: Mapping[str, str], settings: C.Settings
) -> tuple[C.Values, list[C.Check]]:
    values = C.Values(profiled.date_patterns)
    checks = C.quality_checks(table, types, values, settings)
    return values, checks + C.rule_checks(table, values, settings)


def analyze(
    data: DataFrame | Table,
    row_key: str | Sequence[str] | None = None,
    *,
    rules: Iterable[Mapping[str, Any]] | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    id_columns: Iterable[str] = (),
    allowed_categories: Mapping[str, Iterable[Any]] | None = None,
    column_ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    consistency_rules: Iterable[Mapping[str, Any]] = (),
    weights: Mapping[str, float] | None = None,
    review_threshold: float = 0.10,
    min_parse_rate: float = 0.0,
    exact_distinct: bool = True,
    keep: bool = False,
    key_is_data: bool = True,
) -> Report:
    """Profile a table, find its issues, score it and recommend and compute KPIs. With ``keep`` the
    table stays in memory between the passes until the report is closed; ``key_is_data`` as for ``as_table``."""
    table = data if isinstance(data, Table) else as_table(data, row_key, key_is_data)
    table = table.kept() if keep else table
    settings = C.Settings(
        tuple(id_columns), dict(allowed_categories or {}), dict(column_ranges or {}),
        tuple(consistency_rules), list(rules or []), dict(parents or {}),
    )
    C.validate_rules(settings.rules)
    profiled = profile(table, exact_distinct=exact_distinct)
    detections = detect_types(table, profiled, min_parse_rate)
    types = {d.column_name: d.detected_type for d in detections}
    values, checks = compiled_checks(table, profiled, types, settings)

    spark, n, width = table.spark, table.n_rows, len(table.columns)
    counted = C.counts(table, values, checks)
    tally = C.tally_frame(spark, checks, counted)
    dimensions = score_dimensions(tally, n, width, weights, rules is not None)
    rates = {r["column"]: r["defect_rate"] for r in defect_rates(tally, n).collect()} if n else {}
    kpi_list = recommend_kpis(detections, rates, review_threshold)
    distinct = {c.name: c.unique_count for c in profiled.columns}
    return Report(
        table=table,
        profiled=profiled,
        detections=detections,
        kpi_list=kpi_list,
        issue_count=sum(counted),
        dataset=dataset_profile(table),
        profile=profiled.df,
        types=detections_frame(spark, detections),
        issues=C.issues(table, values, checks),
        tally=tally,
        dimensions=dimensions,
        overall=score_overall(dimensions, n, width),
        recommendations=score_recommendations(tally, n, width, rules is not None),
        kpis=kpis_frame(spark, kpi_list),
        measures=measure_table(table, kpi_list, distinct),
        key_faults=key_faults(table),
        grouped=grouped_measures(table, kpi_list, profiled.date_patterns),
    )
