"""Quality checks and business rules.

Every check of a run is compiled to a ``Check``: constant texts plus where its hits come from.
  cell     a predicate on one row; all of them share one scan
  copies   rows equal to an earlier row
  repeats  rows whose value occurs more than once
  orphans  rows whose value is missing in a parent table
  dataset  a fact about the schema, known before any scan
Hits can be listed as issue rows (``issues``) or only counted (``tally``); counting explodes nothing
and joins nothing back, and is all that scoring and KPI review need.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import scalars as S
from plumbline.operators import groups as G
from plumbline.rules import OPERATORS, validate_rules
from plumbline.sources.tables import ROW, ColumnInfo, Table

log = logging.getLogger(__name__)

# Expected condition and message of each issue type; {wanted} is what the check was configured with.
TEXTS = {
    "MISSING_VALUE": ("Non-null value expected", "Column '{column}' is missing a value in this row."),
    "BLANK_VALUE": ("Non-blank text value expected", "Column '{column}' contains a blank or whitespace-only value."),
    "DUPLICATE_ROW": ("Row should be unique across all columns", "This row is an exact duplicate of an earlier row in the dataset."),
    "DUPLICATE_ID": ("Values in '{column}' should be unique", "The value in '{column}' is shared by more than one row."),
    "INVALID_EMAIL": ("Value should match a valid email address pattern", "Value in '{column}' does not look like a valid email address."),
    "INVALID_DATE": ("Value should be a parseable date", "Value in '{column}' could not be parsed as a date."),
    "INVALID_NUMERIC": ("Value should be numeric", "Value in '{column}' could not be interpreted as a numeric value."),
    "INVALID_CATEGORY": ("Value should be one of: {wanted}", "Value in '{column}' is not one of the allowed categories."),
    "OUT_OF_RANGE": ("{wanted}", "Value in '{column}' is outside the configured allowed range."),
    "CONSISTENCY_VIOLATION": ("{wanted}", "Row violates consistency rule: {wanted}."),
    "required_column": ("Column '{column}' must be present in the dataset", "Required column '{column}' is missing from the dataset."),
    "range": ("{wanted}", "Value in '{column}' is outside the allowed range ({wanted})."),
    "allowed_values": ("Value should be one of: {wanted}", "Value in '{column}' is not an allowed value."),
    "uniqueness": ("Values in '{column}' should be unique", "The value in '{column}' is shared by more than one row."),
    "comparison": ("{wanted}", "Row violates comparison rule: {wanted}."),
    "referential_integrity": ("'{column}' must exist in {wanted}", "Value in '{column}' has no matching record in {wanted}."),
}

# Checks compiled into one scan. Each scan reads its own columns only, and its generated code stays small
# enough for the JVM to compile.
CHECKS_PER_SCAN = 16

QUALITY, RULE = "quality_check", "business_rule"

# Severity and advice of each quality issue type.
QUALITY_SEVERITY = {
    "MISSING_VALUE": "LOW",
    "BLANK_VALUE": "LOW",
    "DUPLICATE_ROW": "MEDIUM",
    "DUPLICATE_ID": "CRITICAL",
    "INVALID_EMAIL": "MEDIUM",
    "INVALID_DATE": "HIGH",
    "INVALID_NUMERIC": "HIGH",
    "INVALID_CATEGORY": "MEDIUM",
    "OUT_OF_RANGE": "HIGH",
    "CONSISTENCY_VIOLATION": "HIGH",
}
QUALITY_ADVICE = {
    "MISSING_VALUE": "Impute missing value or drop row if critical.",
    "BLANK_VALUE": "Trim whitespace or treat as missing.",
    "DUPLICATE_ROW": "Review and deduplicate exact row matches.",
    "DUPLICATE_ID": "Investigate ID generation or deduplicate entities.",
    "INVALID_EMAIL": "Correct email format or flag user for update.",
    "INVALID_DATE": "Standardize date format or fix data entry issue.",
    "INVALID_NUMERIC": "Remove non-numeric characters or correct data type.",
    "INVALID_CATEGORY": "Map to an allowed category or expand allowed list.",
    "OUT_OF_RANGE": "Verify value against domain bounds.",
    "CONSISTENCY_VIOLATION": "Investigate contradictory data across columns.",
}
RULE_ADVICE = "Review business rule logic or correct data to meet business requirements."

ISSUE_COLUMNS = [
    "row_index",
    "column",
    "source",
    "issue_type",
    "rule_or_check_name",
    "actual_value",
    "expected_condition",
    "severity",
    "message",
    "recommendation",
    "issue_id",
]
ISSUE_SCHEMA = ", ".join(f"`{c}` string" for c in ISSUE_COLUMNS)
TALLY_SCHEMA = (
    "source string, issue_type string, rule_or_check_name string, `column` string, severity string, "
    "recommendation string, row_level boolean, n bigint"
)

@dataclass(frozen=True)
class Check:
    source: str
    issue_type: str
    name: str
    column: str | None
    severity: str
    expected: str
    message: str
    kind: str = "cell"
    hit: str | None = None
    actual: str | None = None
    info: ColumnInfo | None = None
    other: ColumnInfo | None = None
    parent: DataFrame | None = None
    key_type: str | None = None

    @property
    def advice(self) -> str:
        return QUALITY_ADVICE[self.issue_type] if self.source == QUALITY else RULE_ADVICE

    def texts(self) -> dict[str, str | None]:
        """The constant part of an issue row."""
        return {
            "column": self.column,
            "source": self.source,
            "issue_type": self.issue_type,
            "rule_or_check_name": self.name,
            "expected_condition": self.expected,
            "severity": self.severity,
            "message": self.message,
            "recommendation": self.advice,
        }


@dataclass(frozen=True)
class Settings:
    """What the caller asks for beyond the checks that always run."""

    id_columns: Iterable[str] = ()
    allowed_categories: Mapping[str, Iterable[Any]] = field(default_factory=dict)
    column_ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    consistency_rules: Iterable[Mapping[str, Any]] = ()
    rules: Iterable[Mapping[str, Any]] = ()
    parents: Mapping[str, DataFrame] = field(default_factory=dict)


# --- predicates ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Values:
    """Derived values of cells that several checks use: stripped text, number, timestamp. Each is named by
    the column it derives from and computed once per row, in a projection below the checks."""

    patterns: Mapping[str, str | None]
    derived: dict[str, str] = field(default_factory=dict)

    def _named(self, name: str, value: str) -> str:
        self.derived.setdefault(name, value)
        return name

    def stripped(self, c: ColumnInfo) -> str:
        return self._named(f"{c.ref}_stripped", S.strip(c.ref if c.kind == "text" else _text(c)))

    def number(self, c: ColumnInfo) -> str:
        if c.kind == "text":
            return self._named(f"{c.ref}_number", S.to_number(c.ref, c.dtype))
        return S.to_number(c.ref, c.dtype)

    def timestamp(self, c: ColumnInfo) -> str:
        if c.kind == "text":
            pattern = self.patterns.get(c.name)
            return self._named(f"{c.ref}_timestamp", S.to_timestamp(c.ref, c.dtype, pattern))
        return S.to_timestamp(c.ref, c.dtype, None)

    def under(self, table: Table, refs: set[str]) -> DataFrame:
        """The table with the derived values of the given columns."""
        chosen = [f"{v} AS {n}" for n, v in self.derived.items() if n.split("_")[0] in refs]
        return table.df.selectExpr(ROW, *[c.ref for c in table.columns if c.ref in refs], *chosen)


def _said(issue_type: str, column: str | None, wanted: Any) -> list[str]:
    return [text.format(column=column, wanted=wanted) for text in TEXTS[issue_type]]


def _quality(issue_type: str, name: str, column: str | None, wanted: Any = "", **kw) -> Check:
    return Check(QUALITY, issue_type, name, column, QUALITY_SEVERITY[issue_type], *_said(issue_type, column, wanted), **kw)


def _rule(rule: Mapping[str, Any], column: str | None, wanted: Any = "", **kw) -> Check:
    severity = rule.get("severity", "MEDIUM")
    return Check(RULE, rule["type"], rule["name"], column, severity, *_said(rule["type"], column, wanted), **kw)


def _text(c: ColumnInfo) -> str:
    return f"CAST({c.ref} AS STRING)"


def _number(value: float) -> str:
    return f"CAST('{value}' AS DOUBLE)"


def _is_time_of(values: Iterable[Any], c: ColumnInfo) -> str:
    """Membership of a date or timestamp column: members are dates, datetimes or ISO texts; a date means its midnight."""
    members = []
    for v in values:
        try:
            moment = datetime.fromisoformat(v) if isinstance(v, str) else v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
        except (ValueError, AttributeError):
            continue
        members.append(f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ')}'")
    return f"coalesce(CAST({c.ref} AS TIMESTAMP_NTZ) IN ({', '.join(members)}), false)" if members else "false"


def _is_value_of(values: Iterable[Any], c: ColumnInfo) -> str:
    """Membership without any type coercion: only members of the column's own class can match."""
    if c.kind == "time":
        return _is_time_of(values, c)
    classes = {"number": (int, float), "text": (str,), "flag": (bool,)}.get(c.kind, ())
    same = [v for v in values if isinstance(v, classes) and (c.kind == "flag" or not isinstance(v, bool))]
    if not same:
        return "false"
    if c.kind == "text":
        members = [S.literal(v) for v in same]
    elif c.kind == "flag":
        members = [str(v).lower() for v in same]
    else:
        members = [_number(v) if isinstance(v, float) else str(v) for v in same]
    return f"coalesce({c.ref} IN ({', '.join(members)}), false)"


def _is_exact(c: ColumnInfo) -> bool:
    return isinstance(c.dtype, (T.IntegralType, T.DecimalType))


def _exact(value: float) -> str:
    """A bound as a decimal literal; its digits are those that Python shows."""
    return f"{Decimal(repr(value)):f}BD"


def _outside(values: Values, c: ColumnInfo, low: float | None, high: float | None) -> str:
    """Whole and decimal columns are compared in their own type: a double can't tell 2^53 from 2^53 + 1."""
    finite = all(b is None or math.isfinite(b) for b in (low, high))
    n, bound = (c.ref, _exact) if _is_exact(c) and finite else (values.number(c), _number)
    tests = ([f"{n} < {bound(low)}"] if low is not None else []) + ([f"{n} > {bound(high)}"] if high is not None else [])
    return f"({' OR '.join(tests)})" if tests else "false"


def _bounds(low: float | None, high: float | None) -> str:
    parts = ([f">= {low}"] if low is not None else []) + ([f"<= {high}"] if high is not None else [])
    return " and ".join(parts)


def _shown(c: ColumnInfo) -> str:
    text = f"concat('\\'', {c.ref}, '\\'')" if c.kind == "text" else _text(c)
    return f"{S.literal(c.name + '=')}, coalesce({text}, 'None')"


def _pair(a: ColumnInfo, b: ColumnInfo) -> dict[str, Any]:
    return {"actual": f"concat({_shown(a)}, ', ', {_shown(b)})", "info": a, "other": b}


def _broken(values: Values, a: ColumnInfo, b: ColumnInfo, operator: str, as_dates: bool) -> str:
    exact = not as_dates and G.exact_type(a.dtype, b.dtype)
    left, right = (values.timestamp(c) if as_dates else f"CAST({c.ref} AS {exact})" if exact else values.number(c) for c in (a, b))
    return f"({left} IS NOT NULL AND {right} IS NOT NULL AND NOT ({left} {operator} {right}))"


# --- quality checks --------------------------------------------------------------------------


def quality_checks(
    table: Table, types: Mapping[str, str], values: Values, settings: Settings = Settings()
) -> list[Check]:
    """Checks that need no configuration, then the configured ones. ``types`` maps column to semantic
    type."""
    out: list[Check] = []
    for c in table.columns:
        out.append(
            _quality(
                "MISSING_VALUE", "missing_value_check", c.name,
                hit=f"{c.ref} IS NULL", actual="CAST(NULL AS STRING)", info=c,
            )
        )
    for c in table.columns:
        if c.kind == "text":
            out.append(
                _quality(
                    "BLANK_VALUE", "blank_value_check", c.name,
                    hit=f"{values.stripped(c)} = ''", actual=_text(c), info=c,
                )
            )
    if table.columns:
        out.append(
            _quality(
                "DUPLICATE_ROW", "duplicate_row_check", None, kind="copies",
            )
        )
    ids = {c.name for c in table.columns if types.get(c.name) == "ID"} | set(settings.id_columns)
    for c in table.columns:
        if c.name in ids and c.kind != "other":
            out.append(
                _quality(
                    "DUPLICATE_ID", "duplicate_id_check", c.name, kind="repeats", info=c,
                )
            )
    for c in table.columns:
        semantic = types.get(c.name)
        if semantic == "Email":
            out.append(
                _quality(
                    "INVALID_EMAIL", "invalid_email_check", c.name,
                    hit=f"NOT {S.is_email(values.stripped(c))}", actual=_text(c), info=c,
                )
            )
        elif semantic in ("Date", "DateTime") and c.kind == "text":
            out.append(
                _quality(
                    "INVALID_DATE", "invalid_date_check", c.name,
                    hit=f"({c.ref} IS NOT NULL AND {values.timestamp(c)} IS NULL)", actual=_text(c), info=c,
                )
            )
        elif semantic in ("Integer", "Decimal", "Currency", "Percentage") and c.kind == "text":
            out.append(
                _quality(
                    "INVALID_NUMERIC", "invalid_numeric_check", c.name,
                    hit=f"NOT {S.is_lenient_number(values.stripped(c))}", actual=_text(c), info=c,
                )
            )
    for name, allowed in settings.allowed_categories.items():
        if c := table.find(name):
            listed = sorted(str(v) for v in set(allowed))
            out.append(
                _quality(
                    "INVALID_CATEGORY", "invalid_category_check", name, listed,
                    hit=f"({c.ref} IS NOT NULL AND NOT {_is_value_of(allowed, c)})", actual=_text(c), info=c,
                )
            )
    for name, (low, high) in settings.column_ranges.items():
        if (c := table.find(name)) and (low is not None or high is not None):
            out.append(
                _quality(
                    "OUT_OF_RANGE", "range_check", name, _bounds(low, high),
                    hit=_outside(values, c, low, high), actual=_text(c), info=c,
                )
            )
    for rule in settings.consistency_rules:
        a, b = table.find(rule.get("column_a")), table.find(rule.get("column_b"))
        operator = rule.get("operator", "<=")
        if not a or not b or operator not in OPERATORS:
            continue
        as_dates = any(types.get(c.name) in ("Date", "DateTime") for c in (a, b))
        expected = f"{a.name} {operator} {b.name}"
        out.append(
            _quality(
                "CONSISTENCY_VIOLATION", rule.get("name", "consistency_check"), f"{a.name} / {b.name}",
                expected,
                hit=_broken(values, a, b, operator, as_dates), **_pair(a, b),
            )
        )
    return out


# --- business rules --------------------------------------------------------------------------


def _compare_as_dates(table: Table, rules: list[Mapping[str, Any]], values: Values) -> dict[str, bool]:
    """For comparison rules that leave it open: dates or numbers, whichever makes more rows comparable.
    One aggregate answers for all of them."""
    out, counts, refs = {}, [], set()
    for rule in rules:
        a, b = table.find(rule["column_a"]), table.find(rule["column_b"])
        if rule.get("value_type"):
            out[rule["name"]] = rule["value_type"] == "date"
        elif a.kind == b.kind and a.kind in ("number", "time"):
            out[rule["name"]] = a.kind == "time"
        else:
            kinds = (values.timestamp, values.number)
            both = [f"count_if({v(a)} IS NOT NULL AND {v(b)} IS NOT NULL)" for v in kinds]
            counts.append((rule["name"], *both))
            refs |= {a.ref, b.ref}
    if counts:
        row = values.under(table, refs).selectExpr(*[c for _, d, n in counts for c in (d, n)]).first()
        for i, (name, _, _) in enumerate(counts):
            out[name] = row[2 * i] >= row[2 * i + 1]
    return out


def rule_checks(table: Table, values: Values, settings: Settings) -> list[Check]:
    """Checks for the configured rules. A rule naming an absent column or parent is skipped."""
    rules = list(settings.rules)
    validate_rules(rules)
    usable = []
    for rule in rules:
        named = [rule[f] for f in ("column", "column_a", "column_b", "child_column") if f in rule]
        absent = [n for n in named if table.find(n) is None]
        if absent and rule["type"] != "required_column":
            log.warning("Rule '%s' (%s) references missing column '%s'; skipping.", rule["name"], rule["type"], absent[0])
            continue
        usable.append(rule)
    comparisons = [r for r in usable if r["type"] == "comparison"]
    as_dates = _compare_as_dates(table, comparisons, values)

    out: list[Check] = []
    for rule in usable:
        kind = rule["type"]
        c = table.find(rule.get("column") or rule.get("child_column") or rule.get("column_a"))
        if kind == "required_column":
            if c is None:
                name = rule["column"]
                out.append(
                    _rule(
                        rule, name, kind="dataset",
                    )
                )
        elif kind == "range":
            low, high = rule.get("min"), rule.get("max")
            expected = f"{c.name} {_bounds(low, high)}"
            out.append(
                _rule(
                    rule, c.name, expected,
                    hit=_outside(values, c, low, high), actual=_text(c), info=c,
                )
            )
        elif kind == "allowed_values":
            wrong = f"NOT {_is_value_of(rule['values'], c)}"
            if not rule.get("treat_null_as_invalid"):
                wrong = f"({c.ref} IS NOT NULL AND {wrong})"
            listed = sorted(str(v) for v in set(rule["values"]))
            out.append(
                _rule(
                    rule, c.name, listed, hit=wrong, actual=_text(c), info=c,
                )
            )
        elif kind == "uniqueness":
            out.append(
                _rule(
                    rule, c.name, kind="repeats", info=c,
                )
            )
        elif kind == "comparison":
            a, b = c, table.find(rule["column_b"])
            expected = f"{a.name} {rule['operator']} {b.name}"
            out.append(
                _rule(
                    rule, f"{a.name} / {b.name}", expected,
                    hit=_broken(values, a, b, rule["operator"], as_dates[rule["name"]]), **_pair(a, b),
                )
            )
        else:
            out += _reference_checks(rule, c, settings.parents)
    return out


def _reference_checks(rule: Mapping[str, Any], c: ColumnInfo, parents: Mapping[str, DataFrame]) -> list[Check]:
    """A reference check finds orphans by a join. NULLs (when they count) and, if the two sides are of
    different classes and nothing can match, all values are row-local and ride on the shared scan."""
    parent, column = parents.get(rule["parent_dataset"]), rule["parent_column"]
    source = f"{rule['parent_dataset']}.{column}"
    if parent is None or column not in parent.columns:
        log.warning("Rule '%s' (referential_integrity): %s is not available; skipping.", rule["name"], source)
        return []
    texts = (rule, c.name, source)
    values = parent.select(F.col(S.quote(column)))
    key_type = G.shared_key_type(c.dtype, values.schema.fields[0].dataType)
    nulls_count = bool(rule.get("treat_null_as_invalid"))
    if key_type is None:
        hit = "true" if nulls_count else f"{c.ref} IS NOT NULL"
        return [_rule(*texts, hit=hit, actual=_text(c), info=c)]
    out = [_rule(*texts, kind="orphans", info=c, parent=values, key_type=key_type)]
    if nulls_count:
        out.append(_rule(*texts, hit=f"{c.ref} IS NULL", actual=_text(c), info=c))
    return out


# --- running ---------------------------------------------------------------------------------


def _scans(checks: list[Check]) -> list[list[tuple[int, Check]]]:
    cells = [(i, c) for i, c in enumerate(checks) if c.kind == "cell"]
    # Checks of one column stay together, so that each scan reads few columns.
    cells.sort(key=lambda e: (int(e[1].info.ref[1:]) if e[1].info else 1 << 30, e[0]))
    return [cells[i : i + CHECKS_PER_SCAN] for i in range(0, len(cells), CHECKS_PER_SCAN)]


def _under(table: Table, values: Values, entries: list[tuple[int, Check]]) -> DataFrame:
    infos = [c for _, e in entries for c in (e.info, e.other) if c]
    return values.under(table, {c.ref for c in infos})


def _cell_hits(table: Table, values: Values, entries: list[tuple[int, Check]]) -> DataFrame:
    """(check, row_index, actual_value) of row-local hits: one struct or NULL per check and row, NULLs
    dropped after the explode. A filter on the predicates ahead of it would be pushed below the
    projection of derived values and evaluate everything twice."""
    hits = [
        f"CASE WHEN {c.hit} THEN named_struct('check', {i}, 'actual_value', {c.actual}) END" for i, c in entries
    ]
    exploded = _under(table, values, entries).select(
        table.row_label.alias("row_index"), F.expr(f"explode(array({', '.join(hits)}))").alias("hit")
    )
    return exploded.where("hit IS NOT NULL").select("hit.check", "row_index", "hit.actual_value")


def _group_hits(table: Table, check: Check, numbers: list[int], part_rows: int) -> DataFrame:
    if check.kind == "copies":
        hits = G.later_copies(table, part_rows).withColumn("k0", F.lit(None).cast("string"))
    elif check.kind == "repeats":
        hits = G.repeated_values(table, check.info, part_rows)
    else:
        hits = G.orphans(table, check.info, check.parent, check.key_type, part_rows)
    flagged = Table(hits, table.columns, files=table.files)
    value = F.col("k0")
    if check.kind == "orphans" and check.info.dtype != hits.schema["k0"].dataType:
        value = value.try_cast(check.info.dtype)
    number = F.explode(F.array(*[F.lit(i) for i in numbers]))
    return hits.select(
        number.alias("check"), flagged.row_label.alias("row_index"), value.cast("string").alias("actual_value")
    )


def _shared_groups(checks: list[Check]) -> list[tuple[Check, list[int]]]:
    """Group checks with the numbers of all checks they serve: an ID check and a uniqueness rule on the
    same column list the same rows."""
    out: list[tuple[Check, list[int]]] = []
    seen: dict[Any, list[int]] = {}
    for i, c in enumerate(checks):
        if c.kind in ("cell", "dataset"):
            continue
        key = (c.kind, c.info.ref) if c.kind == "repeats" else (c.kind, i)
        if key in seen:
            seen[key].append(i)
        else:
            seen[key] = [i]
            out.append((c, seen[key]))
    return out


def _issue_id() -> Column:
    parts = ["source", "issue_type", "rule_or_check_name", "row_index", "column"]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p), F.lit("DATASET")) for p in parts]), 256)


def issues(table: Table, values: Values, checks: list[Check], part_rows: int = G.PART_ROWS) -> DataFrame:
    """One row per offending cell, row or schema fact, with a deterministic id."""
    hits = [_cell_hits(table, values, entries) for entries in _scans(checks)]
    hits += [_group_hits(table, c, numbers, part_rows) for c, numbers in _shared_groups(checks)]
    facts = [(i, None, None) for i, c in enumerate(checks) if c.kind == "dataset"]
    if facts or not hits:
        hits.append(table.spark.createDataFrame(facts, "check int, row_index string, actual_value string"))
    all_hits = reduce(DataFrame.unionByName, hits)
    if not checks:
        return table.spark.createDataFrame([], ISSUE_SCHEMA)
    # The texts travel as one literal that the optimizer parses once.
    fields = ", ".join(f"`{k}`: string" for k in checks[0].texts())
    rows = json.dumps([c.texts() for c in checks])
    catalogue = F.from_json(F.lit(rows), f"array<struct<{fields}>>")
    texts = F.element_at(catalogue, F.col("check") + 1)
    described = all_hits.select("row_index", "actual_value", texts.alias("t")).select(
        "row_index", "actual_value", "t.*"
    )
    return described.withColumn("issue_id", _issue_id()).select(*ISSUE_COLUMNS)


def counts(table: Table, values: Values, checks: list[Check]) -> list[int]:
    """Hits of each check, counted without listing them. All counts are branches of one plan, so their
    stages run side by side."""
    parts = []
    for entries in _scans(checks):
        counted = [f"count_if({c.hit}) AS n{i}" for i, c in entries]
        pairs = ", ".join(f"named_struct('check', {i}, 'n', n{i})" for i, _ in entries)
        parts.append(_under(table, values, entries).selectExpr(*counted).selectExpr(f"inline(array({pairs}))"))
    for c, numbers in _shared_groups(checks):
        if c.kind == "copies":
            total = G.later_copies_count(table)
        elif c.kind == "repeats":
            total = G.repeated_values_count(table, c.info)
        else:
            total = G.orphans_count(table, c.info, c.parent, c.key_type)
        served = F.explode(F.array(*[F.lit(i) for i in numbers])).alias("check")
        parts.append(total.select(served, F.col("n").cast("bigint")))
    out = [1 if c.kind == "dataset" else 0 for c in checks]
    if parts:
        for r in reduce(DataFrame.unionByName, parts).collect():
            out[r.check] += r.n
    return out


def tally_frame(spark: SparkSession, checks: list[Check], counted: list[int]) -> DataFrame:
    """Issue counts per check, one row for each check that hit."""
    rows = [
        (c.source, c.issue_type, c.name, c.column, c.severity, c.advice, c.kind != "dataset", n)
        for c, n in zip(checks, counted)
        if n
    ]
    return spark.createDataFrame(rows, TALLY_SCHEMA)


def tally(table: Table, values: Values, checks: list[Check]) -> DataFrame:
    return tally_frame(table.spark, checks, counts(table, values, checks))


def tally_of(issue_rows: DataFrame) -> DataFrame:
    """The same counts taken from listed issues. A row whose key is NULL has no label either; only an absent column is a fact
    about the table."""
    keys = ["source", "issue_type", "rule_or_check_name", "column", "severity", "recommendation"]
    return issue_rows.groupBy(*keys, (F.col("issue_type") != "required_column").alias("row_level")).agg(
        F.count(F.lit(1)).alias("n")
    )
