"""Is this table fit for analytics? Profile, check, score and measure a table on Spark."""

from plumbline.operators.checks import Settings, issues, tally
from plumbline.operators.detect import detect_types
from plumbline.operators.profile import profile
from plumbline.plans.analyze import Report, analyze
from plumbline.rules import RuleConfigError, load_rules, validate_rules
from plumbline.sinks.reports import export
from plumbline.sources.tables import Table, as_table, read_parquet

__all__ = [
    "Report",
    "RuleConfigError",
    "Settings",
    "Table",
    "analyze",
    "as_table",
    "detect_types",
    "export",
    "issues",
    "load_rules",
    "profile",
    "read_parquet",
    "tally",
    "validate_rules",
]
