"""The ten-row golden case: 16 expected issues, none missed, none extra."""

import pytest

from plumbline import analyze
from plumbline.operators.checks import tally_of
from plumbline.operators.evaluate import issue_set, precision_recall
from plumbline.sources.csv import load_csv

# The golden data set, its rules and its expected issues.
CSV = """customer_id,name,email,age,status,order_date,delivery_date,quantity,price,discount
1,Alice,alice@example.com,25,active,2023-01-01,2023-01-05,2,19.99,0.0
2,Bob,bob.example.com,150,pending,2023-02-01,2023-01-30,-5,-10.0,2.5
3,,charles@test.com,,ACTIVE,invalid_date,2023-03-05,1,100.0,0.1
1,Alice,alice@example.com,25,active,2023-01-01,2023-01-05,2,19.99,0.0
5,Eve,eve@example.com,17,unknown,2023-05-01,2023-05-10,1,50.0,0.5
6,Frank,frank@example.com,30,active,2023-06-01,,10,15.50,0.2
7,Grace,grace@example.com,40,active,2023-07-01,2023-07-05,3,45.0,0.0
8,Heidi,heidi@example.com,35,pending,2023-08-01,2023-08-05,1,10.0,0.1
9,Ivan,ivan@example.com,50,active,2023-09-01,2023-09-05,5,99.99,0.2
10,Judy,judy@example.com,28,active,2023-10-01,2023-10-05,2,25.0,0.0
"""
RULES = [
    {"name": "age_range", "type": "range", "column": "age", "min": 18, "max": 120, "severity": "HIGH"},
    {"name": "status_values", "type": "allowed_values", "column": "status",
     "values": ["active", "pending", "cancelled"], "severity": "MEDIUM"},
    {"name": "delivery_after_order", "type": "comparison", "column_a": "delivery_date", "operator": ">=",
     "column_b": "order_date", "severity": "HIGH"},
    {"name": "quantity_min", "type": "range", "column": "quantity", "min": 1, "severity": "MEDIUM"},
    {"name": "price_min", "type": "range", "column": "price", "min": 0, "severity": "MEDIUM"},
    {"name": "discount_range", "type": "range", "column": "discount", "min": 0, "max": 1, "severity": "LOW"},
    {"name": "customer_unique", "type": "uniqueness", "column": "customer_id", "severity": "CRITICAL"},
]
EXPECTED = [
    ("0", "customer_id", "uniqueness"),
    ("1", "email", "INVALID_EMAIL"),
    ("1", "age", "range"),
    ("1", "delivery_date / order_date", "comparison"),
    ("1", "quantity", "range"),
    ("1", "price", "range"),
    ("1", "discount", "range"),
    ("2", "name", "MISSING_VALUE"),
    ("2", "age", "MISSING_VALUE"),
    ("2", "status", "allowed_values"),
    ("2", "order_date", "INVALID_DATE"),
    ("3", None, "DUPLICATE_ROW"),
    ("3", "customer_id", "uniqueness"),
    ("4", "age", "range"),
    ("4", "status", "allowed_values"),
    ("5", "delivery_date", "MISSING_VALUE"),
]
TYPES = {
    "customer_id": "Integer", "name": "String", "email": "Email", "age": "Integer", "status": "Category",
    "order_date": "Date", "delivery_date": "Date", "quantity": "Integer", "price": "Percentage",
    "discount": "Percentage",
}


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "golden.csv"
    path.write_text(CSV)
    return analyze(load_csv(spark, str(path)), rules=RULES)


def test_semantic_types(report):
    assert {d.column_name: d.detected_type for d in report.detections} == TYPES


def test_every_expected_issue_and_no_other(spark, report):
    expected = spark.createDataFrame(EXPECTED, "row_index string, column string, issue_type string")
    rows = {r.issue_type: r for r in precision_recall(expected, issue_set(report.issues)).collect()}
    total = rows["OVERALL"]
    assert (total.tp, total.fp, total.fn) == (16, 0, 0)
    assert (total.precision, total.recall, total.f1) == (1.0, 1.0, 1.0)
    assert rows["range"].tp == 5 and rows["MISSING_VALUE"].tp == 3


def test_counts_match_listed_issues(report):
    def key(r):
        return tuple(r)

    listed = sorted(map(key, tally_of(report.issues).collect()), key=str)
    assert listed == sorted(map(key, report.tally.collect()), key=str)
    assert report.issue_count == 16


def test_score(report):
    score = report.overall.first()
    # completeness 3 LOW; validity 1 MEDIUM + 1 HIGH; consistency 1 HIGH; uniqueness 1 MEDIUM + 2 CRITICAL;
    # rules 2 HIGH + 4 MEDIUM + 1 LOW, all over 10 rows
    parts = {r.dimension: r.score for r in report.dimensions.collect()}
    assert parts == pytest.approx(
        {"COMPLETENESS": 97.0, "VALIDITY": 85.0, "CONSISTENCY": 90.0, "UNIQUENESS": 0.0, "RULE_COMPLIANCE": 59.0}
    )
    assert score.overall_score == pytest.approx(97 * 0.25 + 85 * 0.25 + 90 * 0.2 + 59 * 0.15)
    assert (score.grade, score.status) == ("Needs Improvement", "REVIEW_REQUIRED")


def test_exported_tables(report, tmp_path):
    from plumbline import export

    paths = export(report, str(tmp_path), "golden")
    assert len(paths) == 7
    issues = report.table.spark.read.option("header", True).csv(str(tmp_path / "quality_issues"))
    assert issues.count() == 16
    ids = [r.issue_id for r in issues.collect()]
    assert ids == sorted(ids)
