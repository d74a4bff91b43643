import pytest
from pyspark.sql import functions as F

from plumbline import analyze, as_table, export
from plumbline.operators import explore as X
from plumbline.operators import reconcile as R
from plumbline.operators.checks import ISSUE_SCHEMA
from plumbline.operators.evaluate import precision_recall
from plumbline.operators.kpi import recommend_kpis
from plumbline.operators.measures import Aggregate, Measure, measure_by_column
from plumbline.sinks import reports as W


@pytest.fixture
def ledger(table):
    return table("ID bigint, Sales double, Name string, `Complex Name!` bigint", ID=[1, 2, 2, None, 5, 5, 5],
                 Sales=[100.5, 200.0, None, 50.0, 300.0, 300.0, -10.0], Name=["A", "B", "  ", "", "C", "C", "D"],
                 **{"Complex Name!": [1, 2, 3, 4, 5, 6, 7]})


def test_recomputed_metrics(spark, ledger):
    metrics = [R.Metric("missing", "Sales"), R.Metric("blank", "Name"), R.Metric("duplicate_ids", "ID"),
               R.Metric("range", "Sales", 0, 250), R.Metric("duplicate_rows"), R.Metric("missing", "Complex Name!")]
    actual = R.actual_metrics(ledger, metrics)
    claims = {"Missing Values (Sales)": 1, "Blank Values (Name)": 2, "Duplicate IDs (ID)": 5, "Range Violation (Sales)": 3,
              "Duplicate Rows": 99, "Made Up": 1}
    rows = {r.metric: r for r in R.reconcile(spark.createDataFrame(list(claims.items()), "metric string, claimed int"), actual).collect()}
    assert {m for m, r in rows.items() if r.match_status == "MATCH"} == set(list(claims)[:4])
    assert rows["Duplicate Rows"].match_status == rows["Made Up"].match_status == "MISMATCH"
    assert rows["Duplicate Rows"].difference == 99 and rows["Missing Values (Complex Name!)"].claimed is None


def test_kpi_metrics(spark, table):
    t = table("Order_ID string, Profit double, Sales double, Region string", Order_ID=["A", "B", "C", "D"], Profit=[10.0, 20.0, 5.0, 5.0], Sales=[0.0] * 4, Region=["x", "x", "y", "y"])
    report = analyze(t)
    from plumbline.operators.detect import TypeDetection
    types = [TypeDetection(c, "object", k, 0.9, "", "OK", "") for c, k in (("Order_ID", "ID"), ("Profit", "Currency"), ("Sales", "Currency"), ("Region", "Category"))]
    metrics = [R.Metric("kpi", kpi=k) for k in recommend_kpis(types, {})]
    claimed = spark.createDataFrame([("Total Sales", 0.0), ("Total Orders", 4.0)], "metric string, claimed double")
    rows = {r.metric: r for r in R.reconcile(claimed, report.actual_metrics(metrics)).collect()}
    assert rows["Total Sales"].match_status == rows["Total Orders"].match_status == "MATCH"
    assert rows["Profit Margin"].match_status == "NOT_AVAILABLE" and rows["Profit Margin"].actual is None
    assert rows["Sales by Region"].match_status == "NOT_AVAILABLE"
    assert "Missing Values (Sales)" not in [m.name for m in report.default_metrics()]


@pytest.mark.parametrize("a, b, match, gap", [
    (None, None, True, 0.0), ("1", None, False, None), ("1", "1.0", True, 0.0), ("100000.0", "100000.9", True, 0.9), ("0.000001", "0.0", True, 1e-6),
    ("1.0", "1.1", False, 0.1), ("nan", "NaN", True, 0.0), ("abc", "abc", True, None), ("abc", "abd", False, None), ("inf", "inf", True, 0.0), ("inf", "1", False, float("inf")),
])
def test_value_comparison(spark, a, b, match, gap):
    m, d = R.compare_values(F.col("a"), F.col("b"))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(m.alias("m"), d.alias("d")).first()
    assert row.m is match and (row.d == gap if gap is None else row.d == pytest.approx(gap))


def test_grouped_reconciliation(spark, table):
    t = table("g string, v double", g=["x", "x", None], v=[1.0, 2.0, 5.0])
    actual = measure_by_column(t, Measure(Aggregate("SUM", "v"), group_by="g"), "actual")
    claimed = spark.createDataFrame([("x", 3.0), (None, 6.0), ("z", 1.0)], "g string, claimed double")
    assert {r.g: r.match_status for r in R.reconcile_grouped(claimed, actual, ["g"]).collect()} == {"x": "MATCH", None: "MISMATCH", "z": "MISMATCH"}


# --- evaluation ------------------------------------------------------------------------------


def evaluated(spark, expected, detected):
    schema = "row_index string, column string, issue_type string"
    rows = precision_recall(spark.createDataFrame(expected, schema), spark.createDataFrame(detected, schema)).collect()
    return {r.issue_type: r for r in rows}


def test_evaluation(spark):
    expected = [("1", "a", "MISSING"), ("1", "b", "DATE"), (None, None, "DUP")]
    got = evaluated(spark, expected, [("1", "a", "MISSING"), ("1", "a", "MISSING"), (None, None, "DUP"), ("2", "c", "EMAIL")])
    assert (got["OVERALL"].tp, got["OVERALL"].fp, got["OVERALL"].fn) == (2, 1, 1)
    assert (got["DATE"].recall, got["DATE"].precision, got["DATE"].f1) == (0.0, 1.0, 0.0)
    assert (got["EMAIL"].precision, got["DUP"].f1) == (0.0, 1.0)


def test_evaluation_of_nothing(spark):
    got = evaluated(spark, [], [])
    assert (got["OVERALL"].precision, got["OVERALL"].recall, got["OVERALL"].f1) == (1.0, 1.0, 1.0)


# --- browsing --------------------------------------------------------------------------------


def test_browsing(spark):
    frame = spark.createDataFrame([("A.b", 1, "HIGH"), ("Axb", 2, "LOW"), (None, 3, "HIGH")], "name string, n int, severity string")
    assert X.search(frame, "a.B").count() == 1 and X.search(frame, "").count() == 3
    assert X.select_rows(frame, {"severity": ["HIGH"], "n": [1, 2], "name": []}).count() == 1
    assert X.visible_columns(["a", "b", "c", "d", "e", "f"], ["z"]) == ["a", "b", "c", "d", "e"]
    assert X.pick_columns(frame, ["n", "zz"]).columns == ["n"]
    assert {r.severity: r.n for r in X.count_by(frame, "severity").collect()} == {"HIGH": 2, "LOW": 1}


# --- reports ---------------------------------------------------------------------------------


def test_cell_text(spark):
    frame = spark.sql("SELECT CAST(NULL AS STRING) a, double('nan') b, array(1, NULL, 3) c, map('Key', 'Value', 'Num', '5') d, 1.5D e")
    assert tuple(W.as_text(frame).first()) == ("", "", "1, , 3", "Key: Value | Num: 5", "1.5")


def test_empty_issue_file_has_a_header(spark, tmp_path):
    W.write_csv(W.sorted_issues(spark.createDataFrame([], ISSUE_SCHEMA)), str(tmp_path / "x"))
    (part,) = (tmp_path / "x").glob("part-*.csv")
    assert part.read_text().startswith("issue_id,source,issue_type,rule_or_check_name,row_index,column,")


def test_export_is_repeatable(table, tmp_path):
    t = table("CustomerID bigint, Revenue double", CustomerID=[1, 2, 2, 4], Revenue=[100.5, 200.0, None, 50.0])
    report = analyze(t, id_columns=["CustomerID"])
    texts = []
    for run in ("one", "two"):
        paths = export(report, str(tmp_path / run), "SalesData")
        parts = {p.rsplit("/", 1)[1]: next((tmp_path / run / p.rsplit("/", 1)[1]).glob("part-*.csv")).read_text() for p in paths}
        texts.append(parts)
    assert texts[0] == texts[1] and len(texts[0]) == 7
    assert texts[0]["dataset_profile"] == "dataset_name,row_count,column_count\nSalesData,4,2\n"
    assert len(texts[0]["quality_issues"].splitlines()) == 4
    assert "issues_by_severity" in texts[0]["quality_summary"] and "CRITICAL: 2 | LOW: 1" in texts[0]["quality_summary"]
    assert "dim_UNIQUENESS_score" in texts[0]["readiness_score"] and "Total Sales" in texts[0]["measures"]
    export(report, str(tmp_path / "pq"), file_format="parquet")
    assert t.spark.read.parquet(str(tmp_path / "pq/quality_issues")).where("issue_type = 'DUPLICATE_ID'").count() == 2


def test_kept_and_plain_tables_agree(spark, tmp_path):
    spark.range(500, numPartitions=2).selectExpr("id % 7 AS a", "IF(id % 11 = 0, NULL, id % 13) AS b").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    kept, plain = analyze(frame, keep=True), analyze(frame)
    assert kept.table.df.is_cached and not plain.table.df.is_cached
    assert sorted(r.issue_id for r in kept.issues.collect()) == sorted(r.issue_id for r in plain.issues.collect())
    assert kept.overall.first() == plain.overall.first()
    kept.close()
    assert kept.issues.count() == plain.issue_count
    assert as_table(frame).df.select("__row").distinct().count() == 500
