import pytest

from plumbline import analyze
from plumbline.operators import checks as C
from plumbline.operators import kpi as K
from plumbline.operators import measures as M
from plumbline.operators import score as S
from plumbline.operators.detect import TypeDetection


@pytest.fixture
def tally(spark):
    def build(*rows):
        """rows of (issue_type, severity, n, row_level, source)"""
        full = [(src, t, "check", "col", sev, f"Fix {t}", lvl, n) for t, sev, n, lvl, src in rows]
        return spark.createDataFrame(full, C.TALLY_SCHEMA)

    return build


def by_dimension(frame):
    return {r.dimension: r for r in frame.collect()}


def quality(kind, severity, n, row_level=True):
    return (kind, severity, n, row_level, "quality_check")


def test_clean_data(tally):
    d = by_dimension(S.score_dimensions(tally(), 3, 1))
    assert all(r.score == 100 for r in d.values()) and "Perfect" in d["COMPLETENESS"].reason
    o = S.score_overall(S.score_dimensions(tally(), 3, 1), 3, 1).first()
    assert (o.overall_score, o.grade, o.status, o.letter_grade) == (100, "Excellent", "READY", "A")
    assert S.score_recommendations(tally(), 3, 1).first().recommendation == "Dataset is clean and ready for analysis."
    assert "adding business rules" in S.score_recommendations(tally(), 3, 1, False).first().recommendation


def test_row_and_dataset_level_penalties(tally):
    d = by_dimension(S.score_dimensions(
        tally(quality("MISSING_VALUE", "LOW", 100), ("required_column", "CRITICAL", 1, False, "business_rule")), 1000, 1))
    assert d["COMPLETENESS"].score == 99.0 and d["RULE_COMPLIANCE"].score == 0.0
    assert d["RULE_COMPLIANCE"].evidence == "0 row-level and 1 dataset-level issues."


def test_mapping_and_unknowns(tally):
    rows = [quality("comparison", "INFO", 1), quality("UNKNOWN", "SUPER_BAD", 1), ("UNKNOWN", "MEDIUM", 2, True, "business_rule"),
            quality("DUPLICATE_ROW", "MEDIUM", 1)]
    d = by_dimension(S.score_dimensions(tally(*rows), 4, 1))
    assert [d[k].issue_count for k in ("COMPLETENESS", "VALIDITY", "CONSISTENCY", "UNIQUENESS", "RULE_COMPLIANCE")] == [0, 1, 1, 1, 2]
    assert d["VALIDITY"].score == 87.5 and d["CONSISTENCY"].score == 100


def test_rules_not_configured_and_empty_data(tally):
    d = S.score_dimensions(tally(quality("INVALID_EMAIL", "CRITICAL", 10)), 2, 1, rules_configured=False)
    got = by_dimension(d)
    assert not got["RULE_COMPLIANCE"].is_applicable and "not applicable" in got["RULE_COMPLIANCE"].reason
    assert got["VALIDITY"].score == 0.0
    assert S.score_overall(d, 2, 1).first().overall_score == pytest.approx(60 / 0.85)
    empty = S.score_dimensions(tally(), 0, 0)
    assert not any(r.is_applicable for r in empty.collect()) and S.score_overall(empty, 0, 0).first().overall_score == 100


def test_weights():
    with pytest.raises(ValueError, match="sum to 1.0"):
        S.check_weights(dict.fromkeys(S.DEFAULT_WEIGHTS, 0.5))
    with pytest.raises(ValueError, match="contain all 5 dimensions"):
        S.check_weights({"COMPLETENESS": 1.0})


@pytest.mark.parametrize("validity, grade", [(0, "Excellent"), (85, "Good"), (150, "Needs Improvement"), (220, "Poor"), (320, "Critical")])
def test_grades(spark, tally, validity, grade):
    names = ["MISSING_VALUE", "INVALID_EMAIL", "comparison", "uniqueness"]
    d = S.score_dimensions(tally(*[quality(t, "HIGH", validity // 4 + 1) for t in names]), 100, 1)
    assert S.score_overall(d, 100, 1).first().grade == grade


def test_top_three(tally):
    rows = [quality("A", "LOW", 5), quality("B", "LOW", 9), quality("C", "LOW", 7), quality("D", "LOW", 1), quality("B", "HIGH", 1)]
    assert [r.recommendation for r in S.score_recommendations(tally(*rows), 9, 1).collect()] == [
        "(10 issues) Fix B", "(7 issues) Fix C", "(5 issues) Fix A"
    ]


# --- KPIs ------------------------------------------------------------------------------------


def kpis(columns, rates=None):
    types = [TypeDetection(c, "object", t, 0.9, "", "OK", "") for c, t in columns.items()]
    return {k.kpi_name: k for k in K.recommend_kpis(types, rates or {})}


def test_nothing_available():
    got = kpis({})
    assert set(got) == {"Total Orders", "Average Order Value", "Profit Margin"}
    assert all(k.status == "UNAVAILABLE" and k.calculation_logic == "N/A" for k in got.values())


def test_sales_profit_time_and_dimension():
    got = kpis({"Order_ID": "ID", "Sales": "Currency", "Profit": "Currency", "Discount": "Percentage", "Order_Date": "Date", "Region": "Category"})
    logic = {n: k.calculation_logic for n, k in got.items()}
    assert logic == {
        "Total Sales": "SUM(Sales)", "Average Sales": "AVERAGE(Sales)", "Total Orders": "DISTINCTCOUNT(Order_ID)",
        "Average Order Value": "SUM(Sales) / DISTINCTCOUNT(Order_ID)", "Profit Margin": "SUM(Profit) / SUM(Sales)",
        "Discount Rate": "SUM(Discount) / SUM(Sales)", "Sales over Time": "SUM(Sales) grouped by Order_Date",
        "Sales by Region": "SUM(Sales) grouped by Region",
    }
    assert all(k.status == "AVAILABLE" for k in got.values())


def test_roles():
    got = kpis({"Customer_ID": "Integer", "Age": "Integer", "Year": "Integer", "Quantity": "Integer"})
    assert "Total Quantity" in got and got["Distinct Customers"].measure.top.column == "Customer_ID"
    assert not {"Total Age", "Total Year", "Total Customer_ID"} & set(got)
    assert got["Total Orders"].status == got["Average Order Value"].status == "UNAVAILABLE"
    assert [K.column_role(n, t) for n, t in (("o_totalprice", "Currency"), ("zip_code", "Integer"), ("City", "String"), ("note", "String"), ("__", "Integer"), ("__", "Currency"))] == [
        "measure", None, "dimension", None, None, "measure"
    ]
    assert "Total O_Totalprice" in kpis({"o_totalprice": "Currency"})


def test_review_threshold():
    k = kpis({"Sales": "Currency"}, {"Sales": 0.15})["Total Sales"]
    assert k.status == "REQUIRES_REVIEW" and "defect rate of 15.0%" in k.explanation
    assert kpis({"Sales": "Currency"}, {"Sales": 0.10})["Total Sales"].status == "AVAILABLE"


def test_measures(table):
    t = table("order_id bigint, sales double, profit double, text string", order_id=[1, 2, 2, None], sales=[100.0, None, 50.0, 0.5],
              profit=[10.0, 20.0, None, 0.0], text=["1", "x", " 2.5 ", None])
    agg = M.Aggregate
    values = M.measure_values(t, {
        "sum": M.Measure(agg("SUM", "sales")), "avg": M.Measure(agg("AVERAGE", "sales")), "n": M.Measure(agg("DISTINCTCOUNT", "order_id")),
        "ratio": M.Measure(agg("SUM", "profit"), agg("SUM", "sales")), "text": M.Measure(agg("SUM", "text")),
        "aov": M.Measure(agg("SUM", "sales"), agg("DISTINCTCOUNT", "order_id")), "absent": M.Measure(agg("SUM", "zz")),
    })
    assert values == {"sum": 150.5, "avg": pytest.approx(150.5 / 3), "n": 2, "ratio": pytest.approx(30 / 150.5), "text": 3.5, "aov": 75.25, "absent": None}


def test_empty_sums_and_division_by_zero(table):
    t = table("profit double, sales double", profit=[10.0, 20.0], sales=[0.0, 0.0])
    agg = M.Aggregate
    assert M.measure_values(t, {"m": M.Measure(agg("SUM", "profit"), agg("SUM", "sales"))}) == {"m": None}
    assert M.measure_values(table("sales double", sales=[None]), {"s": M.Measure(agg("SUM", "sales"))}) == {"s": 0.0}


def test_grouped_measures(table):
    t = table("region string, day string, sales double", region=["N", "S", "N", None], day=["2024-01-05", "2024-01-20", "2024-02-01", "x"], sales=[1.0, 2.0, 3.0, 4.0])
    m = M.Aggregate("SUM", "sales")
    assert {r.region: r.value for r in M.measure_by_column(t, M.Measure(m, group_by="region")).collect()} == {"N": 4, "S": 2, None: 4}
    months = M.measure_by_time(t, M.Measure(m, group_by="day"), patterns={"day": "yyyy-M-d"})
    assert {str(r.day)[:7]: r.value for r in months.collect()} == {"2024-01": 3, "2024-02": 3, "None": 4}


def test_measure_table_carries_status(table):
    t = table("Order_ID string, Revenue double", Order_ID=["A1", "B2", "C3", "D4", "E5"], Revenue=[100.25, None, 50.5, -10.75, 200.5])
    report = analyze(t)
    rows = {r.measure_name: r for r in report.measures.collect()}
    assert rows["Total Sales"].value == 340.5 and rows["Total Sales"].status == "REVIEW_REQUIRED" and len(rows["Total Sales"].warnings) == 1
    assert rows["Profit Margin"].status == "UNAVAILABLE" and rows["Profit Margin"].warnings == ["Missing requirements: Missing requirement for Ratio"]
    assert rows["Total Orders"].value == 5
