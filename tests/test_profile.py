import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import as_table, detect_types, profile
from plumbline.operators import profile as P
from plumbline.operators.detect import semantic_type, status_and_action
from plumbline.operators.groups import distinct_counts
from plumbline.sources.tables import DuplicateColumnError, dataset_profile


def test_numeric_text_and_date_statistics(table):
    whole, words = [-7, 12, 12, 40, 3], ["pear tree", "fig", "", None, "quince"]
    days = [dt.datetime(2021, 3, d) for d in (9, 2, 27, 14, 2)]
    t = table(
        "n bigint, one int, s string, d timestamp_ntz, empty string, x double",
        n=whole, one=[None, None, -8, None, None], s=words, d=days, empty=[None] * 5, x=[7.5, float("nan"), -0.0, 0.0, None],
    )
    p = profile(t)
    n, one, s, d, empty, x = p.columns
    assert (n.min_value, n.max_value, n.mean_value, n.median_value) == (min(whole), max(whole), statistics.fmean(whole), statistics.median(whole))
    assert n.std_value == pytest.approx(statistics.stdev(whole)) and n.unique_percentage == pytest.approx(100 * len(set(whole)) / len(whole))
    assert (one.std_value, one.null_count, one.median_value) == (0.0, 4, -8)
    sizes = [len(w) for w in words if w is not None]
    assert (s.min_length, s.max_length, s.unique_count, s.null_percentage) == (min(sizes), max(sizes), len(sizes), 20)
    assert s.avg_length == pytest.approx(statistics.fmean(sizes)) and s.sample_values == ["pear tree", "fig", "", "quince"]
    assert (d.min_date, d.max_date) == (min(days), max(days))
    assert (empty.null_percentage, empty.unique_percentage, empty.sample_values) == (100, 0, [])
    assert (x.null_count, x.unique_count) == (2, 2)  # NaN is missing; the two zeros are one value
    assert p.df.count() == 6


def test_samples_of_a_sparse_column_come_in_row_order(table):
    n = 300
    t = table("a bigint, b string", a=list(range(n)), b=[f"v{i}" if i % 50 == 49 else None for i in range(n)])
    assert P.first_values(t)["c1"] == ["v49", "v99", "v149", "v199", "v249"]
    assert P.first_values(t)["c0"] == ["0", "1", "2", "3", "4"]


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 100) for _ in range(5000)],
    [random.Random(2).choice([1.0, 2.0, 3.0]) for _ in range(4001)],
    [0.0] * 1500 + [1.0] * 1500,
    [0.0] * 1500 + [0.25, 0.5, 0.75] + [1.0] * 1500,
    [10.0 ** random.Random(3).uniform(-5, 9) for _ in range(3000)],
])
def test_median_of_many_rows_is_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert P._large_median(frame, len(values), limit=40) == statistics.median(values)


def test_large_and_small_median_paths_agree(table):
    t = table("v double", v=[random.Random(5).random() for _ in range(700)])
    assert P.profile(t, median_limit=50).columns[0].median_value == P.profile(t).columns[0].median_value


def test_distinct_counts_match_sql(spark, table):
    t = table("a string, b string, m map<string,int>", a=["x", None, "x"], b=[None, "x", "y"], m=[{"k": 1}, {"k": 1}, {"k": 2}])
    assert {r.ordinal: r.unique_count for r in distinct_counts(t).collect()} == {0: 1, 1: 2, 2: 2}


def test_approximate_distinct(table):
    t = table("a bigint", a=list(range(1000)))
    assert profile(t, exact_distinct=False).columns[0].unique_count == pytest.approx(1000, rel=0.1)


def test_duplicate_columns_are_refused(spark):
    frame = spark.createDataFrame([(1, 2, 3)], ["A", "B", "A"])
    with pytest.raises(DuplicateColumnError, match="Duplicate column names"):
        as_table(frame, "B")


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(1, "x", None), (2, "", 3)], "id int, `a.b``c` string, `Order Date!` int")
    t = as_table(frame, "id", key_is_data=False)
    assert as_table(frame, "id").names == ["id", *t.names]
    assert [c.null_count for c in profile(t).columns] == [0, 1]
    assert dataset_profile(t).first().column_names == "a.b`c, Order Date!"


def test_a_row_key_is_needed_without_files(spark):
    with pytest.raises(ValueError, match="row_key"):
        as_table(spark.range(3).withColumn("x", F.rand()))


# --- semantic types --------------------------------------------------------------------------

TEXT_TYPES = {
    "Email": ["alice@example.com", " bob@test.org ", "c@d.net", "d@e.io", "nope"],
    "String": ["alice@example.com", "bob@test.org", "not-an-email", "word", "other"],
    "URL": ["https://example.com", "http://test.org", "HTTPS://domain.net/path", "http://a.b", "x"],
    "Phone": ["555-123-4567", "(555) 123-4567", "555.123.4567", "+1 555 123 4567", "x"],
    "Boolean": ["yes", "no", "YES", " no ", "Yes"],
    "Percentage": ["10%", "50%", "100%", "25.5%", "7%"],
    "Currency": ["$100.00", "$250.50", "€99.99", "£1.00", "x"],
    "Category": ["active", "inactive", "active", "pending", "active"],
    "DateTime": ["2024-01-01 12:00", "2024-06-15 15:30", "x", "y", "z"],
    "Date": ["2024-01-01", "2024-01-02", "x", "y", "z"],
    "Integer": ["7", "8", "text", "x", "y"],
    "Unknown": [None] * 5,
}


def test_types_of_text_columns(table):
    t = table(", ".join(f"{k} string" for k in TEXT_TYPES), **TEXT_TYPES)
    assert {d.column_name: d.detected_type for d in detect_types(t)} == {k: k for k in TEXT_TYPES}


def test_types_of_typed_columns(table):
    t = table(
        "id bigint, amount double, rate double, flag boolean, made timestamp_ntz, day date, bit int, big double, tel bigint, order_code string",
        id=[1, 2, 3, 4], amount=[100.0, 200.5, 300.0, 400.25], rate=[10.0, 50.0, 99.5, 0.125], flag=[True, False, True, None],
        made=[dt.datetime(2024, 1, 1, 5)] * 4, day=[dt.date(2024, 1, 1)] * 4, bit=[0, 1, 1, 0],
        big=[1000.123, 2000.1234, 3000.55, 4000.777], tel=[5551234567, 5551234568, 15551234567, 5551230000], order_code=["A1", "B2", "C3", "D4"],
    )
    got = {d.column_name: d.detected_type for d in detect_types(t)}
    assert got == {
        "id": "Integer", "amount": "Currency", "rate": "Percentage", "flag": "Boolean", "made": "DateTime", "day": "Date",
        "bit": "Boolean", "big": "Decimal", "tel": "Phone", "order_code": "ID",
    }


def test_status():
    assert status_and_action("int64", "Integer", 0.95) == ("OK", "No action needed")
    assert status_and_action("object", "Date", 0.95) == ("MISMATCH", "Convert from object to Date")
    assert status_and_action("object", "Category", 0.5)[0] == "AMBIGUOUS"
    assert status_and_action("object", "Email", 0.95)[0] == "MISMATCH"


def test_minimum_parse_rate():
    facts = {"nn": 10, "unique": 10, "ts": 1, "midnight": 1, "num": 0, "whole": 0}
    assert semantic_type("x", "text", False, facts) == "Date"
    assert semantic_type("x", "text", False, facts, min_parse_rate=0.5) == "String"
