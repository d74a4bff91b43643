"""Row keys, nested cells, exact numbers, dates in lists, many-file CSV and profile passes."""

import datetime

import pytest

from plumbline import as_table, profile
from plumbline.operators import checks as C
from plumbline.operators import measures as M
from plumbline.operators.groups import distinct_counts, exact_type, later_copies, later_copies_count
from plumbline.sources.csv import IngestionError, load_csv
from plumbline.sources.tables import key_faults
from pyspark.sql import types as T


def rows_with(table, **settings):
    settings = C.Settings(**settings)
    values = C.Values({})
    checks = C.quality_checks(table, {}, values, settings) + C.rule_checks(table, values, settings)
    return sorted(((r.issue_type, r.row_index) for r in C.issues(table, values, checks).collect()), key=str)


def rule(kind, **fields):
    return {"name": kind, "type": kind, **fields}


def test_key_columns_are_analysed_and_faults_counted(spark):
    t = as_table(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k bigint, v string"), "k")
    assert t.names == ["k", "v"]
    assert rows_with(t, rules=[rule("required_column", column="k"), rule("uniqueness", column="k")]) == [("MISSING_VALUE", None), ("uniqueness", "1"), ("uniqueness", "1")]
    assert tuple(key_faults(t).first()) == (1, 1, 2)


def test_labels_of_composite_keys_differ(spark):
    t = as_table(spark.createDataFrame([("a#b", "c"), ("a", "b#c"), ("a", None)], "x string, y string"), ["x", "y"])
    labels = {r[0] for r in t.df.select(t.row_label).collect()}
    assert labels == {"a\\#b#c", "a#b\\#c", "a#\\N"}
    assert tuple(key_faults(t).first()) == (1, 0, 0)


def test_nested_cells_with_nulls_differ(table):
    t = table("a array<int>", a=[[1, None], [1], [None, 1], [None, None, 1]])
    assert distinct_counts(t).first().unique_count == 4 and later_copies(t).count() == 0 == later_copies_count(t).first().n
    t = table("a array<array<int>>", a=[[[1], [2]], [[1, 2]], [[1, 2]]])
    assert distinct_counts(t).first().unique_count == 2 and later_copies(t).count() == 1
    t = table("s struct<x:string,y:string>", s=[(None, "q"), ("q", None), None])
    assert distinct_counts(t).first().unique_count == 2 and later_copies(t).count() == 0


def test_whole_numbers_beyond_doubles(table, spark):
    big = 2**53
    t = table("a bigint, b bigint", a=[big + 1, big], b=[big, big])
    assert rows_with(t, rules=[rule("range", column="a", max=big)]) == [("range", "0")]
    assert rows_with(t, rules=[rule("comparison", column_a="a", column_b="b", operator="<=")]) == [("comparison", "0")]
    parent = spark.createDataFrame([(big,)], "id bigint").selectExpr("CAST(id AS DECIMAL(22,2)) AS id")
    child = rule("referential_integrity", child_column="a", parent_dataset="p", parent_column="id")
    assert rows_with(t, rules=[child], parents={"p": parent}) == [("referential_integrity", "0")]
    assert exact_type(T.LongType(), T.DecimalType(22, 2)) == "decimal(22,2)" and exact_type(T.LongType(), T.DoubleType()) is None


def test_dates_in_lists(table):
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), None]
    t = table("d date", d=days)
    for values in (["2024-01-01"], [days[0]], [datetime.datetime(2024, 1, 1)]):
        assert rows_with(t, rules=[rule("allowed_values", column="d", values=values)]) == [("MISSING_VALUE", "2"), ("allowed_values", "1")]


def folder(path, files):
    path.mkdir()
    for name, text in files.items():
        (path / name).write_text(text)
    return str(path)


def test_numbers_and_samples_over_many_files(spark, tmp_path):
    files = {f"{i:02}.csv": "id,v\n" + "".join(f"{i * 50 + k},x\n" for k in range(50)) for i in range(30)}
    where = folder(tmp_path / "many", files)
    whole = load_csv(spark, where)
    assert [tuple(r) for r in whole.df.select("__row", "c0").orderBy("__row").collect()] == [(i, i) for i in range(1500)]
    some = load_csv(spark, where, sample_size=333)
    assert [tuple(r) for r in some.df.select("__row", "c0").orderBy("__row").collect()] == [(i, i) for i in range(333)]


def test_headers_must_agree(spark, tmp_path):
    with pytest.raises(IngestionError, match="different headers"):
        load_csv(spark, folder(tmp_path / "mixed", {"a.csv": "id,v\n1,2\n", "b.csv": "v,id\n1,2\n"}))


def test_separator_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text('a;b\n1;"x;y"\n-;z\n')
    t = load_csv(spark, str(path), separator=";", na_tokens=["", "-"])
    assert [(r.c0, r.c1) for r in t.df.orderBy("__row").collect()] == [(1, "x;y"), (None, "z")]


def test_profile_passes(table):
    t = table("n int, d date", n=[1, 2, None], d=[datetime.date(2024, 1, 1)] * 3)
    p = profile(t, columns=["d"], passes=(), detect=False).columns
    assert [(c.name, c.unique_count, c.sample_values, c.max_date.day) for c in p] == [("d", None, [], 1)]
    only = profile(t, passes=("median",)).column("n")
    assert only.median_value == 1.5 and only.unique_percentage is None
    with pytest.raises(ValueError, match="unknown passes"):
        profile(t, passes=("x",))


def test_text_dates_need_their_layout(table):
    t = table("day string, sales double", day=["01/02/2026"], sales=[1.0])
    m = M.Measure(M.Aggregate("SUM", "sales"), group_by="day")
    with pytest.raises(ValueError, match="layout"):
        M.measure_by_time(t, m)
    assert str(M.measure_by_time(t, m, patterns={"day": "d/M/yyyy"}).first().day)[:7] == "2026-02"


def test_long_texts_are_not_shuffled_to_find_repeats(table):
    from plumbline.operators.groups import repeated_values_count

    t = table("v string", v=["a", "b", "a", None])
    plan = repeated_values_count(t, t.columns[0])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k0" in plan and repeated_values_count(t, t.columns[0]).first().n == 2
