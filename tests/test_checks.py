import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline import analyze, as_table, profile
from plumbline.operators import checks as C
from plumbline.operators import groups as G
from plumbline.rules import RuleConfigError, load_rules, validate_rules


def found(table, types=None, patterns=None, **kw):
    """{(row, column, type)} of every issue, after making sure that counting gives the same numbers."""
    values = C.Values(patterns or {})
    options = C.Settings(**kw)
    checks = C.quality_checks(table, types or {}, values, options) + C.rule_checks(table, values, options)
    rows = C.issues(table, values, checks).collect()
    listed = [0] * len(checks)
    for i, c in enumerate(checks):
        listed[i] = sum(
            (r.issue_type, r.rule_or_check_name, r.column) == (c.issue_type, c.name, c.column) for r in rows
        )
    counted = C.counts(table, values, checks)
    for i, c in enumerate(checks):
        same = [j for j, d in enumerate(checks) if (d.issue_type, d.name, d.column) == (c.issue_type, c.name, c.column)]
        assert sum(counted[j] for j in same) == listed[i]
    return {(r.row_index, r.column, r.issue_type) for r in rows}, rows


def only(issues, kind):
    return sorted(r for r, _, t in issues if t == kind)


def test_missing_and_blank(table):
    t = table("a double, name string", a=[1.0, None, float("nan"), 3.0, 4.0], name=["Alice", "", "   ", "\t", None])
    issues, _ = found(t)
    assert only(issues, "MISSING_VALUE") == ["1", "2", "4"]
    assert only(issues, "BLANK_VALUE") == ["1", "2", "3"]


def test_later_copies_only(table):
    t = table("a int, b string", a=[1, 2, 1, 1, None, None], b=["x", "y", "x", "x", None, None])
    issues, _ = found(t)
    assert only(issues, "DUPLICATE_ROW") == ["2", "3", "5"]


def test_nulls_in_other_columns_do_not_make_copies(table):
    t = table("a string, b string", a=["x", None, "x"], b=[None, "x", "x"])
    assert only(found(t)[0], "DUPLICATE_ROW") == []


def test_ids(table):
    t = table("customer_id bigint", customer_id=[1, 2, 2, 3, None, None])
    assert only(found(t, {"customer_id": "Integer"})[0], "DUPLICATE_ID") == []
    assert only(found(t, {"customer_id": "ID"})[0], "DUPLICATE_ID") == ["1", "2"]
    assert only(found(t, id_columns=["customer_id", "absent"])[0], "DUPLICATE_ID") == ["1", "2"]


def test_formats(table):
    t = table(
        "email string, day string, amount string", email=["a@b.com", "not-an-email", " c@d.com ", None],
        day=["2024-01-01", "not-a-date", "2024-03-01", None], amount=["$100.00", "abc", "", "25.5%"],
    )
    issues, rows = found(t, {"email": "Email", "day": "Date", "amount": "Currency"}, {"day": "yyyy-M-d"})
    assert only(issues, "INVALID_EMAIL") == only(issues, "INVALID_DATE") == ["1"]
    assert only(issues, "INVALID_NUMERIC") == ["1", "2"]
    assert {r.actual_value for r in rows if r.row_index == "1"} == {"not-an-email", "not-a-date", "abc"}


def test_typed_columns_need_no_format_check(table):
    t = table("day timestamp_ntz, n bigint", day=[dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)], n=[1, 2])
    assert found(t, {"day": "Date", "n": "Integer"})[0] == set()


def test_configured_checks(table):
    t = table("age bigint, status string, lo bigint, hi bigint", age=[18, -5, 150, 100], status=["a", "b", "x", None], lo=[1, 5, 3, 4], hi=[2, 4, None, 4])
    issues, rows = found(
        t, allowed_categories={"status": {"a", "b"}, "none": {1}}, column_ranges={"age": (18, 100), "gone": (0, 1)},
        consistency_rules=[{"name": "order", "column_a": "lo", "column_b": "hi"}, {"column_a": "lo", "column_b": "zz"},
                           {"column_a": "lo", "column_b": "hi", "operator": "~"}],
    )
    assert only(issues, "OUT_OF_RANGE") == ["1", "2"]
    assert only(issues, "INVALID_CATEGORY") == ["2"]
    assert ("1", "lo / hi", "CONSISTENCY_VIOLATION") in issues and len(only(issues, "CONSISTENCY_VIOLATION")) == 1
    assert {r.actual_value for r in rows if r.issue_type == "CONSISTENCY_VIOLATION"} == {"lo=5, hi=4"}


def test_open_range_and_text_numbers(table):
    t = table("q string", q=["5", "-1", "0", "x", None])
    assert only(found(t, column_ranges={"q": (0, None)})[0], "OUT_OF_RANGE") == ["1"]


# --- rules -----------------------------------------------------------------------------------


def rule(kind, **fields):
    return {"name": kind, "type": kind, **fields}


def test_required_column_is_one_dataset_issue(table):
    t = table("a bigint", a=[1, 2])
    issues, rows = found(t, rules=[rule("required_column", column="b", severity="HIGH"), {**rule("required_column", column="a"), "name": "ok"}])
    assert issues == {(None, "b", "required_column")} and rows[0].severity == "HIGH"


def test_allowed_values_are_type_strict(table):
    t = table("code string, n bigint", code=["1", "2", "x", None], n=[1, 2, 3, None])
    rules = [rule("allowed_values", column="code", values=[1, "2"]), {**rule("allowed_values", column="n", values=[1, "2"]), "name": "n"},
             {**rule("allowed_values", column="n", values=[1, 2, 3.0], treat_null_as_invalid=True), "name": "nulls"}]
    issues, _ = found(t, rules=rules)
    assert sorted((r, c) for r, c, k in issues if k == "allowed_values") == [("0", "code"), ("1", "n"), ("2", "code"), ("2", "n"), ("3", "n")]


@pytest.mark.parametrize("operator, broken", [("<=", ["1"]), ("<", ["0", "1"]), (">=", ["2"]), (">", ["0", "2"]), ("==", ["1", "2"]), ("!=", ["0"])])
def test_comparison_operators(table, operator, broken):
    t = table("a string, b string", a=["2024-01-01", "2024-03-05", "2024-01-01", None], b=["2024-01-01", "2024-03-01", "2024-02-01", "2024-01-01"])
    issues, _ = found(t, patterns={"a": "yyyy-M-d", "b": "yyyy-M-d"}, rules=[rule("comparison", column_a="a", column_b="b", operator=operator)])
    assert only(issues, "comparison") == broken


def test_comparison_kind_follows_the_comparable_majority(table):
    t = table("a string, b string", a=["9", "10", "3"], b=["10", "9", "x"])
    assert only(found(t, rules=[rule("comparison", column_a="a", column_b="b", operator="<=")])[0], "comparison") == ["1"]
    forced = rule("comparison", column_a="a", column_b="b", operator="<=", value_type="date")
    assert only(found(t, rules=[forced])[0], "comparison") == []


def test_references(spark, table):
    t = table("cid int, name string", cid=[1, 2, 99, None], name=["a", "b", "c", None])
    parents = {"p": spark.createDataFrame([(1, "a"), (2, "x"), (None, None)], "id bigint, name string")}

    def orphans(**fields):
        base = dict(child_column="cid", parent_dataset="p", parent_column="id")
        return only(found(t, rules=[rule("referential_integrity", **(base | fields))], parents=parents)[0], "referential_integrity")

    assert orphans() == ["2"]
    assert orphans(treat_null_as_invalid=True) == ["2", "3"]
    assert orphans(child_column="name", parent_column="name") == ["1", "2"]
    assert orphans(parent_column="name") == ["0", "1", "2"]  # number against text: nothing can match
    assert orphans(parent_dataset="q") == orphans(parent_column="zz") == orphans(child_column="zz") == []


def test_rules_on_absent_columns_are_skipped(table):
    t = table("unrelated bigint", unrelated=[1, 2, 3])
    rules = [rule("range", column="age", min=0), rule("allowed_values", column="s", values=["a"]), rule("uniqueness", column="id"),
             rule("comparison", column_a="x", column_b="y", operator="<="),
             rule("referential_integrity", child_column="c", parent_dataset="p", parent_column="id")]
    assert found(t, rules=rules)[0] == set()


@pytest.mark.parametrize(
    "rules, message",
    [
        ({"name": "x"}, "must be a list"), (["x"], "must be a mapping"), ([{"type": "range"}], "non-empty 'name'"),
        ([{"name": "a"}], "missing a 'type'"), ([{"name": "a", "type": "zzz"}], "unsupported type 'zzz'"),
        ([{"name": "a", "type": "range"}], "missing required field 'column'"),
        ([rule("range", column="c")], "at least one of"), ([rule("range", column="c", min="x")], "must be numeric"),
        ([rule("range", column="c", min=2, max=1)], "greater than max"), ([rule("allowed_values", column="c", values=[])], "non-empty 'values'"),
        ([rule("comparison", column_a="a", column_b="b", operator="<>")], "unsupported operator"),
        ([rule("comparison", column_a="a", column_b="b", operator="<", value_type="x")], "invalid 'value_type'"),
        ([rule("uniqueness", column="c", severity="BAD")], "invalid severity"),
        ([rule("uniqueness", column="c"), rule("uniqueness", column="d")], "Duplicate rule name"),
    ],
)
def test_faulty_rules(rules, message):
    with pytest.raises(RuleConfigError, match=message):
        validate_rules(rules)


def test_rule_files(tmp_path):
    path = tmp_path / "r.yaml"
    with pytest.raises(RuleConfigError, match="not found"):
        load_rules(path)
    path.write_text("")
    assert load_rules(path) == []
    path.write_text("rules: [this is: not: valid: yaml")
    with pytest.raises(RuleConfigError, match="Failed to parse"):
        load_rules(path)
    path.write_text("- a\n")
    with pytest.raises(RuleConfigError, match="mapping"):
        load_rules(path)
    path.write_text("rules:\n  - {name: r, type: range, column: a, min: 0}\n")
    assert load_rules(path)[0]["min"] == 0


# --- groups ----------------------------------------------------------------------------------


def skewed(spark, n=3000, key="bigint"):
    """A third of all rows share one value; the rest repeat now and then."""
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 1500)) for i in range(n)]
    frame = spark.createDataFrame(rows, "rid bigint, v bigint").repartition(6)
    return as_table(frame.selectExpr(f"CAST(rid AS {key}) AS rid", "v"), "rid", key_is_data=False), rows


def brute_force(rows):
    seen, members, later = {}, {}, set()
    for r, v in sorted(rows):
        members.setdefault(v, []).append(r)
        if v in seen:
            later.add(r)
        seen[v] = r
    return later, {r for m in members.values() if len(m) > 1 for r in m}


@pytest.mark.parametrize("part_rows", [20, 10**6])
def test_hot_groups_are_split_and_stay_whole(spark, part_rows):
    t, rows = skewed(spark)
    later, shared = brute_force(rows)
    assert [r["__row"] for r in G.later_copies(t, part_rows).orderBy("__row").collect()] == sorted(later)
    assert sorted(r["__row"] for r in G.repeated_values(t, t.columns[0], part_rows).collect()) == sorted(shared)
    parent = spark.range(1, 1400).toDF("id")
    orphans = {r for r, v in rows if not 1 <= v < 1400}
    assert sorted(r["__row"] for r in G.orphans(t, t.columns[0], parent, "bigint", part_rows).collect()) == sorted(orphans)


@pytest.mark.parametrize("part_rows", [20, 10**6])
def test_copies_with_a_text_key(spark, part_rows):
    t, rows = skewed(spark, key="string")
    later, _ = brute_force([(str(r), v) for r, v in rows])
    assert sorted(r["__row"] for r in G.later_copies(t, part_rows).collect()) == sorted(later)


def test_parts_of_a_hot_group_stay_under_the_limit(spark):
    t, rows = skewed(spark)
    values = t.df.where("c0 IS NOT NULL").select(*G.value_hashes(t.columns[0]), "__row")
    joined = G.join_groups(values, G.sizes(values).where("n > 1"), t.n_rows, 50)
    assert joined.count() == len(brute_force(rows)[1])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan and "LogicalRDD" in plan  # split by part, group sizes computed once
    assert G.part_limit(10**12) == 10**7 and 10**12 // G.part_limit(10**12) <= G.LARGE_GROUPS


def test_reference_check_aggregates_before_a_large_join(spark):
    """With a parent too large to broadcast, child rows are reduced to distinct values first."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t, _ = skewed(spark)
        rows, parents = G._reference_sides(t, t.columns[0], spark.range(10).toDF("id"), "bigint")
        plan = G._orphan_groups(rows, parents)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lstrip().startswith("Join LeftAnti")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", " ", "", None, "7", "a@b.co"]), st.sampled_from([None, 0.0, 1.5, -3.0, float("nan")])), max_size=14))
def test_counts_equal_listed_issues_whatever_the_data(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid bigint, s string, x double")
    one, many = as_table(frame.coalesce(1), "rid", key_is_data=False), as_table(frame.repartition(3, "rid"), "rid", key_is_data=False)
    options = dict(id_columns=["s", "x"], column_ranges={"x": (0, 1)}, allowed_categories={"s": ["a"]})
    left, right = found(one, {"s": "Email"}, **options)[1], found(many, {"s": "Email"}, **options)[1]
    assert sorted(r.issue_id for r in left) == sorted(r.issue_id for r in right)


# --- whole runs ------------------------------------------------------------------------------


def test_same_issues_on_every_run_and_a_known_id(spark):
    import hashlib

    n = 2000
    frame = spark.range(n, numPartitions=5).selectExpr(
        "id AS rid", "id", "element_at(array('A', 'B', 'C', NULL), CAST(id % 4 + 1 AS INT)) AS category",
        "sin(id) AS amount", "date_add(DATE'2023-01-01', CAST(id AS INT)) AS date",
        "IF(id % 100 = 0, 'invalid', concat('user', id, '@example.com')) AS email",
    )
    first, second = (sorted(r.issue_id for r in analyze(frame, "rid", key_is_data=False).issues.collect()) for _ in range(2))
    assert first == second and len(first) == n // 4 + n // 100
    assert hashlib.sha256(b"quality_check|INVALID_EMAIL|invalid_email_check|100|email").hexdigest() in first


def test_single_row_empty_and_all_null_tables(spark, table):
    assert analyze(table("a bigint, b string", a=[1], b=["x"])).overall.first().overall_score == 100
    empty = analyze(spark.createDataFrame([], "rid bigint, a string, b double"), "rid", key_is_data=False)
    assert empty.issue_count == 0 and empty.overall.first().overall_score == 100
    assert empty.recommendations.first().recommendation.startswith("Dataset is empty")
    assert analyze(table("c string, d double", c=[None, None], d=[float("nan"), None])).issue_count == 5
    assert profile(table("status string", status=["active"] * 50)).columns[0].unique_count == 1
    assert analyze(table("status string", status=["active"] * 50)).issue_count == 49


def test_nested_columns_get_null_counts_only(table):
    t = table("tags array<string>, props map<string,int>", tags=[["a"], None, ["a"]], props=[{"k": 1}, None, {"k": 1}])
    report = analyze(t)
    assert {(r.row_index, r.column, r.issue_type) for r in report.issues.collect()} == {
        ("1", "tags", "MISSING_VALUE"), ("1", "props", "MISSING_VALUE"), ("2", None, "DUPLICATE_ROW")
    }
