"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import analyze, as_table, profile
from plumbline.operators import checks as C
from plumbline.operators import explore as X
from plumbline.operators import kpi as K
from plumbline.operators import measures as M
from plumbline.operators import reconcile as R
from plumbline.operators import score as S
from plumbline.operators import sketches as K2
from plumbline.operators.detect import detect_types, detections_frame
from plumbline.operators.groups import compared_copies_count, distinct_counts, later_copies_count
from plumbline.operators.evaluate import precision_recall
from plumbline.operators.profile import Profile
from plumbline.plans.analyze import compiled_checks
from plumbline.sinks import reports as W
from plumbline.sources.csv import land_csv, load_csv
from plumbline.sources.tables import Table, dataset_profile, key_faults
from workload import views as V

# Tables profiled by the profile queries, with their keys. ``lineitem`` has no key of its own and is
# numbered by its position in the file.
PROFILED = {
    "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey",
    "documents": "doc_id", "events": "event_id", "pages": "page_id", "lineitem": None,
}
TYPES = {
    "Order_ID": "ID", "Customer_ID": "Integer", "Email": "Email", "Order_Date": "Date",
    "Delivery_Date": "Date", "Quantity": "Integer", "Sales": "Currency", "Discount": "Percentage",
    "Amount_Text": "Currency", "Status": "Category",
}
#: What identifies an order line.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PATTERNS = {"Order_Date": "yyyy-M-d", "Delivery_Date": "yyyy-M-d"}
CONSISTENCY = {"name": "delivery_after_order", "column_a": "Delivery_Date", "column_b": "Order_Date", "operator": ">="}


def _dirty(spark: SparkSession, sf: str) -> Table:
    return as_table(V.dirty_orders(spark, sf), "row_key", key_is_data=False)


def _table(spark: SparkSession, sf: str, name: str, key: str | None) -> Table:
    return as_table(V.read(spark, sf, name), key, key_is_data=False)


def _parents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"customer": V.read(spark, sf, "customer")}


def _issues(table: Table, settings: C.Settings, *kinds: str, types=TYPES, patterns=PATTERNS) -> DataFrame:
    """Issue rows of the given types only."""
    values = C.Values(patterns)
    checks = C.quality_checks(table, types, values, settings) + C.rule_checks(table, values, settings)
    return C.issues(table, values, [c for c in checks if c.issue_type in kinds])


def _rules(*types: str) -> list[dict]:
    return [r for r in V.RULES if r["type"] in types]


def _quality(kind: str, **settings):
    return lambda spark, sf: _issues(_dirty(spark, sf), C.Settings(**settings), kind)


def _business(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        settings = C.Settings(rules=_rules(kind), parents=_parents(spark, sf))
        return _issues(_dirty(spark, sf), settings, kind)

    return run


# --- profile and types -----------------------------------------------------------------------


def _profiles(spark: SparkSession, sf: str, names, passes, kind) -> dict[str, Profile]:
    out = {}
    for n in names:
        table = _dirty(spark, sf) if n == "dirty_orders" else _table(spark, sf, n, PROFILED[n])
        columns = [c.name for c in table.columns if kind in (None, c.kind)]
        out[n] = profile(table, detect=False, columns=columns, passes=passes)
    return out


def _profile_rows(spark, sf, *columns: str, names=("dirty_orders", *PROFILED), passes=(), kind=None) -> DataFrame:
    """Rows of the profiles of some tables, from the passes that the wanted columns need."""
    frames = [p.df.withColumn("table_name", F.lit(n)) for n, p in _profiles(spark, sf, names, passes, kind).items()]
    chosen = reduce(DataFrame.unionByName, frames)
    return chosen.select("table_name", F.col("name").alias("column_name"), *columns)


def profile_counts(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("null_percentage", "unique_percentage")]
    return _profile_rows(spark, sf, "storage_type", "total_rows", "non_null_count", "null_count", "unique_count", *rounded, passes=("distinct",))


def profile_numeric(spark, sf):
    stats = [F.round(c, 4).alias(c) for c in ("min_value", "max_value", "mean_value", "median_value")]
    names = ("dirty_orders", "orders", "customer", "part", "lineitem")
    rows = _profile_rows(spark, sf, *stats, F.round("std_value", 3).alias("std_value"), names=names, passes=("median",), kind="number")
    return rows.where("min_value IS NOT NULL")


def profile_text(spark, sf):
    names = ("dirty_orders", "documents", "pages", "part")
    rows = _profile_rows(spark, sf, "min_length", "max_length", F.round("avg_length", 6).alias("avg_length"), names=names, kind="text")
    return rows.where("min_length IS NOT NULL")


def profile_dates(spark, sf):
    rows = _profile_rows(spark, sf, "min_date", "max_date", names=("orders", "events", "lineitem"), kind="time")
    return rows.where("min_date IS NOT NULL")


def profile_samples(spark, sf):
    rows = _profile_rows(spark, sf, F.posexplode("sample_values").alias("position", "value"), names=("dirty_orders",), passes=("samples",))
    return rows.drop("table_name")


def dataset_profiles(spark, sf):
    frames = [dataset_profile(_table(spark, sf, n, None), n) for n in V.TABLES]
    return reduce(DataFrame.unionByName, frames)


def detect(spark, sf):
    tables = {"dirty_orders": _dirty(spark, sf)} | {n: _table(spark, sf, n, PROFILED[n]) for n in ("pages", "events", "customer")}
    frames = [
        detections_frame(spark, detect_types(t)).withColumn("table_name", F.lit(n)) for n, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def detect_pattern_counts(spark, sf):
    facts = profile(_dirty(spark, sf)).evidence
    keys = ("email", "url", "phone", "currency", "num", "whole", "cents", "pin", "ts", "midnight")
    rows = [(c, k, f[k]) for c, f in facts.items() for k in keys if k in f]
    return spark.createDataFrame(rows, "column_name string, test string, n bigint")


# --- checks on other tables ------------------------------------------------------------------


def duplicate_lineitems(spark, sf):
    table = _table(spark, sf, "lineitem", None)
    return _issues(table, C.Settings(), "DUPLICATE_ROW", types={}, patterns={})


def duplicate_texts(spark, sf):
    table = _table(spark, sf, "documents", "doc_id")
    issues = _issues(table, C.Settings(id_columns=["text"]), "DUPLICATE_ID", types={}, patterns={})
    return issues.withColumn("actual_value", F.md5("actual_value"))


def late_orders(spark, sf):
    """Lines shipped before their order date, as a comparison rule over a join."""
    lines, orders = V.read(spark, sf, "lineitem"), V.read(spark, sf, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(*LINE_KEY, "l_shipdate", "o_orderdate")
    rule = {"name": "ship_after_order", "type": "comparison", "column_a": "l_shipdate", "operator": ">=",
            "column_b": "o_orderdate", "severity": "HIGH"}
    table = as_table(joined, LINE_KEY)
    issues = _issues(table, C.Settings(rules=[rule]), "comparison", types={}, patterns={})
    return issues.select("row_index", "column", "actual_value", "expected_condition", "issue_id")


def account_ranges(spark, sf):
    table = _table(spark, sf, "customer", "c_custkey")
    settings = C.Settings(column_ranges={"c_acctbal": (0, None)}, allowed_categories={"c_mktsegment": ["BUILDING"]})
    return _issues(table, settings, "OUT_OF_RANGE", "INVALID_CATEGORY", types={}, patterns={})


def known_parts(spark, sf):
    """Order lines whose part is unknown: a part number far above all others is put into some orders."""
    rule = {"name": "known_part", "type": "referential_integrity", "child_column": "part",
            "parent_dataset": "part", "parent_column": "p_partkey", "severity": "LOW"}
    parts = V.read(spark, sf, "part")
    moved = F.when(F.col("l_orderkey") % 97 == 0, F.col("l_partkey") + 1_000_000_000).otherwise(F.col("l_partkey"))
    lines = V.read(spark, sf, "lineitem").select(*LINE_KEY, moved.alias("part"))
    table = as_table(lines, LINE_KEY)
    issues = _issues(table, C.Settings(rules=[rule], parents={"part": parts}), "referential_integrity", types={}, patterns={})
    return issues.select("row_index", "actual_value", "issue_id")


def planted_copies(spark, sf):
    """Order lines with copies of every hundredth order's lines behind them."""
    lines = V.read(spark, sf, "lineitem").drop("l_shipdate")
    names = [*lines.columns, "copy"]
    first = lines.groupBy(*LINE_KEY).agg(*[F.min(c).alias(c) for c in lines.columns if c not in LINE_KEY]).withColumn("copy", F.lit(0))
    both = first.select(names).union(first.where("l_orderkey % 100 = 7").withColumn("copy", F.lit(1)).select(names))
    keyed = both.withColumn("line", F.concat_ws("/", *LINE_KEY, "copy")).drop("copy")
    table = as_table(keyed, "line", key_is_data=False)
    return _issues(table, C.Settings(), "DUPLICATE_ROW", types={}, patterns={}).select("row_index", "issue_type", "issue_id")


def repeated_keys(spark, sf):
    """Labels with some rows twice: the row key is checked like any column, and key faults are counted."""
    labels = V.read(spark, sf, "labels")
    twice = labels.unionByName(labels.where("doc_id % 50 = 0")).withColumn("doc_id", F.expr("CASE WHEN doc_id % 90 = 1 THEN NULL ELSE doc_id END"))
    table = as_table(twice, "doc_id")
    issues = _issues(table, C.Settings(id_columns=["doc_id"]), "DUPLICATE_ID", "MISSING_VALUE", types={}, patterns={})
    found = issues.groupBy(F.concat_ws(" ", "issue_type", "column").alias("fact")).agg(F.count("*").alias("n"))
    faults = key_faults(table)
    return found.union(faults.unpivot([], faults.columns, "fact", "n"))


def keyed_copies(spark, sf):
    """Copies of whole rows, key included, and rows without a key: what is listed, and what is counted."""
    labels = V.read(spark, sf, "labels").select("doc_id", "quality")
    key = F.expr("CASE WHEN doc_id % 11 = 3 THEN NULL ELSE doc_id END").alias("doc_id")
    rows = labels.unionByName(labels.where("doc_id % 10 = 0")).unionByName(labels.where("doc_id % 30 = 0")).select(key, "quality")
    table = as_table(rows, "doc_id")
    listed = _issues(table, C.Settings(id_columns=["quality"]), "DUPLICATE_ROW", types={}, patterns={})
    per_row = listed.groupBy(F.coalesce("row_index", F.lit("none")).alias("fact")).agg(F.count("*").alias("n"))
    counted = later_copies_count(table).select(F.lit("counted").alias("fact"), F.col("n").cast("bigint").alias("n"))
    compared = compared_copies_count(table).select(F.lit("compared").alias("fact"), F.col("n").cast("bigint").alias("n"))
    return per_row.unionByName(counted).unionByName(compared)


def repeated_texts_by_key(spark, sf):
    """Repeated texts where keys are missing or shared: a row is listed for its own text only."""
    rows = V.read(spark, sf, "conversations").selectExpr("CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id END AS conv_id", "role", "concat(role, turn) AS said")
    table = as_table(rows, "conv_id")
    issues = _issues(table, C.Settings(id_columns=["said"]), "DUPLICATE_ID", types={}, patterns={})
    return issues.groupBy("row_index", "actual_value").agg(F.count("*").alias("n"))


def nested_values(spark, sf):
    """Distinct values and repeated rows of arrays and structs that hold NULLs."""
    rows = V.read(spark, sf, "embeddings").selectExpr(
        "vec_id", "embedding",
        "CASE vec_id % 4 WHEN 0 THEN array(label, NULL) WHEN 1 THEN array(label) WHEN 2 THEN array(NULL, label) ELSE array(NULL, NULL, label) END AS gaps",
        "CASE vec_id % 3 WHEN 0 THEN named_struct('a', CAST(NULL AS INT), 'b', label) WHEN 1 THEN named_struct('a', label, 'b', CAST(NULL AS INT)) END AS pair",
    )
    frames = []
    for name, columns in {"embeddings": ["embedding"], "gaps": ["gaps"], "pairs": ["pair"], "both": ["gaps", "pair"]}.items():
        table = as_table(rows.select("vec_id", *columns), "vec_id", key_is_data=False)
        copies = later_copies_count(table).select(F.lit(f"{name} copies").alias("fact"), F.col("n").cast("bigint").alias("n"))
        unique = distinct_counts(table).select(F.concat(F.lit(f"{name} unique "), F.col("ordinal")).alias("fact"), F.col("unique_count").alias("n"))
        frames += [copies, unique]
    return reduce(DataFrame.unionByName, frames)


def exact_values(spark, sf):
    """Rules on whole numbers beyond 2^53, decimals and dates, which doubles can't hold."""
    big = 9007199254740992
    rows = V.read(spark, sf, "orders").selectExpr(
        "o_orderkey", f"o_orderkey + {big} AS big", f"o_orderkey + {big} + CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END AS other",
        f"CAST(o_orderkey + {big} AS DECIMAL(20, 0)) AS money", "CAST(o_orderdate AS DATE) AS day",
    )
    known = rows.where("o_orderkey % 5 <> 0").selectExpr("CAST(money AS DECIMAL(24, 2)) AS money")
    rules = [
        {"name": "top", "type": "range", "column": "big", "max": big + 500},
        {"name": "order", "type": "comparison", "column_a": "big", "operator": "<", "column_b": "other", "value_type": "numeric"},
        {"name": "days", "type": "allowed_values", "column": "day", "values": ["1995-01-01", "1995-01-02", "1996-07-04"]},
        {"name": "known", "type": "referential_integrity", "child_column": "money", "parent_dataset": "known", "parent_column": "money"},
    ]
    table = as_table(rows, "o_orderkey")
    settings = C.Settings(rules=rules, parents={"known": known})
    issues = _issues(table, settings, *[r["type"] for r in rules], types={}, patterns={})
    return issues.select("row_index", "rule_or_check_name", "column", "issue_id")


def conversation_checks(spark, sf):
    """Turns with faulty roles and texts: missing and blank texts, roles outside the list."""
    turns = V.read(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN conv_id % 41 = 0 THEN 'bot' ELSE role END AS role",
        "CASE WHEN (conv_id + turn) % 53 = 0 THEN NULL WHEN (conv_id + turn) % 59 = 0 THEN '  ' ELSE text END AS text",
    )
    table = as_table(turns, ["conv_id", "turn"])
    settings = C.Settings(allowed_categories={"role": ["user", "assistant", "system"]})
    issues = _issues(table, settings, "MISSING_VALUE", "BLANK_VALUE", "INVALID_CATEGORY", types={}, patterns={})
    return issues.select("row_index", "column", "issue_type", "issue_id")


def required_columns(spark, sf):
    """Columns that rules demand of every table, absent ones, with the rows that lack them."""
    wanted = ("doc_id", "text", "o_orderkey", "value")
    rules = [{"name": f"needs_{c}", "type": "required_column", "column": c, "severity": "HIGH"} for c in wanted]
    frames = []
    for name in V.TABLES:
        frame = V.read(spark, sf, name)
        table = as_table(frame, frame.columns[0])
        issues = _issues(table, C.Settings(rules=rules), "required_column", types={}, patterns={})
        rows = table.df.agg(F.count(F.lit(1)).alias("n_rows"))
        frames.append(issues.select(F.lit(name).alias("table_name"), "column", "severity", "message", "issue_id").join(rows, how="cross"))
    return reduce(DataFrame.unionByName, frames)


# --- files -----------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share. Where the session names none, a local one if it has one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    shared = shared or tempfile.mkdtemp(prefix="plumbline-")
    return f"{shared}/files-{uuid.uuid4().hex}"


def _orders_as_csv(spark, sf) -> str:
    """Orders in key order as CSV files, with texts for missing values, line breaks and quotes in cells, and Latin-1 letters."""
    rows = V.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS key", "CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE CAST(o_custkey AS STRING) END AS customer",
        "CASE WHEN o_orderkey % 9 = 0 THEN '#N/A' ELSE CAST(o_totalprice AS STRING) END AS price",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END AS even",
        r"CASE o_orderkey % 5 WHEN 0 THEN concat('line\nbreak ', o_orderkey) WHEN 1 THEN concat('say \"', o_orderkey, '\", now') WHEN 2 THEN concat('caf\u00e9 ', o_orderkey) ELSE o_orderpriority END AS note",
    )
    path = _scratch(spark)
    rows.repartitionByRange(5, "key").sortWithinPartitions("key").write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return path


def csv_rows(spark, sf):
    """CSV files of orders read back: row numbers, inferred types, missing values, encoding."""
    table = load_csv(spark, _orders_as_csv(spark, sf))
    typed = F.lit(", ".join(c.dtype.simpleString() for c in table.columns)).alias("types")
    cells = [c.cell.alias(c.name) for c in table.columns]
    return table.df.select(F.col("__row").alias("row"), *cells, typed).withColumns({"price": F.round("price", 2), "customer": F.col("customer").cast("string")})


def csv_head(spark, sf):
    """The first hundred rows of the files."""
    table = load_csv(spark, _orders_as_csv(spark, sf), sample_size=100)
    return table.df.select(F.col("__row").alias("row"), F.col("c0").alias("key"))


def csv_landed(spark, sf):
    """Issues of the landed files: the text is parsed once, the passes read Parquet."""
    path = _orders_as_csv(spark, sf)
    table = land_csv(spark, path, f"{path}-landed")
    issues = _issues(table, C.Settings(column_ranges={"price": (50_000, None)}), "MISSING_VALUE", "OUT_OF_RANGE", types={}, patterns={})
    return issues.select("row_index", "column", "issue_type", "issue_id")


def file_keys(spark, sf):
    """Orders in several Parquet files, written in parts, some rows in two of them: keys by file and row, later copies listed."""
    orders = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    path = _scratch(spark)
    names = []
    for i, part in enumerate((orders, orders.where("o_orderkey % 20 = 0"), orders.where("o_orderkey % 50 = 0"))):
        names.append(f"{path}/{i}")
        # Equal keys stay in the order of the input.
        ordered = part.withColumn("__at", F.monotonically_increasing_id()).orderBy("o_orderkey", "__at")
        ordered.drop("__at").write.parquet(names[-1])
    table = as_table(spark.read.parquet(*names), folders=True)
    listed = _issues(table, C.Settings(), "DUPLICATE_ROW", types={}, patterns={})
    return listed.select("row_index", "issue_id")


# --- names, types, sketches ------------------------------------------------------------------


def odd_names(spark, sf):
    """Column names with dots, quotes, blanks and accents in all checks."""
    rows = V.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS `key.of \"row\"`", "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS `customer's é`", "o_totalprice AS `a.b``c`"
    )
    table = as_table(rows, 'key.of "row"', key_is_data=False)
    settings = C.Settings(column_ranges={"a.b`c": (1000, None)})
    return _issues(table, settings, "MISSING_VALUE", "OUT_OF_RANGE", types={}, patterns={}).select("row_index", "column", "expected_condition", "issue_id")


def _calls(spark, sf) -> Table:
    rows = V.read(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('555-', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS callback",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS answered", "o_orderkey * 1.2345678e0 + 1000.00123e0 AS weight",
        "CAST(NULL AS STRING) AS remark", "concat('x', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE '' END) AS tag",
    )
    return as_table(rows, "o_orderkey", key_is_data=False)


def detect_more(spark, sf):
    """Phone, Boolean, Decimal, Unknown and String columns."""
    return detections_frame(spark, detect_types(_calls(spark, sf)))


def type_counts(spark, sf):
    """How many columns of some tables have each type."""
    tables = [_dirty(spark, sf), _calls(spark, sf), *[_table(spark, sf, n, PROFILED[n]) for n in ("pages", "events", "customer")]]
    return X.count_by(reduce(DataFrame.unionByName, [detections_frame(spark, detect_types(t)) for t in tables]), "detected_type")


def sketched_profiles(spark, sf):
    """Sketches of orders by status, merged: exact figures, and whether the estimates keep within their bounds."""
    orders = V.read(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority")
    table = as_table(orders.withColumn("k", F.lit(0)), "k", key_is_data=False)
    parts = K2.sketches(table, ["o_orderstatus"])
    rows = K2.sketched_profile(K2.merged(parts)).select("column_name", "n_rows", "null_count", "distinct_estimate", "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"), "max_length", "q50")
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in orders.columns[1:]], *[F.count_if(F.lit(False)).alias("none")])
    exact = exact.unpivot([], orders.columns[1:], "column_name", "true_distinct")
    numbers = orders.select(F.expr("stack(2, 'o_custkey', CAST(o_custkey AS DOUBLE), 'o_totalprice', o_totalprice) AS (column_name, v)"))
    middle = numbers.join(rows.select("column_name", "q50"), "column_name").groupBy("column_name")
    middle = middle.agg(F.count_if(F.col("v") < F.col("q50")).alias("below"), F.count_if(F.col("v") <= F.col("q50")).alias("up_to"), F.count("v").alias("n"))
    within = (F.col("below") <= (0.5 + K2.RANK_ERROR) * F.col("n")) & (F.col("up_to") >= (0.5 - K2.RANK_ERROR) * F.col("n"))
    close = F.abs(F.col("distinct_estimate") - F.col("true_distinct")) <= K2.DISTINCT_ERROR * F.col("true_distinct")
    return rows.join(exact, "column_name").join(middle, "column_name", "left").select(
        "column_name", "n_rows", "null_count", "min_value", "max_value", "mean_value", F.coalesce("max_length", F.lit(0)).alias("max_length"), close.alias("distinct_close"), within.alias("median_close")
    )


# --- whole analysis --------------------------------------------------------------------------


def _report(spark, sf):
    return analyze(V.dirty_orders(spark, sf), "row_key", rules=V.RULES, parents=_parents(spark, sf), key_is_data=False)


def _all_checks(spark, sf):
    """Table, derived values, checks and their counts, with the semantic types given."""
    table = _dirty(spark, sf)
    values = C.Values(PATTERNS)
    settings = C.Settings(rules=V.RULES, parents=_parents(spark, sf))
    checks = C.quality_checks(table, TYPES, values, settings) + C.rule_checks(table, values, settings)
    return table, values, checks


def _tally(spark, sf) -> tuple[Table, DataFrame]:
    table, values, checks = _all_checks(spark, sf)
    return table, C.tally(table, values, checks)


def issues_all(spark, sf):
    table = _dirty(spark, sf)
    profiled = profile(table)
    types = {d.column_name: d.detected_type for d in detect_types(table, profiled)}
    settings = C.Settings(rules=V.RULES, parents=_parents(spark, sf))
    return C.issues(table, *compiled_checks(table, profiled, types, settings))


def issue_tally(spark, sf):
    return _tally(spark, sf)[1]


def score_dimensions(spark, sf):
    table, tally = _tally(spark, sf)
    numbers = ("score", "row_penalty", "dataset_penalty", "defect_rate")
    rows = S.score_dimensions(tally, table.n_rows, len(table.columns))
    return rows.select(
        "dimension", "weight", "is_applicable", "issue_count", "row_issue_count", "dataset_issue_count",
        *[F.round(c, 8).alias(c) for c in numbers], "evidence",
    )


def score_overall(spark, sf):
    table, tally = _tally(spark, sf)
    n, width = table.n_rows, len(table.columns)
    overall = S.score_overall(S.score_dimensions(tally, n, width), n, width)
    return overall.withColumn("overall_score", F.round("overall_score", 8))


def score_recommendations(spark, sf):
    table, tally = _tally(spark, sf)
    return S.score_recommendations(tally, table.n_rows, len(table.columns))


def summary_counts(spark, sf):
    return X.summary_long(_tally(spark, sf)[1])


def severity_counts(spark, sf):
    return X.severity_counts(_tally(spark, sf)[1])


def issue_search(spark, sf):
    found = X.search(C.issues(*_all_checks(spark, sf)), "EXAMPLE.com")
    chosen = X.select_rows(found, {"severity": ["MEDIUM", "HIGH"], "column": ["Email"]})
    return X.pick_columns(chosen, ["issue_id", "row_index", "column", "severity", "actual_value"])


def headline(spark, sf):
    report = _report(spark, sf)
    found = X.headline(report.overall, report.kpis, report.measures)
    return found.withColumn("overall_score", F.round("overall_score", 8))


def readiness_row(spark, sf):
    table, tally = _tally(spark, sf)
    n, width = table.n_rows, len(table.columns)
    dimensions = S.score_dimensions(tally, n, width)
    row = W.readiness_row(S.score_overall(dimensions, n, width), dimensions)
    return row.select(*[F.round(c, 8).alias(c) if row.schema[c].dataType.typeName() == "double" else c for c in row.columns])


def column_metadata(spark, sf):
    table = _dirty(spark, sf)
    profiled = profile(table)
    rows = W.column_metadata(profiled.df, detections_frame(spark, detect_types(table, profiled)))
    doubles = ("null_percentage", "unique_percentage", "min", "max", "mean", "median")
    return rows.select(*[F.round(c, 4).alias(c) if c in doubles else c for c in rows.columns])


# --- KPIs, measures, reconciliation, evaluation ------------------------------------------------


def kpi_defect_rates(spark, sf):
    table, tally = _tally(spark, sf)
    return K.defect_rates(tally, table.n_rows).withColumn("defect_rate", F.round("defect_rate", 10))


def kpi_recommendations(spark, sf):
    kpis = _report(spark, sf).kpis
    return W.as_text(kpis)


def _sales(spark, sf) -> Table:
    # No key identifies a line here and measures need none.
    return as_table(V.sales_lines(spark, sf).withColumn("line", F.lit(0)), "line", key_is_data=False)


def kpi_values(spark, sf):
    """Sum, average, distinct counts and ratios over all order lines."""
    total = M.Aggregate("SUM", "Sales")
    wanted = {
        "Total Sales": M.Measure(total),
        "Average Sales": M.Measure(M.Aggregate("AVERAGE", "Sales")),
        "Total Quantity": M.Measure(M.Aggregate("SUM", "Quantity")),
        "Total Orders": M.Measure(M.Aggregate("DISTINCTCOUNT", "Order_ID")),
        "Distinct Customers": M.Measure(M.Aggregate("DISTINCTCOUNT", "Customer_ID")),
        "Average Order Value": M.Measure(total, M.Aggregate("DISTINCTCOUNT", "Order_ID")),
        "Profit Margin": M.Measure(M.Aggregate("SUM", "Profit"), total),
        "Discount Rate": M.Measure(M.Aggregate("SUM", "Discount"), total),
    }
    values = M.measure_values(_sales(spark, sf), wanted)
    rows = [(k, round(float(v), 4)) for k, v in values.items()]
    return spark.createDataFrame(rows, "kpi_name string, value double")


def kpi_by_month(spark, sf):
    m = M.Measure(M.Aggregate("SUM", "Sales"), group_by="Order_Date")
    return M.measure_by_time(_sales(spark, sf), m).withColumn("value", F.round("value", 2))


def kpi_by_dimension(spark, sf):
    """Three measures per region from one aggregation over one join."""
    sums = {
        "sales": M.Measure(M.Aggregate("SUM", "Sales"), group_by="Region"),
        "orders": M.Measure(M.Aggregate("DISTINCTCOUNT", "Order_ID"), group_by="Region"),
        "order_value": M.Measure(M.Aggregate("SUM", "Sales"), M.Aggregate("DISTINCTCOUNT", "Order_ID"), "Region"),
    }
    wide = M.measures_by_column(_sales(spark, sf), sums, "Region")
    wide = wide.select("Region", *[F.col(n).cast("double").alias(n) for n in sums])
    return wide.unpivot("Region", list(sums), "measure", "value").withColumn("value", F.round("value", 4))


def reconcile_metrics(spark, sf):
    """Claims derived from a count of rows, some right and some not, against recomputed values."""
    table = _dirty(spark, sf)
    metrics = [
        R.Metric("missing", "Email"), R.Metric("missing", "Sales"), R.Metric("blank", "Email"),
        R.Metric("duplicate_rows"), R.Metric("duplicate_ids", "Order_ID"), R.Metric("range", "Discount", 0, 1),
    ]
    actual = R.actual_metrics(table, metrics)
    claims = table.df.agg(
        F.count_if(F.col("c2").isNull()).alias("Missing Values (Email)"),
        F.count(F.lit(1)).alias("Missing Values (Sales)"),
        F.count_if(F.col("c7") > 1).alias("Range Violation (Discount)"),
        F.lit(None).cast("bigint").alias("Duplicate Rows"),
    )
    claimed = claims.unpivot([], claims.columns, "metric", "claimed")
    return R.reconcile(claimed, actual).withColumn("difference", F.round("difference", 6))


def measure_rows(spark, sf):
    """The measure table: values and status of every KPI."""
    rows = _report(spark, sf).measures
    return W.as_text(rows.drop("value")).join(rows.select("measure_name", F.round("value", 4).alias("value")), "measure_name")


def reconcile_defaults(spark, sf):
    """All default metrics, KPI values among them, against claims from plain aggregates, one of them wrong."""
    report = _report(spark, sf)
    d = V.dirty_orders(spark, sf)
    claims = d.agg(
        F.count_if(F.col("Email").isNull()).cast("double").alias("Missing Values (Email)"),
        F.sum("Sales").alias("Total Sales"), F.avg("Sales").alias("Average Sales"), (F.sum("Quantity") + 1).cast("double").alias("Total Quantity"),
        F.count_distinct("Order_ID").cast("double").alias("Total Orders"), F.lit(0.0).alias("Not A Metric"),
    )
    rows = R.reconcile(claims.unpivot([], claims.columns, "metric", "claimed"), report.actual_metrics())
    return rows.select("metric", F.round("difference", 2).alias("difference"), "match_status")


def score_reasons(spark, sf):
    """Explanations of the dimensions: with rules, without, and of a table without rows."""
    table, tally = _tally(spark, sf)
    n, width = table.n_rows, len(table.columns)
    plain = tally.where("source = 'quality_check'")
    cases = {"rules": (tally, n, True), "no rules": (plain, n, False), "empty": (tally, table.df.where("__row IS NULL").count(), True)}
    frames = [S.score_dimensions(t, rows, width, rules_configured=configured).withColumn("case", F.lit(k)) for k, (t, rows, configured) in cases.items()]
    return reduce(DataFrame.unionByName, frames).select("case", "dimension", "is_applicable", F.round("score", 8).alias("score"), "reason", "evidence")


def quality_summary(spark, sf):
    """The summary row: counts by severity, type, source and column as report text."""
    return W.as_text(X.summary_wide(_tally(spark, sf)[1]))


def reconcile_grouped(spark, sf):
    """Sales per region: the claim rounds each line to whole units."""
    table = _sales(spark, sf)
    actual = M.measure_by_column(table, M.Measure(M.Aggregate("SUM", "Sales"), group_by="Region"), "actual")
    claimed = V.sales_lines(spark, sf).groupBy("Region").agg(
        F.sum(F.round("Sales", 0)).cast("double").alias("claimed")
    ).where("Region <> 'ASIA'")
    rows = R.reconcile_grouped(claimed, actual, ["Region"])
    return rows.select("Region", F.round("difference", 2).alias("difference"), "match_status")


def eval_precision_recall(spark, sf):
    """Detected issues of dirty_orders against the faults that were injected, leaving out two kinds."""
    detected = C.issues(*_all_checks(spark, sf))
    orders = V.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    faults = [("Email", "MISSING_VALUE", k % 53 == 0), ("Sales", "MISSING_VALUE", k % 101 == 0),
              ("Order_Date", "INVALID_DATE", k % 61 == 1), ("Amount_Text", "INVALID_NUMERIC", k % 79 == 0),
              ("Quantity", "range", k % 83 == 0), ("Status", "allowed_values", k % 73 == 0)]
    planted = F.array(*[F.when(p, F.struct(F.lit(c).alias("column"), F.lit(t).alias("issue_type"))) for c, t, p in faults])
    expected = orders.select(k.cast("string").alias("row_index"), F.explode(planted).alias("f")).where("f IS NOT NULL")
    rows = precision_recall(expected.select("row_index", "f.column", "f.issue_type"), detected)
    return rows.select("issue_type", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


QUERIES = {
    "dataset_profile": dataset_profiles,
    "profile_counts": profile_counts,
    "profile_numeric": profile_numeric,
    "profile_text": profile_text,
    "profile_dates": profile_dates,
    "profile_samples": profile_samples,
    "detect_types": detect,
    "detect_pattern_counts": detect_pattern_counts,
    "q_missing": _quality("MISSING_VALUE"),
    "q_blank": _quality("BLANK_VALUE"),
    "q_duplicate_rows": _quality("DUPLICATE_ROW"),
    "q_duplicate_ids": _quality("DUPLICATE_ID"),
    "q_emails": _quality("INVALID_EMAIL"),
    "q_dates": _quality("INVALID_DATE"),
    "q_numeric": _quality("INVALID_NUMERIC"),
    "q_category": _quality("INVALID_CATEGORY", allowed_categories={"Status": ["O", "F", "P"]}),
    "q_range": _quality("OUT_OF_RANGE", column_ranges={"Quantity": (1, None), "Discount": (0, 1)}),
    "q_consistency": _quality("CONSISTENCY_VIOLATION", consistency_rules=[CONSISTENCY]),
    "q_duplicate_lineitems": duplicate_lineitems,
    "q_duplicate_texts": duplicate_texts,
    "q_account_ranges": account_ranges,
    "q_planted_copies": planted_copies,
    "q_repeated_keys": repeated_keys,
    "q_nested_values": nested_values,
    "q_conversations": conversation_checks,
    "r_exact_values": exact_values,
    "r_required": required_columns,
    "q_keyed_copies": keyed_copies,
    "q_texts_by_key": repeated_texts_by_key,
    "q_odd_names": odd_names,
    "csv_rows": csv_rows,
    "csv_head": csv_head,
    "csv_landed": csv_landed,
    "file_keys": file_keys,
    "detect_more": detect_more,
    "type_counts": type_counts,
    "sketched_profiles": sketched_profiles,
    "measure_rows": measure_rows,
    "reconcile_defaults": reconcile_defaults,
    "score_reasons": score_reasons,
    "quality_summary": quality_summary,
    "r_range": _business("range"),
    "r_allowed": _business("allowed_values"),
    "r_unique": _business("uniqueness"),
    "r_comparison": _business("comparison"),
    "r_referential": _business("referential_integrity"),
    "r_late_orders": late_orders,
    "r_known_parts": known_parts,
    "issues_all": issues_all,
    "issue_tally": issue_tally,
    "score_dimensions": score_dimensions,
    "score_overall": score_overall,
    "score_recommendations": score_recommendations,
    "readiness_row": readiness_row,
    "column_metadata": column_metadata,
    "kpi_defect_rates": kpi_defect_rates,
    "kpi_recommendations": kpi_recommendations,
    "kpi_values": kpi_values,
    "kpi_by_month": kpi_by_month,
    "kpi_by_dimension": kpi_by_dimension,
    "reconcile_metrics": reconcile_metrics,
    "reconcile_grouped": reconcile_grouped,
    "summary_counts": summary_counts,
    "severity_counts": severity_counts,
    "issue_search": issue_search,
    "headline": headline,
    "eval_precision_recall": eval_precision_recall,
}
