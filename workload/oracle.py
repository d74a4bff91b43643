"""DuckDB SQL that answers each registered query on its own terms."""

from __future__ import annotations

from workload.views import DIRTY_ORDERS_DUCKDB, SALES_LINES, TABLES

D = f"d AS ({DIRTY_ORDERS_DUCKDB})"
SALES = f"s AS ({SALES_LINES})"

LINE = "l_orderkey || '#' || l_linenumber || '#' || l_partkey || '#' || l_suppkey"
# Patterns of semantic types.
NUM = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
PHONE = r"^(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"
CURRENCY = r"^[$€£¥]?\s?\d{1,3}([,.]\d{3})*([.,]\d{2})?$"
PERCENT = r"^\d+(\.\d+)?%?$"

# Severity and advice of each quality issue, and the advice of rules.
SEVERITY = {
    "MISSING_VALUE": "LOW", "BLANK_VALUE": "LOW", "DUPLICATE_ROW": "MEDIUM", "DUPLICATE_ID": "CRITICAL", "INVALID_EMAIL": "MEDIUM", "INVALID_DATE": "HIGH",
    "INVALID_NUMERIC": "HIGH", "INVALID_CATEGORY": "MEDIUM", "OUT_OF_RANGE": "HIGH", "CONSISTENCY_VIOLATION": "HIGH",
}
ADVICE = {
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


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


# --- issues ----------------------------------------------------------------------------------


def _issue(
    source: str, kind: str, name: str, column: str | None, expected: str, message: str, where: str,
    actual: str = "NULL", row: str = "CAST(row_key AS VARCHAR)", frm: str = "d", severity: str | None = None,
) -> str:
    severity = severity or SEVERITY[kind]
    advice = ADVICE[kind] if source == "quality_check" else RULE_ADVICE
    return f"""SELECT {row} AS row_index, {_text(column)} AS "column", {_text(source)} AS source,
  {_text(kind)} AS issue_type, {_text(name)} AS rule_or_check_name, CAST({actual} AS VARCHAR) AS actual_value,
  {_text(expected)} AS expected_condition, {_text(severity)} AS severity, {_text(message)} AS message,
  {_text(advice)} AS recommendation,
  sha256({_text(f"{source}|{kind}|{name}|")} || coalesce({row}, 'DATASET') || '|' || {_text(column or "DATASET")}) AS issue_id
FROM {frm} WHERE {where}"""


def _q(*args, **kw) -> str:
    return _issue("quality_check", *args, **kw)


def _r(*args, **kw) -> str:
    return _issue("business_rule", *args, **kw)


COLUMNS = ["Order_ID", "Customer_ID", "Email", "Order_Date", "Delivery_Date", "Quantity", "Sales", "Discount", "Amount_Text", "Status"]
TEXTS = ["Order_ID", "Email", "Order_Date", "Delivery_Date", "Amount_Text", "Status"]
DATE_A = "try_strptime(Delivery_Date, '%Y-%m-%d')"
DATE_B = "try_strptime(Order_Date, '%Y-%m-%d')"
PAIR = "'Delivery_Date=''' || Delivery_Date || ''', Order_Date=''' || Order_Date || ''''"
LATE = f"{DATE_A} < {DATE_B}"
COPIES = f"""(SELECT *, row_number() OVER (PARTITION BY {", ".join(COLUMNS)} ORDER BY row_key) AS copy FROM d)"""
SHARED_ID = "Order_ID IN (SELECT Order_ID FROM d GROUP BY Order_ID HAVING count(*) > 1)"

ISSUES = {
    "MISSING_VALUE": [
        _q("MISSING_VALUE", "missing_value_check", c, "Non-null value expected",
           f"Column '{c}' is missing a value in this row.", f"{c} IS NULL")
        for c in COLUMNS
    ],
    "BLANK_VALUE": [
        _q("BLANK_VALUE", "blank_value_check", c, "Non-blank text value expected",
           f"Column '{c}' contains a blank or whitespace-only value.", f"trim({c}) = ''", c)
        for c in TEXTS
    ],
    "DUPLICATE_ROW": [
        _q("DUPLICATE_ROW", "duplicate_row_check", None, "Row should be unique across all columns",
           "This row is an exact duplicate of an earlier row in the dataset.", "copy > 1", frm=COPIES)
    ],
    "DUPLICATE_ID": [
        _q("DUPLICATE_ID", "duplicate_id_check", "Order_ID", "Values in 'Order_ID' should be unique",
           "The value in 'Order_ID' is shared by more than one row.", SHARED_ID, "Order_ID")
    ],
    "INVALID_EMAIL": [
        _q("INVALID_EMAIL", "invalid_email_check", "Email", "Value should match a valid email address pattern",
           "Value in 'Email' does not look like a valid email address.",
           f"NOT regexp_matches(trim(Email), '{EMAIL}')", "Email")
    ],
    "INVALID_DATE": [
        _q("INVALID_DATE", "invalid_date_check", c, "Value should be a parseable date",
           f"Value in '{c}' could not be parsed as a date.",
           f"{c} IS NOT NULL AND try_strptime({c}, '%Y-%m-%d') IS NULL", c)
        for c in ("Order_Date", "Delivery_Date")
    ],
    "INVALID_NUMERIC": [
        _q("INVALID_NUMERIC", "invalid_numeric_check", "Amount_Text", "Value should be numeric",
           "Value in 'Amount_Text' could not be interpreted as a numeric value.",
           f"NOT regexp_matches(translate(Amount_Text, '$,%', ''), '{NUM}')", "Amount_Text")
    ],
    "INVALID_CATEGORY": [
        _q("INVALID_CATEGORY", "invalid_category_check", "Status", "Value should be one of: ['F', 'O', 'P']",
           "Value in 'Status' is not one of the allowed categories.", "Status NOT IN ('O', 'F', 'P')", "Status")
    ],
    "OUT_OF_RANGE": [
        _q("OUT_OF_RANGE", "range_check", "Quantity", ">= 1",
           "Value in 'Quantity' is outside the configured allowed range.", "Quantity < 1", "Quantity"),
        _q("OUT_OF_RANGE", "range_check", "Discount", ">= 0 and <= 1",
           "Value in 'Discount' is outside the configured allowed range.", "Discount < 0 OR Discount > 1", "Discount"),
    ],
    "CONSISTENCY_VIOLATION": [
        _q("CONSISTENCY_VIOLATION", "delivery_after_order", "Delivery_Date / Order_Date",
           "Delivery_Date >= Order_Date", "Row violates consistency rule: Delivery_Date >= Order_Date.", LATE, PAIR)
    ],
    "range": [
        _r("range", "discount_range", "Discount", "Discount >= 0 and <= 1",
           "Value in 'Discount' is outside the allowed range (Discount >= 0 and <= 1).",
           "Discount < 0 OR Discount > 1", "Discount", severity="MEDIUM"),
        _r("range", "quantity_min", "Quantity", "Quantity >= 1",
           "Value in 'Quantity' is outside the allowed range (Quantity >= 1).", "Quantity < 1", "Quantity",
           severity="MEDIUM"),
    ],
    "allowed_values": [
        _r("allowed_values", "status_values", "Status", "Value should be one of: ['F', 'O', 'P']",
           "Value in 'Status' is not an allowed value.", "Status NOT IN ('O', 'F', 'P')", "Status", severity="MEDIUM")
    ],
    "uniqueness": [
        _r("uniqueness", "order_unique", "Order_ID", "Values in 'Order_ID' should be unique",
           "The value in 'Order_ID' is shared by more than one row.", SHARED_ID, "Order_ID", severity="CRITICAL")
    ],
    "comparison": [
        _r("comparison", "delivery_after_order", "Delivery_Date / Order_Date", "Delivery_Date >= Order_Date",
           "Row violates comparison rule: Delivery_Date >= Order_Date.", LATE, PAIR, severity="HIGH")
    ],
    "referential_integrity": [
        _r("referential_integrity", "known_customer", "Customer_ID", "'Customer_ID' must exist in customer.c_custkey",
           "Value in 'Customer_ID' has no matching record in customer.c_custkey.",
           "Customer_ID NOT IN (SELECT c_custkey FROM customer)", "Customer_ID", severity="HIGH")
    ],
    "required_column": [
        _r("required_column", "warehouse_required", "Warehouse", "Column 'Warehouse' must be present in the dataset",
           "Required column 'Warehouse' is missing from the dataset.", "one = 1", row="CAST(NULL AS VARCHAR)",
           frm="(SELECT 1 AS one)", severity="LOW")
    ],
}
DEFAULT_KINDS = [k for k in ISSUES if k not in ("INVALID_CATEGORY", "OUT_OF_RANGE", "CONSISTENCY_VIOLATION")]


def _issues(*kinds: str) -> str:
    return " UNION ALL ".join(sql for k in kinds for sql in ISSUES[k])


ALL = f"i AS ({_issues(*DEFAULT_KINDS)})"
TALLY = f"""{D}, {ALL}, t AS (SELECT source, issue_type, rule_or_check_name, "column", severity, recommendation,
  row_index IS NOT NULL AS row_level, count(*) AS n FROM i GROUP BY ALL)"""
PENALTY = "CASE severity WHEN 'INFO' THEN 0.0 WHEN 'LOW' THEN 0.1 WHEN 'HIGH' THEN 1.0 WHEN 'CRITICAL' THEN 5.0 ELSE 0.5 END"
DIMENSION = """CASE WHEN issue_type IN ('MISSING_VALUE', 'BLANK_VALUE') THEN 'COMPLETENESS'
  WHEN issue_type IN ('CONSISTENCY_VIOLATION', 'comparison') THEN 'CONSISTENCY'
  WHEN issue_type IN ('DUPLICATE_ROW', 'DUPLICATE_ID', 'uniqueness') THEN 'UNIQUENESS'
  WHEN source = 'business_rule' THEN 'RULE_COMPLIANCE' ELSE 'VALIDITY' END"""
DIMENSIONS = f"""{TALLY}, total AS (SELECT count(*) AS n_rows FROM d),
w(dimension, weight) AS (VALUES ('COMPLETENESS', 0.25e0), ('VALIDITY', 0.25e0), ('CONSISTENCY', 0.2e0),
  ('UNIQUENESS', 0.15e0), ('RULE_COMPLIANCE', 0.15e0)),
rolled AS (SELECT {DIMENSION} AS dimension, sum(n) AS issue_count, sum(CASE WHEN row_level THEN n ELSE 0 END) AS row_issue_count,
  sum(CASE WHEN row_level THEN n * CAST({PENALTY} AS DOUBLE) ELSE 0 END) AS row_penalty,
  sum(CASE WHEN row_level THEN 0 ELSE n * CAST({PENALTY} AS DOUBLE) END) AS dataset_penalty FROM t GROUP BY 1),
base AS (SELECT dimension, weight, CAST(coalesce(issue_count, 0) AS BIGINT) AS issue_count,
  CAST(coalesce(row_issue_count, 0) AS BIGINT) AS row_issue_count,
  coalesce(row_penalty, 0e0) AS row_penalty, coalesce(dataset_penalty, 0e0) AS dataset_penalty
  FROM w LEFT JOIN rolled USING (dimension)),
dims AS (SELECT *, row_penalty / n_rows + dataset_penalty AS defect_rate,
  greatest(0e0, least(100e0, 100 - 100 * (row_penalty / n_rows + dataset_penalty))) AS score FROM base, total)"""
OVERALL = f"{DIMENSIONS}, o AS (SELECT sum(weight * score) / sum(weight) AS score, sum(issue_count) AS issues FROM dims)"
GRADE = "CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Needs Improvement' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END"
STATUS = "CASE WHEN score >= 90 THEN 'READY' WHEN score >= 75 THEN 'READY_WITH_WARNINGS' WHEN score >= 60 THEN 'REVIEW_REQUIRED' ELSE 'NOT_READY' END"
LETTER = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"

# --- profile ---------------------------------------------------------------------------------

# Columns of each table: (name, class, storage type).
SCHEMAS = {
    "dirty_orders": [("Order_ID", "text", "object"), ("Customer_ID", "number", "int64"), ("Email", "text", "object"),
                     ("Order_Date", "text", "object"), ("Delivery_Date", "text", "object"), ("Quantity", "number", "int64"),
                     ("Sales", "number", "float64"), ("Discount", "number", "float64"), ("Amount_Text", "text", "object"),
                     ("Status", "text", "object")],
    "orders": [("o_custkey", "number", "int64"), ("o_orderstatus", "text", "object"), ("o_totalprice", "number", "float64"),
               ("o_orderdate", "time", "datetime64[ns]"), ("o_orderpriority", "text", "object")],
    "customer": [("c_name", "text", "object"), ("c_nationkey", "number", "int32"), ("c_acctbal", "number", "float64"),
                 ("c_mktsegment", "text", "object")],
    "part": [("p_name", "text", "object"), ("p_brand", "text", "object"), ("p_type", "text", "object"),
             ("p_size", "number", "int32"), ("p_retailprice", "number", "float64")],
    "supplier": [("s_name", "text", "object"), ("s_nationkey", "number", "int32"), ("s_acctbal", "number", "float64")],
    "documents": [("text", "text", "object"), ("lang", "text", "object"), ("source", "text", "object"), ("n_chars", "number", "int64")],
    "events": [("ts", "time", "datetime64[ns]"), ("user_id", "number", "int64"), ("event_type", "text", "object"),
               ("value", "number", "float64"), ("props", "text", "object")],
    "pages": [("url", "text", "object"), ("html", "text", "object")],
    "lineitem": [("l_orderkey", "number", "int64"), ("l_partkey", "number", "int64"), ("l_suppkey", "number", "int64"),
                 ("l_linenumber", "number", "int32"), ("l_quantity", "number", "float64"), ("l_extendedprice", "number", "float64"),
                 ("l_discount", "number", "float64"), ("l_tax", "number", "float64"), ("l_returnflag", "text", "object"),
                 ("l_linestatus", "text", "object"), ("l_shipdate", "time", "datetime64[ns]")],
}


def _source(table: str) -> str:
    return "d" if table == "dirty_orders" else table


def _per_column(select: str, tables, classes=("text", "number", "time")) -> str:
    """One SELECT per column; {c} is the column, {s} its storage type."""
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {select.format(c=c, s=s)} FROM {_source(t)}"
        for t in tables
        for c, kind, s in SCHEMAS[t]
        if kind in classes
    ]
    return f"WITH {D} " + " UNION ALL ".join(parts)


COUNTS = """'{s}' AS storage_type, count(*) AS total_rows, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS unique_count, round((count(*) - count({c})) * 100.0e0 / count(*), 6) AS null_percentage,
  round(count(DISTINCT {c}) * 100.0e0 / count({c}), 6) AS unique_percentage"""
NUMBERS = """round(CAST(min({c}) AS DOUBLE), 4) AS min_value, round(CAST(max({c}) AS DOUBLE), 4) AS max_value,
  round(avg(CAST({c} AS DOUBLE)), 4) AS mean_value, round(CAST(median({c}) AS DOUBLE), 4) AS median_value,
  round(stddev_samp(CAST({c} AS DOUBLE)), 3) AS std_value"""
LENGTHS = "CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length, round(avg(length({c})), 6) AS avg_length"
SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY row_key) - 1 AS INT) AS position,
  CAST({c} AS VARCHAR) AS value FROM d WHERE {c} IS NOT NULL QUALIFY row_number() OVER (ORDER BY row_key) <= 5"""
    for c in COLUMNS
)

# Facts that decide types, for one column of one table.
FACTS = {
    "email": "count(*) FILTER (regexp_matches(x, '{EMAIL}'))",
    "url": "count(*) FILTER (regexp_matches(x, '{URL}', 'i'))",
    "phone": "count(*) FILTER (regexp_matches(x, '{PHONE}'))",
    "currency": "count(*) FILTER (regexp_matches(x, '{CURRENCY}'))",
    "num": "count(v)",
    "whole": "count(*) FILTER (v % 1 = 0)",
    "cents": "count(*) FILTER ((v * 100) % 1 = 0)",
    "pin": "count(*) FILTER (v BETWEEN 0 AND 100)",
    "ts": "count(ts)",
    "midnight": "count(*) FILTER (ts = date_trunc('day', ts))",
}
FACTS = {k: v.replace("{EMAIL}", EMAIL).replace("{URL}", URL).replace("{PHONE}", PHONE).replace("{CURRENCY}", CURRENCY) for k, v in FACTS.items()}
KEPT_FACTS = {
    "text": tuple(FACTS), "double": ("phone", "currency", "num", "whole", "cents", "pin"), "int": ("phone",), "time": ("ts", "midnight"),
}


def _cells(table: str, column: str, kind: str) -> str:
    """(x text, v number, ts timestamp) of the non-null cells of a column."""
    if kind == "time":
        value, ts = "CAST(NULL AS DOUBLE)", column
    elif kind == "number":
        value, ts = f"CAST({column} AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"
    else:
        value = f"CASE WHEN regexp_matches({column}, '{NUM}') THEN try_cast({column} AS DOUBLE) END"
        ts = f"try_strptime({column}, '%Y-%m-%d')"
    return f"(SELECT trim(CAST({column} AS VARCHAR)) AS x, {value} AS v, {ts} AS ts FROM {_source(table)} WHERE {column} IS NOT NULL)"


def _kind(kind: str, storage: str) -> str:
    return {"number": "int" if storage.startswith("int") else "double"}.get(kind, kind)


PATTERN_COUNTS = f"WITH {D} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{f}' AS test, {FACTS[f]} AS n FROM {_cells('dirty_orders', c, k)}"
    for c, k, s in SCHEMAS["dirty_orders"]
    for f in KEPT_FACTS[_kind(k, s)]
)


def _types() -> str:
    facts = ", ".join(f"{sql} AS {name}" for name, sql in FACTS.items())
    id_words = ("id", "key", "pk", "fk", "code", "number", "no", "num")
    parts = []
    for table in ("dirty_orders", "pages", "events", "customer"):
        for c, kind, storage in SCHEMAS[table]:
            is_id = any(w in id_words for w in c.lower().split("_"))
            parts.append(
                f"""SELECT '{table}' AS table_name, '{c}' AS column_name, '{storage}' AS storage_type, '{kind}' AS kind,
  {str(is_id).lower()} AS named_id, count(*) AS nn, count(DISTINCT x) AS u, {facts},
  count(*) FILTER (contains(x, '%')) AS marked, count(*) FILTER (regexp_matches(rtrim(x, '%'), '{PERCENT}')) AS percent,
  bool_and(lower(x) IN ('true', 'false')) OR bool_and(lower(x) IN ('yes', 'no')) OR bool_and(lower(x) IN ('y', 'n'))
    OR bool_and(x IN ('1', '0')) OR bool_and(lower(x) IN ('t', 'f')) AS pairs
FROM {_cells(table, c, kind)}"""
            )
    return f"""WITH {D}, f AS ({" UNION ALL ".join(parts)}), typed AS (SELECT *, CASE
  WHEN email >= 0.8 * nn THEN 'Email' WHEN url >= 0.8 * nn THEN 'URL' WHEN phone >= 0.7 * nn THEN 'Phone' WHEN pairs THEN 'Boolean'
  WHEN kind <> 'number' AND ts > 0 AND midnight < ts THEN 'DateTime' WHEN kind <> 'number' AND ts > 0 THEN 'Date'
  WHEN num > 0 AND whole = num THEN 'Integer'
  WHEN marked > 0 AND percent >= 0.8 * nn OR num > 0 AND pin >= 0.9 * num THEN 'Percentage'
  WHEN named_id AND u > 0.95 * nn THEN 'ID' WHEN currency >= 0.7 * nn OR num > 0 AND cents >= 0.8 * num THEN 'Currency'
  WHEN u < nn AND (u <= 20 AND u <= 0.8 * nn OR u < 0.05 * nn) THEN 'Category'
  WHEN num > 0.8 * nn THEN 'Decimal' ELSE 'String' END AS detected_type FROM f),
judged AS (SELECT *, CASE detected_type WHEN 'Integer' THEN storage_type LIKE '%int%' WHEN 'Decimal' THEN storage_type LIKE '%float%'
    WHEN 'Date' THEN storage_type LIKE '%date%' WHEN 'DateTime' THEN storage_type LIKE '%datetime%'
    WHEN 'String' THEN storage_type = 'object' WHEN 'Category' THEN storage_type = 'object'
    WHEN 'ID' THEN storage_type = 'object' OR storage_type LIKE '%int%'
    WHEN 'Currency' THEN storage_type LIKE '%float%' WHEN 'Percentage' THEN storage_type LIKE '%float%' ELSE false END AS fits FROM typed)
SELECT table_name, column_name, storage_type, detected_type,
  CAST(CASE WHEN detected_type IN ('Decimal', 'String', 'Category', 'ID') THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence,
  CASE detected_type WHEN 'Email' THEN 'email pattern match' WHEN 'URL' THEN 'URL pattern match' WHEN 'Phone' THEN 'phone pattern match'
    WHEN 'Boolean' THEN 'boolean value set' WHEN 'DateTime' THEN 'datetime with time component' WHEN 'Date' THEN 'date-only values'
    WHEN 'Integer' THEN 'whole numbers only' WHEN 'Percentage' THEN '% symbol or 0-100 numeric'
    WHEN 'ID' THEN 'high-cardinality key-like column' WHEN 'Currency' THEN 'currency pattern or 2-decimal numeric'
    WHEN 'Category' THEN 'low cardinality' WHEN 'Decimal' THEN 'mostly numeric with decimals' ELSE 'fallback for any string data' END AS evidence,
  CASE WHEN fits THEN 'OK' ELSE 'MISMATCH' END AS status,
  CASE WHEN fits THEN 'No action needed' ELSE 'Convert from ' || storage_type || ' to ' || detected_type END AS recommended_action
FROM judged"""


TYPES_SQL = _types()
METADATA = f"""{TYPES_SQL.replace("WITH ", "WITH meta AS (WITH ", 1)}), {D}, p AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100e0 / count(*), 4) AS null_percentage, "
    f"count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100e0 / count({c}), 4) AS unique_percentage, "
    + (f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median"
       if k == "number" else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median")
    + " FROM d" for c, k, s in SCHEMAS["dirty_orders"])})
SELECT column_name, storage_type, null_count, null_percentage, unique_count, unique_percentage, min, max, mean, median,
  detected_type AS semantic_type, recommended_action, confidence, status, evidence
FROM p JOIN meta USING (column_name) WHERE table_name = 'dirty_orders'"""

# --- KPIs and the rest -----------------------------------------------------------------------

KPI_ROWS = [
    ("Total Sales", "Aggregation", "HIGH", "Sales", "SUM(Sales)"),
    ("Average Sales", "Aggregation", "MEDIUM", "Sales", "AVERAGE(Sales)"),
    ("Total Quantity", "Aggregation", "MEDIUM", "Quantity", "SUM(Quantity)"),
    ("Total Orders", "Transaction", "HIGH", "Order_ID", "DISTINCTCOUNT(Order_ID)"),
    ("Distinct Customers", "Transaction", "HIGH", "Customer_ID", "DISTINCTCOUNT(Customer_ID)"),
    ("Average Order Value", "Transaction", "HIGH", "Sales, Order_ID", "SUM(Sales) / DISTINCTCOUNT(Order_ID)"),
    ("Discount Rate", "Ratio", "MEDIUM", "Discount, Sales", "SUM(Discount) / SUM(Sales)"),
    ("Sales over Time", "Time", "HIGH", "Sales, Order_Date", "SUM(Sales) grouped by Order_Date"),
    ("Sales by Status", "Dimension", "MEDIUM", "Sales, Status", "SUM(Sales) grouped by Status"),
]
KPIS = f"""WITH {TALLY}, rate AS (SELECT "column" AS c, sum(n) * 1e0 / (SELECT count(*) FROM d) AS r FROM t GROUP BY 1),
k(kpi_name, category, priority, cols, logic) AS (VALUES {", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in KPI_ROWS)}),
worst AS (SELECT kpi_name, max(coalesce(r, 0)) AS w FROM (SELECT kpi_name, unnest(string_split(cols, ', ')) AS c FROM k) LEFT JOIN rate USING (c) GROUP BY 1)
SELECT kpi_name, category, priority, CASE WHEN w > 0.1 THEN 'REQUIRES_REVIEW' ELSE 'AVAILABLE' END AS status,
  cols AS required_columns, cols AS available_columns, logic AS calculation_logic,
  CASE WHEN w > 0.1 THEN kpi_name || ' can be calculated, but relies on columns with a defect rate of ' || printf('%.1f', w * 100)
    || '%. Review data quality before reporting.' ELSE kpi_name || ' is fully supported by the dataset.' END AS explanation,
  '' AS missing_requirements FROM k JOIN worst USING (kpi_name)
UNION ALL SELECT 'Profit Margin', 'Ratio', 'HIGH', 'UNAVAILABLE', '[Missing Required Column], Sales', 'Sales', 'N/A',
  'Profit Margin requires additional columns to be calculated.', 'Missing requirement for Ratio'"""

KPI_VALUES = f"""WITH {SALES}, a AS (SELECT CAST(sum(Sales) AS DOUBLE) AS sales, CAST(sum(Sales) AS DOUBLE) / count(Sales) AS mean, sum(Quantity) AS q,
  count(DISTINCT Order_ID) AS orders, count(DISTINCT Customer_ID) AS customers, CAST(sum(Profit) AS DOUBLE) AS profit,
  CAST(sum(Discount) AS DOUBLE) AS discount FROM s)
SELECT kpi_name, round(CAST(value AS DOUBLE), 4) AS value FROM (
  SELECT 'Total Sales' AS kpi_name, sales AS value FROM a UNION ALL SELECT 'Average Sales', mean FROM a
  UNION ALL SELECT 'Total Quantity', CAST(q AS DOUBLE) FROM a UNION ALL SELECT 'Total Orders', CAST(orders AS DOUBLE) FROM a
  UNION ALL SELECT 'Distinct Customers', CAST(customers AS DOUBLE) FROM a UNION ALL SELECT 'Average Order Value', sales / orders FROM a
  UNION ALL SELECT 'Profit Margin', profit / sales FROM a UNION ALL SELECT 'Discount Rate', discount / sales FROM a)"""

BY_REGION = f"""WITH {SALES}, g AS (SELECT Region, CAST(sum(Sales) AS DOUBLE) AS sales, count(DISTINCT Order_ID) AS orders FROM s GROUP BY 1)
SELECT 'sales' AS measure, Region, round(sales, 4) AS value FROM g
UNION ALL SELECT 'orders', Region, CAST(orders AS DOUBLE) FROM g
UNION ALL SELECT 'order_value', Region, round(sales / orders, 4) FROM g"""

RECONCILE = f"""WITH {D}, actual(metric, a) AS (
  SELECT 'Missing Values (Email)', count(*) FROM d WHERE Email IS NULL
  UNION ALL SELECT 'Missing Values (Sales)', count(*) FROM d WHERE Sales IS NULL
  UNION ALL SELECT 'Blank Values (Email)', count(*) FROM d WHERE trim(Email) = ''
  UNION ALL SELECT 'Duplicate Rows', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY {", ".join(COLUMNS)})
  UNION ALL SELECT 'Duplicate IDs (Order_ID)', count(*) FROM d WHERE {SHARED_ID}
  UNION ALL SELECT 'Range Violation (Discount)', count(*) FROM d WHERE Discount < 0 OR Discount > 1),
claim(metric, c) AS (
  SELECT 'Missing Values (Email)', count(*) - count(Email) FROM d UNION ALL SELECT 'Missing Values (Sales)', count(*) FROM d
  UNION ALL SELECT 'Range Violation (Discount)', count(*) FILTER (Discount > 1) FROM d)
SELECT metric, CAST(c AS VARCHAR) AS claimed, CAST(a AS VARCHAR) AS actual, CAST(abs(a - c) AS DOUBLE) AS difference,
  CASE WHEN c = a THEN 'MATCH' ELSE 'MISMATCH' END AS match_status FROM actual LEFT JOIN claim USING (metric)"""

RECONCILE_GROUPED = f"""WITH {SALES}, a AS (SELECT Region, CAST(sum(Sales) AS DOUBLE) AS v FROM s GROUP BY 1),
c AS (SELECT Region, CAST(sum(round(Sales, 0)) AS DOUBLE) AS v FROM s WHERE Region <> 'ASIA' GROUP BY 1)
SELECT Region, round(abs(a.v - c.v), 2) AS difference,
  CASE WHEN abs(a.v - c.v) <= greatest(1e-5 * greatest(abs(a.v), abs(c.v)), 1e-5) THEN 'MATCH' ELSE 'MISMATCH' END AS match_status
FROM a LEFT JOIN c USING (Region)"""

EVAL = f"""WITH {D}, {ALL}, det AS (SELECT DISTINCT row_index, "column" AS c, issue_type FROM i),
ex AS (SELECT CAST(o_orderkey AS VARCHAR) AS row_index, c, issue_type FROM orders, (VALUES ('Email', 'MISSING_VALUE', 53, 0),
  ('Sales', 'MISSING_VALUE', 101, 0), ('Order_Date', 'INVALID_DATE', 61, 1), ('Amount_Text', 'INVALID_NUMERIC', 79, 0),
  ('Quantity', 'range', 83, 0), ('Status', 'allowed_values', 73, 0)) f(c, issue_type, m, r) WHERE o_orderkey % m = r),
per AS (SELECT coalesce(ex.issue_type, det.issue_type) AS issue_type,
  count(*) FILTER (ex.issue_type IS NOT NULL AND det.issue_type IS NOT NULL) AS tp,
  count(*) FILTER (ex.issue_type IS NULL) AS fp, count(*) FILTER (det.issue_type IS NULL) AS fn
  FROM ex FULL JOIN det ON ex.row_index IS NOT DISTINCT FROM det.row_index AND ex.c IS NOT DISTINCT FROM det.c AND ex.issue_type = det.issue_type GROUP BY 1),
every AS (SELECT * FROM per UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM per),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 1e0 END AS p, CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 1e0 END AS r FROM every)
SELECT issue_type, tp, fp, fn, round(p, 8) AS precision, round(r, 8) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 8) AS f1 FROM pr"""

STORAGE = """CASE WHEN data_type = 'BIGINT' THEN 'int64' WHEN data_type = 'INTEGER' THEN 'int32' WHEN data_type = 'DOUBLE' THEN 'float64'
  WHEN data_type = 'VARCHAR' THEN 'object' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime64[ns]' WHEN data_type = 'FLOAT[]' THEN 'array<float>' ELSE data_type END"""
TITLE = "CASE dimension WHEN 'RULE_COMPLIANCE' THEN 'Rule_Compliance' ELSE upper(substr(dimension, 1, 1)) || lower(substr(dimension, 2)) END"


def _reason(title: str = TITLE) -> str:
    return f"""CASE WHEN issue_count = 0 THEN 'Perfect ' || {title} || ' score. No issues detected.' ELSE {title}
  || printf(' score is %.1f because %d issues caused a defect rate of %.4f.', score, issue_count, defect_rate) END"""


EVIDENCE = "row_issue_count || ' row-level and ' || (issue_count - row_issue_count) || ' dataset-level issues.'"
REASONS = f"""WITH {DIMENSIONS}, plain AS (SELECT {DIMENSION} AS dimension, CAST(sum(n) AS BIGINT) AS issue_count, CAST(sum(CASE WHEN row_level THEN n ELSE 0 END) AS BIGINT) AS row_issue_count,
  sum(n * CAST({PENALTY} AS DOUBLE)) AS row_penalty FROM t WHERE source = 'quality_check' GROUP BY 1),
p AS (SELECT w.dimension, coalesce(issue_count, 0) AS issue_count, coalesce(row_issue_count, 0) AS row_issue_count, coalesce(row_penalty, 0e0) / n_rows AS defect_rate,
  greatest(0e0, 100 - 100 * coalesce(row_penalty, 0e0) / n_rows) AS score FROM w LEFT JOIN plain USING (dimension), total)
SELECT 'rules' AS "case", dimension, true AS is_applicable, round(score, 8) AS score, {_reason()} AS reason, {EVIDENCE} AS evidence FROM dims
UNION ALL SELECT 'no rules', dimension, dimension <> 'RULE_COMPLIANCE', CASE WHEN dimension = 'RULE_COMPLIANCE' THEN 100 ELSE round(score, 8) END,
  CASE WHEN dimension = 'RULE_COMPLIANCE' THEN {TITLE} || ' is not applicable (no business rules configured).' ELSE {_reason()} END, {EVIDENCE} FROM p
UNION ALL SELECT 'empty', dimension, false, 100, 'Empty dataset', 'No data' FROM w"""

REQUIRED = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, c AS "column", 'HIGH' AS severity, 'Required column ''' || c || ''' is missing from the dataset.' AS message,
  sha256('business_rule|required_column|needs_' || c || '|DATASET|' || c) AS issue_id, (SELECT count(*) FROM {t}) AS n_rows
FROM (VALUES ('doc_id'), ('text'), ('o_orderkey'), ('value')) v(c) WHERE c NOT IN (SELECT column_name FROM duckdb_columns() WHERE table_name = '{t}')"""
    for t in TABLES
)

KEYED = """WITH l AS (SELECT CASE WHEN doc_id % 11 = 3 THEN NULL ELSE doc_id END AS k, quality FROM
  (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT * FROM labels WHERE doc_id % 30 = 0)),
g AS (SELECT k, quality, count(*) - 1 AS n FROM l GROUP BY k, quality HAVING count(*) > 1)
SELECT coalesce(CAST(k AS VARCHAR), 'none') AS fact, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1
UNION ALL SELECT x, (SELECT CAST(sum(n) AS BIGINT) FROM g) FROM (VALUES ('counted'), ('compared')) v(x)"""

TEXTS_BY_KEY = """WITH t AS (SELECT CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id END AS k, role || turn AS said FROM conversations),
r AS (SELECT said FROM t GROUP BY said HAVING count(*) > 1)
SELECT CAST(k AS VARCHAR) AS row_index, said AS actual_value, count(*) AS n FROM t JOIN r USING (said) GROUP BY 1, 2"""

CSV = """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey AS key, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer,
  CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderkey % 2 = 0 AS even,
  CASE o_orderkey % 5 WHEN 0 THEN 'line' || chr(10) || 'break ' || o_orderkey WHEN 1 THEN 'say "' || o_orderkey || '", now' WHEN 2 THEN 'caf' || chr(233) || ' ' || o_orderkey ELSE o_orderpriority END AS note,
  'bigint, bigint, double, boolean, string' AS types FROM orders"""
LANDED = """WITH c AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, * FROM orders),
i AS (SELECT r, 'customer' AS c, 'MISSING_VALUE' AS y, 'missing_value_check' AS n FROM c WHERE o_orderkey % 7 = 0 UNION ALL SELECT r, 'price', 'MISSING_VALUE', 'missing_value_check' FROM c WHERE o_orderkey % 9 = 0
  UNION ALL SELECT r, 'price', 'OUT_OF_RANGE', 'range_check' FROM c WHERE o_orderkey % 9 <> 0 AND o_totalprice < 50000)
SELECT CAST(r AS VARCHAR) AS row_index, c AS "column", y AS issue_type, sha256('quality_check|' || y || '|' || n || '|' || r || '|' || c) AS issue_id FROM i"""
FILE_KEYS = """WITH r AS (SELECT row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS i, f
  FROM (SELECT 1 AS f, o_orderkey AS k FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 50 = 0))
SELECT f || '#' || i AS row_index, sha256('quality_check|DUPLICATE_ROW|duplicate_row_check|' || f || '#' || i || '|DATASET') AS issue_id FROM r"""
ODD = """WITH i AS (SELECT o_orderkey AS k, 'customer''s é' AS c, 'Non-null value expected' AS e, 'MISSING_VALUE' AS y, 'missing_value_check' AS n FROM orders WHERE o_orderkey % 53 = 0
  UNION ALL SELECT o_orderkey, 'a.b`c', '>= 1000', 'OUT_OF_RANGE', 'range_check' FROM orders WHERE o_totalprice < 1000)
SELECT CAST(k AS VARCHAR) AS row_index, c AS "column", e AS expected_condition, sha256('quality_check|' || y || '|' || n || '|' || k || '|' || c) AS issue_id FROM i"""

# A column's type by the test that its values must pass; the tests before it have to fail.
CALLS = f"""calls AS (SELECT '555-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS callback,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS answered, o_orderkey * 1.2345678e0 + 1000.00123e0 AS weight, CAST(NULL AS VARCHAR) AS remark,
  'x' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE '' END AS tag FROM orders),
k AS (SELECT 'callback' AS column_name, 'object' AS storage_type, CASE WHEN avg(CAST(regexp_matches(callback, '{PHONE}') AS INT)) >= 0.7 THEN 'Phone' END AS detected_type, 'phone pattern match' AS evidence, 0.95e0 AS confidence,
    'MISMATCH' AS status, 'Convert from object to Phone' AS recommended_action FROM calls
  UNION ALL SELECT 'answered', 'object', CASE WHEN bool_and(lower(answered) IN ('yes', 'no')) THEN 'Boolean' END, 'boolean value set', 0.95, 'MISMATCH', 'Convert from object to Boolean' FROM calls
  UNION ALL SELECT 'weight', 'float64', CASE WHEN bool_or(weight % 1 <> 0) AND avg(CAST(weight BETWEEN 0 AND 100 AS INT)) < 0.9 AND avg(CAST((weight * 100) % 1 = 0 AS INT)) < 0.8
    AND count(DISTINCT weight) >= 0.05 * count(*) THEN 'Decimal' END, 'mostly numeric with decimals', 0.7, 'OK', 'No action needed' FROM calls
  UNION ALL SELECT 'remark', 'object', CASE WHEN count(remark) = 0 THEN 'Unknown' END, 'All values are null', 0.0, 'AMBIGUOUS', 'Manual review required - low confidence detection' FROM calls
  UNION ALL SELECT 'tag', 'object', CASE WHEN count(DISTINCT tag) = count(*) AND count(*) FILTER (regexp_matches(tag, '{NUM}')) = 0 THEN 'String' END, 'fallback for any string data', 0.7, 'OK', 'No action needed' FROM calls)"""

SKETCHED = """SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS null_count, CAST(min(o_custkey) AS DOUBLE) AS min_value, CAST(max(o_custkey) AS DOUBLE) AS max_value,
  round(avg(CAST(o_custkey AS DOUBLE)), 4) AS mean_value, CAST(0 AS INT) AS max_length, true AS distinct_close, true AS median_close FROM orders
UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 4), 0, true, true FROM orders
UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL, NULL, CAST(max(length(o_orderpriority)) AS INT), true, NULL FROM orders"""

MEASURES = f"""WITH k AS ({KPIS}), {D}, v AS (SELECT sum(Sales) AS sales, avg(Sales) AS mean, sum(Quantity) AS q, count(DISTINCT Order_ID) AS orders, count(DISTINCT Customer_ID) AS customers, sum(Discount) AS discount FROM d)
SELECT kpi_name AS measure_name, kpi_name, calculation_logic, CASE status WHEN 'REQUIRES_REVIEW' THEN 'REVIEW_REQUIRED' ELSE status END AS status, required_columns,
  CASE WHEN status = 'UNAVAILABLE' THEN '' ELSE available_columns END AS referenced_columns,
  CASE WHEN status = 'UNAVAILABLE' THEN 'Measure skipped because required columns are missing.' ELSE 'Computed measure for ' || kpi_name || '.' END AS explanation,
  CASE status WHEN 'UNAVAILABLE' THEN 'Missing requirements: ' || missing_requirements
    WHEN 'REQUIRES_REVIEW' THEN 'WARNING: This KPI relies on columns with a high defect rate. Review data quality before reporting.' ELSE '' END AS warnings,
  round(CASE kpi_name WHEN 'Total Sales' THEN sales WHEN 'Average Sales' THEN mean WHEN 'Total Quantity' THEN q WHEN 'Total Orders' THEN orders WHEN 'Distinct Customers' THEN customers
    WHEN 'Average Order Value' THEN sales / orders WHEN 'Discount Rate' THEN discount / sales END, 4) AS value FROM k, v"""

DEFAULTS = f"""WITH {D}, v AS (SELECT sum(Sales) AS sales, avg(Sales) AS mean, sum(Quantity) AS q, count(DISTINCT Order_ID) AS orders, count(*) - count(Email) AS email,
  count(*) - count(Sales) AS nosales FROM d), a(metric, status, difference) AS (
  SELECT 'Missing Values (Email)', 'MATCH', 0e0 FROM v WHERE email > 0 UNION ALL SELECT 'Missing Values (Sales)', 'MISMATCH', NULL FROM v WHERE nosales > 0
  UNION ALL SELECT 'Duplicate Rows', 'MISMATCH', NULL FROM v WHERE (SELECT count(*) FROM (SELECT DISTINCT {", ".join(COLUMNS)} FROM d)) < (SELECT count(*) FROM d)
  UNION ALL SELECT 'Total Sales', 'MATCH', 0e0 UNION ALL SELECT 'Average Sales', 'MATCH', 0e0
  UNION ALL SELECT 'Total Quantity', CASE WHEN 1 <= greatest(1e-5 * greatest(abs(q), abs(q + 1)), 1e-5) THEN 'MATCH' ELSE 'MISMATCH' END, 1e0 FROM v
  UNION ALL SELECT 'Total Orders', 'MATCH', 0e0 UNION ALL SELECT x, 'MISMATCH', NULL FROM (VALUES ('Distinct Customers'), ('Average Order Value'), ('Discount Rate')) u(x)
  UNION ALL SELECT x, 'NOT_AVAILABLE', NULL FROM (VALUES ('Sales over Time'), ('Sales by Status')) u(x)
  UNION ALL SELECT 'Not A Metric', 'MISMATCH', NULL)
SELECT metric, difference, status AS match_status FROM a"""

SUMMARY = f"""WITH {TALLY}, g AS (SELECT 'severity' AS g, severity AS k, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 2 UNION ALL SELECT 'type', issue_type, CAST(sum(n) AS BIGINT) FROM t GROUP BY 2
  UNION ALL SELECT 'source', source, CAST(sum(n) AS BIGINT) FROM t GROUP BY 2 UNION ALL SELECT 'column', "column", CAST(sum(n) AS BIGINT) FROM t WHERE "column" IS NOT NULL GROUP BY 2)
SELECT CAST((SELECT CAST(sum(n) AS BIGINT) FROM t) AS VARCHAR) AS total_issues, {", ".join(f"string_agg(k || ': ' || n, ' | ' ORDER BY k) FILTER (g = '{x}') AS issues_by_{x}" for x in ("severity", "type", "source", "column"))} FROM g"""

COPIES_OF_LINES = """(SELECT rn, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ORDER BY rn) AS copy
  FROM (SELECT *, row_number() OVER () - 1 AS rn FROM lineitem))"""

ORACLES = {
    "dataset_profile": " UNION ALL ".join(
        f"""SELECT '{t}' AS dataset_name, (SELECT count(*) FROM {t}) AS row_count, count(*) AS column_count,
  string_agg(column_name, ', ' ORDER BY column_index) AS column_names,
  string_agg(column_name || ': ' || {STORAGE}, ', ' ORDER BY column_index) AS storage_types FROM duckdb_columns() WHERE table_name = '{t}'"""
        for t in TABLES
    ),
    "profile_counts": _per_column(COUNTS, SCHEMAS),
    "profile_numeric": _per_column(NUMBERS, ("dirty_orders", "orders", "customer", "part", "lineitem"), ("number",)),
    "profile_text": _per_column(LENGTHS, ("dirty_orders", "documents", "pages", "part"), ("text",)),
    "profile_dates": _per_column("min({c}) AS min_date, max({c}) AS max_date", ("orders", "events", "lineitem"), ("time",)),
    "profile_samples": f"WITH {D} {SAMPLES}",
    "detect_types": TYPES_SQL,
    "detect_pattern_counts": PATTERN_COUNTS,
    "q_missing": f"WITH {D} {_issues('MISSING_VALUE')}",
    "q_blank": f"WITH {D} {_issues('BLANK_VALUE')}",
    "q_duplicate_rows": f"WITH {D} {_issues('DUPLICATE_ROW')}",
    "q_duplicate_ids": f"WITH {D} {_issues('DUPLICATE_ID')}",
    "q_emails": f"WITH {D} {_issues('INVALID_EMAIL')}",
    "q_dates": f"WITH {D} {_issues('INVALID_DATE')}",
    "q_numeric": f"WITH {D} {_issues('INVALID_NUMERIC')}",
    "q_category": f"WITH {D} {_issues('INVALID_CATEGORY')}",
    "q_range": f"WITH {D} {_issues('OUT_OF_RANGE')}",
    "q_consistency": f"WITH {D} {_issues('CONSISTENCY_VIOLATION')}",
    "q_duplicate_lineitems": _q(
        "DUPLICATE_ROW", "duplicate_row_check", None, "Row should be unique across all columns",
        "This row is an exact duplicate of an earlier row in the dataset.", "copy > 1", frm=COPIES_OF_LINES,
        row="CAST(rn AS VARCHAR)"),
    "q_duplicate_texts": _q(
        "DUPLICATE_ID", "duplicate_id_check", "text", "Values in 'text' should be unique",
        "The value in 'text' is shared by more than one row.",
        "text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)", "md5(text)", "CAST(doc_id AS VARCHAR)", "documents"),
    "q_account_ranges": _q(
        "OUT_OF_RANGE", "range_check", "c_acctbal", ">= 0", "Value in 'c_acctbal' is outside the configured allowed range.",
        "c_acctbal < 0", "c_acctbal", "CAST(c_custkey AS VARCHAR)", "customer") + " UNION ALL " + _q(
        "INVALID_CATEGORY", "invalid_category_check", "c_mktsegment", "Value should be one of: ['BUILDING']",
        "Value in 'c_mktsegment' is not one of the allowed categories.", "c_mktsegment <> 'BUILDING'", "c_mktsegment",
        "CAST(c_custkey AS VARCHAR)", "customer"),
    "r_required": REQUIRED,
    "q_keyed_copies": KEYED,
    "q_texts_by_key": TEXTS_BY_KEY,
    "q_odd_names": ODD,
    "csv_rows": CSV,
    "csv_head": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey AS key FROM orders ORDER BY o_orderkey LIMIT 100""",
    "csv_landed": LANDED,
    "file_keys": FILE_KEYS,
    "detect_more": f"WITH {CALLS} SELECT * FROM k",
    "type_counts": f"""WITH {CALLS}, types AS ({TYPES_SQL}) SELECT detected_type, count(*) AS n
  FROM (SELECT detected_type FROM types UNION ALL SELECT detected_type FROM k) GROUP BY 1""",
    "sketched_profiles": SKETCHED,
    "measure_rows": MEASURES,
    "reconcile_defaults": DEFAULTS,
    "score_reasons": REASONS,
    "quality_summary": SUMMARY,
    "r_range": f"WITH {D} {_issues('range')}",
    "r_allowed": f"WITH {D} {_issues('allowed_values')}",
    "r_unique": f"WITH {D} {_issues('uniqueness')}",
    "r_comparison": f"WITH {D} {_issues('comparison')}",
    "r_referential": f"WITH {D} {_issues('referential_integrity')}",
    "r_late_orders": f"""SELECT {LINE} AS row_index, 'l_shipdate / o_orderdate' AS "column",
  'l_shipdate=' || CAST(l_shipdate AS VARCHAR) || ', o_orderdate=' || CAST(o_orderdate AS VARCHAR) AS actual_value,
  'l_shipdate >= o_orderdate' AS expected_condition,
  sha256('business_rule|comparison|ship_after_order|' || {LINE} || '|l_shipdate / o_orderdate') AS issue_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
    "r_known_parts": f"""SELECT {LINE} AS row_index, CAST(l_partkey + 1000000000 AS VARCHAR) AS actual_value,
  sha256('business_rule|referential_integrity|known_part|' || {LINE} || '|part') AS issue_id
FROM lineitem WHERE l_orderkey % 97 = 0""",
    "q_planted_copies": """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/1' AS row_index, 'DUPLICATE_ROW' AS issue_type,
  sha256('quality_check|DUPLICATE_ROW|duplicate_row_check|' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/1|DATASET') AS issue_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 100 = 7)""",
    "q_repeated_keys": """WITH t AS (SELECT CASE WHEN doc_id % 90 = 1 THEN NULL ELSE doc_id END AS k FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0)),
g AS (SELECT k, count(*) AS n FROM t WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)
SELECT 'DUPLICATE_ID doc_id' AS fact, CAST(sum(n) AS BIGINT) AS n FROM g UNION ALL SELECT 'MISSING_VALUE doc_id', count(*) FROM t WHERE k IS NULL
UNION ALL SELECT 'null_keys', count(*) FROM t WHERE k IS NULL UNION ALL SELECT 'repeated_keys', count(*) FROM g
UNION ALL SELECT 'rows_with_repeated_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM g""",
    "q_nested_values": """WITH v AS (SELECT embedding,
  CASE vec_id % 4 WHEN 0 THEN [label, NULL] WHEN 1 THEN [label] WHEN 2 THEN [NULL, label] ELSE [NULL, NULL, label] END AS gaps,
  CASE vec_id % 3 WHEN 0 THEN {'a': NULL::INT, 'b': label} WHEN 1 THEN {'a': label, 'b': NULL::INT} END AS pair FROM embeddings)
SELECT 'embeddings copies' AS fact, (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT embedding FROM v)) AS n
UNION ALL SELECT 'gaps copies', (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT gaps FROM v))
UNION ALL SELECT 'pairs copies', (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT pair FROM v))
UNION ALL SELECT 'both copies', (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT gaps, pair FROM v))
UNION ALL SELECT 'embeddings unique 0', (SELECT count(*) FROM (SELECT DISTINCT embedding FROM v WHERE embedding IS NOT NULL))
UNION ALL SELECT 'gaps unique 0', (SELECT count(*) FROM (SELECT DISTINCT gaps FROM v WHERE gaps IS NOT NULL))
UNION ALL SELECT 'pairs unique 0', (SELECT count(*) FROM (SELECT DISTINCT pair FROM v WHERE pair IS NOT NULL))
UNION ALL SELECT 'both unique 0', (SELECT count(*) FROM (SELECT DISTINCT gaps FROM v WHERE gaps IS NOT NULL))
UNION ALL SELECT 'both unique 1', (SELECT count(*) FROM (SELECT DISTINCT pair FROM v WHERE pair IS NOT NULL))""",
    "q_conversations": """WITH t AS (SELECT conv_id || '#' || turn AS k, CASE WHEN conv_id % 41 = 0 THEN 'bot' ELSE role END AS role,
  CASE WHEN (conv_id + turn) % 53 = 0 THEN NULL WHEN (conv_id + turn) % 59 = 0 THEN '  ' ELSE text END AS text FROM conversations),
i AS (SELECT k, 'text' AS c, 'MISSING_VALUE' AS y, 'missing_value_check' AS n FROM t WHERE text IS NULL
UNION ALL SELECT k, 'text', 'BLANK_VALUE', 'blank_value_check' FROM t WHERE trim(text) = ''
UNION ALL SELECT k, 'role', 'INVALID_CATEGORY', 'invalid_category_check' FROM t WHERE role NOT IN ('user', 'assistant', 'system'))
SELECT k AS row_index, c AS "column", y AS issue_type, sha256('quality_check|' || y || '|' || n || '|' || k || '|' || c) AS issue_id FROM i""",
    "r_exact_values": """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
i AS (SELECT k, 'range' AS y, 'top' AS n, 'big' AS c FROM t WHERE k > 500 UNION ALL SELECT k, 'comparison', 'order', 'big / other' FROM t WHERE k % 7 = 0
UNION ALL SELECT k, 'allowed_values', 'days', 'day' FROM t WHERE d NOT IN (DATE '1995-01-01', DATE '1995-01-02', DATE '1996-07-04')
UNION ALL SELECT k, 'referential_integrity', 'known', 'money' FROM t WHERE k % 5 = 0)
SELECT CAST(k AS VARCHAR) AS row_index, n AS rule_or_check_name, c AS "column", sha256('business_rule|' || y || '|' || n || '|' || k || '|' || c) AS issue_id FROM i""",
    "issues_all": f"WITH {D} {_issues(*DEFAULT_KINDS)}",
    "issue_tally": f"WITH {TALLY} SELECT * FROM t",
    "score_dimensions": f"""WITH {DIMENSIONS} SELECT dimension, weight, true AS is_applicable, issue_count, row_issue_count,
  issue_count - row_issue_count AS dataset_issue_count, round(score, 8) AS score, round(row_penalty, 8) AS row_penalty,
  round(dataset_penalty, 8) AS dataset_penalty, round(defect_rate, 8) AS defect_rate,
  row_issue_count || ' row-level and ' || (issue_count - row_issue_count) || ' dataset-level issues.' AS evidence FROM dims""",
    "score_overall": f"""WITH {OVERALL} SELECT round(score, 8) AS overall_score, {GRADE} AS grade, {STATUS} AS status,
  {LETTER} AS letter_grade, n_rows AS total_rows, CAST({len(COLUMNS)} AS BIGINT) AS total_columns, CAST(issues AS BIGINT) AS total_issues,
  printf('Overall score is %.1f. Evaluated %d issues across %d rows.', score, CAST(issues AS BIGINT), n_rows) AS explanation FROM o, total""",
    "score_recommendations": f"""WITH {TALLY} SELECT CAST(row_number() OVER (ORDER BY n DESC, issue_type) AS INT) AS rank,
  '(' || n || ' issues) ' || r AS recommendation FROM (SELECT issue_type, CAST(sum(n) AS BIGINT) AS n, min(recommendation) AS r FROM t GROUP BY 1)
  ORDER BY n DESC, issue_type LIMIT 3""",
    "readiness_row": f"""WITH {OVERALL} SELECT round(o.score, 8) AS overall_score, {GRADE.replace("score", "o.score")} AS grade,
  {STATUS.replace("score", "o.score")} AS status, {", ".join(
      f"round(max(dims.score) FILTER (dimension = '{x}'), 8) AS dim_{x}_score, true AS dim_{x}_applicable, "
      f"round(max(row_penalty + dataset_penalty) FILTER (dimension = '{x}'), 8) AS dim_{x}_penalties, "
      f"max({_reason().replace(', score, ', ', dims.score, ')}) FILTER (dimension = '{x}') AS dim_{x}_explanation"
      for x in ("COMPLETENESS", "VALIDITY", "CONSISTENCY", "UNIQUENESS", "RULE_COMPLIANCE"))} FROM dims, o GROUP BY o.score""",
    "column_metadata": METADATA,
    "kpi_defect_rates": f"""WITH {TALLY} SELECT "column", CAST(sum(n) AS BIGINT) AS issue_count,
  round(sum(n) * 1e0 / (SELECT count(*) FROM d), 10) AS defect_rate FROM t WHERE "column" IS NOT NULL GROUP BY 1""",
    "kpi_recommendations": KPIS,
    "kpi_values": KPI_VALUES,
    "kpi_by_month": f"""WITH {SALES} SELECT date_trunc('month', Order_Date) AS Order_Date, round(CAST(sum(Sales) AS DOUBLE), 2) AS value FROM s GROUP BY 1""",
    "kpi_by_dimension": BY_REGION,
    "reconcile_metrics": RECONCILE,
    "reconcile_grouped": RECONCILE_GROUPED,
    "summary_counts": f"""WITH {TALLY} SELECT 'total' AS grouping, 'all' AS key, CAST(sum(n) AS BIGINT) AS n FROM t
  UNION ALL SELECT 'severity', severity, CAST(sum(n) AS BIGINT) FROM t GROUP BY 2
  UNION ALL SELECT 'issue_type', issue_type, CAST(sum(n) AS BIGINT) FROM t GROUP BY 2
  UNION ALL SELECT 'source', source, CAST(sum(n) AS BIGINT) FROM t GROUP BY 2
  UNION ALL SELECT 'column', "column", CAST(sum(n) AS BIGINT) FROM t WHERE "column" IS NOT NULL GROUP BY 2""",
    "severity_counts": f"""WITH {TALLY} SELECT v.severity, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
  FROM (VALUES ('INFO'), ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(severity) LEFT JOIN t USING (severity) GROUP BY 1""",
    "issue_search": f"""WITH {D}, {ALL} SELECT issue_id, row_index, "column", severity, actual_value FROM i
  WHERE contains(lower(actual_value), 'example.com') AND severity IN ('MEDIUM', 'HIGH') AND "column" = 'Email'""",
    "headline": f"""WITH {OVERALL} SELECT n_rows AS total_rows, CAST({len(COLUMNS)} AS BIGINT) AS total_columns, round(score, 8) AS overall_score,
  {LETTER} AS letter_grade, CAST(issues AS BIGINT) AS total_issues, CAST({len(KPI_ROWS)} AS BIGINT) AS kpis_available, CAST({len(KPI_ROWS) + 1} AS BIGINT) AS measures FROM o, total""",
    "eval_precision_recall": EVAL,
}
