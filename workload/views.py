"""Test views over the given tables, written once for Spark and once for DuckDB.

The given tables hold no NULLs and few faults, so faults are injected by arithmetic on a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIRTY = """
SELECT o_orderkey + {shift} AS row_key,
  'ORD' || lpad(CAST(CASE WHEN o_orderkey % 211 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS {text}), 8, '0') AS Order_ID,
  CASE WHEN o_orderkey % 131 = 0 THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS Customer_ID,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL
       WHEN o_orderkey % 97 = 0 THEN '  '
       WHEN o_orderkey % 37 = 0 THEN 'user' || CAST(o_custkey AS {text}) || '.example.com'
       ELSE 'user' || CAST(o_custkey AS {text}) || '@example.com' END AS Email,
  CASE WHEN o_orderkey % 61 = 1 THEN 'invalid_date' ELSE {day}(o_orderdate, {fmt}) END AS Order_Date,
  CASE WHEN o_orderkey % 71 = 0 THEN {day}({minus3}, {fmt}) ELSE {day}({plus}, {fmt}) END AS Delivery_Date,
  CASE WHEN o_orderkey % 83 = 0 THEN -(o_orderkey % 50 + 1) ELSE o_orderkey % 50 + 1 END AS Quantity,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_totalprice END AS Sales,
  CASE WHEN o_orderkey % 89 = 0 THEN 2.5e0 ELSE CAST(o_orderkey % 11 AS DOUBLE) / 10e0 END AS Discount,
  CASE WHEN o_orderkey % 79 = 0 THEN 'abc' ELSE '$' || CAST(o_orderkey % 900 + 100 AS {text}) || '.50' END AS Amount_Text,
  CASE WHEN o_orderkey % 73 = 0 THEN 'X' ELSE o_orderstatus END AS Status
FROM orders {where}
"""


def _dirty_orders(**dialect: str) -> str:
    first = _DIRTY.format(shift=0, where="", **dialect)
    copies = _DIRTY.format(shift=10000000, where="WHERE o_orderkey % 499 = 0", **dialect)
    return f"{first} UNION ALL {copies}"


DIRTY_ORDERS_SPARK = _dirty_orders(
    text="STRING", day="date_format", fmt="'yyyy-MM-dd'", minus3="date_add(CAST(o_orderdate AS DATE), -3)",
    plus="date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 10 AS INT))",
)
DIRTY_ORDERS_DUCKDB = _dirty_orders(
    text="VARCHAR", day="strftime", fmt="'%Y-%m-%d'", minus3="CAST(o_orderdate AS DATE) - 3",
    plus="CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INT)",
)

SALES_LINES = """
SELECT l_orderkey AS Order_ID, o_custkey AS Customer_ID, o_orderdate AS Order_Date, r_name AS Region,
  CAST(l_quantity AS BIGINT) AS Quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS Sales,
  CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS Discount,
  CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.30e0 - l_discount AS DECIMAL(4,2)) AS Profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Business rules used on dirty_orders.
RULES = [
    {"name": "discount_range", "type": "range", "column": "Discount", "min": 0, "max": 1, "severity": "MEDIUM"},
    {"name": "quantity_min", "type": "range", "column": "Quantity", "min": 1, "severity": "MEDIUM"},
    {"name": "status_values", "type": "allowed_values", "column": "Status", "values": ["O", "F", "P"],
     "severity": "MEDIUM"},
    {"name": "order_unique", "type": "uniqueness", "column": "Order_ID", "severity": "CRITICAL"},
    {"name": "delivery_after_order", "type": "comparison", "column_a": "Delivery_Date", "operator": ">=",
     "column_b": "Order_Date", "severity": "HIGH"},
    {"name": "known_customer", "type": "referential_integrity", "child_column": "Customer_ID",
     "parent_dataset": "customer", "parent_column": "c_custkey", "severity": "HIGH"},
    {"name": "warehouse_required", "type": "required_column", "column": "Warehouse", "severity": "LOW"},
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_ORDERS_SPARK.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "orders", "customer", "nation", "region")
    text = SALES_LINES
    for n in names:
        text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})
