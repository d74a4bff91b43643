"""Result tables written as CSV or Parquet.

Schema-sized tables become one sorted file each. The issue table can be as large as the data: it is
written by all tasks, for CSV in sorted files with fixed borders, and folded into one file only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import quote
from plumbline.operators.checks import ISSUE_COLUMNS
from plumbline.operators.explore import summary_wide

METADATA_COLUMNS = [
    "column_name", "storage_type", "null_count", "null_percentage", "unique_count", "unique_percentage",
    "min", "max", "mean", "median", "semantic_type", "recommended_action", "confidence", "status", "evidence",
]


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """A cell as report text: NULL and NaN are empty, lists are comma-separated, maps are
    ``key: value | key: value``."""
    if isinstance(dtype, T.ArrayType):
        parts = F.transform(c, lambda x: cell_text(x, dtype.elementType))
        return F.coalesce(F.array_join(parts, ", "), F.lit(""))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.concat(e["key"].cast("string"), F.lit(": "), cell_text(e["value"], dtype.valueType)),
        )
        return F.coalesce(F.array_join(entries, " | "), F.lit(""))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return F.coalesce(c.cast("string"), F.lit(""))


def as_text(frame: DataFrame) -> DataFrame:
    return frame.select(*[cell_text(F.col(quote(f.name)), f.dataType).alias(f.name) for f in frame.schema.fields])


def column_metadata(profile: DataFrame, types: DataFrame) -> DataFrame:
    detected = types.select(
        "column_name", F.col("detected_type").alias("semantic_type"), "recommended_action", "confidence",
        "status", "evidence",
    )
    renamed = profile.select(
        F.col("name").alias("column_name"), "storage_type", "null_count", "null_percentage", "unique_count",
        "unique_percentage", F.col("min_value").alias("min"), F.col("max_value").alias("max"),
        F.col("mean_value").alias("mean"), F.col("median_value").alias("median"),
    )
    return renamed.join(detected, "column_name", "left").select(*METADATA_COLUMNS)


def readiness_row(overall: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Score, grade and status with four columns per dimension."""
    picked = overall.select("overall_score", "grade", "status").withColumn("one", F.lit(1))
    found = {
        "score": F.col("score"),
        "applicable": F.col("is_applicable"),
        "penalties": F.col("row_penalty") + F.col("dataset_penalty"),
        "explanation": F.col("reason"),
    }
    names = ["COMPLETENESS", "VALIDITY", "CONSISTENCY", "UNIQUENESS", "RULE_COMPLIANCE"]
    wide = dimensions.agg(
        *[
            F.max(F.when(F.col("dimension") == d, e)).alias(f"dim_{d}_{label}")
            for d in names
            for label, e in found.items()
        ]
    ).withColumn("one", F.lit(1))
    return picked.join(F.broadcast(wide), "one").drop("one")


def sorted_issues(issues: DataFrame) -> DataFrame:
    order = ["issue_id", "row_index", "column"]
    first = ["issue_id", "source", "issue_type", "rule_or_check_name", "row_index", "column"]
    rest = [c for c in ISSUE_COLUMNS if c not in first]
    return issues.select(*first, *rest).orderBy(*[F.asc_nulls_first(c) for c in order])


def in_files(issues: DataFrame, rows_per_file: int = 1_000_000) -> DataFrame:
    """Issue rows dealt into sorted files whose borders depend on the rows alone.

    Rows are counted by the first four hex digits of their id, which are spread evenly, and neighbouring counts are gathered
    until a file is full. So a rerun, on however many tasks, gives the same files; a border by sampled quantiles would not.
    Rows with equal ids stand in one file.
    """
    prefix = F.conv(F.substring("issue_id", 1, 4), 16, 10).cast("int")
    counts = sorted((r.prefix, r.n) for r in issues.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect())
    files, at, held = [], 0, 0
    for p, n in counts:  # 65,536 at most
        if held and held + n > rows_per_file:
            at, held = at + 1, 0
        files.append((p, at))
        held += n
    numbers = issues.sparkSession.createDataFrame(files, "prefix int, file int")
    numbered = issues.withColumn("prefix", prefix).join(F.broadcast(numbers), "prefix").repartitionById(at + 1, F.col("file"))
    first = ["issue_id", "source", "issue_type", "rule_or_check_name", "row_index", "column"]
    columns = first + [c for c in ISSUE_COLUMNS if c not in first]
    order = ["issue_id", "row_index", "column", *[c for c in columns if c not in ("issue_id", "row_index", "column")]]
    return numbered.sortWithinPartitions(*[F.asc_nulls_first(c) for c in order]).select(*columns)


def write_csv(frame: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header, also when there are no rows."""
    text = as_text(frame)
    writer = (text.coalesce(1) if one_file else text).write.mode("overwrite").option("header", True)
    writer.option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def export(
    report, directory: str, name: str = "dataset", file_format: str = "csv", one_file: bool = False, grouped: bool = False
) -> list[str]:
    """Write the seven tables of a report, and with ``grouped`` the values of its grouped measures; returns their paths. With ``one_file`` the issues, whose number grows with the
    table, go into a single CSV file like the other tables."""
    tables = {
        "dataset_profile": report.dataset.select(F.lit(name).alias("dataset_name"), "row_count", "column_count"),
        "column_metadata": column_metadata(report.profile, report.types).orderBy("column_name"),
        "quality_issues": report.issues,
        "quality_summary": summary_wide(report.tally),
        "readiness_score": readiness_row(report.overall, report.dimensions),
        "kpi_recommendations": report.kpis.orderBy("kpi_name"),
        "measures": report.measures.orderBy("measure_name"),
    }
    if grouped:
        tables["grouped_measures"] = report.grouped
    paths = []
    for table, frame in tables.items():
        path = f"{directory.rstrip('/')}/{table}"
        paths.append(path)
        large = table in ("quality_issues", "grouped_measures")
        if file_format == "csv":
            if table == "quality_issues":
                frame = sorted_issues(frame) if one_file else in_files(frame)
            write_csv(frame, path, one_file=one_file or not large)
        elif table == "quality_issues":
            frame.write.mode("overwrite").partitionBy("issue_type").parquet(path)
        else:
            frame.coalesce(1).write.mode("overwrite").parquet(path)
    return paths
