"""CSV source: header, missing-value tokens, encoding fallback, type inference and load errors.

One scan of the raw lines decides how the file must be read (encoding, whether quoted fields span
lines), so that files without such fields stay splittable; one aggregate infers all column types.
"""

from __future__ import annotations

import csv as python_csv
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.scalars import literal, strip, to_number
from plumbline.sources.tables import ROW, ColumnInfo, Table, as_table

# Texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?\d+\s*$"
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")
CORRUPT = "__corrupt"


class IngestionError(Exception):
    """The file cannot be loaded."""


def closed_line(separator: str) -> str:
    """Pattern of a line whose every quoted field is closed on the line."""
    s = re.escape(separator)
    return rf'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{s}"]*+|[^"{s}][^{s}]*+)?(?:{s}|$))*+$'


def detect_format(path: str) -> str:
    dot = path.rfind(".")
    suffix = path[dot:].lower() if dot > path.rfind("/") else ""
    if suffix != ".csv":
        raise IngestionError(f"Unsupported file format: {suffix}. Supported: ['.csv']")
    return "csv"


def _check_files(spark: SparkSession, path: str) -> None:
    """Not found, empty and wrong suffix, in that order, through the file system the path belongs to."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(location):
        raise IngestionError(f"File not found: {path}")
    status = files.getFileStatus(location)
    if status.isFile():
        if status.getLen() == 0:
            raise IngestionError(f"File is empty: {path}")
        detect_format(path)
    elif files.getContentSummary(location).getLength() == 0:
        raise IngestionError(f"File is empty: {path}")


def _header(spark: SparkSession, path: str, encoding: str, separator: str) -> list[str]:
    """Column names; an empty name and a repeated name get a distinguishing suffix."""
    text = F.decode(F.col("value").cast("binary"), encoding)
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(text.alias("line")).first()
    if line is None:
        raise IngestionError("File contains no data")
    names: list[str] = []
    for i, raw in enumerate(next(python_csv.reader([line[0].lstrip("\ufeff").rstrip("\r")], delimiter=separator))):
        name = base = raw or f"Unnamed: {i}"
        k = 0
        while name in names:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
    return names


def _line_facts(spark: SparkSession, path: str, separator: str):
    """(any line not UTF-8, any field open at a line end, any file with an odd number of quotes, all headers equal)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    line = F.rtrim("value", F.lit("\r"))
    per_file = lines.groupBy("file").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bad_utf8"),
        F.bool_or(F.contains("value", F.lit('"')) & ~line.rlike(closed_line(separator))).alias("open"),
        F.sum(quotes).alias("quotes"),
        F.min_by(F.ltrim(line, F.lit("\ufeff")), F.when(F.length(F.trim("value")) > 0, F.struct("block", "id"))).alias("header"),
    )
    return per_file.agg(
        F.bool_or("bad_utf8").alias("bad_utf8"),
        F.bool_or("open").alias("open"),
        F.bool_or(F.col("open") & (F.col("quotes") % 2 == 1)).alias("unclosed"),
        (F.min("header").eqNullSafe(F.max("header"))).alias("one_header"),
    ).first()


def read_csv_text(
    spark: SparkSession,
    path: str,
    *,
    multi_line: bool | None = None,
    encoding: str | None = None,
    separator: str = ",",
    na_tokens: Sequence[str] = NA_TOKENS,
) -> tuple[DataFrame, list[str]]:
    """All cells as text, missing tokens as NULL, columns ``s0..`` plus file position columns.

    ``multi_line`` and ``encoding`` skip the scan of raw lines, and with it the comparison of headers, when both are given.
    """
    if multi_line is None or encoding is None:
        facts = _line_facts(spark, path, separator)
        if not facts.one_header:
            raise IngestionError("Failed to parse file: the files of the folder have different headers")
        if facts.unclosed and multi_line is None:
            raise IngestionError("Failed to parse file: a quoted field is never closed")
        encoding = encoding or ("ISO-8859-1" if facts.bad_utf8 else "UTF-8")
        multi_line = bool(facts.open) if multi_line is None else multi_line
    names = _header(spark, path, encoding, separator)
    cells = [f"s{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*cells, CORRUPT])
    frame = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("escape", '"')
        .option("nullValue", "")
        .option("sep", separator)
        .option("enforceSchema", True)
        .csv(path)
    )
    meta = [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    ]
    values = [F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c) for c in cells]
    return frame.select(*values, CORRUPT, *meta), names


def _is_too_long(width: int, separator: str) -> Column:
    """The raw record has more fields than the header. Short records are padded and fine."""
    unquoted = F.regexp_replace(F.col(CORRUPT), r'"[^"]*+(?:""[^"]*+)*+"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) >= width


def infer_types(frame: DataFrame, cells: Sequence[str], separator: str = ",") -> tuple[dict[str, str], int, bool]:
    """bigint, double, boolean or string for each text column: the narrowest type all its values have.
    The same pass counts the rows and looks for records with more fields than the header."""
    long = F.coalesce(F.bool_or(_is_too_long(len(cells), separator)), F.lit(False)).alias("long")
    words = ", ".join(literal(b) for b in BOOLEANS)
    tests = []
    for c in cells:
        whole = f"{c} RLIKE r'{INTEGER}' AND try_cast({strip(c)} AS BIGINT) IS NOT NULL"
        tests += [
            f"count_if({c} IS NOT NULL AND NOT ({whole})) AS {c}_int",
            f"count_if({c} IS NOT NULL AND ({to_number(c, T.StringType())}) IS NULL) AS {c}_num",
            f"count_if({c} NOT IN ({words})) AS {c}_bool",
            f"count({c}) AS {c}_n",
        ]
    row = frame.agg(F.count(F.lit(1)).alias("n"), long, *[F.expr(t) for t in tests]).first()
    out = {}
    for c in cells:
        if row[f"{c}_n"] == 0:
            out[c] = "double"
        elif row[f"{c}_int"] == 0:
            out[c] = "bigint"
        elif row[f"{c}_num"] == 0:
            out[c] = "double"
        else:
            out[c] = "boolean" if row[f"{c}_bool"] == 0 else "string"
    return out, row["n"], row["long"]


def load_csv(
    spark: SparkSession,
    path: str,
    sample_size: int | None = None,
    row_key: str | Sequence[str] | None = None,
    *,
    multi_line: bool | None = None,
    encoding: str | None = None,
    separator: str = ",",
    na_tokens: Sequence[str] = NA_TOKENS,
) -> Table:
    """Load a CSV file, or a directory of them that share one header, as a typed table.

    Rows are numbered from 0 in file order unless ``row_key`` names key columns. ``sample_size`` keeps
    the first rows. ``separator`` and ``na_tokens`` (texts read as missing) are as given. Raises IngestionError when there is nothing to load or a record has too many fields.
    """
    _check_files(spark, path)
    try:
        frame, names = read_csv_text(spark, path, multi_line=multi_line, encoding=encoding, separator=separator, na_tokens=na_tokens)
    except AnalysisException as e:
        raise IngestionError(f"Failed to parse file: {e}") from e
    cells = [f"s{i}" for i in range(len(names))]
    if sample_size is not None:
        frame = frame.orderBy("__file", "__block", "__id").limit(sample_size)
        order = Window.orderBy("__file", "__block", "__id")  # of sample_size rows
        frame = frame.withColumn("__number", (F.row_number().over(order) - 1).cast("bigint"))
    elif row_key is None:
        frame = _with_row_numbers(frame)
    kinds, rows, too_long = infer_types(frame, cells, separator)
    if too_long:
        raise IngestionError(f"Failed to parse file: a record has more than {len(names)} fields")
    if rows == 0:
        raise IngestionError("Dataset has no rows after loading")
    typed = []
    for c, name in zip(cells, names):
        v = F.col(c)
        value = v if kinds[c] == "string" else F.expr(f"try_cast({strip(c)} AS {kinds[c]})")
        typed.append(value.alias(name))
    if row_key is not None:
        return as_table(frame.select(*typed), row_key)
    return as_table(frame.select(*typed, F.col("__number").alias(ROW)), ROW, key_is_data=False)


def _with_row_numbers(frame: DataFrame) -> DataFrame:
    """Adds ``__number``, 0-based over the files in path order, without moving a row.

    Within a task the reader's ids go up by one, and a file block belongs to one task. So a row's number is its id plus a shift
    that its block's rows have in common: the rows of all blocks before, less the block's first id. Shifts come from a table
    with a row per block, 24 bytes each for 128 MB of text, which is sent to all tasks; the ids of both sides come from the
    same scan of the same files, planned together.
    """
    block = ["__file", "__block"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # a row per file block
    sizes = frame.groupBy(*block).agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__first"))
    ahead = F.coalesce(F.sum("__size").over(before), F.lit(0))
    shifts = sizes.select(F.xxhash64("__file").alias("__f"), F.col("__block").alias("__b"), (ahead - F.col("__first")).alias("__shift"))
    same = (F.xxhash64("__file") == F.col("__f")) & (F.col("__block") == F.col("__b"))
    return frame.join(F.broadcast(shifts), same).withColumn("__number", F.col("__id") + F.col("__shift")).drop("__f", "__b", "__shift")


# --- landing zone ----------------------------------------------------------------------------

MANIFEST_SCHEMA = "source string, separator string, encoding string, n_rows bigint, names array<string>, types array<string>"


def land_csv(spark: SparkSession, path: str, target: str, **options) -> Table:
    """Read a CSV file or folder once and keep it as typed Parquet at ``target``, with its row numbers.

    ``options`` are those of ``load_csv``. A manifest beside the data holds the column names, their types and where they came
    from. Later passes read the columns they need and parse no text.
    """
    table = load_csv(spark, path, **options)
    table.df.write.mode("overwrite").parquet(f"{target}/rows")
    types = [table.df.schema[c.ref].dataType.simpleString() for c in table.columns]
    n = spark.read.parquet(f"{target}/rows").count()
    facts = [(path, options.get("separator", ","), options.get("encoding"), n, table.names, types)]
    spark.createDataFrame(facts, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{target}/manifest")
    return landed(spark, target)


def landed(spark: SparkSession, target: str) -> Table:
    """The table that ``land_csv`` has kept at ``target``."""
    try:
        manifest = spark.read.schema(MANIFEST_SCHEMA).json(f"{target}/manifest").first()
        rows = spark.read.parquet(f"{target}/rows")
    except AnalysisException as e:
        raise IngestionError(f"Nothing landed at {target}") from e
    columns = [ColumnInfo(name, f"c{i}", rows.schema[f"c{i}"].dataType) for i, name in enumerate(manifest.names)]
    return Table(rows, tuple(columns))
