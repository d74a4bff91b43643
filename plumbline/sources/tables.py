"""The table every operator works on: a DataFrame with one row key and known column classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.scalars import quote, storage_class, storage_type

ROW = "__row"


class DuplicateColumnError(ValueError):
    """Two columns share a name."""


@dataclass(frozen=True)
class ColumnInfo:
    """A column of the caller's table. ``ref`` is its positional name inside the engine, which keeps
    dots, quotes and letter case of the real name out of every expression."""

    name: str
    ref: str
    dtype: T.DataType

    @property
    def storage(self) -> str:
        return storage_type(self.dtype)

    @property
    def kind(self) -> str:
        return storage_class(self.dtype)

    @property
    def cell(self) -> Column:
        return F.col(self.ref)


@dataclass(frozen=True)
class Table:
    """``df`` holds the row key as ``__row`` and the data columns as ``c0, c1, ...``.

    The row key is a label: rows may share one or have none. ``key_in_data`` says that it follows from the data columns.
    ``files`` are those that a row key counts in, if it is made of a file's number and a row of it.
    """

    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    key_in_data: bool = False
    files: tuple[str, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    def find(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def row_label(self) -> Column:
        """The row key as text."""
        dtype = self.df.schema[ROW].dataType
        if isinstance(dtype, T.StructType):  # a # inside a part is escaped and a NULL part is marked
            safe = [F.regexp_replace(F.col(ROW)[f.name].cast("string"), r"([\\#])", r"\\$1") for f in dtype.fields]
            return F.concat_ws("#", *[F.coalesce(part, F.lit("\\N")) for part in safe])
        if self.files:
            return F.concat_ws("#", F.shiftright(ROW, FILE_BITS), F.col(ROW).bitwiseAND(F.lit((1 << FILE_BITS) - 1)))
        return F.col(ROW).cast("string")

    def kept(self) -> Table:
        """This table spread evenly over the cores and held in memory (or on disk), so that the passes of an analysis do
        not read and derive it again. For the caller to choose; else each pass reads just the columns it needs."""
        if self.df.is_cached:
            return self
        spread = self.df.repartition(self.spark.sparkContext.defaultParallelism)
        return Table(spread.persist(StorageLevel.MEMORY_AND_DISK), self.columns, self.key_in_data, self.files)

    def release(self) -> None:
        self.df.unpersist()

    def original(self) -> DataFrame:
        """The data columns under their own names."""
        return self.df.select(*[c.cell.alias(c.name) for c in self.columns])


#: Bits of a key for the row in its file; the file's number stands above them.
FILE_BITS = 40


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def _file_rows(df: DataFrame, folders: bool = False) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with ``__row``, the position inside the data file; with several files, these are numbered in path order and the
    number stands above FILE_BITS bits of the row, so that the key stays one BIGINT that sorts by file and row. Also returns the files.
    With ``folders`` the files of a folder, in path order, are parts of one, and the folders stand for files.

    The numbers go to all tasks, 24 bytes for a file.
    """
    index = F.col("_metadata.row_index")
    try:
        df.select(index)
    except AnalysisException as e:
        raise ValueError(
            "This table has no file row numbers; pass row_key=<column or columns> that identify a row."
        ) from e
    files = tuple(sorted(df.inputFiles()))
    if len(files) == 1:
        return df.select("*", index.alias(ROW)), ()
    own = [f"s{i}" for i in range(len(df.columns))]
    whole = tuple(sorted({f.rpartition("/")[0] for f in files})) if folders else files
    number_of = {f: i for i, f in enumerate(whole)}
    numbers = [(number_of[f.rpartition("/")[0] if folders else f], f) for f in files]
    numbers = df.sparkSession.createDataFrame(numbers, "number bigint, path string")
    numbers = numbers.select("number", "path", F.xxhash64(_plain(F.col("path"))).alias("hash"))
    if folders:  # a part begins after the rows of the parts before it; a file without rows has no place
        sizes = df.select(F.xxhash64(_plain(F.col("_metadata.file_path"))).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
        before = Window.partitionBy("number").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        numbers = numbers.join(sizes, "hash").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    else:
        numbers = numbers.withColumn("start", F.lit(0).cast("bigint"))
    numbers = numbers.select("number", "start", "hash")
    placed = df.select("*", F.xxhash64(_plain(F.col("_metadata.file_path"))).alias(ROW), index.alias("__index")).toDF(*own, ROW, "__index")
    known = placed.join(F.broadcast(numbers), F.col(ROW) == F.col("hash"), "left")
    number = F.coalesce("number", F.raise_error(F.lit("a file of the table is not among its input files")).cast("bigint"))
    row = F.shiftleft(number, FILE_BITS) + F.col("start") + F.col("__index")
    if len(whole) == 1:
        row, whole = F.when(number.isNotNull(), F.col("start") + F.col("__index")), ()
    return known.select(*own, row.alias(ROW)).toDF(*df.columns, ROW), whole


def as_table(df: DataFrame, row_key: str | Sequence[str] | None = None, key_is_data: bool = True, folders: bool = False) -> Table:
    """Prepare a DataFrame for analysis.

    ``row_key`` names the column(s) that identify a row; they are analysed like any other unless ``key_is_data`` is
    false, as for a number that was added to tell rows apart. Without it the position in the source file is used, as ``file#row`` by
    the file's number if there are several; with ``folders`` the folders of files count as files, as Spark writes a table in parts.
    Uniqueness of a key is not assumed silently: ``key_faults`` counts NULL and repeated keys. NaN becomes NULL here, once, so that both mean missing.
    """
    names = list(df.columns)
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise DuplicateColumnError(f"Duplicate column names detected: {repeated}")
    keys = [row_key] if isinstance(row_key, str) else list(row_key or [])
    unknown = [k for k in keys if k not in names]
    if unknown:
        raise ValueError(f"row_key columns not in the table: {unknown}")
    files: tuple[str, ...] = ()
    if not keys:
        keyed, files = _file_rows(df, folders)
    elif len(keys) == 1:
        keyed = df.select("*", F.col(quote(keys[0])).alias(ROW))
    else:
        keyed = df.select("*", F.struct(*[F.col(quote(k)) for k in keys]).alias(ROW))

    positional = [f"s{i}" for i in range(len(names))]
    flat = keyed.toDF(*positional, ROW)
    infos, cells = [], []
    for ref, field in zip(positional, df.schema.fields):
        if field.name in keys and not key_is_data:
            continue
        info = ColumnInfo(field.name, f"c{len(infos)}", field.dataType)
        cell = F.col(ref)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            cell = F.nanvl(cell, F.lit(None).cast(field.dataType))
        elif isinstance(field.dataType, T.NullType):
            cell = cell.cast("string")
        infos.append(info)
        cells.append(cell.alias(info.ref))
    return Table(flat.select(ROW, *cells), tuple(infos), bool(keys) and key_is_data, files)


def read_parquet(spark: SparkSession, path: str | Sequence[str], row_key=None) -> Table:
    paths = [path] if isinstance(path, str) else list(path)
    return as_table(spark.read.parquet(*paths), row_key)


def dataset_profile(table: Table, name: str = "dataset") -> DataFrame:
    """One row: row and column counts, column names and storage types. The count stays in the plan."""
    names = F.lit(", ".join(table.names))
    types = F.lit(", ".join(f"{c.name}: {c.storage}" for c in table.columns))
    return table.df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset_name"),
        "row_count",
        F.lit(len(table.columns)).cast("bigint").alias("column_count"),
        names.alias("column_names"),
        types.alias("storage_types"),
    )


def key_faults(table: Table) -> DataFrame:
    """One row: rows whose key is NULL (or has a NULL part), keys that several rows share, and the rows that share one."""
    dtype = table.df.schema[ROW].dataType
    parts = [F.col(ROW)[f.name] for f in dtype.fields] if isinstance(dtype, T.StructType) else [F.col(ROW)]
    bare = reduce(or_, [p.isNull() for p in parts])
    keys = table.df.select(table.row_label.alias("k"), bare.alias("bare"))
    groups = keys.groupBy(F.xxhash64("k").alias("h0"), F.xxhash64(F.lit(1), "k").alias("h1"), "bare").agg(F.count("*").alias("n"))
    shared = ~F.col("bare") & (F.col("n") > 1)
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("bare"), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(shared).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("rows_with_repeated_key"),
    )
