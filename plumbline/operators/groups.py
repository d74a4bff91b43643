"""Equal-value groups: distinct counts, repeated rows, repeated values, values without a parent.

Groups are found by hashes of cells, 16 bytes a row; what they name is then fetched through a Bloom filter and checked on the
cells themselves, so that only rows that may belong to a group are shuffled with their cells. Rows are told apart by
what they hold and how often, never by their key, which may be NULL or repeated.

A single value or one set of row copies may hold a large part of the table, so a group is never
brought to one task: sizes are counted with map-side partial aggregation, and when flagged rows have
to be listed, large groups are split over several join keys. Any group above ``limit`` rows is split
into parts of about that size. At most ``n_rows / limit`` groups can be that large, so the table of
large groups that is broadcast has at most LARGE_GROUPS rows of 12 bytes whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.scalars import storage_class
from plumbline.operators.bloom import bloom, thinned
from plumbline.sources.tables import ROW, ColumnInfo, Table

PART_ROWS = 1_000_000
LARGE_GROUPS = 100_000


def hashable(info: ColumnInfo) -> Column:
    """A cell in a form the hash functions take. They refuse maps, skip NULLs inside nested cells and do not tell where an
    inner array ends, so nested cells are hashed as JSON text, in which all of this shows."""

    def written(cell: Column) -> Column:
        return F.when(info.cell.isNotNull(), F.to_json(F.struct(cell.alias("v")), {"ignoreNullFields": "false"}))

    def has_map(t: T.DataType) -> bool:
        if isinstance(t, T.MapType):
            return True
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        return isinstance(t, T.StructType) and any(has_map(f.dataType) for f in t.fields)

    if isinstance(info.dtype, T.MapType):
        cell = F.map_entries(info.cell)
        return written(cell if has_map(info.dtype.valueType) else F.array_sort(cell))
    return written(info.cell) if isinstance(info.dtype, (T.ArrayType, T.StructType)) else info.cell


def row_fingerprint(columns: list[ColumnInfo]) -> list[Column]:
    """Two independently seeded 64-bit hashes of a row. The null flags are part of the input because
    the hash skips NULLs, which would make (NULL, 'x') and ('x', NULL) equal."""
    parts: list[Column] = []
    for c in columns:
        parts += [hashable(c), c.cell.isNull()]
    return [F.xxhash64(*parts).alias("k0"), F.xxhash64(F.lit(1), *parts).alias("k1")]


def _is_fixed_width(dtype: T.DataType) -> bool:
    return isinstance(
        dtype,
        (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType),
    ) and not isinstance(dtype, T.DecimalType)


def distinct_counts(table: Table, columns: list[ColumnInfo] | None = None) -> DataFrame:
    """(ordinal, unique_count) of every column, NULLs left out, in one scan and one shuffle.

    Values travel as 64-bit hashes (one-to-one for fixed-width types) or as two seeded hashes for the
    rest, so a column of long documents shuffles 16 bytes per distinct value.
    """
    columns = list(table.columns) if columns is None else columns
    cells = []
    for c in columns:
        value = hashable(c)
        second = F.lit(0).cast("bigint") if _is_fixed_width(c.dtype) else F.xxhash64(F.lit(1), value)
        cells.append(
            F.struct(
                F.lit(table.columns.index(c)).alias("ordinal"),
                F.when(c.cell.isNotNull(), F.xxhash64(value)).alias("k0"),
                second.alias("k1"),
            )
        )
    return (
        table.df.select(F.inline(F.array(*cells)))
        .where(F.col("k0").isNotNull())
        .distinct()
        .groupBy("ordinal")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


# --- group sizes -----------------------------------------------------------------------------


def value_hashes(info: ColumnInfo) -> list[Column]:
    """(k0, k1): two hashes of a value, 16 bytes however long it is."""
    value = hashable(info)
    return [F.xxhash64(value).alias("k0"), F.xxhash64(F.lit(1), value).alias("k1")]


def sizes(rows: DataFrame) -> DataFrame:
    """Every distinct row of ``rows`` with its number ``n``; row keys don't count."""
    keys = [k for k in rows.columns if k != ROW]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def part_limit(n_rows: int, part_rows: int = PART_ROWS) -> int:
    return max(part_rows, -(-n_rows // LARGE_GROUPS))


def settled(frame: DataFrame) -> DataFrame:
    """The frame written once to the folder the cluster names in spark.checkpoint.dir, for a result that
    is used several times and costly to derive. Without such a folder it is derived at each use."""
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return frame
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint()


def join_groups(rows: DataFrame, groups: DataFrame, n_rows: int, part_rows: int = PART_ROWS, keys: list[str] | None = None) -> DataFrame:
    """Rows joined to the groups they belong to (``groups`` carries its size ``n``) by ``keys``, all columns but the row key
    unless given; no task receives more than about ``part_limit`` rows of one group."""
    keys = [k for k in rows.columns if k != ROW] if keys is None else keys
    limit = part_limit(n_rows, part_rows)
    if n_rows <= limit:
        return rows.join(groups, keys)
    groups = settled(groups)
    # Hashing the keys bounds what is broadcast. Both sides use the same hash, so keys that share one
    # are merely split alike. Rows are dealt out by their place, as their keys may all be equal.
    key_hash = F.xxhash64(*keys).alias("key_hash")
    large = (
        groups.where(F.col("n") > limit)
        .groupBy(key_hash)
        .agg(F.ceil(F.max("n") / limit).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    split_rows = (
        rows.withColumn("key_hash", key_hash)
        .join(F.broadcast(large), "key_hash", "left")
        .withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
        .drop("key_hash", "parts")
    )
    split_groups = (
        groups.withColumn("key_hash", key_hash)
        .join(F.broadcast(large), "key_hash", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("key_hash", "parts")
    )
    return split_rows.join(split_groups, [*keys, "part"]).drop("part")


def times(rows: DataFrame, n: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Every row as often as its column ``n`` says. A row for very many becomes a row for each ``part_rows`` of them, and these
    are dealt out before they are written out."""
    whole = F.floor((F.col(n) - 1) / part_rows).cast("int")
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(0), whole)))
    here = F.when(F.col("part") < whole, part_rows).otherwise(F.col(n) - whole.cast("bigint") * part_rows)
    dealt = cut.withColumn(n, here).repartition(*[c for c in rows.columns if c != n], "part")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop("copy", "part", n)


# --- flagged rows and their counts -----------------------------------------------------------


def _cells(columns: list[ColumnInfo]) -> list[Column]:
    """The cells in a form that can be grouped."""
    return [hashable(c).alias(f"v{i}") for i, c in enumerate(columns)]


def copied_rows(table: Table, fingerprint=row_fingerprint) -> DataFrame:
    """(k0, k1, v0.., __row) of rows that may have copies: rows whose fingerprint occurs more than once, and a few more that
    the filter lets through."""
    columns = list(table.columns)
    hashes = fingerprint(columns)
    repeated = sizes(table.df.select(*hashes)).where("n > 1")
    return thinned(table.df.select(*hashes, *_cells(columns), ROW), bloom(settled(repeated)))


def later_copies(table: Table, part_rows: int = PART_ROWS, fingerprint=row_fingerprint) -> DataFrame:
    """(__row) of every row equal in all columns to an earlier one; the earliest copy is left out.

    Rows are compared by their cells; fingerprints only choose what is compared. Copies that share a row key, or have none, are
    counted: such a key is listed as often as it occurs, once less if it is the group's earliest (a NULL key comes last).
    """
    cells = [f"v{i}" for i in range(len(table.columns))]
    rows = copied_rows(table, fingerprint)
    if table.key_in_data:  # copies have the key in common
        groups = rows.groupBy("k0", "k1", *cells).agg(F.count(F.lit(1)).alias("n"), F.first(ROW).alias(ROW))
        return times(groups.where("n > 1").select(ROW, (F.col("n") - 1).alias("n")), "n", part_rows)
    by_key = settled(rows.groupBy("k0", "k1", *cells, ROW).agg(F.count(F.lit(1)).alias("times")))
    groups = by_key.groupBy("k0", "k1", *cells).agg(F.sum("times").alias("n"), F.min(ROW).alias("first_row"))
    # Cells that meet under one fingerprint get numbers; two hashes of 64 bits make that a number 1 for all but never.
    number = F.row_number().over(Window.partitionBy("k0", "k1").orderBy(*cells))
    groups = settled(groups.where("n > 1").withColumn("variant", number))
    told = groups.where("variant > 1").select("k0", "k1").distinct()
    plain = groups.join(told, ["k0", "k1"], "left_anti").select("k0", "k1", "n", "first_row")
    copies = join_groups(by_key.select("k0", "k1", "times", ROW), plain, table.n_rows, part_rows, ["k0", "k1"])
    mixed = groups.join(told, ["k0", "k1"], "left_semi").select("k0", "k1", *[F.col(c).alias(f"w{c}") for c in cells], "n", "first_row")
    same = (F.col("r.k0") == F.col("g.k0")) & (F.col("r.k1") == F.col("g.k1"))
    for c in cells:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"g.w{c}"))
    apart = by_key.alias("r").join(mixed.alias("g"), same).select("r.times", f"r.{ROW}", "g.first_row")
    found = copies.select("times", ROW, "first_row").unionAll(apart)
    later = F.col("times") - F.when(F.col(ROW).eqNullSafe(F.col("first_row")), 1).otherwise(0)
    return times(found.select(ROW, later.alias("n")).where("n > 0"), "n", part_rows)


def later_copies_count(table: Table) -> DataFrame:
    """One row ``n``: how many rows later_copies lists, by fingerprints alone."""
    groups = sizes(table.df.select(*row_fingerprint(list(table.columns)))).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def compared_copies_count(table: Table, fingerprint=row_fingerprint) -> DataFrame:
    """The same number by comparison of cells; only rows that may have copies are shuffled with them."""
    cells = [f"v{i}" for i in range(len(table.columns))]
    groups = sizes(copied_rows(table, fingerprint).select(*cells))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def repeated_values(table: Table, info: ColumnInfo, part_rows: int = PART_ROWS) -> DataFrame:
    """(__row, k0) of every row whose value occurs more than once. Values that are not of fixed width are counted by hashes;
    only rows that may be flagged are shuffled with their values, and are counted again on these."""
    present = table.df.where(info.cell.isNotNull())
    if _is_fixed_width(info.dtype):
        rows = present.select(info.cell.alias("k0"), ROW)
        return join_groups(rows, sizes(rows).where("n > 1"), table.n_rows, part_rows).select(ROW, "k0")
    repeated = sizes(present.select(*value_hashes(info))).where("n > 1")
    rows = thinned(present.select(*value_hashes(info), hashable(info).alias("v"), ROW), bloom(settled(repeated)))
    groups = sizes(rows.select("k0", "k1", "v")).where("n > 1")
    return join_groups(rows, groups, table.n_rows, part_rows, ["k0", "k1", "v"]).select(ROW, F.col("v").alias("k0"))


def repeated_values_count(table: Table, info: ColumnInfo) -> DataFrame:
    keys = [info.cell.alias("k0")] if _is_fixed_width(info.dtype) else value_hashes(info)
    groups = sizes(table.df.where(info.cell.isNotNull()).select(*keys)).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def exact_type(*dtypes: T.DataType) -> str | None:
    """A type that holds all values of whole and decimal types exactly; None if a type is floating or none is wide enough."""
    if all(isinstance(d, T.IntegralType) for d in dtypes):
        return "bigint"
    if not all(isinstance(d, (T.IntegralType, T.DecimalType)) for d in dtypes):
        return None
    scale = max(d.scale for d in dtypes if isinstance(d, T.DecimalType))
    whole = max(d.precision - d.scale if isinstance(d, T.DecimalType) else 19 for d in dtypes)
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None


def shared_key_type(child_dtype: T.DataType, parent_dtype: T.DataType) -> str | None:
    """Type both sides of a reference compare in; None when their classes differ and nothing can match."""
    a, b = storage_class(child_dtype), storage_class(parent_dtype)
    if a != b or a == "other":
        return None
    if a == "number":
        return exact_type(child_dtype, parent_dtype) or "double"
    return {"text": "string", "time": "timestamp", "flag": "boolean"}[a]


def _orphan_groups(rows: DataFrame, parent: DataFrame) -> DataFrame:
    """Child values (with their sizes) that the parent lacks. Both sides are reduced to distinct values
    before they meet, so a hot value on either side is one row of the join."""
    return sizes(rows).join(parent.distinct(), "k0", "left_anti")


def _reference_sides(table: Table, info: ColumnInfo, parent: DataFrame, key_type: str):
    rows = table.df.select(info.cell.cast(key_type).alias("k0"), ROW)
    parents = parent.select(F.col(parent.columns[0]).cast(key_type).alias("k0"))
    if key_type == "double":
        parents = parents.select(F.nanvl("k0", F.lit(None).cast("double")).alias("k0"))
    present = F.col("k0").isNotNull()
    return rows.where(present), parents.where(present)


def orphans(
    table: Table, info: ColumnInfo, parent: DataFrame, key_type: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """(__row, k0) of every row whose value is not in the single-column ``parent``."""
    rows, parents = _reference_sides(table, info, parent, key_type)
    return join_groups(rows, _orphan_groups(rows, parents), table.n_rows, part_rows).select(ROW, "k0")


def orphans_count(table: Table, info: ColumnInfo, parent: DataFrame, key_type: str) -> DataFrame:
    rows, parents = _reference_sides(table, info, parent, key_type)
    groups = _orphan_groups(rows.select("k0"), parents)
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
