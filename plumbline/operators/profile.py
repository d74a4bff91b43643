"""Column profile and the evidence for semantic types.

Four passes, each over the columns it needs only:
  head      first rows in row order -> sample values and, per text column, the date layout
  scan      one shuffle-free aggregate per chunk of columns -> counts, ranges, lengths, pattern rates
  distinct  one shuffle of value hashes -> exact distinct counts
  median    exact middle value per numeric column
Only one row per column reaches the driver.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import scalars as S
from plumbline.functions.jobs import together
from plumbline.operators.groups import distinct_counts, hashable
from plumbline.sources.tables import ROW, ColumnInfo, Table

# Aggregates per scan. Generated methods beyond 8000 bytes of bytecode are not compiled by the JVM, which
# a scan of many columns at once would reach; each chunk reads its own columns only.
SCAN_FIELDS = 45
# Rows up to which a column's median may be held by one task.
MEDIAN_ROWS = 1_000_000
HEAD_ROWS = 64
SAMPLES = 5
PASSES = ("samples", "distinct", "median")

PROFILE_SCHEMA = (
    "name string, ordinal int, storage_type string, total_rows bigint, non_null_count bigint, "
    "null_count bigint, null_percentage double, unique_count bigint, unique_percentage double, "
    "sample_values array<string>, min_value double, max_value double, mean_value double, "
    "median_value double, std_value double, min_length int, max_length int, avg_length double, "
    "min_date timestamp_ntz, max_date timestamp_ntz"
)


@dataclass
class ColumnProfile:
    name: str
    ordinal: int
    storage_type: str
    total_rows: int
    non_null_count: int
    null_count: int
    null_percentage: float
    unique_count: int | None
    unique_percentage: float | None
    sample_values: list[str] = field(default_factory=list)
    min_value: float | None = None
    max_value: float | None = None
    mean_value: float | None = None
    median_value: float | None = None
    std_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    avg_length: float | None = None
    min_date: Any = None
    max_date: Any = None


@dataclass
class Profile:
    """Profile rows plus what type detection needs: pattern counts and date layouts per column."""

    spark: SparkSession
    columns: list[ColumnProfile]
    evidence: dict[str, dict[str, Any]]
    date_patterns: dict[str, str | None]

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    @property
    def df(self) -> DataFrame:
        return self.spark.createDataFrame([vars(c) for c in self.columns], PROFILE_SCHEMA)


# --- head ------------------------------------------------------------------------------------


def _as_text(c: ColumnInfo) -> Column:
    return F.to_json(c.cell) if isinstance(c.dtype, (T.ArrayType, T.MapType, T.StructType)) else c.cell.cast("string")


def first_values(table: Table, n: int = SAMPLES, head_rows: int = HEAD_ROWS) -> dict[str, list[str]]:
    """First ``n`` non-null values of each column in row order, as text.

    The key of the last head row is found from the key column alone; it then filters the scan that
    reads the other columns. Columns too sparse to fill up within the head share one more scan.
    """
    head_keys = table.df.select(ROW).orderBy(ROW).limit(head_rows)
    last = head_keys.agg(F.max(ROW)).first()[0]
    if not table.columns:
        return {}
    if last is None:  # no rows, or none of the first has a key
        return _first_of(table, list(table.columns), n)
    texts = [_as_text(c).alias(c.ref) for c in table.columns]
    head = (
        table.df.where(F.col(ROW) <= _literal(last, table.df.schema[ROW].dataType))
        .select(ROW, *texts)
        .orderBy(ROW)
        .limit(head_rows)
        .collect()
    )
    found = {c.ref: [r[c.ref] for r in head if r[c.ref] is not None][:n] for c in table.columns}
    sparse = [c for c in table.columns if len(found[c.ref]) < n]
    if sparse and len(head) < table.n_rows:
        found |= _first_of(table, sparse, n)
    return found


def _first_of(table: Table, columns: list[ColumnInfo], n: int) -> dict[str, list[str]]:
    """First ``n`` non-null values of some columns from one scan of these: cells are ranked by row within their column, and
    Spark keeps ``n`` of each column and task before any are shuffled. Rows without a key come last."""
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), _as_text(c).alias("v")) for i, c in enumerate(columns)]))
    order = Window.partitionBy("i").orderBy(F.col(ROW).asc_nulls_last(), "v")
    ranked = table.df.select(ROW, cells).where("v IS NOT NULL").withColumn("rank", F.row_number().over(order))
    out: dict[str, list[str]] = {c.ref: [] for c in columns}
    for r in sorted(ranked.where(F.col("rank") <= n).select("i", "v", "rank").collect(), key=lambda r: r.rank):
        out[columns[r.i].ref].append(r.v)
    return out


def _literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in dtype.fields])
    return F.lit(value).cast(dtype)


def date_patterns(table: Table, samples: dict[str, list[str]]) -> dict[str, str | None]:
    """Date layout of each text column, fixed by its first non-null value."""
    texts = [c for c in table.columns if c.kind == "text" and samples[c.ref]]
    if not texts:
        return {}
    first = [(c.ref, samples[c.ref][0]) for c in texts]
    rows = table.spark.createDataFrame(first, "ref string, v string")
    rows = rows.withColumn("p", F.expr(S.date_pattern("v")))
    return {r.ref: r.p for r in rows.where(F.try_to_timestamp("v", F.col("p")).isNotNull()).collect()}


# --- scan ------------------------------------------------------------------------------------


def _statistics(c: ColumnInfo) -> dict[str, str]:
    v = c.ref
    out = {"nn": f"count({v})"}
    if c.kind == "number":
        n = f"CAST({v} AS DOUBLE)"
        out |= {"min": f"min({n})", "max": f"max({n})", "mean": f"avg({n})", "std": f"stddev_samp({n})"}
    elif c.kind == "text":
        size = f"char_length({v})"
        out |= {"minlen": f"min({size})", "maxlen": f"max({size})", "chars": f"sum({size})"}
    elif c.kind == "time":
        t = f"CAST({v} AS TIMESTAMP_NTZ)"
        out |= {"mindate": f"min({t})", "maxdate": f"max({t})"}
    return out


def _patterns(c: ColumnInfo, pattern: str | None) -> tuple[dict[str, str], ...]:
    """(values prepared once per row, values prepared from those, counts over both) for the type detectors
    of one column."""
    if c.kind in ("other", "flag"):
        return {}, {}, {}
    v = c.ref
    if c.kind == "time":
        midnight = S.is_midnight(f"CAST({v} AS TIMESTAMP)")
        return {}, {}, {"ts": f"count({v})", "midnight": f"count_if({midnight})"}
    if S.is_integral(c.dtype):
        # Only long positive numbers read as phone numbers, and only 0 and 1 as booleans.
        phone = f"{v} >= 1000000000 AND {S.is_phone(f'CAST({v} AS STRING)')}"
        bit = 1 << S.BOOLEAN_PAIRS.index(("1", "0"))
        pair = f"CASE WHEN {v} IN (0, 1) THEN {bit} WHEN {v} IS NOT NULL THEN 0 END"
        return {}, {}, {"phone": f"count_if({phone})", "pairs": f"bit_and({pair})"}
    text, num, ts, pnum = (f"{v}_{k}" for k in ("text", "num", "ts", "pnum"))
    if c.kind == "number":
        pair = S.boolean_pair(text) if isinstance(c.dtype, T.DecimalType) else "0"
        return {"text": f"CAST({v} AS STRING)", "num": f"CAST({v} AS DOUBLE)"}, {}, {
            "phone": f"count_if({S.is_phone(text)})",
            "pairs": f"bit_and(CASE WHEN {v} IS NOT NULL THEN {pair} END)",
            "num": f"count({num})",
            "whole": f"count_if({num} % 1 = 0)",
            "cents": f"count_if(({num} * 100) % 1 = 0)",
            "currency": f"count_if({num} BETWEEN 0 AND 1000 AND {S.is_currency(text)})",
            "pnum": f"count({num})",
            "pin": f"count_if({num} BETWEEN 0 AND 100)",
        }
    unmarked = S.to_number(f"rtrim('%', {v})", c.dtype)
    prepared = {
        "text": S.strip(v),
        "ts": S.to_timestamp(v, c.dtype, pattern),
    }
    numbers = {
        "num": S.text_number(text),
        "pnum": f"CASE WHEN endswith({v}, '%') THEN {unmarked} ELSE {S.text_number(text)} END",
    }
    return prepared, numbers, {
        "email": f"count_if({S.is_email(text)})",
        "url": f"count_if({S.is_url(text)})",
        "phone": f"count_if({S.is_phone(text)})",
        "pairs": f"bit_and(CASE WHEN {v} IS NOT NULL THEN {S.boolean_pair(text)} END)",
        "ts": f"count({ts})",
        "midnight": f"count_if({S.is_midnight(ts)})",
        "num": f"count({num})",
        "whole": f"count_if({num} % 1 = 0)",
        "cents": f"count_if(({num} * 100) % 1 = 0)",
        "currency": f"count_if({S.is_currency(text)})",
        "marked": f"count_if(contains({v}, '%'))",
        "percent": f"count_if({S.is_percent(text)})",
        "pnum": f"count({pnum})",
        "pin": f"count_if({pnum} BETWEEN 0 AND 100)",
    }


def _chunks(columns: list[ColumnInfo], width) -> list[list[ColumnInfo]]:
    out: list[list[ColumnInfo]] = []
    used = SCAN_FIELDS
    for c in columns:
        if used + width(c) > SCAN_FIELDS:
            out.append([])
            used = 0
        out[-1].append(c)
        used += width(c)
    return out


def scan(table: Table, patterns: dict[str, str | None] | None, columns=None) -> dict[str, dict[str, Any]]:
    """Statistics and (when ``patterns`` is given) detector counts of every column."""
    columns = list(table.columns) if columns is None else columns
    plans = {}
    for c in columns:
        *prepared, counts = ({}, {}, {}) if patterns is None else _patterns(c, patterns.get(c.ref))
        plans[c.ref] = (*prepared, _statistics(c) | counts)

    def named(chunk: list[ColumnInfo], part: int) -> list[str]:
        return [f"{e} AS {c.ref}_{k}" for c in chunk for k, e in plans[c.ref][part].items()]

    def run(chunk: list[ColumnInfo]):
        prepared = table.df.selectExpr(*[c.ref for c in chunk], *named(chunk, 0))
        row = prepared.selectExpr("*", *named(chunk, 1)).selectExpr(*named(chunk, 2)).first()
        return {c.ref: {k: row[f"{c.ref}_{k}"] for k in plans[c.ref][2]} for c in chunk}

    chunks = _chunks(columns, lambda c: len(plans[c.ref][2]) + 2)
    out: dict[str, dict[str, Any]] = {}
    for part in together(table.spark, *[lambda chunk=chunk: run(chunk) for chunk in chunks]):
        out |= part
    return out


# --- median ----------------------------------------------------------------------------------


def medians(table: Table, counts: dict[str, int], limit: int = MEDIAN_ROWS) -> dict[str, float | None]:
    """Exact median of each numeric column. ``counts`` gives non-null counts by column reference."""
    numeric = [c for c in table.columns if c.kind == "number" and counts.get(c.ref)]
    out: dict[str, float | None] = {}
    small: list[ColumnInfo] = []
    for c in sorted(numeric, key=lambda c: counts[c.ref]):  # the bound is on what one task holds of all of them
        if sum(counts[x.ref] for x in small) + counts[c.ref] <= limit:
            small.append(c)
    if small:
        row = table.df.agg(*[F.median(c.cell.cast("double")).alias(c.ref) for c in small]).first()
        out |= {c.ref: row[c.ref] for c in small}
    large = [c for c in numeric if c not in small]
    if large:
        values = table.df.select(*[c.cell.cast("double").alias(c.ref) for c in large])
        out |= large_medians(values, {c.ref: counts[c.ref] for c in large}, limit)
    return out


@dataclass
class _Search:
    """Where the value of a rank is looked for: strictly between two values (NULL: no end), among ``inside`` values."""

    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    def within(self, name: str) -> Column:
        v = F.col(name)
        kept = v.isNotNull()
        if self.low is not None:
            kept &= v > self.low
        if self.high is not None:
            kept &= v < self.high
        return kept

    def fractions(self) -> list[float]:
        at = self.rank / self.inside
        return [max(0.0, at - 1e-3), min(1.0, at + 1e-3)]

    def narrow(self, low: float, high: float, below: int, at_low: int, between: int, at_high: int) -> None:
        """Go on where the rank lies: below, on, between or above two values."""
        rank, inside = self.rank, self.inside
        if rank <= below:
            self.high, self.inside = low, below
        elif (rank := rank - below) <= at_low:
            self.answer = low
        elif (rank := rank - at_low) <= between:
            self.low, self.high, self.inside = low, high, between
        elif (rank := rank - between) <= at_high:
            self.answer = high
        else:
            rank, self.low, self.inside = rank - at_high, high, inside - below - at_low - between - at_high
        self.rank = rank


def large_medians(values: DataFrame, counts: dict[str, int], limit: int) -> dict[str, float]:
    """Exact medians of several columns of doubles; ``counts`` has their non-null values.

    All columns go through the same rounds: approximate quantiles bracket each column's middle, exact counts on and around
    the brackets say where to go on, until at most ``limit`` values of a column are left, which one shuffle ranks. The
    number of jobs is that of the column that takes most rounds, whatever the number of columns.
    """
    searches = {c: _Search((n + 1) // 2, n) for c, n in counts.items()}
    while wide := {c: s for c, s in searches.items() if s.answer is None and s.inside > limit}:
        sketches = [F.percentile_approx(F.when(s.within(c), F.col(c)), s.fractions(), 10_000).alias(c) for c, s in wide.items()]
        brackets = values.agg(*sketches).first()
        exact = []
        for c, s in wide.items():
            v, (lo, hi) = F.when(s.within(c), F.col(c)), brackets[c]
            for i, test in enumerate((v < lo, v == lo, (v > lo) & (v < hi), (v == hi) & (v > lo))):
                exact.append(F.count_if(test).alias(f"{c}_{i}"))
        row = values.agg(*exact).first()
        for c, s in wide.items():
            s.narrow(*brackets[c], *[row[f"{c}_{i}"] for i in range(4)])
    rest = [(i, c, s) for i, (c, s) in enumerate(searches.items()) if s.answer is None]
    if rest:
        cells = [F.struct(F.lit(i).alias("i"), F.lit(s.rank).alias("rank"), F.when(s.within(c), F.col(c)).alias("v")) for i, c, s in rest]
        sizes = values.select(F.inline(F.array(*cells))).where("v IS NOT NULL").groupBy("i", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        reached = sizes.withColumn("up_to", running).where("up_to >= rank").groupBy("i").agg(F.min("v").alias("v"))
        names = list(searches)
        for r in reached.collect():
            searches[names[r.i]].answer = r.v
    lower = {c: s.answer for c, s in searches.items()}
    even = [c for c, n in counts.items() if n % 2 == 0]
    if not even:
        return lower
    ends = []
    for c in even:
        ends += [F.count_if(F.col(c) <= lower[c]).alias(f"{c}_up"), F.min(F.when(F.col(c) > lower[c], F.col(c))).alias(f"{c}_next")]
    row = values.agg(*ends).first()
    upper = {c: lower[c] if row[f"{c}_up"] > counts[c] // 2 else row[f"{c}_next"] for c in even}
    return lower | {c: (lower[c] + upper[c]) / 2 for c in even}


def _large_median(values: DataFrame, n: int, limit: int) -> float:
    return large_medians(values, {"v": n}, limit)["v"]


# --- profile ---------------------------------------------------------------------------------


def _unique(table: Table, exact: bool) -> dict[int, int]:
    if exact or not table.columns:
        return {r.ordinal: r.unique_count for r in distinct_counts(table).collect()} if table.columns else {}
    sketches = [F.approx_count_distinct(hashable(c)).alias(c.ref) for c in table.columns]
    row = table.df.agg(*sketches).first()
    return {i: row[c.ref] for i, c in enumerate(table.columns)}


def profile(
    table: Table,
    *,
    detect: bool = True,
    exact_distinct: bool = True,
    median_limit: int = MEDIAN_ROWS,
    columns: Sequence[str] | None = None,
    passes: Collection[str] = PASSES,
) -> Profile:
    """Profile every column, or those named; with ``detect`` also gather the evidence for semantic types.

    ``passes`` leaves out what is not needed: without "samples" there are no sample values (and no detection), without
    "distinct" and "median" the fields they fill are NULL. Counts, ranges, lengths and dates come from the scan.

    ``exact_distinct=False`` swaps the distinct shuffle for a HyperLogLog sketch of each column.
    """
    if unknown := set(passes) - set(PASSES):
        raise ValueError(f"unknown passes: {sorted(unknown)}")
    if columns is not None:
        table = Table(table.df, tuple(c for c in table.columns if c.name in set(columns)), files=table.files)
    return _profile(table, detect and "samples" in passes, exact_distinct, median_limit, passes)


def _profile(table: Table, detect: bool, exact_distinct: bool, median_limit: int, passes: Collection[str]) -> Profile:
    n = table.n_rows
    samples = first_values(table) if "samples" in passes else {c.ref: [] for c in table.columns}
    patterns = date_patterns(table, samples) if detect else None
    numeric = {c.ref: n for c in table.columns if c.kind == "number"} if "median" in passes else {}
    count_distinct = (lambda: _unique(table, exact_distinct)) if "distinct" in passes else dict
    if n * max(len(numeric), 1) <= median_limit:  # the values of all columns meet in one task
        stats, unique, middle = together(
            table.spark,
            lambda: scan(table, patterns),
            count_distinct,
            lambda: medians(table, numeric, median_limit),
        )
    else:
        stats, unique = together(
            table.spark, lambda: scan(table, patterns), count_distinct
        )
        middle = medians(table, {r: stats[r]["nn"] for r in numeric}, median_limit)

    columns, evidence = [], {}
    for i, c in enumerate(table.columns):
        s = stats[c.ref]
        nn, u = s["nn"], unique.get(i, 0) if "distinct" in passes else None
        p = ColumnProfile(
            name=c.name,
            ordinal=i,
            storage_type=c.storage,
            total_rows=n,
            non_null_count=nn,
            null_count=n - nn,
            null_percentage=(n - nn) / n * 100 if n else 0.0,
            unique_count=u,
            unique_percentage=None if u is None else u / nn * 100 if nn else 0.0,
            sample_values=samples[c.ref],
        )
        if nn and c.kind == "number":
            p.min_value, p.max_value, p.mean_value = s["min"], s["max"], s["mean"]
            p.median_value = middle.get(c.ref)
            p.std_value = 0.0 if s["std"] is None or s["std"] != s["std"] else s["std"]
        elif nn and c.kind == "text":
            p.min_length, p.max_length, p.avg_length = s["minlen"], s["maxlen"], s["chars"] / nn
        elif nn and c.kind == "time":
            p.min_date, p.max_date = s["mindate"], s["maxdate"]
        columns.append(p)
        evidence[c.name] = s | {"unique": u}
    return Profile(
        table.spark, columns, evidence, {c.name: (patterns or {}).get(c.ref) for c in table.columns}
    )
