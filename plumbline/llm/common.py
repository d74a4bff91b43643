"""Helpers shared by the operators: cutting lineage, word patterns, slices of Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space and words as the contracts define them, in Java's and Python's notation.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Texts are handed to numpy in slices of about this many bytes, so a worker's memory does not follow the batch.
SLICE_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one if it has one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application; nothing needs to be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="plumbline-")
        with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")
        _shipped.add(app)


def cut(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, computed once and kept in the shared folder, with no lineage behind them."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def unused(name: str, frame: DataFrame) -> str:
    """A column name that ``frame`` does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column = "text") -> Column:
    """A text, a null one as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array: a blank text has none."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def settle(frame: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """``frame``'s columns ``keep`` and new ones, computed once per row at this point of the plan.

    A projection would be merged into whatever reads it, and a filter above it pushed below: an array built once would
    be built again for each element of a later expression. Rows generated from a one-element array stay where they are.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return frame.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(row)))


#: Entries that a running sum takes one by one, and characters of a part of a long text.
CHUNK, PART = 256, 1024


def running(x: str, dtype: str = "int") -> str:
    """SQL: the running sums of an array column. Chunks are summed first, then each is gone through from its own start, so that
    no array grows entry by entry over the whole length."""
    none, zero = f"CAST(array() AS array<{dtype}>)", f"CAST(0 AS {dtype})"
    chunks = f"transform(sequence(0, (size({x}) - 1) div {CHUNK}), k -> slice({x}, k * {CHUNK} + 1, {CHUNK}))"
    heads = f"""
      aggregate({chunks}, struct({zero} AS at, CAST(array() AS array<struct<at:{dtype},c:array<{dtype}>>>) AS out),
        (a, c) -> struct(a.at + aggregate(c, {zero}, (s, v) -> s + v) AS at, concat(a.out, array(struct(a.at AS at, c AS c))) AS out), a -> a.out)"""
    one = f"aggregate(h.c, struct(h.at AS at, {none} AS out), (a, v) -> struct(a.at + v AS at, concat(a.out, array(a.at + v)) AS out), a -> a.out)"
    return f"CASE WHEN coalesce(size({x}), 0) <= 0 THEN {none} ELSE flatten(transform({heads}, h -> {one})) END"


def parts_of(text: str) -> str:
    """SQL: a text in parts of PART characters, for ``cut_out``."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"


def cut_out(parts: str, start: str, size: str) -> str:
    """SQL: ``size`` characters (one at least) from ``start`` on of a text given as its parts; a substring of the text itself
    would count through all characters before it."""
    some = f"slice({parts}, {start} div {PART} + 1, ({start} + {size} - 1) div {PART} - {start} div {PART} + 1)"
    return f"substring(array_join({some}, ''), {start} % {PART} + 1, {size})"


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about SLICE_BYTES: (first row, end row, bytes of all texts, offsets of each)."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
