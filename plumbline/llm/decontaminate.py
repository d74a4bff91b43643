"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a small Jaccard similarity with it, so a signature of the whole document says
nothing. Here the signature belongs to the item alone, and the documents answer for membership:

* items are partitioned by the number of their shingles; an item of size q is represented by its k smallest shingle
  hashes, k = q - ceil(0.75 q) + 1. A document that contains at least 75 % of the item lacks at most k - 1 of its
  shingles, so it has one of these k: the search loses nothing;
* within a size class the largest kept hash is a bound: of a document only the hashes below it are looked up, which
  for long items is a small part;
* every candidate is verified by exact containment: distinct shared shingles against the item's full set.

The items' shingles are sent to the tasks in blocks of at most BLOCK_SHINGLES (24 bytes each); more items mean more
passes over the documents, never a larger broadcast. Documents are not shuffled.

An item is its item_id and its set of shingles, so items that share an item_id or have none are searched for one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ship, text_slices
from plumbline.llm.textnum import U, distinct, shingles

WIDTH = 5
CONTAINED = 75  # percent of an item's shingles
BLOCK_SHINGLES = 2_000_000
_GATE = 20  # bits of the first filter


class Block:
    """Some items' shingles: full sets as a sorted table, and the probes of each size class."""

    def __init__(self, items: list[int | None], values: np.ndarray, starts: np.ndarray):
        self.items = items
        self.sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        keep = self.sizes - (-(-self.sizes * CONTAINED // 100)) + 1
        rank = np.arange(len(values)) - np.repeat(starts[:-1], self.sizes)  # values are sorted within an item
        probe = rank < np.repeat(keep, self.sizes)
        level = np.repeat(np.log2(np.maximum(self.sizes, 1)).astype(int), self.sizes)
        self.classes = []
        for size_class in np.unique(level):
            own = np.unique(values[probe & (level == size_class)])
            gate = np.zeros(1 << _GATE, bool)
            gate[(own >> U(64 - _GATE)).astype(np.int64)] = True
            self.classes.append((own, own.max(), gate))

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        """Which of a text's shingle hashes are a probe of some item."""
        hit = np.zeros(len(hashes), bool)
        for own, bound, gate in self.classes:
            at = np.flatnonzero(gate[(hashes >> U(64 - _GATE)).astype(np.int64)] & (hashes <= bound))
            found = own[np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)] == hashes[at]
            hit[at[found]] = True
        return hit

    def contained(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items whose share of shingles in a text reaches the limit, and how many they share."""
        hashes = np.unique(hashes)
        a, b = np.searchsorted(self.values, hashes, "left"), np.searchsorted(self.values, hashes, "right")
        present = np.flatnonzero(b > a)
        rows = np.concatenate([np.arange(a[i], b[i]) for i in present]) if len(present) else np.empty(0, np.int64)
        shared = np.bincount(self.owner[rows], minlength=len(self.items))
        good = np.flatnonzero((shared > 0) & (shared * 100 >= self.sizes * CONTAINED))
        return good, shared[good]


def _search(block, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Block = block.value
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for first, _, data, offsets in text_slices(batch):
                values, starts = shingles(data, offsets, width)
                hits = np.flatnonzero(table.suspects(values))
                for text in np.unique(np.searchsorted(starts, hits, side="right") - 1).tolist():
                    found, shared = table.contained(values[starts[text] : starts[text + 1]])
                    for item, n in zip(found.tolist(), shared.tolist(), strict=True):
                        if table.items[item] is not None:
                            out.append((docs[first + text], table.items[item], n, int(table.sizes[item])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            names = ["doc_id", "item_id", "n_shared", "n_item"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _leaking(blocks: list):
    """For every text, whether it contains an item; of several blocks a task holds one at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            leaks = np.zeros(len(texts), bool)
            for block in blocks:
                table: Block = block.value if len(blocks) == 1 else block.load_from_path(block._path)
                for first, _, data, offsets in text_slices(batch):
                    values, starts = shingles(data, offsets, WIDTH)
                    hits = np.flatnonzero(table.suspects(values))
                    for text in np.unique(np.searchsorted(starts, hits, side="right") - 1).tolist():
                        leaks[first + text] |= len(table.contained(values[starts[text] : starts[text + 1]])[0]) > 0
            yield pa.array(leaks)

    return run


def _item_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, end, data, offsets in text_slices(batch):
                values, starts = distinct(*shingles(data, offsets, width))
                keys = [xxhash.xxh64_intdigest(repr(i).encode() + values[a:b].tobytes()) for i, a, b in zip(ids[first:end], starts[:-1], starts[1:], strict=True)]
                sizes = np.diff(starts)
                columns = [np.repeat(np.array(keys, U).view(np.int64), sizes), np.repeat([i or 0 for i in ids[first:end]], sizes).astype(np.int64), np.repeat([i is not None for i in ids[first:end]], sizes), values.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "item_id", "named", "h"])

    return run


def _blocks(items: DataFrame, width: int) -> Iterator[Block]:
    """The items' sets in blocks of bounded size; only one is on the driver at a time.

    An item larger than a block would break the bound and fills a block of its own: test items are short by nature.
    """
    source = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = source.mapInArrow(_item_sets(width), "item bigint, item_id bigint, named boolean, h bigint")
    sets = cut(sets.distinct())
    sizes = sets.groupBy("item").agg(F.count("*").alias("n"))
    total = sets.count()
    if not total:
        return
    if total <= BLOCK_SHINGLES:
        blocks = [(None, sets)]
    else:  # running size over the items, by range of id, decides the block
        running = F.sum("n").over(Window.orderBy("item"))
        block = cut(sizes.withColumn("block", F.floor(running / BLOCK_SHINGLES)))
        joined = cut(sets.join(block.select("item", "block"), "item"))
        numbers = [r.block for r in block.select("block").distinct().orderBy("block").collect()]
        blocks = [(b, joined.filter(F.col("block") == b)) for b in numbers]
    for _, rows in blocks:
        table = rows.select("item", "item_id", "named", "h").toPandas()
        items, values = table["item"].to_numpy(), table["h"].to_numpy().view(U)
        order = np.lexsort((values, items))
        items, values = items[order], values[order]
        begin = np.unique(items, return_index=True)[1]
        ids, named = table["item_id"].to_numpy()[order][begin], table["named"].to_numpy()[order][begin]
        names = [i if own else None for i, own in zip(ids.tolist(), named.tolist(), strict=True)]
        yield Block(names, values, np.concatenate([begin, [len(items)]]))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, item_id, n_shared, n_item (distinct shingles).

    An item is contained if at least 75 % of its distinct five-word shingles are in the document (A-Z as a-z). A null
    or blank text contains nothing, and an item without words is in nothing. Items without item_id are not
    reported; items that share an item_id with different texts are searched for and reported one by one; documents without doc_id are searched and reported with a null doc_id. Repeated rows are reported once each;
    repeated items count once. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"
    found = [source.mapInArrow(_search(spark.sparkContext.broadcast(b), width), schema) for b in _blocks(items, width)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, items without item_id included, with their columns.

    Every row is judged by its own text, so doc_id may be null or repeated."""
    spark = docs.sparkSession
    ship(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(items, WIDTH)]
    if not blocks:
        return docs
    leaking = F.arrow_udf(_leaking(blocks), "boolean", F.ArrowUDFType.SCALAR_ITER)
    return docs.filter(~leaking(docs["text"].cast("string")))
