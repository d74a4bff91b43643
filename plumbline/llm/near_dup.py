"""Near-duplicate detection by min-max hashing.

Every text becomes the set of its distinct five-word shingles. Under each of ``permutations`` hash permutations both the
smallest and the largest shingle are kept: each equals the other text's with a probability of the Jaccard similarity, so
one evaluation gives two signature values. Two permutations (four values) make a band; texts that agree in a band become
candidates; every link is confirmed on the full sets. All permutations together give a sketch of one bit per value, from
which a pair's similarity is estimated before its sets are fetched.

With 40 bands a pair of similarity 0.75 shares none with a probability of
(1 - 0.75**4) ** 40 = 3e-7, less above it.

How groups are kept linear: texts with equal sets are one node. Nodes with so
many shingles of their own that no link is possible leave first. A band's nodes are not paired with each other; a node
is tried against the one of each band that has the smallest share of own shingles (the one it meets in most bands
first), and confirmed links merge components. After ``rounds`` of this, only pairs of nodes in one band whose components
still differ are left. A band's nodes are then dealt into blocks of about CELL, and every two blocks of a band meet in a task
which lets go only the pairs whose counts allow a link and whose sketches differ by no more than SLACK standard deviations
above what a pair at the limit differs (5e-7 of such pairs do); these are all tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ship, text_slices
from plumbline.llm.textnum import U, distinct, mix, randoms, shingles
from plumbline.operators.bloom import bloom, marked, thinned

WIDTH = 5
PERMUTATIONS = 512
BANDS = 40
PER_BAND = 2
SIMILARITY = 75  # percent
PRUNINGS = 2
#: Differing sketch bits of a pair that is still tried, in standard deviations above the mean of a pair at the limit.
SLACK = 4.9
#: Longs that may be sent to all tasks (16 MB); what is larger is shuffled.
SENT = 2_000_000
CELL = 512
#: Rows of a partition of a table whose size is known.
PART_ROWS = 250_000
#: The same where a row holds lists.
WIDE_ROWS = 20_000
#: Rows of a table of a known size that is sent to all tasks rather than shuffled, about a megabyte.
SMALL = 30_000
#: Partitions of a Bloom filter's words.
FILTER_PARTS = 16


def minmax(values: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """(2 * permutations) x texts: the smallest and the largest value of every non-empty set under each permutation."""
    factors = randoms(permutations, 37) | U(1)
    out = np.empty((2 * permutations, len(starts)), U)
    for p, factor in enumerate(factors):
        turned = values * factor
        out[2 * p] = np.minimum.reduceat(turned, starts)
        out[2 * p + 1] = np.maximum.reduceat(turned, starts)
    return out


def band_keys(signature: np.ndarray, per_band: int) -> np.ndarray:
    """texts x bands: one key per band of 2 * per_band signature values."""
    width = 2 * per_band
    bands = len(signature) // width
    factors = randoms(width, 41) | U(1)
    keys = np.empty((signature.shape[1], bands), U)
    for b in range(bands):
        total = np.full(signature.shape[1], b + 1, U)
        for k in range(width):
            total = mix(total + signature[b * width + k] * factors[k])
        keys[:, b] = total
    return keys


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """texts x longs: one bit of every signature value; two sets agree in a bit with a probability of (1 + J) / 2."""
    bits = (mix(signature + U(303)) & U(1)).astype(np.uint8).T
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def sketch_limit(bits: int) -> int:
    """Most differing bits of a pair worth trying."""
    p = (1 - SIMILARITY / 100) / 2
    return int(bits * p + SLACK * (bits * p * (1 - p)) ** 0.5)


def _signatures(width: int, permutations: int, bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = permutations * 2 // 64
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                values, starts = distinct(*shingles(data, offsets, width))
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                keys = np.zeros((end - first, 2), U)
                lists = sketches = np.zeros(0, U)
                if len(full):
                    at = starts[full]
                    keys[full, 0] = np.add.reduceat(mix(values + U(101)), at)
                    keys[full, 1] = np.add.reduceat(mix(values + U(202)), at)
                    signature = minmax(values, at, permutations)
                    lists, sketches = band_keys(signature[: 2 * per_band * bands], per_band).ravel(), sketch_bits(signature).ravel()
                ends = np.concatenate([[0], np.cumsum(sizes > 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, end - first) for c in ("doc_id", "t0", "t1")],
                        pa.array(sizes),
                        pa.array(keys[:, 0].view(np.int64)),
                        pa.array(keys[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends * bands), pa.array(lists.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends * longs), pa.array(sketches.view(np.int64))),
                    ],
                    names=["doc_id", "t0", "t1", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                values, starts = distinct(*shingles(data, offsets, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64))),
                    ],
                    names=["node", "shingles"],
                )

    return run


def _close(limit: int):
    """Rows of cells, in order, to the pairs (a, b) of each cell that are worth trying."""

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, size = rows["cell"], len(rows["cell"])
        at, step = np.arange(size), 0
        while len(at):
            step += 1
            at = at[at + step < size]
            at = at[cell[at] == cell[at + step]]
            one, two = at, at + step
            apart = (rows["node"][one] != rows["node"][two]) & (rows["component"][one] != rows["component"][two])
            apart &= (rows["side"][one] != rows["side"][two]) | (rows["i"][one] == rows["j"][one])
            one, two = one[apart], two[apart]
            n, s = rows["n"], rows["s"]
            likely = (100 + SIMILARITY) * np.minimum(s[one], s[two]) >= SIMILARITY * (n[one] + n[two])
            likely &= 100 * np.minimum(n[one], n[two]) >= SIMILARITY * np.maximum(n[one], n[two])
            one, two = one[likely], two[likely]
            near = np.bitwise_count(rows["sketch"][one] ^ rows["sketch"][two]).sum(axis=1) <= limit
            one, two = one[near], two[near]
            # A pair comes from the first of its bands only.
            first = (rows["bands"][one] == rows["bands"][two]).argmax(axis=1) == rows["place"][one]
            x, y = rows["node"][one[first]], rows["node"][two[first]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "place", "i", "j", "side", "node", "component", "n", "s")}
            for c in ("sketch", "bands"):
                new[c] = batch.column(c).flatten().to_numpy().reshape(len(batch), -1)
            new["sketch"] = new["sketch"].view(U)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            border = (held["band"][1:] != held["band"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])
            held["cell"] = np.concatenate([[0], np.cumsum(border)])
            last = int(np.searchsorted(held["cell"], held["cell"][-1]))  # the cell under way waits for the next batch
            yield from pairs({c: v[:last] for c, v in held.items()})
            held = {c: v[last:] for c, v in held.items() if c != "cell"}
        if held is not None:
            yield from pairs(held | {"cell": np.zeros(len(held["node"]), np.int64)})

    return run


def _pairs_left(members: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Pairs of nodes of one band and different components that may be similar enough. ``members`` carries the band's size and
    its place among a node's bands; ``sketches`` has half of every band's key, by which a pair knows the first it shares."""
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    dealt = members.join(sketches, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side")]
    dealt = dealt.select("band", "place", *cell, "node", "component", "n", "s", "sketch", "bands")
    cells = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return cells.mapInArrow(_close(limit), "a bigint, b bigint")


def tidy(frame: DataFrame, n_rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """A table of a known size in no more partitions than its rows need, so that a small one isn't many small files and tasks:
    the driver keeps something of each."""
    return frame.coalesce(max(1, -(-n_rows // part_rows)))


def small(frame: DataFrame, n_rows: int) -> DataFrame:
    """A table of a known size for a join: a small one is sent at once, without two shuffles to find out that it is small."""
    return F.broadcast(frame) if n_rows <= SMALL else frame


def connect(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``links`` (a, b): columns node, component.

    Labels are lowered along links and then along themselves, so the rounds needed grow with the logarithm of a chain.
    Both sides of the large joins are cut tables, which lets Spark split a node with very many links.
    """
    n = 2 * links.count()
    both = cut(tidy(links.select("a", "b").union(links.select("b", "a")).distinct(), n))
    labels = cut(tidy(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), n))
    while True:
        near = both.join(small(labels, n), both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        before = labels.withColumn("before", F.col("component"))
        lower = before.unionByName(near.withColumn("before", F.lit(None).cast("bigint"))).groupBy("node")
        lower = cut(tidy(lower.agg(F.min("component").alias("component"), F.max("before").alias("before")), n))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        lower = lower.join(small(jump, n), "component", "left").select("node", F.coalesce("further", "component").alias("component"), "before")
        lower = cut(tidy(lower, n))
        if lower.filter("component < before").isEmpty():
            return lower.drop("before")
        labels = lower.drop("before")


def _few(frame: DataFrame, column: str = "1") -> bool:
    """Is the sum of ``column`` small enough for ``frame`` to be sent to all tasks?"""
    return (frame.agg(F.expr(f"sum({column})")).head()[0] or 0) <= SENT


def _confirmed(pairs: DataFrame, n_pairs: int, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. Sets of few shingles in all are sent to the pairs; else both are
    shuffled."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = cut(tidy(needed, 2 * n_pairs))
    own = sets.join(F.broadcast(needed) if _few(needed) else needed, "node", "left_semi")
    if _few(own, "size(shingles)"):
        sets = F.broadcast(cut(own))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.select("a", "b")
        .join(one, "a")
        .join(two, "b")
        .select("a", "b", both.alias("shared"), (F.size("sa") + F.size("sb") - both).alias("united"))
        .filter(F.col("shared") * 100 >= F.col("united") * SIMILARITY)
        .select("a", "b")
        .distinct()
    )


def _linkable(members: DataFrame, sets: DataFrame, n_nodes: int) -> DataFrame:
    """``members`` without nodes that can't have a link, with s (shingles that another candidate has too) and own (share
    of the others).

    All that two texts share is in both. A copy with many edits has so many shingles of its own that no other text can
    be similar enough to it; such nodes would be tried against all others of a large group in vain. Shingles of one node
    are counted without joining back: of a shingle counted once, the smallest node is the only one.
    """
    left = cut(tidy(members.select("node", "n").distinct(), n_nodes))
    for again in range(PRUNINGS):  # nodes that have left don't count as others any more
        own = sets if not again else sets.join(F.broadcast(left.select("node")) if _few(left) else left, "node", "left_semi")
        seen = own.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
        alone = cut(tidy(seen.filter("node = other").groupBy("node").agg(F.count("*").alias("alone")), n_nodes))
        shared = left.select("node", "n").join(small(alone, n_nodes), "node", "left").withColumn("s", F.col("n") - F.least("n", F.coalesce("alone", F.lit(0))))
        left = cut(tidy(shared.filter(f"100 * s >= {SIMILARITY} * n").select("node", "n", "s"), n_nodes))
    kept = members.join(small(left, n_nodes), ["node", "n"]).withColumn("own", 1 - F.col("s") / F.col("n"))
    return kept.select("node", "n", "s", "own", "place", "band", F.col("node").alias("component"))


def _classes(docs: DataFrame, width: int, permutations: int, bands: int, per_band: int, rounds: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, t0, t1, n_shingles, k1, k2), the sets' classes (k1, k2, n_shingles, component, the smallest doc_id
    reachable, group) that have a doc_id, and the number of rows. t0 and t1 are hashes of the text; components of one name
    differ in their group."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"), text.alias("text"))
    signed = cut(
        source.mapInArrow(
            _signatures(width, permutations, bands, per_band),
            "doc_id bigint, t0 bigint, t1 bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>",
        )
    )
    n_rows = signed.count()  # more than any table of one row per node; a task or file per shuffle partition is the driver's to keep
    signed = tidy(signed, n_rows, WIDE_ROWS)
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["k1", "k2", "n_shingles"]
    lowest = tidy(usable.groupBy(*key).agg(F.min(F.struct("doc_id", "t0", "t1")).alias("low")), n_rows)
    # A node has the smallest doc_id of its class as its number; where several classes have the same, all but one get others.
    first = tidy(lowest.groupBy("low.doc_id").agg(F.min(F.struct(*key)).alias("first")), n_rows)
    number = F.when(F.struct(*key) == F.col("first"), F.col("low.doc_id")).otherwise(F.xxhash64("low.doc_id", *key))
    classes = lowest.join(first, lowest["low.doc_id"] == first["doc_id"]).select(*key, "low", number.alias("node"))
    classes = cut(tidy(classes, n_rows))
    named = classes.select(*key, "node", F.col("low.doc_id").alias("doc_id"), F.col("low.t0").alias("t0"), F.col("low.t1").alias("t1"))
    chosen = usable.join(named, [*key, "doc_id", "t0", "t1"])
    chosen = cut(tidy(chosen.select("node", F.col("n_shingles").alias("n"), "bands", "sketch"), n_rows, WIDE_ROWS))
    rows = chosen.select("node", "n", F.posexplode("bands").alias("place", "band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = cut(tidy(shared.select("band"), n_rows * bands // 2))
    hashes = [F.col("band").alias("k0"), F.xxhash64("band").alias("k1")]
    likely = thinned(rows.select("node", "n", "place", "band", *hashes), bloom(shared.select(*hashes)).coalesce(FILTER_PARTS)).drop("k0", "k1")
    members = cut(tidy(likely.dropDuplicates(["band", "node", "n"]), n_rows * bands).join(shared, "band"))
    ids = cut(tidy(members.select("node").distinct().join(named.select("node", "doc_id", "t0", "t1"), "node"), n_rows))
    n_nodes = ids.count()
    at = ["doc_id", "t0", "t1"]
    if _few(ids, "4"):  # so that texts are not shuffled to pick out a few
        wanted = source.join(F.broadcast(ids), at)
    else:
        hashed = [F.xxhash64(*at).alias("k0"), F.xxhash64(F.lit(1), *at).alias("k1")]
        wanted = thinned(source.select("*", *hashed), bloom(ids.select(*hashed)).coalesce(FILTER_PARTS)).join(ids, at)
    sets = cut(wanted.select("node", "text").mapInArrow(_sets(width), "node bigint, shingles array<bigint>"))
    sets = tidy(sets, n_nodes, WIDE_ROWS)
    members = _linkable(members, sets, n_nodes)

    labels = tried = links = None
    n_members = 0
    for turn in range(rounds + 1):
        if labels is not None:  # bands whose nodes are not all connected yet
            members = members.drop("component").join(small(labels, n_nodes), "node", "left")
            members = members.withColumn("component", F.coalesce("component", "node"))
        members = cut(members if labels is None else tidy(members, n_members))
        if labels is None:
            n_members = members.count()
        best = F.min(F.struct("own", "node")).alias("best")
        ends = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), best, F.count("*").alias("size"))
        ends = cut(tidy(ends.filter("x < y").select("band", F.col("best.node").alias("center"), "size"), n_members))
        members = cut(tidy(members.join(small(ends, n_members), "band"), n_members))
        if turn < rounds:  # each node against the nodes of its bands that have the smallest share of own shingles
            pairs = members.filter("node <> center").select(F.col("center").alias("c"), "node")
            pairs = pairs.groupBy(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"), "node").agg(F.count("*").alias("bands"))
            pairs = tidy(pairs, n_members)
        else:  # all pairs of a band that are still apart and can share enough
            wide = permutations * 2
            halves = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")
            sketches = chosen.select("node", "sketch", halves).join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
            pairs = _pairs_left(members.select("band", "place", "node", "component", "n", "s", "size"), cut(sketches), sketch_limit(wide))
        members = members.drop("center", "size")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if turn < rounds:
            best = Window.partitionBy("node").orderBy(F.col("bands").desc(), "a", "b")
            pairs = tidy(pairs.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("a", "b"), n_nodes)
            pairs = tidy(pairs.distinct(), n_nodes)
        pairs = cut(pairs.select("a", "b"))
        n = pairs.count()
        if not n:
            continue
        pairs = tidy(pairs, n)
        tried = pairs if tried is None else tried.union(pairs)
        found = tidy(cut(_confirmed(pairs, n, sets)), n)
        links = found if links is None else links.union(found)
        labels = connect(links)
    if labels is None:
        named = classes.select(*key, F.col("low.doc_id").alias("component"), F.col("node").alias("group"))
    else:
        grouped = classes.join(labels, "node", "left").select(*key, F.col("low.doc_id").alias("doc_id"), F.coalesce("component", "node").alias("group"))
        smallest = grouped.groupBy("group").agg(F.min("doc_id").alias("component"))
        named = grouped.join(smallest, "group").select(*key, "component", "group")
    return signed.drop("bands", "sketch"), cut(tidy(named, n_rows)), n_rows


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, permutations: int = PERMUTATIONS, bands: int = BANDS, per_band: int = PER_BAND, rounds: int = 2
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    A null or blank text has an empty set and is linked with nothing. Every row is a document of its own: rows that share a
    doc_id and a set are in one component, with different sets each goes with its own. A row without doc_id can't be named: it
    is linked with nothing, its component_id is null and it is kept. Other columns of ``docs`` are not read.
    """
    rows, named, _ = _classes(docs, width, permutations, bands, per_band, rounds)
    return (
        rows.join(named, ["k1", "k2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component one row stays, with the smallest doc_id.

    Rows are judged by doc_id and text. A row without doc_id goes if a row with one has its shingles, else one of those
    with equal shingles stays. Rows without words all stay. Columns are those of ``docs``. Only rows that may go, or
    occur more than once, are shuffled with their texts.
    """
    rows, named, n_rows = _classes(docs, WIDTH, PERMUTATIONS, BANDS, PER_BAND, 2)
    key, at = ["k1", "k2", "n_shingles"], ["doc_id", "t0", "t1"]
    rows = tidy(rows.filter("n_shingles > 0").groupBy(*at, *key).agg(F.count("*").alias("times")), n_rows)
    judged = cut(tidy(rows.join(named, key, "left"), n_rows))
    text = F.struct("t0", "t1")
    # Rows with the component's own doc_id, whose texts may still differ, and rows of classes that no doc_id is known of.
    heads = judged.filter("doc_id = component").select(*at, "times", F.struct("group").cast("string").alias("group"))
    bare = judged.filter("component IS NULL").select(*at, "times", F.struct(*key).cast("string").alias("group"))
    both = heads.union(bare)
    first = tidy(both.groupBy("group").agg(F.min(text).alias("first")), n_rows)
    ranked = both.join(first, "group").select(*at, "times", (text == F.col("first")).alias("stays"))
    others = judged.filter("component IS NOT NULL AND NOT doc_id <=> component").select(*at, "times", F.lit(False).alias("stays"))
    touched = cut(tidy(others.union(ranked.filter("times > 1 OR NOT stays")), n_rows))
    own = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    hashes = {"d": doc.cast("bigint"), "h0": F.xxhash64(text.cast("string")), "h1": F.xxhash64(F.lit(1), text.cast("string"))}
    named_rows = docs.toDF(*own).withColumns(hashes)
    print_ = lambda a, b, c: [F.xxhash64(a, b, c).alias("k0"), F.xxhash64(F.lit(1), a, b, c).alias("k1")]
    marks = cut(bloom(touched.select(*print_("doc_id", "t0", "t1"))).coalesce(FILTER_PARTS))
    hit = marked(named_rows.select("*", *print_("d", "h0", "h1")), marks, "hit")
    clear = hit.filter("NOT hit").select(*own)
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h0") == F.col("t0")) & (F.col("h1") == F.col("t1"))
    maybe = hit.filter("hit").join(touched, same, "left")
    once = maybe.filter("stays").dropDuplicates(["d", "h0", "h1"]).select(*own)
    untouched = maybe.filter("stays IS NULL").select(*own)
    return clear.union(once).union(untouched).toDF(*docs.columns)
