"""Language-model scoring with a probabilistic suffix tree, and the unigram base score.

The tree's symbols are 64 classes of characters of the token sequence (words in lower case, a space between them, an end
behind the last): letters and digits have classes of their own, other bytes share some. A text's probability is the
product over its bytes of P(class | context) and P(byte | class), so it is a distribution over texts.

Contexts of up to DEPTH classes are counted over all training documents. A context is considered if it occurs at least
LEAST_COUNT times, whatever the size of the corpus, and retained if its next-symbol distribution diverges from that of its
parent, the context without the oldest symbol: its count times the Kullback-Leibler divergence must reach DIVERGENCE nats.
Retained contexts keep their suffixes. Distributions are smoothed by their parent's (Dirichlet, MASS), the root's by one
per class. Each position is scored by its longest retained context.

The states grow with the corpus. The top of the tree, contexts of up to TOP classes (64 ** TOP of them at most), is held
by every task. The subtrees below each context of TOP classes are built where the counts of all their contexts meet, and
stay a partitioned table. For scoring they are sent to the tasks in blocks of about BLOCK_BYTES in the order of their
codes; a task gathers CHUNK positions, sorts them by context and takes one block after the other for those in its range.

Unigram counts follow the corpus: words that make up at least FREQUENT of all tokens (1 / FREQUENT of them at most) are
looked up in the tasks; tokens of rarer words are joined with the counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ship, text_slices
from plumbline.llm.textnum import U, words

DEPTH = 8
TOP = 3
CLASSES = 64
LEAST_COUNT = 4
DIVERGENCE = 10.0
MASS = 8.0
FREQUENT = 1e-6
ALPHA = 0.1  # of the base score, fixed by the contract
END_HASH = np.int64(0xE2D)  # the end token among the word hashes
_BITS, _MASK = 6, 63
_KEY = _BITS * (DEPTH + 1)  # bits of a key, DEPTH classes and the next one
_BELOW = _BITS * (DEPTH - TOP + 1)  # bits of a key behind its TOP latest classes
_FLUSH = 2_000_000
GATHER = 6_000_000
BLOCK_BYTES = 32_000_000
CHUNK = 3_000_000
PIECE = 1 << 15


def class_table() -> np.ndarray:
    """Class of every byte: 0 end (no byte has it), 1 space, 2-27 letters, 28-37 digits, 38-47 other ASCII, 48-63 others."""
    table = np.full(256, 46, np.int64)
    table[:32] = table[127] = 47
    table[32] = 1
    for i in range(26):
        table[97 + i] = table[65 + i] = 2 + i
    for i in range(10):
        table[48 + i] = 28 + i
    for i, c in enumerate(b".,#*$%&!"):
        table[c] = 38 + i
    table[128:] = 48 + (np.arange(128, 256) & 15)
    return table


_CLASS = class_table()
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.where(_BLANK, 32, _LOWER).astype(np.uint8)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and bytes (lower case; 32 for a space, 0 for an end) of the token sequences, and where each text's begin."""
    texts = len(offsets) - 1
    starts = np.zeros(texts + 1, np.int64)
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.uint8), starts
    closed = np.insert(data, offsets[1:], 32)  # every text ends in a blank
    begin = offsets[:-1] + np.arange(texts)
    solid = ~_BLANK[closed]
    kept = solid.copy()
    kept[1:] |= solid[:-1]  # words, and the first blank behind each
    lone = ~np.logical_or.reduceat(kept, begin)
    kept[offsets[1:][lone] + np.flatnonzero(lone)] = True
    np.cumsum(np.add.reduceat(kept.view(np.uint8), begin, dtype=np.int64), out=starts[1:])
    out = _PLAIN[closed[kept]]
    classes = _CLASS[out]
    out[starts[1:] - 1] = 0
    classes[starts[1:] - 1] = 0
    return classes, out, starts


def contexts(classes: np.ndarray, starts: np.ndarray, depth: int = 4) -> np.ndarray:
    """The ``depth`` classes before each position, the latest in the highest bits; ends stand before a text's beginning."""
    n = len(classes)
    runs, width = np.zeros(n, np.int64), 1
    runs[1:] = classes[:-1]
    code, done = np.zeros(n, np.int64), 0
    while True:  # runs holds the ``width`` classes before each position; depth is put together from powers of two
        if depth & width:
            shifted = runs if not done else np.concatenate([np.zeros(min(done, n), np.int64), runs[: n - done] if n > done else runs[:0]])
            code, done = (code << (_BITS * width)) | shifted, done + width
        if done == depth:
            break
        wider = runs << (_BITS * width)
        wider[width:] |= runs[:-width] if n > width else runs[:0]
        runs, width = wider, width * 2
    # Where a text begins, what lies before it is blotted out.
    lengths = np.diff(starts)
    for k in range(depth):
        at = starts[:-1][lengths > k] + k
        code[at] &= ~((1 << (_BITS * (depth - k))) - 1)
    return code


def order_of(keys: np.ndarray) -> np.ndarray:
    """The places of keys of _KEY bits in the keys' order, equal ones by place. Numbers sort several times faster than places by
    their numbers: so the place goes into the bits behind a key, and what a key has more bits than that is sorted by after it."""
    n = len(keys)
    places = max(n - 1, 1).bit_length()
    low = max(0, _KEY + places - 63)
    if 2 * places + low > 63:
        return np.argsort(keys, kind="stable")
    at, mask = np.arange(n), (1 << places) - 1
    packed = ((keys >> low) << places) | at
    packed.sort()
    order = packed & mask
    packed >>= places
    if low:
        border = np.zeros(n, bool)
        np.not_equal(packed[1:], packed[:-1], out=border[1:])
        packed = (((np.cumsum(border) << low) | (keys[order] & ((1 << low) - 1))) << places) | at
        packed.sort()
        order = order[packed & mask]
    return order


def near_order(keys: np.ndarray) -> np.ndarray:
    """The places of keys in the order of their TOP + 1 latest classes, and of a hash of the whole key below it: so one sort is
    enough. Equal keys stand together unless another one shares their classes and hash."""
    n = len(keys)
    places = max(n - 1, 1).bit_length()
    high = _BITS * (TOP + 1)
    spread = 63 - places - high
    if spread < 1 or _KEY + places <= 63:
        return order_of(keys)
    packed = (keys.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - spread)
    packed |= (keys >> (_KEY - high)).view(U) << U(spread)
    packed <<= U(places)
    packed |= np.arange(n, dtype=U)
    packed.sort()
    packed &= U((1 << places) - 1)
    return packed.view(np.int64)


def told_apart(keys: np.ndarray, order_of: Callable[[np.ndarray], np.ndarray] = order_of) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them. In ``near_order`` a few may come more than once."""
    order = order_of(keys)
    ranked = keys[order]
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    back = np.empty(len(keys), np.int32)
    back[order] = np.cumsum(first, dtype=np.int32) - 1
    return ranked[first], back


class Counter64:
    """Counts of 64-bit keys, merged when enough have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.add_counts(*np.unique(keys, return_counts=True))

    def add_counts(self, found: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > _FLUSH + 2 * self.merged:
            self._merge()

    def _merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], np.add.reduceat(n, first))]
        self.held = self.merged = len(first)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        self._merge()
        return self.parts[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: words (kind 0) and bytes (kind 2)."""
    word = Counter64()
    byte, texts = np.zeros(256, np.int64), 0
    for batch in batches:
        for first, end, data, offsets in text_slices(batch):
            word.add(words(data, offsets)[0].view(np.int64))
            byte += np.bincount(_LOWER[data[~_BLANK[data]]], minlength=256)
            texts += end - first
    parts = [(0, *word.result()), (0, np.array([END_HASH]), np.array([texts])), (2, np.arange(256), byte)]
    for kind, keys, n in parts:
        for a in range(0, len(keys), 200_000):
            own = keys[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(n[a : a + 200_000])], names=["kind", "k", "n"])


class Tree:
    """The top: retained contexts as a table from the last TOP classes to a state, and log10 probabilities by state and class."""

    def __init__(self, states: dict[int, dict[int, np.ndarray]], byte_counts: np.ndarray):
        root = states.get(0, {}).get(0, np.zeros(CLASSES))
        rows = [(root + 1) / (root.sum() + CLASSES)]
        self.depths, self.codes = [0], [0]
        index: list[dict[int, int]] = [{0: 0}]
        for depth in range(1, TOP + 1):
            index.append({})
            for code, n in sorted(states.get(depth, {}).items()):
                parent = rows[index[depth - 1][code >> _BITS]]  # the oldest class has the lowest bits
                index[depth][code] = len(rows)
                rows.append((n + MASS * parent) / (n.sum() + MASS))
                self.depths.append(depth)
                self.codes.append(code)
        self.log = np.log10(np.array(rows))
        emit = np.zeros(256)
        lower = np.ones(256, bool)
        lower[65:91] = False  # upper case never occurs, so its bytes are no members of the letters' classes
        sizes = np.bincount(_CLASS[lower], minlength=CLASSES)
        totals = np.bincount(_CLASS, weights=byte_counts, minlength=CLASSES)
        wide = (sizes[_CLASS] > 1) & lower
        emit[wide] = np.log10((byte_counts[wide] + 1) / (totals[_CLASS[wide]] + sizes[_CLASS[wide]]))
        self.emit = emit
        self._table: np.ndarray | None = None
        self._chance: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self._table is None:
            table = np.zeros(1 << (_BITS * TOP), np.int32)
            for state, (depth, code) in enumerate(zip(self.depths, self.codes, strict=True)):
                width = _BITS * (TOP - depth)
                table[code << width : (code + 1) << width] = state
            self._table = table
        return self._table

    def chances(self, keys: np.ndarray) -> np.ndarray:
        """P(class | longest context of the top) of keys, DEPTH classes and the next one."""
        if self._chance is None:
            self._chance = 10**self.log
        return self._chance[self.table()[keys >> _BELOW], keys & _MASK]


_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # making one takes longer than a small blob


def _pressed(data: bytes) -> bytes:
    return _press.compress(data)


def _unpressed(blob: bytes) -> bytes:
    return _unpress.decompress(blob)


def _planes(numbers: np.ndarray) -> np.ndarray:
    """A row for each byte of the numbers: most high ones are zero, which packs well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)


def _packed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts as one compressed row per bucket, the TOP latest classes."""
    if not len(keys):
        return
    bucket = keys >> _BELOW
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]])
    for a in range(0, len(edges) - 1, 1000):
        own = edges[a : a + 1001]
        low, high = own[0], own[-1]
        step = np.diff(keys[low:high], prepend=0)
        step[own[:-1] - low] = keys[own[:-1]]
        step, count = _planes(step), _planes(n[low:high].astype(np.uint32))
        blobs = [_pressed(step[:, x:y].tobytes() + count[:, x:y].tobytes()) for x, y in zip(own[:-1] - low, own[1:] - low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[own[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_unpressed(blob), np.uint8).reshape(12, -1)
    step, n = (np.ascontiguousarray(x.T).view(t).ravel() for x, t in ((planes[:8], np.int64), (planes[8:], np.uint32)))
    return np.cumsum(step), n.astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of contexts of DEPTH classes with the next class, packed by bucket for every GATHER positions."""
    held, size = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return _packed(keys[first], np.diff(first, append=len(keys)))

    for batch in batches:
        for _, _, data, offsets in text_slices(batch):
            classes, _, starts = symbols(data, offsets)
            held.append((contexts(classes, starts, DEPTH) << _BITS) | classes)
            size += len(classes)
            if size >= GATHER:
                yield from counted()
                held, size = [], 0
    if held:
        yield from counted()


def _shorter(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs (context, next class) and their counts without the contexts' oldest class, and where each pair went."""
    code = pair >> (2 * _BITS)
    border = np.zeros(len(pair), bool)
    np.not_equal(code[1:], code[:-1], out=border[1:])
    want = (np.cumsum(border) << _BITS) | (pair & _MASK)
    places = max(len(pair) - 1, 1).bit_length()
    if 2 * places + _BITS <= 63:  # the place goes into the bits behind, as numbers sort faster than places by their numbers
        want = (want << places) | np.arange(len(pair))
        want.sort()
        order = want & ((1 << places) - 1)
        want >>= places
    else:
        order = np.argsort(want, kind="stable")
        want = want[order]
    first = np.ones(len(pair), bool)
    np.not_equal(want[1:], want[:-1], out=first[1:])
    back = np.empty(len(pair), np.int64)
    back[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    found = order[begin]
    return (code[found] << _BITS) | (pair[found] & _MASK), np.add.reduceat(count[order], begin), back


def _retained(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts of some whole buckets, contexts of TOP classes, and the retained contexts longer than TOP: a row per bucket
    and depth."""
    counts = [(keys, n, None)]  # by depth, the deepest last; where each pair of the next depth went
    for _ in range(TOP, DEPTH):
        *above, back = _shorter(*counts[0][:2])
        counts[0] = (*counts[0][:2], back)
        counts.insert(0, (*above, None))
    levels = []
    for pair, count, spot in counts:
        code = pair >> _BITS
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.add.reduceat(count, begin)
        state = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(pair)))
        kept = np.zeros(len(begin), bool)
        often = total >= LEAST_COUNT
        if levels and often.any():
            above = levels[-1]
            own = often[state]
            spot, some = spot[own], count[own]
            q = above[1][spot] / above[4][above[2][spot]]
            sizes = np.diff(begin, append=len(pair))[often]
            kept[often] = np.add.reduceat(some * np.log(some / total[state[own]] / q), np.cumsum(sizes) - sizes) >= DIVERGENCE
        levels.append((pair, count, state, code[begin], total, kept))
    needed, rows = np.empty(0, np.int64), []
    pair, count, _, code, _, _ = levels[0]
    ends = np.searchsorted(pair >> _BITS, code, side="right")
    for b, u, v in zip(code.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        rows.append((b, TOP, 1, v - u, _pressed(pair[u:v].tobytes() + count[u:v].astype(np.int64).tobytes())))
    for depth in range(DEPTH, TOP, -1):
        pair, count, state, code, _, kept = levels[depth - TOP]
        kept = kept | np.isin(code, needed)
        needed = np.unique(code[kept] >> _BITS)
        own = kept[state]
        pair, count, code = pair[own], count[own], code[kept]
        if not len(code):
            continue
        bucket, at = np.unique(code >> (_BITS * (depth - TOP)), return_index=True)
        pairs_at = np.searchsorted(pair >> _BITS, code[at])
        for b, x, y, u, v in zip(bucket.tolist(), at, [*at[1:], len(code)], pairs_at, [*pairs_at[1:], len(pair)], strict=True):
            rows.append((b, depth, int(y - x), int(v - u), _pressed(pair[u:v].tobytes() + count[u:v].astype(np.int64).tobytes())))
    schema = pa.schema([("bucket", pa.int64()), ("depth", pa.int32()), ("states", pa.int64()), ("pairs", pa.int64()), ("blob", pa.binary())])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained contexts from packed counts that come by bucket; small buckets are taken several at a time."""
    gram, last = Counter64(), None
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket != last and gram.held > _FLUSH // 3:
                yield from _retained(*gram.result())
                gram = Counter64()
            gram.add_counts(*_unpacked(blob.as_py()))
            last = bucket
    if gram.parts:
        yield from _retained(*gram.result())


def subtrees(docs: DataFrame) -> DataFrame:
    """The states below the top: bucket, depth, states, pairs, blob (pairs of a context and a class, and their counts)."""
    grams = docs.select("text").mapInArrow(_grams, "bucket bigint, blob binary")
    states = grams.repartition("bucket").sortWithinPartitions("bucket")
    return cut(states.mapInArrow(_subtrees, "bucket bigint, depth int, states bigint, pairs bigint, blob binary"))


class Block:
    """States of a range of buckets by depth: codes, sets of seen classes as bits, and their counts; sets of the classes that lead
    on to a longer context, as bits, and where those contexts begin in the next depth."""

    def __init__(self, rows: list):
        self.first, self.last = rows[0].bucket, rows[-1].bucket
        self.levels = []
        for depth in range(TOP + 1, DEPTH + 1):
            parts = [np.frombuffer(_unpressed(r.blob), np.int64).reshape(2, -1) for r in rows if r.depth == depth]
            if not parts:
                break  # suffixes are kept: nothing is deeper
            pair, count = np.concatenate(parts, 1)
            code = pair >> _BITS
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            seen = np.bitwise_or.reduceat(U(1) << (pair & _MASK).astype(U), begin)
            code = code[begin]
            if self.levels:
                _, above, _, _, _, _, longer, start = self.levels[-1]
                parent = code >> _BITS
                first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
                spot = np.searchsorted(above, parent[first])
                longer[spot] = np.bitwise_or.reduceat(U(1) << (code & _MASK).astype(U), first)
                start[spot] = first
            self.levels.append((depth, code, seen, begin, np.add.reduceat(count, begin), count, np.zeros(len(code), U), np.zeros(len(code), np.int64)))

    def refine(self, keys: np.ndarray, p: np.ndarray) -> None:
        """Turn P(class | top context) of keys in order, or in ``near_order``, into P(class | longest retained context)."""
        a, b = np.searchsorted(keys, [self.first << _BELOW, (self.last + 1) << _BELOW])
        for x in range(a, b if self.levels else a, PIECE):  # what a piece needs meanwhile stays in the processor's cache
            self._refine(keys, p, x, min(x + PIECE, b))

    def _refine(self, keys: np.ndarray, p: np.ndarray, a: int, b: int) -> None:
        want = keys[a:b] >> (_BITS * (DEPTH - TOP))
        runs = np.concatenate([[0], np.flatnonzero(want[1:] != want[:-1]) + 1])  # keys of one context stand together
        sizes = np.diff(runs, append=len(want))
        code = self.levels[0][1]
        at = np.minimum(np.searchsorted(code, want[runs]), len(code) - 1)
        good = code[at] == want[runs]
        own = np.flatnonzero(np.repeat(good, sizes))
        at, alive, key = np.repeat(at[good], sizes[good]), own + a, keys[a:b][own]
        bit, q = U(1) << (key & _MASK).astype(U), p[alive]
        for depth, _, seen, begin, total, count, longer, start in self.levels:
            if not len(at):
                return
            known = seen[at]
            place = begin[at] + np.bitwise_count(known & (bit - U(1)))
            n = np.where(known & bit != 0, count[np.minimum(place, len(count) - 1)], 0)
            q = (n + MASS * q) / (total[at] + MASS)
            p[alive] = q
            if depth == DEPTH:
                return
            known = longer[at]
            oldest = U(1) << ((key >> (_BITS * (DEPTH - depth))) & _MASK).astype(U)
            own = np.flatnonzero(known & oldest)
            at = start[at[own]] + np.bitwise_count(known[own] & (oldest[own] - U(1)))
            alive, key, bit, q = alive[own], key[own], bit[own], q[own]


def _top_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (code, next, n) of contexts of TOP classes from the rows of their buckets."""
    for batch in batches:
        for blob in batch.column("blob"):
            pair, count = np.frombuffer(_unpressed(blob.as_py()), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> _BITS), pa.array(pair & _MASK), pa.array(count)], names=["code", "next", "n"])


def blocks_of_states(states: DataFrame) -> Iterator[Block]:
    """The states in blocks of about BLOCK_BYTES, whole buckets each, in their order; one at a time on the driver."""
    rows, held = [], 0
    for row in states.filter(F.col("depth") > TOP).orderBy("bucket", "depth").toLocalIterator():
        if rows and held >= BLOCK_BYTES and row.bucket != rows[-1].bucket:
            yield Block(rows)
            rows, held = [], 0
        rows.append(row)
        held += 48 * row.states + 8 * row.pairs
    if rows:
        yield Block(rows)


def grow(counts: DataFrame, states: DataFrame) -> Tree:
    """The top of the tree from the counts of ``states`` and those of bytes (kind, k, n); it keeps what states stand below."""
    grams = states.filter(F.col("depth") == TOP).select("blob").mapInArrow(_top_counts, "code bigint, next bigint, n bigint")
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("code", _BITS * (TOP - d)).alias("context")) for d in range(TOP + 1)]))
    level = grams.select(levels.alias("l"), "next", "n").groupBy("l.depth", "l.context", "next").agg(F.sum("n").alias("n"))
    level = cut(level)
    level = level.withColumn("all", F.sum("n").over(Window.partitionBy("depth", "context")))
    level = cut(level.filter((F.col("all") >= LEAST_COUNT) | (F.col("depth") == 0)))
    parent = level.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "next", (F.col("n") / F.col("all")).alias("q"))
    child = level.filter("depth > 0").withColumn("suffix", F.shiftright("context", _BITS))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("q")))
    kept = child.join(parent, ["depth", "suffix", "next"]).groupBy("depth", "context").agg(gain.alias("gain")).filter(F.col("gain") >= DIVERGENCE)
    kept = kept.select("depth", "context")
    kept = kept.union(states.filter(F.col("depth") > TOP).select(F.lit(TOP), "bucket").distinct())
    up = F.explode(F.sequence(F.lit(0), "depth"))
    kept = kept.select("depth", "context", up.alias("back")).select((F.col("depth") - F.col("back")).alias("depth"), F.expr(f"shiftright(context, {_BITS} * back)").alias("context"))
    kept = kept.union(kept.sparkSession.createDataFrame([(0, 0)], "depth int, context bigint")).distinct()
    rows = level.join(kept, ["depth", "context"], "left_semi").select("depth", "context", "next", "n").toPandas()  # at most 64 ** TOP contexts of TOP classes
    states: dict[int, dict[int, np.ndarray]] = {}
    for (depth, context), own in rows.groupby(["depth", "context"]):
        n = np.zeros(CLASSES)
        n[own["next"].to_numpy()] = own["n"].to_numpy()
        states.setdefault(int(depth), {})[int(context)] = n
    seen = counts.filter("kind = 2").select("k", "n").toPandas()
    byte = np.zeros(256)
    byte[seen["k"].to_numpy()] = seen["n"].to_numpy()
    return Tree(states, byte)


def _score(tree, blocks, frequent):
    def finished(held: list) -> Iterator[pa.RecordBatch]:
        for block in blocks:  # read, used and let go: a task holds one at a time
            table: Block = block.load_from_path(block._path)
            for _, _, keys, _, p, _, _ in held:
                table.refine(keys, p)
            del table
        for arrays, names, _, back, p, emit, starts in held:
            score = np.add.reduceat(np.log10(p)[back] + emit, starts[:-1])
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score)], names=[*names, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tree = tree.value
        known, log_known = frequent.value
        row = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                hashes, at = words(data, offsets)
                hashes = hashes.view(np.int64)
                counts = np.diff(at)
                classes, raw, starts = symbols(data, offsets)
                keys, back = told_apart((contexts(classes, starts, DEPTH) << _BITS) | classes, near_order)
                emit = np.where(classes > 1, model.emit[raw], 0.0)
                if len(known):
                    spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[spot] == hashes
                    part = np.where(hit, log_known[spot], 0.0)
                else:
                    hit, part = np.zeros(len(hashes), bool), np.zeros(len(hashes))
                sums = np.concatenate([[0.0], np.cumsum(part)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                rare = hits[at] * -1 + at  # tokens left over before each text's first
                arrays = [
                    pa.array(np.arange(row, row + end - first)),
                    batch.column("doc_id").slice(first, end - first),
                    batch.column("held_out").slice(first, end - first),
                    pa.array(counts + 1),
                    pa.array(hits[at[1:]] - hits[at[:-1]]),
                    pa.array(sums[at[1:]] - sums[at[:-1]]),
                    pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(hashes[~hit])),
                ]
                names = ["row", "doc_id", "held_out", "n_tokens", "hits", "part", "rare"]
                held.append((arrays, names, keys, back, model.chances(keys), emit, starts))
                row += end - first
                size += len(classes)
                if size >= CHUNK:
                    yield from finished(held)
                    held, size = [], 0
        yield from finished(held)

    return run


def scored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of doc_id (as text) is a multiple of 10 are held out of training; a null doc_id is not. A null
    or blank text is the end token alone. Repeated rows count and are scored as often as they come. An empty table, or
    one without training documents, gives scores by smoothing alone. Other columns are not read.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    partial = source.filter("NOT held_out").select("text").mapInArrow(_count, "kind int, k bigint, n bigint")
    counts = cut(partial.groupBy("kind", "k").agg(F.sum("n").alias("n")).filter("n > 0"))
    tokens = counts.filter("kind = 0")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    denominator = total.n + ALPHA * (total.v + 1)
    floor = FREQUENT * total.n
    often = tokens.filter(F.col("n") >= floor).select("k", "n").orderBy("k").toPandas()  # at most 1 / FREQUENT words
    ends = tokens.filter(F.col("k") == int(END_HASH)).select("n").head()
    end_count = ends.n if ends else 0
    frequent = sc.broadcast((often["k"].to_numpy(np.int64), np.log10((often["n"].to_numpy(float) + ALPHA) / denominator)))
    states = subtrees(source.filter("NOT held_out"))
    tree = sc.broadcast(grow(counts, states))
    blocks = [sc.broadcast(b) for b in blocks_of_states(states)]
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, hits bigint, part double, rare array<bigint>, score double"
    first = cut(source.mapInArrow(_score(tree, blocks, frequent), schema))
    for block in blocks:
        block.unpersist()
    seldom = cut(tokens.filter((F.col("n") < floor) & (F.col("k") != int(END_HASH))).select("k", "n"))
    log = F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / denominator)
    rest = first.select("row", F.explode("rare").alias("k")).join(seldom, "k", "left")
    rest = rest.groupBy("row").agg(F.sum(log).alias("rest"), F.count("n").alias("known"))
    end_log = float(np.log10((end_count + ALPHA) / denominator))
    return first.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("known", F.lit(0)) + int(end_count > 0)).alias("n_known"),
        F.lit(total.n).cast("bigint").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) + end_log).alias("base_score"),
        "score",
    )
