"""Toxicity of texts by subword-bag embeddings under a linear softmax, trained in numpy.

A word (a run of letters and digits, in lower case) is the bag of its character n-grams with its borders marked, hashed to
BUCKETS vectors; a word it has never seen shares the vectors of its parts with those it has. A word's vector is the mean
of its bag, and a softmax over two classes reads the mean of a window. A text is cut into windows of WINDOW words, whatever its
length, and scores as its most toxic window, so that one passage in a long clean text counts. A window's mean is over WINDOW
places: repeats of a word and missing words are places with a vector of zeros, so that a word said twenty times weighs no more
than a word said once.
Embeddings and softmax are trained together: first with every window under its text's label, then with the window that
decides a text's score.

Only TRAIN_TEXTS rows are fitted on (a bound of the training sample alone; every text is scored, whole): labelled rows with the
smallest hash of doc_id, as many toxic as others at most, of at most TRAIN_CHARS characters, outside the held-out quarter. As
the softmax is linear, tasks need one number per bucket: its vector's product with the difference of the two class vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship, text_of
from plumbline.llm.textnum import U, mix, randoms

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5, 6)
LONGEST = 40  # characters of a word that count for its bag; a longer run is split into several words
WINDOW = 24
TRAIN_TEXTS = 10_000
TRAIN_CHARS = 8_000
STEPS = 240
RATE = 0.1
DECAY = 2e-6
THRESHOLD = 0.3
SLICE_CHARS = 1 << 20

_FACTORS = randoms(max(NGRAMS) + 1, 71) | U(1)


def held_out(doc_id: Column) -> Column:
    """Is this row in the quarter that is never learnt from? A row without doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Bags:
    """Words of some texts: ``window`` and ``word`` list each window's distinct words by their number in the table of all;
    ``text`` gives each window's text. The n-grams of the distinct words stand in ``grams`` from ``starts`` on."""

    word: np.ndarray
    window: np.ndarray
    text: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    texts: int
    hashes: np.ndarray  # of the distinct words


def bags(texts: list[str]) -> Bags:
    """Cut texts into words, windows and n-grams, all at once."""
    whole = " " + " ".join(t.lower() for t in texts) + " "
    chars = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1
    solid = ((chars >= 97) & (chars <= 122)) | ((chars >= 48) & (chars <= 57)) | ((chars >= 0xAA) & (chars < 0x2000)) | (chars >= 0x2E80)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, end = edges[0::2], edges[1::2]
    over = (end - first - 1) // LONGEST  # a long run becomes several words
    if over.any():
        part = np.concatenate([[0], np.cumsum(over + 1)])
        nth = np.arange(part[-1]) - np.repeat(part[:-1], over + 1)
        stop = np.repeat(end, over + 1)
        first = np.repeat(first, over + 1) + nth * LONGEST
        end = np.minimum(first + LONGEST, stop)
    owner = np.searchsorted(begins, first, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
    windows = -(-counts // WINDOW)
    at = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.repeat(np.cumsum(windows) - windows, counts) + at // WINDOW

    # A word's hash is taken over its characters by a polynomial, read off one running sum.
    base = int(_FACTORS[0])
    powers = np.concatenate([[U(1)], np.cumprod(np.full(len(chars), U(base)), dtype=U)])
    sums = np.zeros(len(chars) + 1, U)
    np.cumsum(mix(chars.astype(U)) * powers[:-1], out=sums[1:])
    inverse = np.cumprod(np.concatenate([[U(1)], np.full(len(chars), U(pow(base, -1, 1 << 64)))]), dtype=U)
    hashes = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(U))
    _, place, word = np.unique(hashes, return_index=True, return_inverse=True)
    first, end = first[place], end[place]

    # Distinct words side by side, each with a border before and behind.
    size = end - first + 2
    start = np.concatenate([[0], np.cumsum(size)])
    line = np.ones(start[-1], U)
    inside = np.arange(start[-1]) - np.repeat(start[:-1], size)
    real = (inside > 0) & (inside < np.repeat(size, size) - 1)
    line[real] = mix(chars[np.repeat(first, size)[real] + inside[real] - 1].astype(U) + U(5))
    left = np.repeat(size, size) - inside  # characters from here to the word's end
    parts, owners = [mix(hashes[place] + U(9)) % U(BUCKETS)], [np.arange(len(first))]
    word_of = np.repeat(np.arange(len(first)), size)
    for n in NGRAMS:
        go = np.flatnonzero(left >= n)
        total = np.full(len(go), U(n))
        for k in range(n):
            total += line[go + k] * _FACTORS[k + 1]
        parts.append(mix(total) % U(BUCKETS))
        owners.append(word_of[go])
    owner_of = np.concatenate(owners)
    order = np.argsort(owner_of, kind="stable")
    starts = np.searchsorted(owner_of[order], np.arange(len(first) + 1))
    text = np.repeat(np.arange(len(texts)), windows)
    places = np.unique(window * np.int64(len(first) + 1) + word)
    window, word = places // (len(first) + 1), places % (len(first) + 1)
    return Bags(word, window, text, np.concatenate(parts)[order].astype(np.int32), starts, len(texts), hashes[place])


def sliced(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE_CHARS characters, in order."""
    first = chars = 0
    for i, text in enumerate(texts):
        if i > first and chars + len(text) > SLICE_CHARS:
            yield texts[first:i]
            first, chars = i, 0
        chars += len(text)
    if first < len(texts):
        yield texts[first:]


def joined(parts: list[Bags]) -> Bags:
    """Bags of several runs of texts as one: a word has one number in all of them."""
    all_hashes = np.concatenate([b.hashes for b in parts])
    hashes, first, number = np.unique(all_hashes, return_index=True, return_inverse=True)
    words = np.cumsum([0, *[len(b.hashes) for b in parts]])
    windows = np.cumsum([0, *[len(b.text) for b in parts]])
    texts = np.cumsum([0, *[b.texts for b in parts]])
    grams = np.concatenate([b.grams for b in parts])
    begins = np.concatenate([b.starts[:-1] + at for b, at in zip(parts, np.cumsum([0, *[len(b.grams) for b in parts]]))])
    sizes = np.concatenate([np.diff(b.starts) for b in parts])[first]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    grams = grams[np.repeat(begins[first] - starts[:-1], sizes) + np.arange(starts[-1])]
    return Bags(
        np.concatenate([number[words[i] : words[i + 1]][b.word] for i, b in enumerate(parts)]),
        np.concatenate([b.window + windows[i] for i, b in enumerate(parts)]),
        np.concatenate([b.text + texts[i] for i, b in enumerate(parts)]),
        grams, starts, int(texts[-1]), hashes,
    )


def window_logits(bag: Bags, per_bucket: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of toxic against not for every window."""
    if not len(bag.text):
        return np.empty(0)
    sizes = np.diff(bag.starts)
    words = np.add.reduceat(per_bucket[bag.grams], bag.starts[:-1]) / sizes
    return np.bincount(bag.window, words[bag.word], minlength=len(bag.text)) / WINDOW + bias


def text_logits(bag: Bags, logits: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of every text: its most toxic window's; of a text without words, the bias."""
    out = np.full(bag.texts, -np.inf)
    np.maximum.at(out, bag.text, logits)
    return np.where(np.isneginf(out), bias, out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    classes: np.ndarray  # DIM x 2
    biases: np.ndarray  # 2

    def per_bucket(self) -> np.ndarray:
        return self.vectors @ (self.classes[:, 1] - self.classes[:, 0])

    @property
    def bias(self) -> float:
        return float(self.biases[1] - self.biases[0])


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """Embeddings and softmax from labelled texts by Adam on the weighted cross entropy of all of them.

    A gradient of a window's vector is a multiple of the difference of the class vectors, so what reaches a bucket is one
    number, its share of the windows' errors.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.5, (BUCKETS, DIM)) / DIM, rng.normal(0, 0.5, (DIM, 2)), np.zeros(2))
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    share = min(max(share, 0.001), 0.999)
    model.biases[1] = np.log(share / (1 - share))
    if not len(labels) or labels.min() == labels.max():
        model.vectors[:] = 0
        return model
    bag = joined([bags(some) for some in sliced(texts)])
    used, grams = np.unique(bag.grams, return_inverse=True)
    grams = grams.astype(np.int32)
    if not len(bag.text):  # no words at all
        return model
    sizes = np.diff(bag.starts)
    per_text = np.bincount(bag.text, minlength=bag.texts)
    vectors = model.vectors[used]
    moments = [np.zeros_like(x) for x in (vectors, vectors, model.classes, model.classes, model.biases, model.biases)]
    for step in range(1, steps + 1):
        line = model.classes[:, 1] - model.classes[:, 0]
        words = np.add.reduceat((vectors @ line)[grams], bag.starts[:-1]) / sizes
        logits = np.bincount(bag.window, words[bag.word], minlength=len(bag.text)) / WINDOW + model.bias
        errors = sigmoid(logits) - labels[bag.text]
        if step <= steps // 6:
            errors *= weights[bag.text] / per_text[bag.text]
        else:  # only the window that decides
            top = text_logits(bag, logits, model.bias)
            errors = np.where(logits == top[bag.text], errors * weights[bag.text], 0.0)
        errors /= weights.sum()
        of_word = np.bincount(bag.word, (errors / WINDOW)[bag.window], minlength=len(sizes)) / sizes
        of_bucket = np.bincount(grams, np.repeat(of_word, sizes), minlength=len(used))
        slope = vectors.T @ of_bucket
        steps_ = (
            np.outer(of_bucket, line) + DECAY * vectors,
            np.stack([-slope, slope], axis=1) + DECAY * model.classes,
            np.array([-errors.sum(), errors.sum()]),
        )
        for i, (value, gradient) in enumerate(zip((vectors, model.classes, model.biases), steps_)):
            mean, square = moments[2 * i], moments[2 * i + 1]
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            value -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.vectors[:] = 0  # a bucket that no training word has says nothing
    model.vectors[used] = vectors
    return model


def training_rows(docs: DataFrame, labels: DataFrame, n: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of labelled texts, their labels and weights that restore the share of each label."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id", F.lit(19)))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    parts = [marks.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(n // 2) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text").cast("string")).alias("text"))
    texts = texts.where(F.length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").dropDuplicates(["doc_id", "text"]).orderBy("draw", "doc_id", "text").limit(n)
    rows = rows.select("text", "toxic").collect()
    y = np.array([r["toxic"] for r in rows], float)
    weights = np.array([sizes.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y.astype(int)] if len(y) else y
    return [r["text"] for r in rows], y, weights / weights.mean() if len(y) else weights


def _scores(per_bucket: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in sliced(batch.column("text").to_pylist()):
                top = sigmoid(_text_scores(texts, per_bucket, bias))
                ids, held = (batch.column(c).slice(first, len(texts)) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(top)], names=["doc_id", "held_out", "score"])
                first += len(texts)

    return run


def _text_scores(texts: list[str], per_bucket: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of some texts; a single very long one is read in pieces that end at blanks, and windows start anew there."""
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_CHARS:
        text, top, at = texts[0], bias, 0
        best = -np.inf
        while at < len(text):
            end = text.find(" ", at + SLICE_CHARS, at + 2 * SLICE_CHARS)
            end = end if end >= 0 else at + SLICE_CHARS
            bag = bags([text[at:end]])
            logits = window_logits(bag, per_bucket, bias)
            best = max(best, logits.max(initial=-np.inf))
            at = end
        return np.array([top if np.isneginf(best) else best])
    bag = bags(texts)
    return text_logits(bag, window_logits(bag, per_bucket, bias), bias)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of toxic), predicted (1 from THRESHOLD on).

    A null text counts as empty; a text without words scores by the bias, the share of toxic rows as far as training left
    it. Of several labels of a doc_id the greatest holds; null labels and those of the held-out quarter are not read. With no
    labels, or labels of one kind only, all texts score alike. Repeated rows are all scored; other columns are not read.
    """
    ship(docs.sparkSession)
    texts, y, weights = training_rows(docs, labels)
    model = fit(texts, y, weights)
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"), text_of(F.col("text").cast("string")).alias("text")
    )
    out = source.mapInArrow(_scores(model.per_bucket(), model.bias), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
