"""Hard-negative mining by a secondary sort.

A pair of an anchor and a row has a score, the integer inner product of their vectors. Pairs travel under the key (anchor,
score descending, id); a partition holds whole anchors in this order, and one pass over it keeps at most POSITIVES
open windows of the current anchor: a row of the anchor's label opens a window below its own score, a row of another label
is given to the windows it lies in, until each has NEGATIVES. Nothing else of an anchor is held.

Anchors meet all rows, so what is shuffled is pruned before: rows and anchors are dealt to the cells of a grid, each of a
bounded number of both, which score their block by one matrix product. A first run over the grid keeps the best POSITIVES of
every anchor and cell, which are merged by the same sort; a second one, which knows the windows, keeps the best NEGATIVES of
every window and cell. Both keep all that can be among the first overall, so nothing is lost. A row goes to every
column of the grid and an anchor to every row of it, so the shuffle grows with rows times anchors / CELL_ANCHORS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, ship

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
ANCHOR_EVERY = 50
CELL_ROWS, CELL_ANCHORS = 8192, 1024
STEP = 1 << 21  # scores of a matrix product at a time
#: Largest component after scaling; a longer vector's scores need not fit a long.
LARGEST = 1 << 24
PAIRS = "anchor bigint, mark bigint, score bigint, id bigint, tag bigint, same boolean"


def mined_labels(rows: DataFrame) -> DataFrame:
    """Every seventh row with its label moved on by one, as the contract has it."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


def vectors(rows: DataFrame) -> DataFrame:
    """Rows that take part: id, tag (tells rows of one id apart), label, v (scaled components)."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < LARGEST / SCALE, F.floor(x * SCALE).cast("bigint")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    out = rows.where(usable).select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), scaled.alias("v"))
    out = out.where(F.forall("v", lambda x: x.isNotNull()))
    return out.withColumn("tag", F.xxhash64("label", "v"))


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    sizes = lists.map(len).to_numpy()
    out = np.zeros((len(lists), width))
    if len(lists) and (sizes == width).all():
        out[:] = np.stack(lists.to_numpy()) if width else 0
    else:
        for i, values in enumerate(lists):
            out[i, : len(values)] = values
    return out


def _block(rows: pd.DataFrame, anchors: pd.DataFrame):
    """The cell's rows in order of (id, tag) without repeats, and its scores for some anchors at a time:
    (positions of anchors, scores with the anchor itself at -inf, same label, itself)."""
    key = ["id", "tag"]
    rows = rows.drop_duplicates(key).sort_values(key, ignore_index=True)
    anchors = anchors.drop_duplicates(key).sort_values(key, ignore_index=True)
    width = max([len(v) for v in rows["v"]] + [len(v) for v in anchors["v"]], default=0)
    wide, tall = _matrix(rows["v"], width), _matrix(anchors["v"], width)
    # Doubles hold the products exactly while they stay below 2**53; longer ones are multiplied as integers.
    if width * (np.abs(wide).max(initial=0) * np.abs(tall).max(initial=0)) >= 2.0**53:
        wide, tall = wide.astype(np.int64), tall.astype(np.int64)

    def scores() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, STEP // max(1, len(rows)))
        for a in range(0, len(anchors), step):
            some = np.arange(a, min(a + step, len(anchors)))
            product = (tall[some] @ wide.T).astype(np.int64)
            same = anchors["label"].to_numpy()[some, None] == rows["label"].to_numpy()[None, :]
            itself = (anchors["id"].to_numpy()[some, None] == rows["id"].to_numpy()) & (anchors["tag"].to_numpy()[some, None] == rows["tag"].to_numpy())
            yield some, product, same & ~itself, ~same

    return rows, anchors, scores


_NONE = np.iinfo(np.int64).min


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``n`` best allowed rows of every anchor, one at a time: (which anchors have one, its position). Rows are in the
    order of their ids, and argmax takes the first of equals."""
    left = np.where(allowed, scores, _NONE)
    if not left.shape[1]:
        return
    for _ in range(n):
        at = left.argmax(axis=1)
        have = np.flatnonzero(left[np.arange(len(left)), at] != _NONE)
        if not len(have):
            return
        yield have, at[have]
        left[have, at[have]] = _NONE


def _frame(rows: pd.DataFrame, anchors: pd.DataFrame, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], same: bool) -> pd.DataFrame:
    who, what, score = (np.concatenate(p) if found else np.empty(0, np.int64) for p in (zip(*found) if found else ((), (), ())))
    one, two = anchors.iloc[who], rows.iloc[what]
    return pd.DataFrame(
        {
            "anchor": one["id"].to_numpy(), "mark": one["tag"].to_numpy(), "score": score.astype(np.int64),
            "id": two["id"].to_numpy(), "tag": two["tag"].to_numpy(), "same": np.full(len(who), same),
        }
    )


def _positives(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    rows, anchors, scores = _block(rows, anchors)
    found = []
    for some, score, same, _ in scores():
        for have, at in _best(score, same, POSITIVES):
            found.append((some[have], at, score[have, at]))
    return _frame(rows, anchors, found, True)


def _negatives(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    rows, anchors, scores = _block(rows, anchors)
    windows = np.full((len(anchors), POSITIVES), _NONE)
    for i, own in enumerate(anchors["windows"]):
        windows[i, : len(own)] = own
    found = []
    for some, score, _, other in scores():
        for slot in range(POSITIVES):
            p = windows[some, slot]
            inside = other & (p >= 0)[:, None] & (100 * score >= (LOW * np.maximum(p, 0))[:, None]) & (100 * score <= (HIGH * np.maximum(p, 0))[:, None])
            for have, at in _best(score, inside, NEGATIVES):
                found.append((some[have], at, score[have, at]))
    return _frame(rows, anchors, found, False).drop_duplicates()


def _cells(rows: DataFrame, anchors: DataFrame, lines: int, columns: int, run) -> DataFrame:
    """``run`` over every cell of the grid."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("line", F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int")).withColumn("column", every(columns))
    met = anchors.toDF(*anchors.columns).withColumn("column", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(columns)).cast("int")).withColumn("line", every(lines))
    return dealt.groupBy("line", "column").cogroup(met.groupBy("line", "column")).applyInPandas(run, PAIRS)


def _in_order(pairs: DataFrame) -> DataFrame:
    """The secondary sort: whole anchors in a partition, their pairs by score and id. At equal scores and ids, positives and
    the tag decide."""
    key = ["anchor", "mark", F.col("score").desc(), "id", F.col("same").desc(), "tag"]
    return pairs.repartition("anchor", "mark").sortWithinPartitions(*key)


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first POSITIVES pairs of every anchor, off pairs in order."""
    now, seen = None, 0
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, key in enumerate(zip(batch["anchor"], batch["mark"])):
            now, seen = (now, seen + 1) if key == now else (key, 1)
            keep[i] = seen <= POSITIVES
        yield batch[keep]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mined triples of every anchor, off its pairs in order."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    now, opened, level, ties = None, [], None, []
    for batch in batches:
        out = []
        for anchor, mark, score, row, same in zip(batch["anchor"], batch["mark"], batch["score"], batch["id"], batch["same"]):
            if (anchor, mark) != now:
                now, opened, level, ties = (anchor, mark), [], None, []
            if score != level:
                level, ties = score, []
            if same:
                opened.append([row, score, 0])
                fits = ties if score == 0 else []  # only a window at 0 holds rows of its own score, which may have come before
                for other in fits:
                    opened[-1][2] += 1
                    out.append((anchor, row, opened[-1][2], other, score, score))
                continue
            if len(ties) < NEGATIVES:
                ties.append(row)
            for window in opened:
                p = window[1]
                if window[2] < NEGATIVES and LOW * p <= 100 * score <= HIGH * p:
                    window[2] += 1
                    out.append((anchor, window[0], window[2], row, p, score))
        yield pd.DataFrame(out, columns=names)


def hard_negatives(rows: DataFrame, cell_rows: int = CELL_ROWS, cell_anchors: int = CELL_ANCHORS) -> DataFrame:
    """Rows (vec_id, embedding, label) to triples: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    A row without vec_id, label or vector, or with a component that is null, not finite or beyond 2**16 (whose scores would not
    fit) takes no part. A shorter vector counts as filled up with zeros. Rows equal in all three columns are one; rows
    that only share a vec_id are rows of their own. An empty table gives no rows; other columns are not read.
    """
    ship(rows.sparkSession)
    data = cut(vectors(rows))
    anchors = data.where(F.col("id") % ANCHOR_EVERY == 0)
    n_rows, n_anchors = data.agg(F.count("*"), F.count_if(F.col("id") % ANCHOR_EVERY == 0)).head()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], schema)
    grid = -(-n_rows // cell_rows), -(-n_anchors // cell_anchors)
    best = cut(_in_order(_cells(data, anchors, *grid, _positives)).mapInPandas(_first, PAIRS))
    scores = best.groupBy(F.col("anchor").alias("id"), F.col("mark").alias("tag")).agg(F.collect_list("score").alias("windows"))
    found = _cells(data, anchors.join(scores, ["id", "tag"]), *grid, _negatives)
    return _in_order(best.union(found)).mapInPandas(_windows, schema)
