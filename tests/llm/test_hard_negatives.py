"""Mined triples against brute force."""

import math
import random

import pytest

from plumbline.llm.hard_negatives import hard_negatives, mined_labels

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows):
    data = {}
    for vec_id, v, label, _ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        data[(vec_id, label, tuple(math.floor(256 * x) for x in v))] = True
    out = []
    for a in data:
        if a[0] % 50:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: E731, B023
        order = sorted((-score(r), r[0]) for r in data if r != a and r[1] == a[1])[:5]
        for s, i in order:
            p = -s
            near = sorted((-score(r), r[0]) for r in data if r[1] != a[1] and 50 * p <= 100 * score(r) <= 95 * p)[:3]
            out += [(a[0], i, k + 1, j, p, -n) for k, (n, j) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, *grid):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(mined_labels(frame), *grid).collect())


def vector(rng, n=6, coarse=False):
    return [float(rng.choice([-0.5, 0.0, 0.25, 0.5])) if coarse else rng.uniform(-1, 1) for _ in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("grid", [(8192, 1024), (37, 2)])
def test_equals_brute_force(spark, coarse, grid):
    rng = random.Random(coarse)
    rows = [(i, vector(rng, coarse=coarse), rng.randrange(3), "s") for i in range(300)]
    expected = brute(rows)
    assert expected and mined(spark, rows, *grid) == expected


def test_scores_of_zero_and_below(spark):
    rng = random.Random(3)
    rows = [(i, [0.0, 0.0] if i % 2 else vector(rng, 2, True), rng.randrange(2) + 3 * (i % 3 == 0), "s") for i in range(120)]
    assert mined(spark, rows, 16, 1) == brute(rows)


def test_rows_that_take_no_part_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, vector(rng), rng.randrange(2), None) for i in range(110)]
    rows += [rows[0], rows[3], (None, vector(rng), 1, "s"), (200, None, 1, "s"), (250, vector(rng), None, "s"), (300, [0.5, None], 1, "s")]
    rows += [(350, [float("nan")] * 6, 1, "s"), (400, [float("inf")] + [0.0] * 5, 1, "s")]
    assert mined(spark, rows, 20, 2) == brute(rows)


def test_one_vector_and_one_label_for_most_rows(spark):
    rng = random.Random(5)
    rows = [(i, [0.5] * 6 if i % 3 else vector(rng), 1 if i % 4 else rng.randrange(5), "s") for i in range(200)]
    assert mined(spark, rows, 64, 2) == brute(rows)


def test_tables_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1, "s"), (2, [1.0], 2, "s")]) == []


def test_short_and_large_vectors(spark):
    rows = [(100, [1.0, 2.0], 1, "s"), (1, [1.0], 1, "s"), (2, [0.7, 0.0, 9.0], 2, "s"), (3, [], 2, "s"), (50, [30000.0] * 2, 2, "s"), (4, [30000.0] * 2, 2, "s"), (5, [25000.0] * 2, 1, "s")]
    out = mined(spark, rows)
    assert (100, 1, 1, 2, 65536, 256 * 179) in out  # 0.7 scales to 179; missing components are zeros
    large = (256 * 30000) ** 2 * 2
    assert (50, 4, 1, 5, large, 256 * 30000 * 256 * 25000 * 2) in out
