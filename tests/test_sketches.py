"""Medians of many columns together, samples from one scan, and profiles kept as mergeable sketches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import as_table
from plumbline.operators import profile as P
from plumbline.operators import sketches as K


def jobs_of(spark, run):
    """How many jobs a call starts."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


def test_medians_of_many_columns_share_their_rounds(spark):
    rng = random.Random(1)
    draws = [lambda i: rng.gauss(0, 1), lambda i: rng.choice([1.0, 2.0]), lambda i: 10.0 ** rng.uniform(-200, 200), lambda i: float(i % 7), lambda i: -0.5, lambda i: None if i % 3 else rng.random()]
    rows = [tuple(draws[k % 6](i) for k in range(12)) for i in range(3001)]
    names = [f"x{k}" for k in range(12)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).cache()
    frame.count()
    values = {n: [r[k] for r in rows if r[k] is not None] for k, n in enumerate(names)}
    counts = {n: len(v) for n, v in values.items()}
    out, many = jobs_of(spark, lambda: P.large_medians(frame, counts, 25))
    assert out == {n: statistics.median(v) for n, v in values.items()}
    _, few = jobs_of(spark, lambda: P.large_medians(frame, {n: counts[n] for n in names[:6]}, 25))
    assert many <= few + 2


def test_samples_of_sparse_columns_come_from_one_scan(spark):
    n = 2000
    cells = [F.when(F.col("id") % (100 + k) == 99, F.concat(F.lit(f"{k}:"), F.col("id"))).alias(f"c{k}") for k in range(8)]
    t = as_table(spark.range(n).select("id", *cells), "id", key_is_data=False)
    found, jobs = jobs_of(spark, lambda: P.first_values(t))
    for k in range(8):
        assert found[f"c{k}"] == [f"{k}:{i}" for i in range(n) if i % (100 + k) == 99][:5]
    assert jobs <= 6


def test_samples_where_keys_are_missing_or_repeated(spark):
    rows = [(None, "n")] * 3 + [(1, None)] * 70 + [(2, "b"), (2, "a")]
    t = as_table(spark.createDataFrame(rows, "id bigint, v string"), "id", key_is_data=False)
    assert P.first_values(t)["c0"] == ["a", "b", "n", "n", "n"]


def test_samples_where_most_keys_are_missing(spark):
    rows = [(None, f"n{i:03}") for i in range(200)] + [(5, "b"), (3, "a")]
    t = as_table(spark.createDataFrame(rows, "id bigint, v string"), "id", key_is_data=False)
    assert P.first_values(t)["c0"] == ["a", "b", "n000", "n001", "n002"]
    assert P.first_values(type(t)(t.df.limit(0), t.columns)) == {"c0": []}


@pytest.fixture
def sold(spark):
    cells = "id % 5 AS day", "CASE WHEN id % 11 = 0 THEN NULL ELSE pmod(xxhash64(id), 20000) / 100e0 END AS price", "concat('n', id % 3000) AS name", "id % 2 = 0 AS flag"
    return as_table(spark.range(20000).selectExpr("id", *cells), "id", key_is_data=False)


def test_sketch_of_parts_is_the_sketch_of_the_whole(spark, sold, tmp_path):
    path = str(tmp_path / "state")
    for day in range(5):
        K.add_sketches(type(sold)(sold.df.where(F.col("c0") == day), sold.columns), path, ["day"])
    parts = spark.read.parquet(path)
    assert parts.count() == 15 and {r["day"] for r in parts.select("day").collect()} == set(range(5))
    one, all_ = (K.sketched_profile(K.merged(p)).drop("day").orderBy("ordinal").collect() for p in (parts, K.sketches(sold, ["day"])))
    whole = K.sketched_profile(K.sketches(type(sold)(sold.df, sold.columns[1:]))).orderBy("ordinal").collect()
    prices = sorted(r[0] for r in sold.df.where("c1 IS NOT NULL").select("c1").collect())
    true = {"price": len(set(prices)), "name": 3000, "flag": 2}
    for rows in (one, all_, whole):
        for r in rows:
            assert (r.n_rows, r.null_count) == (20000, 1819 if r.column_name == "price" else 0)
            assert abs(r.distinct_estimate - true[r.column_name]) <= K.DISTINCT_ERROR * true[r.column_name]
        price, name = rows[0], rows[1]
        assert (price.min_value, price.max_value) == (prices[0], prices[-1])
        assert price.mean_value == pytest.approx(statistics.fmean(prices)) and price.std_value == pytest.approx(statistics.stdev(prices))
        for q, value in ((0.25, price.q25), (0.5, price.q50), (0.75, price.q75)):
            below = sum(p < value for p in prices), sum(p <= value for p in prices)
            assert below[0] - K.RANK_ERROR * len(prices) <= q * len(prices) <= below[1] + K.RANK_ERROR * len(prices)
        assert (name.min_length, name.max_length, name.q50, name.mean_value) == (2, 5, None, None)
    assert [r.distinct_estimate for r in one] == [r.distinct_estimate for r in whole]


def test_sketches_of_days_and_of_nothing(spark, sold):
    days = K.merged(K.sketches(sold, ["day"]), ["day"])
    assert days.count() == 15 and days.agg(F.sum("n_rows")).first()[0] == 60000
    empty = type(sold)(sold.df.limit(0), sold.columns)
    row = K.sketched_profile(K.merged(K.sketches(empty))).where("column_name = 'price'").first()
    assert (row.n_rows, row.distinct_estimate, row.q50, row.mean_value) == (0, 0, None, None)
