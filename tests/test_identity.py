"""Rows are told apart by what they hold, not by a key that may be NULL or repeated."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline import analyze, as_table
from plumbline.operators import groups as G
from plumbline.operators.bloom import WORDS, bloom, thinned

ROWS = [(1, "a"), (1, "a"), (2, "b"), (None, "z"), (None, "z"), (3, "a"), (3, "a"), (3, "a"), (4, None), (4, None), (5, "c")]


def listed(frame):
    return Counter(r["__row"] for r in frame.collect())


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id bigint, v string")


@pytest.mark.parametrize("part_rows", [2, 10**6])
def test_copies_of_a_keyed_table_are_listed(rows, part_rows):
    t = as_table(rows, "id")
    assert listed(G.later_copies(t, part_rows)) == {1: 1, None: 1, 3: 2, 4: 1}
    assert G.later_copies_count(t).first()[0] == G.compared_copies_count(t).first()[0] == 5


@pytest.mark.parametrize("part_rows", [2, 10**6])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_copies_under_a_label_that_is_no_data(spark, rows, key, part_rows):
    t = as_table(rows.withColumn("id", F.col("id").cast(key)), "id", key_is_data=False)
    found = {None if k is None else int(k): n for k, n in listed(G.later_copies(t, part_rows)).items()}
    assert found == {1: 1, 3: 3, None: 1, 4: 1}  # of the five a's the first with key 1 stays; of the two z's one
    assert sum(found.values()) == G.later_copies_count(t).first()[0]


def test_colliding_fingerprints_are_told_apart_by_the_cells(rows):
    t = as_table(rows, "id")

    def constant(columns):
        return [F.lit(7).cast("bigint").alias("k0"), F.lit(8).cast("bigint").alias("k1")]

    assert listed(G.later_copies(t, fingerprint=constant)) == listed(G.later_copies(t))
    assert G.compared_copies_count(t, constant).first()[0] == 5
    label = as_table(rows, "id", key_is_data=False)
    assert listed(G.later_copies(label, fingerprint=constant)) == listed(G.later_copies(label))


@pytest.mark.parametrize("part_rows", [2, 10**6])
def test_repeated_texts_under_repeated_and_missing_keys(spark, part_rows):
    data = [(1, "a"), (1, "b"), (2, "a"), (None, "z"), (None, "z"), (None, "y"), (2, None)]
    t = as_table(spark.createDataFrame(data, "id bigint, v string"), "id")
    found = Counter((r["__row"], r["k0"]) for r in G.repeated_values(t, t.columns[1], part_rows).collect())
    assert found == {(1, "a"): 1, (2, "a"): 1, (None, "z"): 2}
    assert G.repeated_values_count(t, t.columns[1]).first()[0] == 4


def test_issue_rows_equal_the_tally(spark):
    data = ROWS + [(None, None), (6, "  "), (6, "  ")]
    report = analyze(
        spark.createDataFrame(data, "id bigint, v string"), "id", id_columns=["v", "id"],
        rules=[{"name": "u", "type": "uniqueness", "column": "v", "severity": "LOW"}],
    )
    key = ["issue_type", "column"]
    counted = {(r["issue_type"], r["column"]): r["n"] for r in report.tally.collect()}
    assert counted == {(r["issue_type"], r["column"]): r["count"] for r in report.issues.groupBy(*key).count().collect()}
    assert counted[("DUPLICATE_ROW", None)] == 6
    texts = report.issues.where("issue_type = 'DUPLICATE_ID' AND column = 'v'")
    assert texts.where(F.col("row_index").isNull()).count() == 2


def test_bloom_filter_keeps_all_keys_and_few_others(spark):
    frame = spark.range(20000).select("id", F.xxhash64("id").alias("k0"), F.xxhash64(F.lit(1), "id").alias("k1"))
    words = bloom(frame.where("id % 10 = 0").select("k0", "k1"))
    assert words.count() <= WORDS
    kept = {r["id"] for r in thinned(frame, words).collect()}
    assert {i for i in range(0, 20000, 10)} <= kept and len(kept) < 2100
    assert thinned(frame, bloom(frame.limit(0).select("k0", "k1"))).isEmpty()


def test_only_candidates_are_shuffled_with_their_cells(spark):
    t = as_table(spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("long"), (F.col("id") % 999).alias("v")), "id", key_is_data=False)
    assert listed(G.later_copies(t)) == {999: 1}
    assert 2 <= G.copied_rows(t).count() <= 10 and G.compared_copies_count(t).first()[0] == 1
