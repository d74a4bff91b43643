"""Row numbers and keys of files, the landing zone, and files that a rerun repeats."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import analyze, as_table, export
from plumbline.operators import groups as G
from plumbline.sinks.reports import in_files, write_csv
from plumbline.sources.csv import IngestionError, land_csv, landed, load_csv


def exchanges_of(frame):
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for k, n in (("b é%20", 500), ("a", 300), ("c", 700)):
        (path / f"{k}.csv").write_text("k,n,text\n" + "".join(f"{k[0]},{i},{'x' * (i % 50)}\n" for i in range(n)))
    return str(path)


def test_csv_rows_are_numbered_without_moving_cells(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # many blocks, several in a task
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        t = load_csv(spark, folder)
        rows = sorted((r["__row"], r["c0"], r["c1"]) for r in t.df.select("__row", "c0", "c1").collect())
        assert t.df.select("c0").rdd.getNumPartitions() > 5
        moved = exchanges_of(t.df)
        assert moved and not any("c0" in line or "s0" in line for line in moved)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [(i, k, n) for i, (k, n) in enumerate([(k, n) for k, m in (("a", 300), ("b", 500), ("c", 700)) for n in range(m)])]


def test_landed_tables_are_parsed_once(spark, folder, tmp_path):
    target = str(tmp_path / "landed")
    t = land_csv(spark, folder, target)
    again = landed(spark, target)
    assert t.names == again.names == ["k", "n", "text"] and again.columns[1].dtype.simpleString() == "bigint"
    assert "parquet" in again.df._jdf.queryExecution().executedPlan().toString().lower()
    plain = load_csv(spark, folder)
    rows = lambda x: sorted(tuple(r) for r in x.df.collect())
    assert rows(again) == rows(plain)
    assert analyze(again).tally.collect() == analyze(plain).tally.collect()
    with pytest.raises(IngestionError, match="Nothing landed"):
        landed(spark, str(tmp_path / "nowhere"))


def test_rows_of_several_files_have_one_number(spark, tmp_path):
    for name, start in (("x y", 0), ("a%b", 100), ("m#é", 200)):
        spark.range(start, start + 50).selectExpr("id % 120 AS v", "'t' AS s").coalesce(1).write.parquet(str(tmp_path / name))
    frame = spark.read.parquet(*[str(tmp_path / n) for n in ("x y", "a%b", "m#é")])
    t = as_table(frame)
    assert t.df.schema["__row"].dataType.simpleString() == "bigint" and len(t.files) == 3
    labels = sorted(r[0] for r in t.df.select(t.row_label).collect())
    assert labels == sorted(f"{f}#{i}" for f in range(3) for i in range(50))
    order = [r["c0"] for r in t.df.orderBy("__row").select("c0").collect()]  # a%b, m#é, x y
    assert order == [i % 120 for i in [*range(100, 150), *range(200, 250), *range(50)]]
    copies = G.later_copies(t)
    assert copies.count() == G.later_copies_count(t).first()[0] == 60
    issues = analyze(frame).issues.where("issue_type = 'DUPLICATE_ROW'")
    assert {r["row_index"] for r in issues.collect()} == {f"2#{i}" for i in range(30)} | {f"1#{i}" for i in range(20, 50)}


def test_parts_of_a_folder_count_as_one_file(spark, tmp_path):
    for name, start, n in (("b", 0, 90), ("a", 300, 40), ("c", 50, 40), ("d", 0, 0)):
        spark.range(start, start + n, 1, 7).where("id % 100 >= 12").write.parquet(str(tmp_path / name))
    frame = spark.read.parquet(*[str(tmp_path / n) for n in "bacd"])
    assert len(frame.inputFiles()) > 12
    t = as_table(frame, folders=True)
    assert len(t.files) == 4
    rows = sorted((r[0], r[1]) for r in t.df.select(t.row_label, "c0").collect())
    whole = [[v for v in range(a, b) if v % 100 >= 12] for a, b in ((300, 340), (0, 90), (50, 90))]
    assert rows == sorted((f"{f}#{i}", v) for f, own in enumerate(whole) for i, v in enumerate(own))
    one = as_table(spark.read.parquet(str(tmp_path / "b")), folders=True)
    assert not one.files and sorted((r[0], r[1]) for r in one.df.select("__row", "c0").collect()) == list(enumerate(range(12, 90)))


def test_file_keys_sorts_in_many_tasks(spark, tmp_path, monkeypatch):
    from workload import queries

    keys = [(k * 7919 % 1000, k % 13) for k in range(1000)] + [(40, 99), (40, 99), (None, 1)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").repartition(3).write.parquet(str(tmp_path / "in" / "orders.parquet"))
    monkeypatch.setattr(queries, "_scratch", lambda spark: str(tmp_path / "out"))
    monkeypatch.setattr(queries.V, "read", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.row_index for r in queries.file_keys(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "0").glob("*.parquet"))) > 2  # not all rows through one task
    twentieth, fiftieth = (sum(k is not None and k % d == 0 for k, _ in keys) for d in (20, 50))
    later = {f"1#{i}" for i in range(twentieth)} | {f"2#{i}" for i in range(fiftieth)}
    assert later <= got and len(got - later) == 1 and next(iter(got - later)).startswith("0#")


def test_one_file_and_frames_without_files(spark, tmp_path):
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "one"))
    t = as_table(spark.read.parquet(str(tmp_path / "one")))
    assert not t.files and sorted(r[0] for r in t.df.select(t.row_label).collect()) == sorted(map(str, range(20)))
    with pytest.raises(ValueError, match="no file row numbers"):
        as_table(spark.range(3))


def texts(path):
    return [p.read_bytes() for p in sorted(Path(path).glob("part-*.csv"))]


def test_reruns_write_the_same_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS v", "'' AS blank")
    report = analyze(rows, "id")
    written = []
    for i, parts in enumerate((1, 7)):
        frame = in_files(report.issues.repartition(parts, F.rand()), 400)
        write_csv(frame, str(tmp_path / f"out{i}"), one_file=False)
        written.append(texts(tmp_path / f"out{i}"))
    assert written[0] == written[1] and len(written[0]) > 5
    body = [line for text in written[0] for line in text.decode().splitlines()[1:]]
    assert len(body) == report.issue_count == 4000 and body == sorted(body)
    assert max(len(t.decode().splitlines()) for t in written[0]) <= 401
    export(report, str(tmp_path / "all"), "t")
    assert len(texts(tmp_path / "all" / "quality_issues")) == 1
    empty = in_files(report.issues.limit(0))
    write_csv(empty, str(tmp_path / "none"), one_file=False)
    assert len(texts(tmp_path / "none")) == 1
