import pytest

from plumbline import analyze, profile
from plumbline.sources.csv import IngestionError, detect_format, load_csv


@pytest.fixture
def load(spark, tmp_path):
    def run(content: str | bytes, name: str = "data.csv", **options):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return load_csv(spark, str(path), **options)

    return run


def test_types_and_row_numbers(load):
    t = load("id,name,value,flag,gap\n1,Alice,1.5,True,\n2,Bob,2,False,7\n3,,3e2,true,8\n")
    assert [(c.name, c.storage) for c in t.columns] == [
        ("id", "int64"), ("name", "object"), ("value", "float64"), ("flag", "bool"), ("gap", "int64")
    ]
    assert [r["__row"] for r in t.df.orderBy("__row").collect()] == [0, 1, 2]


def test_missing_tokens_and_whitespace(load):
    t = load('a,b\nNA,x\nn/a,"  "\nNULL,""\nnone,None\n')
    assert [c.null_count for c in profile(t).columns] == [3, 2]


def test_repeated_and_empty_headers(load):
    assert load("a,a,,a\n1,2,3,4\n").names == ["a", "a.1", "Unnamed: 2", "a.2"]


def test_latin_1_fallback(load):
    t = load("text,n\nCaf\xe9,1\n".encode("cp1252"))
    assert t.df.first()["c0"] == "Café"
    assert load("text,n\nCafé,1\n".encode(), "utf.csv").df.first()["c0"] == "Café"


def test_quoted_line_breaks_and_doubled_quotes(load):
    t = load('a,b\n"one\ntwo",1\n"say ""hi"", now",2\n')
    assert [r["c0"] for r in t.df.orderBy("__row").collect()] == ["one\ntwo", 'say "hi", now']


def test_short_rows_are_padded(load):
    t = load("a,b,c\n1,2\n4,5,6\n")
    assert [r["c2"] for r in t.df.orderBy("__row").collect()] == [None, 6]


@pytest.mark.parametrize(
    "content, name, message",
    [
        ("", "e.csv", "File is empty"),
        ("id,name\n", "h.csv", "no rows"),
        ("a", "x.txt", "Unsupported file format"),
        ("a,b\n1,2,3\n4,5\n", "long.csv", "more than 2 fields"),
        ('id,name\n1,"unclosed', "q.csv", "never closed"),
    ],
)
def test_load_errors(load, content, name, message):
    with pytest.raises(IngestionError, match=message):
        load(content, name)


def test_missing_file(spark):
    with pytest.raises(IngestionError, match="File not found"):
        load_csv(spark, "/tmp/no-such-file.csv")
    assert detect_format("A.CSV") == "csv"


def test_first_rows_only(load):
    t = load("id,v\n" + "\n".join(f"{i},{i * 10}" for i in range(100)), sample_size=10)
    assert t.n_rows == 10 and sorted(r["c0"] for r in t.df.collect()) == list(range(10))


def test_several_files_are_numbered_through(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("v\n" + "\n".join(str(10 * k + i) for i in range(4)) + "\n")
    t = load_csv(spark, str(tmp_path))
    assert [(r["__row"], r["c0"]) for r in t.df.orderBy("__row").collect()] == [
        (4 * k + i, 10 * k + i) for k in range(3) for i in range(4)
    ]


def test_key_column(load):
    report = analyze(load("k,v\nrow_a,1\nrow_b,\n", row_key="k"))
    assert [r.row_index for r in report.issues.collect()] == ["row_b"]
