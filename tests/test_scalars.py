import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import scalars as S
from plumbline.functions.names import words

TEXT = T.StringType()


@pytest.fixture(scope="module")
def evaluate(spark):
    """Value of a SQL expression over column ``v`` for each of the given texts."""

    def run(expression, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.x for r in rows.select("i", F.expr(expression).alias("x")).orderBy("i").collect()]

    return run


def test_strip_removes_what_python_removes(evaluate):
    values = ["a", " a ", "\ta\n", "\u2003a\xa0", "\x1ca\x1f", "", "   ", "a b", "\u3000", "\xe9", "\xe1 ", None]
    values += [f"{ch}x{ch}" for ch in S.WHITESPACE]
    assert evaluate(S.strip("v"), values) == [None if v is None else v.strip() for v in values]


def test_numbers(evaluate):
    good = {"1": 1.0, " 2.5 ": 2.5, "-3": -3.0, "+4": 4.0, "1e5": 1e5, ".5": 0.5, "5.": 5.0, "inf": float("inf")}
    bad = ["1,000", "1_000", "0x10", "1d", "1.5f", "abc", "", " ", "-", ".", "1 2", "nan?"]
    got = evaluate(S.to_number("v", TEXT), list(good) + bad)
    assert got == list(good.values()) + [None] * len(bad)


def test_lenient_numbers(evaluate):
    good = ["$100.00", "$2,500.50", "45%", "\u20ac 3", "nan", " 7 ", "-1"]
    bad = ["abc", "", "-", ".", "-.", "$", "12x"]
    assert evaluate(S.is_lenient_number(f"({S.strip('v')})"), good + bad) == [True] * len(good) + [False] * len(bad)


def test_patterns(evaluate):
    values = ["a@b.com", "a@b", "http://x.org/p", "HTTPS://xy", "555-123-4567", "(555) 123-4567", "5551234567", "$1,000.00", "£1000.00", "9.99"]
    assert [i for i, x in enumerate(evaluate(S.is_email("v"), values)) if x] == [0]
    assert [i for i, x in enumerate(evaluate(S.is_url("v"), values)) if x] == [2, 3]
    assert [i for i, x in enumerate(evaluate(S.is_phone("v"), values)) if x] == [4, 5, 6]
    assert [i for i, x in enumerate(evaluate(S.is_currency("v"), values)) if x] == [7, 9]


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("2023-01-05", "yyyy-M-d"), ("2023-1-5", "yyyy-M-d"), ("2023/01/05", "yyyy/M/d"), ("01/05/2023", "M/d/yyyy"),
        ("13/05/2023", "d/M/yyyy"), ("2023.01.05", "yyyy.M.d"), ("20230105", "yyyyMMdd"), ("Jan 5, 2023", "MMM d, yyyy"),
        ("January 5, 2023", "MMMM d, yyyy"), ("5 Jan 2023", "d MMM yyyy"), ("2023", "yyyy"),
        ("2023-01-05 10:30", "yyyy-M-d H:mm"), ("2023-01-05T10:30:00", "yyyy-M-d'T'H:mm:ss"),
        ("2023-01-05T10:30:00Z", "yyyy-M-d'T'H:mm:ssXXX"), ("01/05/2023 10:30 AM", "M/d/yyyy h:mm a"),
        ("Alice", None), ("12:30", None), ("1", None), ("ORD2023", None), ("hello world 2023", None),
    ],
)
def test_pattern_of_a_date(evaluate, text, pattern):
    assert evaluate(S.date_pattern("v"), [text]) == [pattern]


def test_first_value_fixes_the_layout(evaluate):
    values = ["2023-01-01", "2023-1-3", "01/02/2023", "2023-01-04 10:00", "2023-02-30", "x"]
    got = evaluate(S.to_timestamp("v", TEXT, "yyyy-M-d"), values)
    assert got == [dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 3), None, None, None, None]
    day_first = evaluate(S.to_timestamp("v", TEXT, "d/M/yyyy"), ["13/01/2026", "01/02/2026", "02/13/2026"])
    assert day_first == [dt.datetime(2026, 1, 13), dt.datetime(2026, 2, 1), None]


def test_values_are_read_by_their_own_shape_without_a_layout(evaluate):
    got = evaluate(S.to_timestamp("v", TEXT, None), ["abc", "2023-01-01", "01/02/2023", "Jan 5, 2023", "2023-01-01 10:30:15.25"])
    assert got == [None, dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2), dt.datetime(2023, 1, 5), dt.datetime(2023, 1, 1, 10, 30, 15, 250000)]


def test_literals_survive_quotes_and_backslashes(evaluate):
    assert evaluate(S.literal("it's a \\ test"), ["x"]) == ["it's a \\ test"]


def test_words():
    assert words("CustomerID") == words("customer_id") == words("customer id") == ["customer", "id"]
    assert "id" not in words("avoid") and "no" not in words("ignore_flag")
