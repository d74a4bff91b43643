"""SQL expressions every operator rests on: trimming, pattern tests, number and date parsing.

Each helper takes an expression as SQL text and returns SQL text; a wide table needs hundreds of them, and
one parsed text is far cheaper to build from Python than a tree of column objects. Only built-in functions
are used, and under ANSI mode only the ``try_`` forms touch user data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Patterns that decide whether a text is an email, URL, phone number, amount or percentage.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
PHONE = r"^(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"
CURRENCY = r"^[$€£¥]?\s?\d{1,3}([,.]\d{3})*([.,]\d{2})?$"
PERCENT = r"^\d+(\.\d+)?%?$"

# Pairs of words that make a column boolean.
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("t", "f"))

# Characters that may decorate a number without making it invalid.
NUMBER_DECORATION = "$€£¥%,"
NUMBER = r"^[+-]?+(?:(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+|(?i:inf|infinity))$"


def quote(name: str) -> str:
    """Back-tick a column name so dots, spaces and quotes in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TRIMMED = literal(WHITESPACE)


def strip(x: str) -> str:
    """Text without leading and trailing whitespace. Trimming a set of characters is slow, so it is left
    to values whose first or last character can be one of them."""
    plain_end = f"ascii(substring({x}, -1, 1)) BETWEEN 33 AND 127"
    return f"CASE WHEN {x} >= '!' AND {x} < '\\u0080' AND {plain_end} THEN {x} ELSE btrim({x}, {_TRIMMED}) END"


# --- pattern tests ---------------------------------------------------------------------------
# Each takes stripped text and puts a byte-level test before the regular expression, which almost every
# value of a column that is not of the kind fails.


def _starts_with(t: str, others: str) -> str:
    codes = ", ".join(str(ord(ch)) for ch in others)
    return f"(ascii({t}) BETWEEN 48 AND 57 OR ascii({t}) IN ({codes}))"


def is_email(t: str) -> str:
    return f"(contains({t}, '@') AND {t} RLIKE r'{EMAIL}')"


def is_url(t: str) -> str:
    return f"(contains({t}, '://') AND {t} RLIKE r'{URL}')"


def is_phone(t: str) -> str:
    return f"(char_length({t}) BETWEEN 10 AND 19 AND {t} RLIKE r'{PHONE}')"


def is_currency(t: str) -> str:
    return f"({_starts_with(t, '$€£¥')} AND {t} RLIKE r'{CURRENCY}')"


def is_percent(t: str) -> str:
    return f"(ascii({t}) BETWEEN 48 AND 57 AND rtrim('%', {t}) RLIKE r'{PERCENT}')"


def boolean_pair(t: str) -> str:
    """Bit of the boolean pair a text belongs to, 0 for none."""
    bits = " ".join(
        f"WHEN lower({t}) IN ('{a}', '{b}') THEN {1 << i}" for i, (a, b) in enumerate(BOOLEAN_PAIRS)
    )
    return f"CASE WHEN char_length({t}) > 5 THEN 0 {bits} ELSE 0 END"


# --- storage classes -------------------------------------------------------------------------

_STORAGE_NAMES = {
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.DecimalType: "decimal",
    T.BooleanType: "bool",
    T.StringType: "object",
    T.NullType: "object",
    T.DateType: "date",
    T.TimestampType: "datetime64[ns]",
    T.TimestampNTZType: "datetime64[ns]",
}


def storage_type(dtype: T.DataType) -> str:
    for cls, name in _STORAGE_NAMES.items():
        if isinstance(dtype, cls):
            return name
    return dtype.simpleString()


def storage_class(dtype: T.DataType) -> str:
    """number, text, time, flag, or other (nested and binary: counts only)."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.NullType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(dtype, T.BooleanType):
        return "flag"
    return "other"


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


# --- numbers ---------------------------------------------------------------------------------


def text_number(t: str) -> str:
    """Number in a stripped text. The pattern is needed because a bare cast also takes ``1d``."""
    return f"CASE WHEN {_starts_with(t, '+-.iI')} AND {t} RLIKE r'{NUMBER}' THEN try_cast({t} AS DOUBLE) END"


def to_number(x: str, dtype: T.DataType) -> str:
    """Number held by a cell, NULL when there is none."""
    kind = storage_class(dtype)
    if kind in ("number", "flag"):
        return f"CAST({x} AS DOUBLE)"
    if kind == "text":
        return text_number(f"btrim({x}, {_TRIMMED})")
    if kind == "time":
        return f"CAST(unix_micros(CAST({x} AS TIMESTAMP)) AS DOUBLE) * 1000"
    return "CAST(NULL AS DOUBLE)"


def is_lenient_number(t: str) -> str:
    """True for stripped text that is a number once currency, percent and thousands marks are removed."""
    bare = f"trim(translate({t}, '{NUMBER_DECORATION}', ''))"
    number = f"{_starts_with(bare, '+-.iI')} AND {bare} RLIKE r'{NUMBER}'"
    return f"({number} OR char_length({bare}) <= 4 AND lower({bare}) IN ('nan', '+nan', '-nan'))"


# --- dates -----------------------------------------------------------------------------------


# Day layouts as (shape, pattern), month first where a value allows both readings, and the
# clock layouts that may follow a numeric day; a T may stand between them in the first day layout.
_MONTH, _DAY, _YEAR = "(0?[1-9]|1[0-2])", "[0-9]{1,2}", "[0-9]{4}"
NUMERIC_DAYS = (
    (f"{_YEAR}-{_DAY}-{_DAY}", "yyyy-M-d"),
    (f"{_YEAR}/{_DAY}/{_DAY}", "yyyy/M/d"),
    (f"{_YEAR}[.]{_DAY}[.]{_DAY}", "yyyy.M.d"),
    (f"{_MONTH}/{_DAY}/{_YEAR}", "M/d/yyyy"),
    (f"{_DAY}/{_DAY}/{_YEAR}", "d/M/yyyy"),
    (f"{_MONTH}-{_DAY}-{_YEAR}", "M-d-yyyy"),
    (f"{_DAY}-{_DAY}-{_YEAR}", "d-M-yyyy"),
    (f"{_MONTH}[.]{_DAY}[.]{_YEAR}", "M.d.yyyy"),
    (f"{_DAY}[.]{_DAY}[.]{_YEAR}", "d.M.yyyy"),
)
OTHER_DAYS = (
    (f"[A-Za-z]{{3}} {_DAY}, {_YEAR}", "MMM d, yyyy"),
    (f"[A-Za-z]{{4,9}} {_DAY}, {_YEAR}", "MMMM d, yyyy"),
    (f"{_DAY} [A-Za-z]{{3}} {_YEAR}", "d MMM yyyy"),
    (f"{_DAY} [A-Za-z]{{4,9}} {_YEAR}", "d MMMM yyyy"),
    (f"{_DAY}-[A-Za-z]{{3}}-{_YEAR}", "d-MMM-yyyy"),
    ("[0-9]{8}", "yyyyMMdd"),
    (f"{_YEAR}-[0-9]{{2}}", "yyyy-MM"),
    (_YEAR, "yyyy"),
)
_FRACTION = "[SSSSSS][SSSSS][SSSS][SSS][SS][S]"
_ZONE = "(Z|[+-][0-9]{2}:[0-9]{2})"
CLOCKS = (
    ("[0-9]{1,2}:[0-9]{2}", "H:mm"),
    ("[0-9]{1,2}:[0-9]{2}:[0-9]{2}", "H:mm:ss"),
    ("[0-9]{1,2}:[0-9]{2}:[0-9]{2}[.][0-9]{1,6}", f"H:mm:ss.{_FRACTION}"),
    ("[0-9]{1,2}:[0-9]{2} (AM|PM)", "h:mm a"),
)


def _choose(ref: str, cases: list[tuple[str, str]]) -> str:
    """SQL text: the pattern of the first shape the value matches."""
    quoted = [(shape, pattern.replace("'", "''")) for shape, pattern in cases]
    return "CASE " + " ".join(f"WHEN {ref} RLIKE '{s}' THEN '{p}'" for s, p in quoted) + " END"


def date_pattern(ref: str) -> str:
    """Date pattern that fits the shape of a text column's value, NULL if none does. A cheap gate keeps
    prose and codes away from the list of shapes."""
    days = _choose(ref, [(f"^{s}([ T]|$)", p) for s, p in NUMERIC_DAYS] + [(f"^{s}$", p) for s, p in OTHER_DAYS])
    clocks = [(f"^[^ T]+$", "")] + [(f"^[^ T]+ {s}$", f" {p}") for s, p in CLOCKS]
    for s, p in CLOCKS[:3]:
        clocks += [(f"^[0-9-]+T{s}$", f"'T'{p}"), (f"^[0-9-]+T{s}{_ZONE}$", f"'T'{p}XXX")]
    named = f"WHEN {ref} RLIKE '[A-Za-z]{{3,}}' THEN '' "
    clock = _choose(ref, clocks).replace("CASE ", "CASE " + named, 1)
    gate = f"char_length({ref}) <= 40 AND {ref} RLIKE '^([0-9]{{1,8}}|[A-Za-z]{{3,9}} [0-9])'"
    return f"CASE WHEN {gate} THEN concat({days}, {clock}) END"


def _shapes() -> dict[str, str]:
    """Shape of each pattern, with month and day as any two digits: once a first value has fixed the
    pattern, the parser and not the shape tells month from day."""
    out = {p: s for s, p in NUMERIC_DAYS + OTHER_DAYS}
    for s, p in NUMERIC_DAYS:
        out |= {f"{p} {cp}": f"{s} {cs}" for cs, cp in CLOCKS}
        for cs, cp in CLOCKS[:3]:
            out |= {f"{p}'T'{cp}": f"{s}T{cs}", f"{p}'T'{cp}XXX": f"{s}T{cs}{_ZONE}"}
    return {p: "^" + s.replace(_MONTH, _DAY) + "$" for p, s in out.items()}


SHAPES = _shapes()


def to_timestamp(x: str, dtype: T.DataType, pattern: str | None) -> str:
    """Timestamp held by a cell. A text column is read with the pattern its first value fixed; when that
    value fits none, each value is read with the pattern of its own shape. Only values of a fitting shape
    reach the parser."""
    kind = storage_class(dtype)
    if kind == "time":
        return f"CAST({x} AS TIMESTAMP)"
    if kind == "number":
        return f"timestamp_micros(try_cast({x} / 1000 AS BIGINT))"
    if kind != "text":
        return "CAST(NULL AS TIMESTAMP)"
    if pattern is None:
        return f"try_to_timestamp({x}, {date_pattern(x)})"
    # Year-first dates are what a plain cast reads, several times faster than a pattern.
    plain = pattern.startswith("yyyy-M-d") and not pattern.endswith("a")
    parsed = f"try_cast({x} AS TIMESTAMP)" if plain else f"try_to_timestamp({x}, {literal(pattern)})"
    return f"CASE WHEN {x} RLIKE '{SHAPES[pattern]}' THEN {parsed} END"


def is_midnight(ts: str) -> str:
    return f"{ts} = date_trunc('day', {ts})"
