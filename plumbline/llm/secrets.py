r"""Secret scans with Spark expressions only: fixed patterns, and windows of high entropy.

Positions of a pattern's matches are not asked for one by one: the texts between the matches (a split at the pattern)
and the matches themselves (all extracts) have lengths, and running sums of these are the positions. Running sums are taken in
chunks, so that no array grows match by match; all steps are linear in the text, or all but.

Entropy: every candidate run of key characters is scanned by a window of WINDOW characters. The window's entropy is
log2(W) - sum(f(n)) / W with f(n) = n log2 n over the counts n of its characters. The counts are kept up as the window moves by
one, five bits for each of the 67 key characters in a few longs, and the sum changes by f of the two counts that change. f is a
table of integers (millionths), which keeps the sum exact. A long run is scanned in blocks that overlap by a window.

Spans of the fixed patterns are cut out of a candidate: where the ends of candidates and of these spans are sorted, a stretch
inside a candidate and outside all spans is seen by a running count. Rulers go off the ends of what remains; each piece of WINDOW
characters or more is a candidate of its own. Its class (hex, lower, mixed) sets the limit, and pieces on the allow list are
suppressed. Patterns with repeated groups are possessive: others recurse per repetition, which a long text turns into a stack
overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import PART, cut_out, parts_of, running, settle, text_of, unused

WINDOW = 20
SCALE = 1_000_000


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed values of the contract: kinds in their order, patterns, least lengths.
KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy of a window in bits, by character class of the candidate.
LIMITS = {"hex": 3.0, "lower": 3.6, "mixed": 3.9}
#: Candidates that look random and aren't: identifiers that are public by nature, paths and rulers.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z]+$",  # a word without digits
    r"^[0-9_+/=-]+$",  # a number
    r"^(?:/?+[a-z0-9_-]++/)++[a-z0-9_-]*+$",  # a path
    r"^(.)\1*$",  # a ruler
)
RULER = r"^([+/_=-])\1{9,}"

BLOCK = 64  # windows' first characters in a block
# Key characters have the codes 0 to 66; counts of twelve of them share a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PER_LONG = 12
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(text: str, pattern: str, group: int = 0, plain: bool = True) -> str:
    """SQL for the matches of a pattern: array of struct(start, end, own), own being a group's text."""
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"""
    CASE WHEN {text} RLIKE {lit} THEN
      struct(split({text}, {lit}, -1) AS gaps, regexp_extract_all({text}, {lit}, 0) AS found, regexp_extract_all({text}, {lit}, {group}) AS own)
    END"""


def _lengths(column: str) -> str:
    """SQL: what each match of the pieces of ``_matches`` adds to the position, its gap and itself."""
    return f"transform({column}.found, (m, i) -> length({column}.gaps[i]) + length(m))"


def _spans(column: str, ends: str, kind: str, least: int, order: int) -> str:
    """SQL for the spans of one kind, those whose own text is long enough."""
    span = f"struct({ends}[i] - length(m) AS start, {order} AS rank, '{kind}' AS kind, {ends}[i] AS end)"
    return f"""
    CASE WHEN {column} IS NULL THEN CAST(array() AS {SPAN}) ELSE
      filter(transform({column}.found, (m, i) -> CASE WHEN length({column}.own[i]) >= {least} THEN {span} END), s -> s IS NOT NULL) END"""


def _events() -> str:
    """SQL: the ends of base spans and of candidates in order, with what each does to the count that ``_pieces`` reads: its low
    byte is 1 inside a candidate and outside all spans, the rest numbers the candidates."""
    edges = lambda of, x, up: f"flatten(transform({of}, {x} -> array(struct({x}.start AS pos, {up}L AS d), struct({x}.end AS pos, {-(up & 255)}L AS d))))"
    return f"CASE WHEN size(candidates) = 0 THEN NULL ELSE array_sort(concat({edges('base', 'b', 2)}, {edges('candidates', 'x', 257)})) END"


def _pieces() -> str:
    """SQL: the stretches of candidates outside base spans, with their text."""
    x = "candidates[CAST(shiftright(depth[i], 8) AS INT) - 1]"
    at, size = f"(events[i].pos - {x}.start)", "(events[i + 1].pos - events[i].pos)"
    piece = f"struct(events[i].pos AS start, events[i + 1].pos AS end, {cut_out(f'{x}.parts', at, size)} AS own)"
    inside = f"(depth[i] & 255) = 1 AND {size} >= {WINDOW}"
    none = "CAST(array() AS array<struct<start:int,end:int,own:string>>)"
    return f"""CASE WHEN events IS NULL THEN {none} ELSE
      filter(transform(sequence(0, size(events) - 2), i -> CASE WHEN {inside} THEN {piece} END), p -> p IS NOT NULL) END"""


def _bare() -> str:
    """SQL: the pieces without rulers at their ends, those that are still long enough."""
    lit = "'" + RULER.replace("\\", "\\\\") + "'"
    head, tail = f"length(regexp_extract(x.own, {lit}, 0))", f"length(regexp_extract(reverse(x.own), {lit}, 0))"
    bare = f"""struct(x.start + {head} AS start, x.end - {tail} AS end, substring(x.own, {head} + 1, length(x.own) - {head} - {tail}) AS own)"""
    return f"filter(transform(pieces, x -> CASE WHEN {head} + {tail} > 0 THEN {bare} ELSE x END), x -> length(x.own) >= {WINDOW})"


def _entropy_hit(own: str) -> str:
    """SQL: does some window of a candidate reach the limit of its class?"""
    table = "array(" + ", ".join(f"{round(SCALE * n * math.log2(n)) if n else 0}L" for n in range(WINDOW + 1)) + ")"
    code = "array(" + ", ".join(str(ALPHABET.find(chr(i))) for i in range(128)) + ")"
    longs = -(-len(ALPHABET) // PER_LONG)
    place = lambda c: f"{c} div {PER_LONG}", lambda c: f"5 * ({c} % {PER_LONG})"
    held = lambda c: f"CAST(shiftright(a.w[CAST({place[0](c)} AS INT)], {place[1](c)}) & 31 AS INT)"
    unit = lambda c: f"shiftleft(1L, {place[1](c)})"
    n_out = held("s.gone")
    n_in = f"({held('s.come')} - CASE WHEN s.come = s.gone THEN 1 ELSE 0 END)"
    now = f"a.now + f[{n_in} + 1] - f[{n_in}] + CASE WHEN s.gone < 0 THEN 0L ELSE f[{n_out} - 1] - f[{n_out}] END"
    counts = f"""transform(a.w, (x, k) -> x + CASE WHEN k = {place[0]("s.come")} THEN {unit("s.come")} ELSE 0L END
      - CASE WHEN s.gone >= 0 AND k = {place[0]("s.gone")} THEN {unit("s.gone")} ELSE 0L END)"""
    top = (1 << 62) - 1
    steps = f"transform(c, (v, i) -> struct(v AS come, CASE WHEN i >= {WINDOW} THEN c[i - {WINDOW}] ELSE -1 END AS gone, i >= {WINDOW - 1} AS full))"
    scan = f"""aggregate({steps}, struct(array_repeat(0L, {longs}) AS w, 0L AS now, {top}L AS least),
      (a, s) -> struct({counts} AS w, {now} AS now, CASE WHEN s.full THEN least(a.least, {now}) ELSE a.least END AS least), a -> a.least)"""
    # A lambda over a one-element array gives a value a name, so that it is worked out once.
    codes = "transform(filter(split(concat(b, substring(coalesce(get(blocks, i + 1), ''), 1, %d)), ''), v -> v <> ''), v -> code[ascii(v)])" % (WINDOW - 1)
    block = f"transform(array({codes}), c -> {scan})[0]"
    least = f"transform(array(regexp_extract_all({own}, '.{{1,{BLOCK}}}', 0)), blocks -> array_min(transform(blocks, (b, i) -> {block})))[0]"
    # The largest entropy has the smallest sum; a sum of W * (log2(W) - limit) or less is a hit.
    bound = "CASE " + " ".join(
        f"WHEN {condition} THEN {math.floor(SCALE * WINDOW * (math.log2(WINDOW) - LIMITS[name]))}L"
        for name, condition in (
            ("hex", f"{own} RLIKE '^[0-9a-fA-F]+$'"),
            ("mixed", f"({own} RLIKE '[A-Z]' AND {own} RLIKE '[a-z]')"),
        )
    ) + f" ELSE {math.floor(SCALE * WINDOW * (math.log2(WINDOW) - LIMITS['lower']))}L END"
    return f"({least}) <= {bound}".replace("f[", f"{table}[").replace("code[", f"{code}[")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with spans, an array of struct(start, kind, end) in code points, by start and then kind.

    A null or empty text has none. Other columns are kept; a clashing name gets underscores behind it.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    step = docs.toDF(*own).select(*own, text_of(own[docs.columns.index("text")]).alias("t"))
    found = [f"p{i}" for i in range(4)]
    step = settle(
        step,
        own,
        p0=F.expr(_matches("t", ASSIGN, 2)),
        p1=F.expr(_matches("t", ACCESS)),
        p2=F.expr(_matches("t", HEX)),
        p3=F.expr(_matches("t", CANDIDATE)),
    )
    step = settle(step, [*own, *found], **{f"l{i}": F.expr(_lengths(p)) for i, p in enumerate(found)})
    step = settle(step, [*own, *found], **{f"e{i}": F.expr(running(f"l{i}")) for i in range(4)})
    kinds = [(k, least, i) for i, (k, least) in enumerate(zip(KINDS, (12, 18, 16)))]
    parts = f"CASE WHEN length(m) <= {PART} THEN array(m) ELSE {parts_of('m')} END"
    runs = f"transform(p3.found, (m, i) -> struct(e3[i] - length(m) AS start, e3[i] AS end, {parts} AS parts))"
    step = settle(
        step,
        own,
        base=F.expr(f"array_sort(concat({', '.join(_spans(f'p{i}', f'e{i}', k, least, i) for k, least, i in kinds)}))"),
        candidates=F.expr(f"coalesce({runs}, CAST(array() AS array<struct<start:int,end:int,parts:array<string>>>))"),
    )
    step = settle(step, [*own, "base", "candidates"], events=F.expr(_events()))
    step = settle(step, [*own, "base", "candidates", "events"], deltas=F.expr("transform(events, e -> e.d)"))
    step = settle(step, [*own, "base", "candidates", "events"], depth=F.expr(running("deltas", "bigint")))
    step = settle(step, [*own, "base"], pieces=F.expr(_pieces()))
    step = settle(step, [*own, "base"], pieces=F.expr(_bare()))
    allowed = " OR ".join("x.own RLIKE '" + a.replace("\\", "\\\\") + "'" for a in ALLOWED)
    hits = f"filter(pieces, x -> NOT ({allowed}) AND {_entropy_hit('x.own')})"
    added = f"transform({hits}, x -> struct(x.start AS start, {len(KINDS) - 1} AS rank, '{KINDS[-1]}' AS kind, x.end AS end))"
    step = settle(step, [*own, "base"], added=F.expr(added))
    spans = F.expr("transform(array_sort(concat(base, added)), s -> struct(s.start AS start, s.kind AS kind, s.end AS end))")
    return step.select(*own, spans.alias("spans")).toDF(*docs.columns, unused("spans", docs))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with the matched parts of the text replaced; overlapping spans count as one."""
    out = scan(docs)
    own = [f"c{i}" for i in range(len(docs.columns))]
    step = out.toDF(*own, "spans").withColumn("t", text_of(own[docs.columns.index("text")]))
    ends = "array_sort(flatten(transform(spans, s -> array(struct(s.start AS pos, 1 AS d), struct(s.end AS pos, -1 AS d)))))"
    step = settle(step, [*own, "t"], events=F.expr(ends), parts=F.expr(parts_of("t")))
    step = settle(step, [*own, "t", "events", "parts"], deltas=F.expr("transform(events, e -> e.d)"))
    step = settle(step, [*own, "t", "events", "parts"], depth=F.expr(running("deltas")))
    stretch = lambda a, b: f"CASE WHEN {b} > {a} THEN {cut_out('parts', a, f'({b} - {a})')} ELSE '' END"
    between = f"transform(filter(sequence(0, size(events) - 1), i -> i < size(events) - 1 AND depth[i] = 0), i -> {stretch('events[i].pos', 'events[i + 1].pos')})"
    ends = stretch("0", "events[0].pos"), stretch("element_at(events, -1).pos", "length(t)")
    lit = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    done = F.expr(f"array_join(concat(array({ends[0]}), {between}, array({ends[1]})), {lit})")
    text = own[docs.columns.index("text")]
    return step.withColumn(text, F.when(F.size("events") > 0, done).otherwise(F.col(text))).select(*own).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    out = scan(docs)
    spans = F.col(f"`{out.columns[-1]}`")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
