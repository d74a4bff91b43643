"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one BIGINT in which bit i is set where
rule i fails. Policies are versioned masks: applying another policy, or asking what a policy would do without one of its
rules, is bitwise arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, settle, text_of, unused, words_of

WINDOW = 5

#: name -> failure condition over the measurements; the position is the bit. Add at the end only.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "10 * n_upper > 7 * n_letters AND n_letters > 0",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


#: The contract's two rules, which every policy includes.
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", (*BASE.rules, "many_symbols", "repeated_lines")),
        Policy("v2", (*BASE.rules, "many_symbols", "repeated_lines", "long_words", "short_words", "shouting")),
    )
}
CURRENT = "v2"


# Words inside windows found twice or more, in three steps from the window hashes ``grams`` of a text: the windows sorted
# by hash (none where all hashes differ), the positions of those that equal a neighbour, and the words these cover: each
# adds the words up to the next one, WINDOW at most.
SORTED = "CASE WHEN size(array_distinct(grams)) = size(grams) THEN array() ELSE sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i))) END"
EQUAL = """
    sort_array(transform(filter(sorted, (x, k) ->
        (k > 0 AND sorted[greatest(k - 1, 0)].g = x.g) OR (k < size(sorted) - 1 AND sorted[least(k + 1, size(sorted) - 1)].g = x.g)),
    x -> x.i))"""
COVERED = f"""
    aggregate(transform(equal, (p, k) -> CASE WHEN k = 0 THEN {WINDOW} ELSE least({WINDOW}, p - equal[greatest(k - 1, 0)]) END),
              0L, (a, x) -> a + x)"""


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``ledger``: the measurements and ``failed``, the bitmask of failing rules
    (underscores follow the name where ``docs`` has it).

    A null or blank text has no words, fails ``few_words`` and no rule about shares. All columns of ``docs`` are kept.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # renamed, so that no name clashes with a measurement's
    step = docs.toDF(*own).select(*own, text_of(own[docs.columns.index("text")]).alias("t"))
    step = settle(step, [*own, "t"], w=words_of(F.col("t")))
    hashed = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD))
    grams = f"CASE WHEN size(w) < {WINDOW} THEN array() ELSE transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({hashed})) END"
    long = lambda c: c.cast("bigint")
    step = settle(
        step,
        own,
        n_words=long(F.size("w")),
        word_chars=long(F.length(F.array_join("w", ""))),
        n_symbols=long(F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", ""))),
        n_upper=long(F.length(F.regexp_replace("t", r"[^A-Z]+", ""))),
        n_letters=long(F.length(F.regexp_replace("t", r"[^A-Za-z]+", ""))),
        lines=lines,
        grams=F.expr(grams),
    )
    measured = [*own, "n_words", "word_chars", "n_symbols", "n_upper", "n_letters"]
    distinct_lines = F.size(F.array_distinct("lines"))
    step = settle(step, [*measured, "grams"], n_lines=long(F.size("lines")), n_dup_lines=long(F.size("lines") - distinct_lines), sorted=F.expr(SORTED))
    measured += ["n_lines", "n_dup_lines"]
    step = settle(step, measured, equal=F.expr(EQUAL))
    step = settle(step, measured, n_repeat_words=F.expr(COVERED))
    failed: Column = F.lit(0).cast("bigint")
    for bit, condition in enumerate(RULES.values()):
        failed = failed + F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")
    step = step.withColumn("failed", failed)
    return step.select(*own, F.struct(*names, "failed").alias("ledger")).toDF(*docs.columns, unused("ledger", docs))


def passes(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(failed: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does, from a column ``failed``: documents it rejects, and those only it rejects.

    One aggregation over the ledger; a document's only failing rule is the one whose bit equals its masked bits.
    """
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    sums, rows = [F.count(F.lit(1)).alias("documents"), F.sum((bits != 0).cast("bigint")).alias("rejected")], []
    for rule in policy.rules:
        bit = F.lit(1 << list(RULES).index(rule)).cast("bigint")
        sums.append(F.sum((bits.bitwiseAND(bit) != 0).cast("bigint")).alias(f"{rule}_fails"))
        sums.append(F.sum((bits == bit).cast("bigint")).alias(f"{rule}_alone"))
        rows.append(F.struct(F.lit(rule).alias("rule"), F.col(f"{rule}_fails").alias("fails"), F.col(f"{rule}_alone").alias("kept_without")))
    return failed.agg(*sums).select(F.lit(policy.version).alias("policy"), "documents", "rejected", F.inline(F.array(*rows)))


def judged(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The contract's columns per document, and the failure bits."""
    out = ledger(docs)
    book = out.columns[-1]
    get = lambda n: F.col(f"`{book}`.{n}")
    return out.select(
        "doc_id",
        *[get(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(get("failed"), BASE)).alias("base_failed"),
        passes(get("failed"), POLICIES[version]).alias("kept"),
        get("failed").alias("failed"),
    )


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their columns."""
    out = ledger(docs)
    return out.filter(passes(F.col(f"`{out.columns[-1]}`.failed"), POLICIES[version])).select(*[F.col(f"`{c}`") for c in docs.columns])
