"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document. The ledger keeps its measurements
and one long with a bit per failed rule; a policy is a named set of rules, so
applying another version, or asking what each rule costs (``ablations``), is a
bitwise test on the stored bits and never reads a text again.

Defined results: a null or blank text has no words and fails ``few_words``;
repeated rows get equal ledgers each; an empty table gives an empty ledger.
Repeated windows are found within one text by 64-bit hashes of eight words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import free_name, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Each rule reads measurements by name and is true where a document fails. Bits follow
#: this order and are never reused; new rules go to the end.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 20,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 100 * m("n_symbols") > 10 * m("n_words"),
    "repeated_lines": lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines"),
    "few_letters": lambda m: 100 * m("n_letters") < 75 * m("word_chars"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 20 * m("n_words"),
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
PRODUCTION = Policy("production-1", tuple(RULES))


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in ``tokens``."""
    hashed = F.transform(tokens, lambda x: F.xxhash64(x))
    from_each = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))))
    windows = let(hashed, lambda h: F.slice(from_each(h), 1, F.greatest(F.size(h) - (width - 1), F.lit(0))))

    def covered(starts: Column) -> Column:
        lengths = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, i: F.struct(x["p"].alias("p"), (((i > 0) & same(x, F.get(ordered, i - 1))) | same(x, F.get(ordered, i + 1))).alias("twice")))
        return F.sort_array(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["p"]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(starts(s), covered)))

    return let(windows, count)


def measurements(text: Column, tokens: Column) -> dict[str, Column]:
    """Named measurements of one text; ``tokens`` is a column that holds its words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda x: x.cast("long")
    return {
        "n_words": long(F.size(tokens)),
        "word_chars": long(F.length(F.array_join(tokens, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_lines": let(lines, lambda x: long(F.size(x))),
        "n_dup_lines": let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))),
        "n_letters": long(F.length(F.regexp_replace(text, r"\P{L}+", ""))),
        "n_repeat_words": repeated_words(tokens),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``fail_bits``: every rule evaluated once."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), words(F.col(text_col)).alias("tokens"))
    rows = held.select("doc_id", *(c.alias(n) for n, c in measurements(F.col("text"), F.col("tokens")).items()))
    return rows.withColumn("fail_bits", _bits(F.col))


def _bits(measure: Callable[[str], Column]) -> Column:
    total = F.lit(0).cast("long")
    for name, fails in RULES.items():
        total = total.bitwiseOR(F.when(fails(measure), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with ``policy`` and ``kept``; reads bits only."""
    return book.withColumns({"policy": F.lit(policy.version), "kept": passes(F.col("fail_bits"), policy)})


def ablations(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of ``policy``: documents failing it, failing it alone, and kept without it."""
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules))
    each = patterns.select("fail_bits", "n", F.inline(rules))
    relevant = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counted = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        counted(relevant.bitwiseAND(F.col("bit")) != 0)("n_failed"),
        counted(relevant == F.col("bit"))("n_failed_alone"),
        counted((relevant == 0) | (relevant == F.col("bit")))("n_kept_without"),
    )


def keep_passing(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their own columns."""
    tokens, name = free_name(docs, "tokens"), free_name(docs, "ledger")
    held = docs.withColumn(tokens, words(F.col(text_col)))
    measured = held.withColumn(name, F.struct(*(c.alias(n) for n, c in measurements(F.col(text_col), F.col(tokens)).items())))
    return measured.filter(passes(_bits(lambda n: F.col(name)[n]), policy)).select(*docs.columns)
