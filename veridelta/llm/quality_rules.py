"""Quality rules as a short-circuit cascade (built-in functions only).

Each rule is a rejection test on measures of the text, which are taken only when
the test asks for them. On a bounded random sample the cost (seconds) and the
selectivity (share rejected) of each rule are measured; the cascade then runs the
rules by rejection per cost, as one CASE expression whose later tests, with their
measures, are evaluated only for documents that passed the earlier ones. The order
changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, text_of

#: Rows that the estimate reads, about (an estimate only: verdicts cover all rows),
#: and how often each is judged, so that a rule's time shows beside a job's.
SAMPLE_ROWS, TURNS = 400, 8


def words_of(text: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{WS}]"))


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order."""
    third = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(F.slice(words, 1, third), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are compared by 64-bit
    hash inside one text. Sorted by hash, equal ones are neighbours; one fold over
    their sorted positions counts the words."""

    def runs(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p, i: p["h"].eqNullSafe(F.get(pairs, i + 1)["h"]) | p["h"].eqNullSafe(F.get(pairs, i - 1)["h"]))
        return F.aggregate(
            F.sort_array(F.transform(kept, lambda p: p["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
            lambda acc: acc["n"],
        )

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), runs)


def _repeat_words(words: Column) -> Column:
    return let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0)).cast("long")


class Measures:
    """Measures of one text by name; ``words`` are its words."""

    def __init__(self, text: Column, words: Column, given: dict[str, Column] | None = None):
        self.text, self.words, self.given = text, words, given or {}

    def __call__(self, name: str) -> Column:
        return self.given[name] if name in self.given else MEASURES[name](self).cast("long")


#: The first five are returned; the rest is taken only when its rule is reached.
MEASURES: dict[str, Callable[[Measures], Column]] = {
    "n_words": lambda m: F.size(m.words),
    "word_chars": lambda m: F.length(F.array_join(m.words, "")),
    "n_symbols": lambda m: F.length(m.text) - F.length(_without(m.text, "#*$%&|<>")),
    "n_dup_lines": lambda m: let(_lines(m.text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
    "n_repeat_words": lambda m: _repeat_words(m.words),
    "n_lines": lambda m: F.size(_lines(m.text)),
    "n_bare_marks": lambda m: F.size(F.filter(m.words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))),
    "n_exclamations": lambda m: F.length(m.text) - F.length(_without(m.text, "!")),
    "n_cut_lines": lambda m: F.size(F.filter(_lines(m.text), lambda line: line.rlike(rf"(?:\.\.\.|…)[{WS}]*\z"))),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


#: The fixed base rules, then the method's own.
BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
)
RULES = (
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("symbols", lambda m: m("n_symbols") * 2 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 6),
    Rule("bare_marks", lambda m: m("n_bare_marks") * 10 > m("n_words") * 3),
    Rule("exclaiming", lambda m: m("n_exclamations") * 10 > m("n_words") * 3),
    Rule("cut_lines", lambda m: m("n_cut_lines") * 10 > m("n_lines") * 3),
)


def cascade(rules, measures: Measures) -> Column:
    """Name of the first of ``rules`` that rejects; null if none does."""
    out = None
    for rule in rules:
        test = rule.rejects(measures)
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def judged(rules, text: Column) -> Column:
    """The cascade over a text; its words and their number are taken once."""
    return let(words_of(text), lambda w: let(F.size(w).cast("long"), lambda n: cascade(rules, Measures(text, w, {"n_words": n}))))


def rule_order(docs: DataFrame, rules, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share per second on a random sample, best first.

    Every rule is timed in a second run, when its code is compiled, and less the
    time of a run that only splits the words."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = docs.select(text_of().alias("_vd_text"))
    sample = (sample if share == 1.0 else sample.sample(share, 17)).limit(4 * sample_rows).persist()
    try:
        text, n = F.col("_vd_text"), max(sample.count(), 1)
        turns = sample.select("_vd_text", F.explode(F.sequence(F.lit(1), F.lit(TURNS))).alias("_vd_turn"))

        def timed(some) -> tuple[float, int]:
            test = judged(some, text).isNotNull() if some else F.size(words_of(text)) < 0
            for _ in range(2):
                began = time.perf_counter()
                found = turns.filter(test).count()
                took = time.perf_counter() - began
            return took, found

        least = timed(())[0]
        ranked = []
        for place, rule in enumerate(rules):
            took, found = timed((rule,))
            cost = max(took - least, 1e-4)
            ranked.append((-(found / (n * TURNS)) / cost, cost, place, rule))
        return [r for *_, r in sorted(ranked, key=lambda x: x[:3])]
    finally:
        sample.unpersist()


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures and verdict for every row: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    These measures are returned, so they are taken of every row; the cascade of
    ``rules`` runs where the base rules pass. Null and empty texts have no words and
    fail the base rule. Repeated rows are judged alike. An empty table gives no
    rows. A filter on the result stays above the measures."""
    df = docs.select(F.col("doc_id").alias("_vd_id"), text_of().alias("_vd_text"))
    order = rule_order(docs, rules)
    measures = Measures(F.col("_vd_text"), F.col("_vd_words"))
    df = df.withColumn("_vd_words", words_of(F.col("_vd_text")))
    # The row number is not deterministic to the optimizer, which then moves no filter below.
    df = df.withColumns({f"_vd_{c}": measures(c) for c in BASE} | {"_vd_row": F.monotonically_increasing_id()})
    given = Measures(F.col("_vd_text"), F.col("_vd_words"), {c: F.col(f"_vd_{c}") for c in BASE})
    failed = (F.col("_vd_row") < 0) | BASE_RULES[0].rejects(given) | BASE_RULES[1].rejects(given)
    return df.select(
        F.col("_vd_id").alias("doc_id"),
        *(F.col(f"_vd_{c}").alias(c) for c in BASE),
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(order, given).isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` (all its columns) without the documents that a rule, a base rule
    among them, rejects: the cascade alone, so a text that an early rule rejects
    is measured no further. Null and empty texts go; repeated rows are judged alike."""
    order = rule_order(docs, (*BASE_RULES, *rules))
    return docs.filter(judged(order, text_of()).isNull())
