"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

measures() derives the counts of a text in one projection: words, their code
points, symbols, repeated lines and words in repeated 5-word windows, stop words,
marks of shouting, blank and short lines. RULES is the table: a rule names a
numerator, a denominator, the least and most that their ratio may be, and the
language it holds for, if not for all. compiled() turns it into one Boolean
expression for each rule. Only languages whose stop words are listed have a rule
for stop words, with a threshold each: a text in another language, or of none that
the table names, passes it.

Repeated windows: the windows' 64-bit hashes are compared first; where all
differ, all windows do and the count is 0. Otherwise the windows themselves are
sorted with their places, so equal hashes of different windows change nothing.

Defined results: a null text has no words; a ratio with denominator 0, or with a
denominator below the rule's floor, passes; a table without `lang` has texts of no
named language; texts are measured whole, whatever their length; rules don't depend
on other rows, so there are no ties; other columns are ignored; repeated rows get
equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_or_empty

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Frequent words of four languages, without marks.
STOP_WORDS_OF = {
    "en": "the of and to a in is that for it was on with be as by",
    "de": "der die und den von zu das sich mit auf des ist nicht im ein",
    "fr": "de la le et les en un du une que pour est qui dans par",
    "es": "el y los se del las por no con su para al es una",
}
STOP_WORDS = list(dict.fromkeys(" ".join(STOP_WORDS_OF.values()).split()))
#: The least part of words that are stop words, in texts of 50 words or more.
LEAST_STOP_WORDS = {"en": 0.02, "de": 0.02, "fr": 0.02, "es": 0.02}


class Rule(NamedTuple):
    """least <= numerator / denominator <= most, where the denominator is at least `floor`, in texts of `lang` (None: all)."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None
    floor: int = 1
    lang: str | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0, 20),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("shouting_per_word", "n_exclamations", "n_words", None, 0.3),
    *(Rule(f"stop_words_{lang}", "n_stop_words", "n_words", least, None, 50, lang) for lang, least in LEAST_STOP_WORDS.items()),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5, 8),
)


def _dropped(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words in windows found twice or more; a union of the places p .. p+4 of those windows."""
    n = F.size(words)
    places = F.sequence(F.lit(1), n - WINDOW + 1)
    word = lambda p, i: F.element_at(words, p + i)
    hashes = F.transform(places, lambda p: F.xxhash64(*[word(p, i) for i in range(WINDOW)]))
    placed = F.array_sort(F.transform(places, lambda p: F.struct(F.concat_ws(" ", *[word(p, i) for i in range(WINDOW)]).alias("w"), p.alias("p"))))

    def twice(placed: Column) -> Column:
        at = lambda i: F.element_at(placed, i)
        same = lambda i, j: (j >= 1) & (j <= F.size(placed)) & (F.get(placed, j - 1)["w"] == at(i)["w"])
        found = F.filter(F.sequence(F.lit(1), F.size(placed)), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(found, lambda i: at(i)["p"]))

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))  # end: the last place counted
        step = lambda s, p: F.struct((s["n"] + p + WINDOW - 1 - F.greatest(s["end"], p - 1)).alias("n"), (p + WINDOW - 1).alias("end"))
        return F.aggregate(found, start, step, lambda s: s["n"])

    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates value one time
    exact = once(placed, lambda a: once(twice(a), covered))
    count = once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact))
    return F.when(n <= WINDOW, 0).otherwise(count).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts that rules are made of."""
    text = text_or_empty()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", lang.alias("lang"), text.alias("text"), F.filter(F.split(text, SPACES + "+"), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    return base.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _dropped(F.col("text"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        _dropped(F.col("text"), "!+").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def compiled(rules=RULES) -> dict[str, Column]:
    """For each rule the Column that tells whether a row of measures() passes it."""
    out = {}
    for r in rules:
        ratio, tests = F.col(r.numerator) / F.col(r.denominator), []
        if r.least is not None:
            tests.append(ratio >= r.least)
        if r.most is not None:
            tests.append(ratio <= r.most)
        ok = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        exempt = F.col(r.denominator) < max(1, r.floor)
        if r.lang is not None:
            exempt = exempt | ~F.col("lang").eqNullSafe(r.lang)
        out[r.name] = F.when(exempt, True).otherwise(ok)
    return out


def verdicts(docs: DataFrame, rules=RULES) -> DataFrame:
    """measures() with base_failed, kept and failed_rules."""
    tests = compiled(rules)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    verdict = F.lit(True)
    for test in tests.values():
        verdict = verdict & test
    names = F.filter(F.array(*[F.when(~test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    measured = measures(docs)
    return measured.select(*(c for c in measured.columns if c != "lang"), failed.alias("base_failed"), (~failed & verdict).alias("kept"), F.array_join(names, ",").alias("failed_rules"))


def good_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), *[c for c in ("text", "lang") if c in docs.columns])
    return verdicts(plain, rules).where("kept").select("doc_id.*")
