"""Operator 10, quality rules: a threshold table compiled into one projection.

Method: RULES lists ratios of length, symbol, stop-word and line counts with
their bounds; `judge` compiles the table into one boolean expression over the
counts, evaluated per row by built-in functions, without user functions and
without a shuffle.

Defined results: null or empty text has all counts 0, fails the base rule and
is not kept; repeated rows and null ids are judged like any other row; a ratio
over zero words or lines is 0. Other input columns pass through `annotate`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The class of bytes that separate words, spelled for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
REPEAT_WIDTH = 8
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "with", "as", "be", "at", "by", "this", "are", "or",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "les", "et", "des", "un", "une", "du", "est", "pour", "que", "dans", "sur", "pas", "qui", "par",
    "el", "los", "las", "y", "en", "una", "se", "del", "por", "con", "no", "para", "su", "al", "como",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` for documents of at least ``from_words`` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None, 200),
)


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text in a column ``q`` (a struct)."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.select(F.struct(*kept).alias("r"), body.alias("t"))
    two = one.select("r", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
                     F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("l"))
    hashed = two.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.when(F.size("h") >= REPEAT_WIDTH, F.transform(
        F.sequence(F.lit(1), F.size("h") - (REPEAT_WIDTH - 1)), lambda i: F.xxhash64(F.slice("h", i, REPEAT_WIDTH))))
    three = hashed.withColumn("v", F.coalesce(windows, F.array().cast("array<bigint>")))
    # positions are ranked only where a window really repeats
    some = F.size(F.array_distinct("v")) < F.size("v")
    four = three.withColumn("s", F.when(some, F.array_sort(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: (
        F.get(F.col("s"), k)["h"].eqNullSafe(F.get(F.col("s"), k - 1)["h"]) | F.get(F.col("s"), k)["h"].eqNullSafe(F.get(F.col("s"), k + 1)["h"])))
    starts = F.array_sort(F.transform(twice, lambda k: F.get(F.col("s"), k)["i"]))
    zero = F.struct(F.lit(-REPEAT_WIDTH).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(REPEAT_WIDTH), p - a["last"])).alias("n")), lambda a: a["n"])
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"))
    return four.select("r", counts.alias("q"))


def measure(spec: str) -> Column:
    """A ratio "a / b" of two counts; 0 where b is 0."""
    top, bottom = (F.col(f"q.{x.strip()}") for x in spec.split("/"))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def base_failed() -> Column:
    return (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))


def judge(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole threshold table as one boolean expression."""
    verdict = ~base_failed()
    for rule in rules:
        ok = F.lit(True)
        if rule.low is not None:
            ok &= measure(rule.measure) >= rule.low
        if rule.high is not None:
            ok &= measure(rule.measure) <= rule.high
        verdict &= (F.col("q.n_words") < rule.from_words) | ok
    return verdict


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were.

    The verdict drops rows through a generator: a filter would be pushed below
    the projection, where every use of a count repeats the work behind it.
    """
    judged = annotate(docs).select("r", judge(rules).alias("ok"))
    return judged.select("r", F.explode(F.when(F.col("ok"), F.array(F.lit(True)))).alias("ok")).select("r.*")


def query(docs: DataFrame) -> DataFrame:
    return annotate(docs.select("doc_id", "text")).select(
        "r.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
        base_failed().alias("base_failed"), judge().alias("kept"), "q.n_lines", "q.n_stop_words")
