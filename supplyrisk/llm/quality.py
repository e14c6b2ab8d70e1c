"""Quality rules by line-first cleaning (native Spark expressions).

Each line is judged by itself: symbol share (punctuation), separators
and short unpunctuated entries (navigation), stock phrases
(boilerplate).  Failing lines are removed; a document is rejected when
the base rules fail or when the removed lines hold more than
``max_lost`` of its characters outside white space.

All statistics of a document are computed inside its row with array
functions, so there is no shuffle and no group to skew.  Repeated
three-word windows are found by sorting the 64-bit hashes of a
document's windows, only for documents that repeat one.

Defined cases: null text counts as no words (rejected by the base rule);
repeated rows are judged alike; columns other than ``text`` pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.columns import WS_CHARS, WS_CLASS, let

SYMBOLS = "#*$%&|<>"
#: Fixed stock phrases of web boilerplate.
BOILERPLATE = (r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|use(s)? cookies"
               r"|enable javascript|lorem ipsum|subscribe to our|sign up for our|click here to|skip to content")


@dataclass(frozen=True)
class LineRules:
    max_symbol_share: float = 0.10   # of a line's characters outside white space
    min_separators: int = 2          # | » • · with as many words each as below
    words_per_separator: int = 6
    short_words: int = 3             # a line with fewer words must end like a sentence
    max_lost: float = 0.40           # of the document's characters outside white space


def _ink(text: Column) -> Column:
    """Characters outside ASCII white space."""
    return F.length(F.translate(text, WS_CHARS, ""))


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; empty array without any."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{WS_CLASS}]+", -1)) \
            .otherwise(F.array().cast("array<string>"))


def line_ok(line: Column, rules: LineRules) -> Column:
    ink = F.greatest(_ink(line), F.lit(1))
    separators = _count_of(line, "|»•·")
    trimmed = F.btrim(line, F.lit(WS_CHARS))
    punctuation = _count_of(line, SYMBOLS + "{}~^\\=") / ink <= rules.max_symbol_share
    # words are counted only where separators ask for it
    navigation = F.when(separators >= rules.min_separators,
                        separators * rules.words_per_separator >= F.size(words_of(line))).otherwise(F.lit(False))
    long = trimmed.rlike(f"^(?:[^{WS_CLASS}]+[{WS_CLASS}]+){{{rules.short_words - 1}}}[^{WS_CLASS}]")
    menu = ~long & ~trimmed.rlike(r"[.!?…:;,\"'”’)\]]$")
    return punctuation & ~navigation & ~menu & ~trimmed.rlike(BOILERPLATE)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more in the array."""
    def count(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(p: Column) -> Column:
            none = F.slice(p, 1, 0)
            n = F.size(p)
            same_next = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n), lambda a, b: a["k"] == b["k"])
            flags = let(same_next, lambda s: F.zip_with(
                F.concat(s, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), s), lambda a, b: a | b))
            hit = F.filter(F.arrays_zip(p.alias("p"), flags.alias("f")), lambda x: x["f"])
            return F.when(n > 1, F.sort_array(F.transform(hit, lambda x: x["p"]["i"]))) \
                    .otherwise(F.transform(none, lambda x: x["i"]))

        def covered(s: Column) -> Column:
            gaps = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                              lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(repeated, let(let(pairs, starts), covered)).otherwise(F.lit(0))

    def keyed(w: Column) -> Column:
        n = F.size(w)
        two = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
        return let(F.zip_with(two, F.slice(w, 3, n - 2), lambda h, c: F.xxhash64(h, c)), count)

    return F.when(F.size(words) >= 4, let(words, keyed)).otherwise(F.lit(0))


def judge(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """All input columns plus the statistics, ``clean_text``, ``base_failed`` and ``kept``."""
    out = documents.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_w", words_of(F.col("_t"))) \
             .withColumn("_lines", F.split("_t", "\n", -1))
    out = out.withColumn("_worded", F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)) \
             .withColumn("_good", F.filter("_lines", lambda x: line_ok(x, rules) | (F.length(F.btrim(x, F.lit(WS_CHARS))) == 0)))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": _ink(F.col("_t")).cast("long"),
        "n_symbols": _count_of(F.col("_t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")).cast("long"),
        "clean_text": F.array_join("_good", "\n"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    lost = 1 - _ink(F.col("clean_text")) / F.greatest(F.col("word_chars"), F.lit(1))
    out = out.withColumn("kept", ~F.col("base_failed") & (lost <= rules.max_lost))
    return out.drop("_t", "_w", "_lines", "_worded", "_good")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, failing lines leave the others."""
    return judge(docs).filter("kept").select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source",
        F.length("clean_text").cast("long").alias("n_chars"))
