"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too large a share of its characters is rejected. Counts of the
whole document (words, symbols, repeated lines, repeated 5-word windows) come beside the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, SPACES, UPPER, let, words

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>»·•"
SENTENCE_MARKS = ".!?…。！？"
BOILERPLATE = r"(?i)\b(cookies?|javascript|all rights reserved|privacy policy|terms of (use|service)|lorem ipsum|click here|sign up now|log ?in|subscribe now|read more)\b"
END_MARK = "[.!?:;…。！？][\"'”’»)\\]]*$"


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def without(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, min_unmarked_words: int = 4, max_words_per_mark: int = 40, mark_share: float = 0.25, upper_share: float = 0.5) -> Column:
    """Whether a line that has a word fails a rule; its words are counted by the spaces between.

    Punctuation: it has no end mark though it has min_unmarked_words words or more and fewer sentence
    marks than one in max_words_per_mark words. Navigation: mark_share symbols or separators a word or
    more. Boilerplate: a stock phrase in a line of at most 12 words, or repeated exclamation marks with
    most letters A-Z in upper case.
    """

    def rules(own: Column) -> Column:
        trimmed, n_words = own["line"], own["spaces"] + 1
        unmarked = (n_words >= min_unmarked_words) & ~F.substring(trimmed, -4, 4).rlike(END_MARK) & (without(trimmed, SENTENCE_MARKS) * max_words_per_mark < n_words)
        shouts = trimmed.contains("!!") & (without(trimmed, UPPER) > without(trimmed, LOWER) * upper_share)
        return unmarked | (without(trimmed, MARKS) >= n_words * mark_share) | shouts | ((n_words <= 12) & trimmed.rlike(BOILERPLATE))

    return let(F.btrim(line, F.lit(SPACES)), lambda own: let(F.struct(own.alias("line"), without(own, SPACES).alias("spaces")), rules))


def repeated_words(found: Column) -> Column:
    """How many words lie in 5-word windows that the list of words holds twice or more, first ones included.

    Windows are compared by 64-bit hashes, sorted only where one repeats, so a text costs n log n at most.
    """

    def covered(places: Column) -> Column:
        step = lambda sum_, i: sum_ + F.least(F.lit(5), F.get(places, i) - F.get(places, i - 1))
        return F.when(F.size(places) == 0, 0).otherwise(5 + F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(places) - 1, F.lit(1))), F.lit(0), lambda s, i: F.when(i < F.size(places), step(s, i)).otherwise(s)))

    def twice(windows: Column) -> Column:
        held = F.filter(windows, lambda w, i: (F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"]))
        return let(F.sort_array(F.transform(held, lambda w: w["i"])), covered)

    def windows_of(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - 5)
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(5)]))
        placed = lambda all_: F.sort_array(F.transform(all_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(hashed, lambda all_: F.when(F.size(F.array_distinct(all_)) == F.size(all_), 0).otherwise(let(placed(all_), twice)))

    return let(found, lambda own: F.when(F.size(own) < 6, 0).otherwise(windows_of(own)))


def quality_rules(docs: DataFrame, max_lost_share: float = 0.3) -> DataFrame:
    """Counts and verdict for every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_share, clean_text.

    docs: doc_id and text; other columns are ignored, whatever their names. Lines are parted by \\n; a line without a word is
    neither judged nor counted, and stays. kept is false if base_failed or if failed lines hold more than
    max_lost_share of the characters of all judged lines. A null text counts as empty: no words,
    base_failed, not kept, null clean_text. Repeated rows are judged each, a very long text whole; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    judged = lambda x: F.struct(x.alias("line"), has_word(x).alias("told"), F.length(x).alias("chars"), (has_word(x) & line_fails(x)).alias("failed"))
    total = lambda each, n: F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + n(x))

    def of_lines(each: Column, told: Column) -> Column:
        lines = F.transform(told, lambda x: x["line"])
        return F.struct(
            F.size(told).alias("n_lines"),
            (F.size(told) - F.size(F.array_distinct(lines))).alias("n_dup"),
            F.size(F.filter(told, lambda x: x["failed"])).alias("n_failed"),
            total(told, lambda x: x["chars"]).alias("chars"),
            total(told, lambda x: F.when(x["failed"], x["chars"]).otherwise(0)).alias("lost"),
            F.array_join(F.transform(F.filter(each, lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("clean"),
        )

    lines = let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), judged), lambda each: let(F.filter(each, lambda x: x["told"]), lambda told: of_lines(each, told)))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.isNull().alias("_null"),
        let(words(text), lambda own: F.struct(F.size(own).alias("n"), repeated_words(own).alias("repeated"))).alias("_words"),
        F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long").alias("word_chars"),
        without(F.coalesce(text, F.lit("")), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n_words, repeated = F.col("_words.n").cast("long"), F.col("_words.repeated").cast("long")
    base_failed = (n_words < 10) | (repeated * 100 > n_words * 20)
    lost = F.when(F.col("_lines.chars") > 0, F.col("_lines.lost") / F.col("_lines.chars")).otherwise(0.0)
    return counted.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_lines.n_dup").cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost <= max_lost_share)).alias("kept"),
        F.col("_lines.n_lines").alias("n_lines"),
        F.col("_lines.n_failed").alias("n_failed_lines"),
        lost.alias("lost_share"),
        F.when(~F.col("_null"), F.col("_lines.clean")).alias("clean_text"),
    )
