"""Quality rules: a table of thresholds compiled into one projection, without user functions or shuffles.

Words are runs of `[^\\x20\\x09-\\x0D]`. Counts of the whole text are made once per row; ratios and comparisons are
plain arithmetic over them. Null text counts as empty: no words, so it fails the base rule. Equal rows get equal
verdicts; other columns are kept, those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, free, quoted

# Common short words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "was", "are", "be", "by", "on", "this", "a", "an", "as", "at",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "en", "du", "dans", "par", "pour", "est", "sur", "au", "avec",
    "der", "die", "das", "und", "zu", "den", "mit", "von", "ist", "ein", "eine", "nicht", "auf", "im", "dem", "des", "sich",
    "el", "los", "las", "y", "una", "del", "por", "con", "no", "se", "para", "su",
)
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """The row of a threshold table: `measure` must lie between `least` and `most`, both included; None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Loose bounds that ordinary prose keeps well inside.
RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=1.5, most=16.0),
    Rule("symbol_ratio", most=0.2),
    Rule("distinct_stop_words", least=1),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.2),
    Rule("blank_line_ratio", most=0.8),
    Rule("shout_ratio", most=0.6),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that occur more than once in the text, the first time included.

    Windows are hashed in one pass; texts without an equal pair stop there. Else hash and place are sorted, equal
    neighbours give the repeated places, and the lengths of the merged windows are summed: O(n log n).
    """

    def windows(v: Column) -> Column:
        places = F.when(F.size(v) >= width, F.sequence(F.lit(0), F.size(v) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(v, i + d) for d in range(width))))

    def places(h: Column) -> Column:
        """Sorted places of windows that are not alone."""
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        alike = F.transform(
            F.array(ordered),
            lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))),
        )
        return F.array_sort(F.transform(F.get(alike, F.lit(0)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        many = F.get(F.transform(F.array(places(h)), covered), F.lit(0))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(many)

    hashes = F.get(F.transform(F.array(words), windows), F.lit(0))
    return F.get(F.transform(F.array(hashes), count), F.lit(0))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the measures, kept."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} | {m for m in MEASURES}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made and c != text_col))
    words, full = free(docs, "words", "full")
    text = as_text(text_col)
    lines = F.split(text, "\n")
    base = docs.withColumns({words: _words(text), full: F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    counted = base.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(F.col(full)))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)),
        "n_lines": F.size(lines).cast("long"),
        "n_full_lines": F.size(full).cast("long"),
        "distinct_stop_words": F.size(F.array_intersect(F.col(words), F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
    }).drop(words, full)
    n, one = F.col("n_words"), F.lit(1.0)
    ratios = {
        "mean_word_chars": F.when(n > 0, F.col("word_chars") / n).otherwise(0.0),
        "symbol_ratio": F.when(n > 0, F.col("n_symbols") / F.greatest(F.col("word_chars") * one, one)).otherwise(0.0),
        "dup_line_ratio": F.when(F.col("n_full_lines") > 0, F.col("n_dup_lines") / F.col("n_full_lines")).otherwise(0.0),
        "repeat_word_ratio": F.when(n > 0, F.col("n_repeat_words") / n).otherwise(0.0),
        "blank_line_ratio": (F.col("n_lines") - F.col("n_full_lines")) / F.greatest(F.col("n_lines") * one, one),
        "shout_ratio": F.when(F.col("word_chars") > 0, F.col("n_upper") / F.col("word_chars")).otherwise(0.0),
    }
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return counted.withColumns(ratios).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


#: Columns that a threshold table may name.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_full_lines", "distinct_stop_words", "n_upper",
    "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_word_ratio", "blank_line_ratio", "shout_ratio",
)


def passes(rules: Sequence[Rule]) -> Column:
    """One boolean column from the table of thresholds."""
    out = F.lit(True)
    for r in rules:
        if r.measure not in MEASURES:
            raise ValueError(f"no such measure: {r.measure}")
        value = quoted(r.measure)
        out = out if r.least is None else out & (value >= r.least)
        out = out if r.most is None else out & (value <= r.most)
    return out
