"""Quality rules: one threshold table compiled into one Spark projection.

Main path: DataFrame functions only.  All statistics of a text are array and
string functions of that row, so there is no shuffle and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WORD_GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "be", "by", "for", "from", "have", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "pas",
    "pour", "que", "qui", "sur", "un", "une",
    "das", "dem", "den", "der", "die", "ein", "eine", "ich", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """A text fails when ``stat`` is below ``low`` or above ``high`` (None: no bound)."""

    stat: str
    low: float | None = None
    high: float | None = None


# The threshold table; every stat is a ratio of the columns of ``STATS``.
RULES = (
    Rule("mean_word_chars", low=2.5, high=14.0),
    Rule("symbols_per_word", high=0.1),
    Rule("bangs_per_word", high=0.5),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.4),
    Rule("words_per_line", low=1.5),
)

BASE = {"min_words": 50, "repeat_percent": 50}


# stat -> (numerator, denominator) among the counted columns.
STATS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions use them.

    A one-element explode is a generator: the optimiser cannot copy the
    expressions below it into the lambdas above it.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_o")
    return df.select(*df.columns, packed).select(*df.columns, *[F.col("_o")[k].alias(k) for k in cols])


def _occurrences(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def _verdict(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of all thresholds, as one expression over the counted columns."""
    ok = F.lit(True)
    for rule in rules:
        top, bottom = STATS[rule.stat]
        value = F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")
        if rule.low is not None:
            ok = ok & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            ok = ok & (value <= F.lit(float(rule.high)))
    return ok


def count_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counted columns per row; ``keep`` names input columns to carry along (prefixed ``in_``).

    Words are maximal runs of characters other than space and U+0009-U+000D.
    ``n_repeat_words`` counts the words that lie in some window of three words
    which occurs at least twice in the same text, first occurrences included.
    Windows are compared by 64-bit hash of the three words (within one text).
    A null or empty text has zero in every count.
    """
    carried = [F.col(c).alias(f"in_{c}") for c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), *carried)
    rows = _once(
        rows,
        words=F.filter(F.split("_text", WORD_GAP, -1), lambda w: w != ""),
        lines=F.filter(F.split("_text", "\n", -1), lambda line: F.rlike(line, F.lit(NOT_GAP))),
        n_symbols=_occurrences(F.col("_text"), SYMBOL),
        n_bangs=_occurrences(F.col("_text"), "!"),
    )
    n = F.size("words")
    window_hash = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = _once(
        rows,
        windows=F.when(n >= 3, window_hash).otherwise(F.array().cast("array<bigint>")),
        n_words=n.cast("long"),
        word_chars=F.char_length(F.array_join("words", "")).cast("long"),
        n_stop_words=F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    ).drop("words", "lines", "_text")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = _once(rows, ordered=F.when(repeats, by_hash)).drop("windows")

    def neighbour(j: Column) -> Column:
        return F.get("ordered", j)["h"]

    starts = F.transform(
        F.filter("ordered", lambda x, j: F.coalesce(neighbour(j - 1) == x["h"], F.lit(False)) | F.coalesce(neighbour(j + 1) == x["h"], F.lit(False))),
        lambda x: x["i"],
    )
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return rows.select(
        "_id", *[f"in_{c}" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        "n_stop_words", "n_bangs", "n_lines",
    )


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
    min_words: int = BASE["min_words"], repeat_percent: int = BASE["repeat_percent"], keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: counts, ``base_failed`` and ``kept``.

    Base: fewer than ``min_words`` words, or more than ``repeat_percent`` per
    cent of the words in repeated windows.  ``kept`` is false for those, else
    the verdict of the threshold table.  Null and empty texts have no words and
    fail the base; repeated rows each get a row; an empty table gives none.
    """
    stats = count_stats(df, id_col, text_col, keep)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    return stats.select(
        F.col("_id").alias(id_col), *[f"in_{c}" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_stop_words", "n_bangs", "n_lines", failed.alias("base_failed"),
        (~failed & _verdict(rules)).alias("kept"),
    )
