"""Column expressions for text.  All JVM-side (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the 29 code points Python's str.isspace() / re ``\s`` treat as
# whitespace, written with ``\x{..}`` escapes that both Java regex and RE2 read.
WS_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same 29 code points for the JVM side: Java's own whitespace test plus the
# four characters it leaves out (U+0085, U+00A0, U+2007, U+202F).  Equal to
# WS_CLASS on the whole BMP and about three times faster to match.
WS_CLASS_JAVA = r"[\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}]"
# Python ``\W`` on str patterns: anything but letters, digits and underscore.
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
# The same without the plain space (a space maps to itself, so matching it is wasted work).
NON_WORD_NOT_SPACE_CLASS = r"[^\p{L}\p{N}_ ]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(col_(c), rf"^{WS_CLASS_JAVA}+|{WS_CLASS_JAVA}+$", "")


def normalize_text(c) -> Column:
    """NBSP -> space, strip, collapse every whitespace run to one space."""
    collapsed = F.regexp_replace(col_(c), f"{WS_CLASS_JAVA}+", " ")
    return F.trim(collapsed)        # at most one plain space is left at each end


def default_process(c) -> Column:
    """Fuzzy-matching preprocess: non-word characters -> space, trim, lower case.

    Runs of replaced characters are not collapsed.
    """
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col_(c), F.lit("")), NON_WORD_NOT_SPACE_CLASS, " ")))


def normalize_answer(c) -> Column:
    """QA answer normalisation: lower, strip, every run of chars outside [a-z0-9.] -> one space.

    Not stripped again afterwards, so "yes!" becomes "yes ".
    """
    return F.regexp_replace(strip_ws(F.lower(col_(c))), r"[^a-z0-9.]+", " ")


def answer_tokens(c) -> Column:
    """Whitespace tokens of the normalised answer (empty pieces dropped)."""
    return F.filter(F.split(normalize_answer(c), " "), lambda t: F.length(t) > 0)


def truncate(c, n: int) -> Column:
    """First n code points."""
    return F.substring(col_(c), 1, n)


def falsy_coalesce(*cols, default: str | None = "") -> Column:
    """``a or b or default`` for strings: skips null and empty string."""
    parts = [F.nullif(col_(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def nonempty(c) -> Column:
    return col_(c).isNotNull() & (F.length(col_(c)) > 0)


def word_tokens(c) -> Column:
    """Whitespace-separated words of normalised text (for corpus statistics)."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: F.length(t) > 0)


def fmt3(c) -> Column:
    """``'%.3f' % x`` without thousands separators (format_number rounds like printf)."""
    return F.regexp_replace(F.format_number(col_(c), 3), ",", "")
