"""Exact candidate filters for similarity of short strings: equi-joins that lose no pair above a bound.

Texts come as rows (_id, _t, m), terms as (system, pos, term, n), m and n being lengths in code points.
Every filter takes the rarest parts of a string first, rarity counted over the terms, so that a large
vocabulary gives few candidates; none makes a cross join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small

TERM = ["system", "pos", "term", "n"]
TEXT = ["_id", "_t", "m"]
GRAM = 6
Hint = Callable[[DataFrame], DataFrame]


def hint_for(v: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> Hint:
    """One size check for all tables that the filters derive from the terms: a broadcast hint, or none.

    A term of n letters has at most ``GRAM`` * (n + 2) grams (padded), and each of their rows holds the term.
    """
    grams = (F.col("n") + 2) * GRAM
    size = v.agg(F.coalesce(F.sum(grams), F.lit(0)).alias("rows"), F.coalesce(F.sum(grams * (4 * F.col("n") + 64)), F.lit(0)).alias("bytes")).first()
    return F.broadcast if size["rows"] <= max_rows and size["bytes"] <= max_bytes else (lambda df: df)


def bigrams(c: Column) -> Column:
    """Multiset of bigrams of a (short) string as an array."""
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, 2))) \
        .otherwise(F.array().cast(T.ArrayType(T.StringType())))


def word_trigrams(c: Column) -> Column:
    """Trigrams of each word of a string, a blank before and after the word: one a letter."""
    words = F.filter(F.split(c, " "), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, 3))))


def destroyed(indel: float, q: int) -> float:
    """The most q-grams of a string, as a share of its length s, that D <= ``indel`` * (s + p) letters can break on the way to a string of length p.

    A letter that goes breaks q of them, one that comes q - 1; D + s - p = 2 * (letters that go), so q * go + (q - 1) * come =
    (q - 1/2) * D + (s - p) / 2, which is greatest at the shortest partner, p = s * (1 - indel) / (1 + indel).
    """
    return (q - 0.5) * indel + 0.5 - (0.5 - (q - 0.5) * indel) * (1 - indel) / (1 + indel)


def prefix_candidates(t: DataFrame, v: DataFrame, keep: int, indel: float | None = None, words: bool = False, hint: Hint = broadcast_if_small) -> DataFrame:
    """Pairs of texts (_id, _t, m) and terms (system, pos, term, n) that can be within ``keep`` per cent of the longer length.

    Prefix filter on bigrams: an edit touches two bigrams of a string at most, so of any 2d + 1 of them one comes
    through d edits, no more than d places off.  With one order over all bigrams that holds between
    the first 2d + 1 of both strings, equal ones at the end of them included (d of the own length: what a
    longer partner allows beyond is asked of the partner).  The
    order is by how many bigrams of the terms are equal: only the rarest ones are joined, and bigrams that no term
    has take places without meeting anyone.  Lengths are compared before a pair is made.
    ``indel``: the strings differ by letters that come or go only, at most this share of both lengths together; then fewer bigrams
    are taken (``destroyed``).  ``words``: grams are trigrams of the single words with blanks around them, and meet wherever they are,
    for strings whose words may move.
    """
    size_of = 3 if words else 2
    cut = word_trigrams if words else bigrams
    vg = v.select("system", "pos", "term", "n", F.posexplode(cut(F.col("term"))).alias("p", "g"))
    rare = hint(vg.groupBy("g").agg(F.count(F.lit(1)).alias("f")))

    def first(rows: DataFrame, of: list[str], size: str) -> DataFrame:
        """The rarest bigrams of each string, as many as the longest string it may meet allows edits for."""
        longest = F.floor(F.col(size) * 100 / (100 - keep))
        edits = F.floor(longest * keep / 100)
        lost = 2 * edits if indel is None else F.floor(F.col(size) * destroyed(indel, size_of) + 1e-9)
        all_ = rows.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("f", "g", "p"))).alias("o"))
        last = F.element_at("o", F.least(lost + 1, F.size("o")).cast("int"))
        taken = F.filter("o", lambda x: F.struct(x["f"], x["g"]) <= F.struct(last["f"], last["g"]))
        return all_.select(*of, F.explode(taken).alias("x")).select(*of, F.col("x.f").alias("f"), F.col("x.g").alias("g"), F.col("x.p").alias("p"))

    vp = first(vg.join(rare, "g"), ["system", "pos", "term", "n"], "n").select("system", "pos", "term", "n", "g", F.col("p").alias("q"))
    tg = t.select("_id", "_t", "m", F.posexplode(cut(F.col("_t"))).alias("p", "g")).join(rare, "g", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    tp = first(tg, ["_id", "_t", "m"], "m").where("f > 0").drop("f")
    longer = F.greatest("m", "n")
    near = longer * (100 - keep) <= F.least("m", "n") * 100
    if not words:
        near = near & (F.abs(F.col("p") - F.col("q")) <= F.floor(longer * keep / 100))
    return tp.join(hint(vp), "g").filter(near).drop("g", "p", "q").distinct()


def cover_candidates(t: DataFrame, v: DataFrame, missing: float, hint: Hint = broadcast_if_small) -> DataFrame:
    """Pairs (_id, system, pos) of which one side has all of its words in the other but for a share ``missing`` of its length.

    Rows hold their distinct words in ``_t`` and ``term``, joined by one space.  A word counts its letters and one separator.  Of the rarest words that
    together are longer than what may be missing one must be shared, so only these are joined, with all
    words of the other side, and in both directions.
    """
    vw = v.select(*TERM, F.explode(F.split("term", " ")).alias("w"))
    tw = t.select(*TEXT, F.explode(F.split("_t", " ")).alias("w"))
    rare = hint(vw.groupBy("w").agg(F.count(F.lit(1)).alias("f")))

    def first(rows: DataFrame, of: list[str], size: str) -> DataFrame:
        before = F.sum(F.length("w") + 1).over(Window.partitionBy(*of).orderBy("f", "w").rowsBetween(Window.unboundedPreceding, -1))
        ranked = rows.join(rare, "w", "left").withColumn("f", F.coalesce("f", F.lit(0))).withColumn("before", F.coalesce(before, F.lit(0)))
        return ranked.where((F.col("before") <= F.col(size) * missing + 1e-9) & (F.col("f") > 0)).select(*of, "w")

    pairs = first(tw, TEXT, "m").join(hint(vw), "w").unionByName(tw.join(hint(first(vw, TERM, "n")), "w"))
    return pairs.select("_id", "system", "pos").distinct()


def piece_candidates(t: DataFrame, v: DataFrame, edits: float, hint: Hint = broadcast_if_small) -> DataFrame:
    """Pairs (_id, system, pos), one 1.5 to 8 times as long as the other, of which the longer may hold the shorter with ``edits`` * length edits.

    A string cut into one piece more than it may have edits keeps a piece whole, so the rarest gram of each
    piece of the shorter is joined with all grams of the longer.  Grams have ``GRAM`` letters; strings below that are grams
    themselves, met by grams of their length.  Needs edits below 1 / 11 (then no piece is shorter than a gram).
    """
    def grams(c: Column, first: Column, last: Column, q: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda i: F.substring(c, i + 1, q))

    def longer(rows: DataFrame, of: list[str], text: str, size: str) -> DataFrame:
        q = rows.select(*of, F.explode(F.sequence(F.lit(1), F.lit(GRAM))).alias("q"))
        q = q.where((F.col(size) >= F.col("q")) & ((F.col("q") == GRAM) | F.col(size).between(F.col("q") * 1.5, F.col("q") * 8)))
        return q.select(*of, F.explode(F.array_distinct(grams(F.col(text), F.lit(0), F.col(size) - F.col("q"), F.col("q")))).alias("g"))

    def shorter(rows: DataFrame, of: list[str], text: str, size: str) -> DataFrame:
        d = F.floor(F.col(size) * edits + 1e-9).cast("int")
        p = rows.select(*of, F.explode(F.sequence(F.lit(0), d)).alias("k"), (d + 1).alias("pieces"), F.least(F.lit(GRAM), F.col(size)).alias("q"))
        edge = lambda k: F.floor(k * F.col(size) / F.col("pieces")).cast("int")
        g = p.select(*of, "k", F.explode(F.array_distinct(grams(F.col(text), edge(F.col("k")), edge(F.col("k") + 1) - F.col("q"), F.col("q")))).alias("g"))
        least = g.join(rare, "g", "left").groupBy(*of, "k").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("x"))
        return least.select(*of, F.col("x.f").alias("f"), F.col("x.g").alias("g"))

    vl = longer(v, TERM, "term", "n")
    rare = hint(vl.groupBy("g").agg(F.count(F.lit(1)).alias("f")))
    in_terms = shorter(t, TEXT, "_t", "m").where("f > 0").drop("f").join(hint(vl), "g").where("n >= 1.5 * m and n <= 8 * m")
    in_texts = longer(t, TEXT, "_t", "m").join(hint(shorter(v, TERM, "term", "n").drop("f")), "g").where("m >= 1.5 * n and m <= 8 * n")
    return in_terms.select("_id", "system", "pos").unionByName(in_texts.select("_id", "system", "pos")).distinct()
