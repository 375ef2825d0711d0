"""The weighted ratio of two strings (0 to 100) and the pairs that can reach a cutoff.

With r(a, b) = 100 * 2 * LCS / (|a| + |b|), words cut at white space, and the longer string l times as long as the shorter:

* l < 1.5: the greatest of r and 0.95 * the word score, which is r of the sorted words or the set score:
  with S the shared words, A and B the others of each side, the greatest r among "S", "S A" and "S B" (100 where there are shared words
  and A or B is empty);
* otherwise, with p = 0.9 up to l = 8 and 0.6 beyond: the greatest of r, p times the best r of the shorter with a window of the longer
  (no window longer than the shorter; shorter ones only at the ends), and 0.95 * p times the same for the words (100 where a word is shared).

Case counts.  Empty strings score 0; strings without a word have no word score.

From a cutoff of 86 on the last of these (at most 85.5) and everything beyond l = 8 can't qualify, nor can r for l >= 1.5 (at most 80).
What is left has an exact filter each (``wratio_candidates``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS_CLASS_JAVA
from ..session import ship_code
from .qgrams import cover_candidates, hint_for, piece_candidates, prefix_candidates

LEAST_CUTOFF = 86
WORDS, PART, FAR_PART = 0.95, 0.9, 0.6     # weights of word scores, of windows up to 8 times the length, and beyond


def places(a: str) -> dict[str, int]:
    """Bit mask of the places of each character."""
    out: dict[str, int] = {}
    for i, ch in enumerate(a):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def lcs(at: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence; all places of one side move in one integer."""
    full = (1 << size) - 1
    row = full
    for ch in b:
        met = row & at.get(ch, 0)
        row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * lcs(places(a), len(a), b) / (len(a) + len(b)) if a or b else 0.0


def window_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one."""
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    if short in long:
        return 100.0
    at, m, best = places(short), len(short), 0.0
    for end in range(1, len(long) + m):
        window = long[max(0, end - m):end]
        # A window whose outer letter is not in the shorter string is no better than the one without it.
        if window[0] in at or window[-1] in at:
            best = max(best, 200 * lcs(at, m, window) / (m + len(window)))
    return best


def word_ratio(a: str, b: str) -> float:
    wa, wb = sorted(a.split()), sorted(b.split())
    if not wa or not wb:
        return 0.0
    best = ratio(" ".join(wa), " ".join(wb))
    shared = " ".join(sorted(set(wa) & set(wb)))
    only_a, only_b = " ".join(sorted(set(wa) - set(wb))), " ".join(sorted(set(wb) - set(wa)))
    if shared and not (only_a and only_b):
        return 100.0
    gap = 1 if shared else 0
    size_a, size_b = len(shared) + gap + len(only_a), len(shared) + gap + len(only_b)
    # The shared words are matched whole, the others with each other.
    best = max(best, 200 * (len(shared) + gap + lcs(places(only_a), len(only_a), only_b)) / (size_a + size_b))
    if shared:
        best = max(best, 200 * len(shared) / (len(shared) + min(size_a, size_b)))
    return best


def word_window_ratio(a: str, b: str) -> float:
    wa, wb = sorted(a.split()), sorted(b.split())
    if set(wa) & set(wb):
        return 100.0
    return max(window_ratio(" ".join(wa), " ".join(wb)), window_ratio(" ".join(sorted(set(wa))), " ".join(sorted(set(wb)))))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short, long = sorted((len(a), len(b)))
    whole = ratio(a, b)
    if 2 * long < 3 * short:
        return max(whole, WORDS * word_ratio(a, b))
    part = PART if long <= 8 * short else FAR_PART
    return max(whole, part * window_ratio(a, b), WORDS * part * word_window_ratio(a, b))


def _words(c: str, distinct: bool) -> Column:
    words = F.filter(F.split(c, f"{WS_CLASS_JAVA}+"), lambda w: F.length(w) > 0)
    return F.array_join(F.array_sort(F.array_distinct(words) if distinct else words), " ")


def wratio_candidates(t: DataFrame, v: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (_id, system, pos) of texts (_id, _t, m) and terms (system, pos, term, n) that can score ``cutoff`` (86 or more).

    r >= c allows (1 - c/100) * (m + n) letters that come or go, at most 2 * (1 - c/100) of the longer length: the bigram
    filter of edits.  The same holds for sorted words, and for sets of words by the trigrams of single words, which do not depend on
    their order (to break all of them takes a quarter of the length, more than a cutoff of 86 allows).  "S" against "S A" needs nearly
    all words of one side in the other (``cover_candidates``), windows a whole piece of the shorter string in the longer
    (``piece_candidates``).
    """
    def gap(of: float) -> float:
        return 1 - cutoff / 100 / of

    def share(of: float) -> int:
        return math.ceil(200 * gap(of) - 1e-9)

    def forms(build: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
        return (t.select("_id", build("_t").alias("_t")).where("_t != ''").withColumn("m", F.length("_t")),
                v.select("system", "pos", build("term").alias("term")).where("term != ''").withColumn("n", F.length("term")))

    key = ["_id", "system", "pos"]
    near = F.greatest("m", "n") * 2 < F.least("m", "n") * 3
    hint = hint_for(v)
    sizes = hint(v.select("system", "pos", "n"))
    equal = t.join(hint(v), F.col("_t") == F.col("term")).select(*key)
    close = equal.unionByName(prefix_candidates(t, v, share(1), gap(1), hint=hint).select(*key))
    if cutoff <= 100 * WORDS:
        close = close.unionByName(prefix_candidates(*forms(lambda c: _words(c, False)), share(WORDS), gap(WORDS), hint=hint).select(*key))
        sets = forms(lambda c: _words(c, True))
        close = close.unionByName(prefix_candidates(*sets, share(WORDS), gap(WORDS), words=True, hint=hint).select(*key))
        k = gap(WORDS)
        close = close.unionByName(cover_candidates(*sets, 2 * k / (1 + k), hint))
    # Word scores count for strings of like lengths only; the length of a text is at hand, the text being its own id.
    close = close.join(sizes, ["system", "pos"]).withColumn("m", F.length("_id")).where(near).select(*key)
    if cutoff <= 100 * PART:
        close = close.unionByName(piece_candidates(t, v, 2 * gap(PART), hint))
    return close.distinct()


def score_pairs(pairs: DataFrame, scorer: Callable[[str, str], float]) -> DataFrame:
    """``pairs`` (system, pos, _id, term) with the score of text and term; the function goes to the tasks, a batch at a time."""
    out = T.StructType([*pairs.select("system", "pos", "_id", "term").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = [float(scorer(x, y)) for x, y in zip(b.column("_id").to_pylist(), b.column("term").to_pylist())]
            yield b.append_column("score", pa.array(scores, pa.float64()))

    ship_code()
    return pairs.select("system", "pos", "_id", "term").mapInArrow(run, out)
