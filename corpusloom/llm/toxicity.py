"""Toxicity: a learned lexicon matched by Levenshtein automata over its trie, with context windows.

Learning (distributed counts over the labelled training rows): words and word
stems that tell toxic from clean texts become the lexicon.  Matching: the
Levenshtein automata of all terms are walked together over the lexicon trie
(one lazily determinised automaton), so every distinct word is read once and
misspelled terms are met as well.  Scoring: every hit weighs by its term, how
it matched and its context window (quotation and reporting against direct
abuse); a logistic curve maps the best evidence of a text to 0..1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import forget_worker_caches, id_and_text, materialise
from corpusloom.session import ship_code

STEM_LENGTHS = (3, 4, 5, 6, 7)
EDIT_SHARE = 0.5  # of a term's weight, per edit
WORD = r"[\p{L}\p{N}]+"
EDGE = re.compile(r"^\W+|\W+$")
PIECE = re.compile(r"[^\W_]+")  # WORD in Python's terms
QUOTES = "\"'«»“”„‘’"
REPORTING = frozenset({
    "said", "says", "called", "wrote", "writes", "quoted", "quote", "reported", "word", "term", "insult", "insulted",
    "dit", "appelé", "écrit", "mot", "sagte", "nannte", "schrieb", "wort", "dijo", "llamó", "escribió", "palabra",
})
DIRECT = frozenset({"you", "your", "u", "he", "she", "they", "tu", "vous", "du", "ihr", "sie", "usted", "tú"})


@dataclass
class Model:
    """Lexicon (term -> weight; stems apart) and the logistic curve of the score."""

    words: dict[str, float]
    stems: dict[str, float]
    # Logistic curve over (evidence of exact terms and stems, evidence of misspelled terms, log length, 1).
    curve: tuple[float, float, float, float] = (1.0, 0.5, 0.0, -4.0)
    # Words of clean texts that lie near a term -> the most they may weigh.
    near: dict[str, float] = field(default_factory=dict)
    window: int = 8
    quoted: float = 0.4
    direct: float = 1.15
    examples: int = 0


class LevenshteinTrie:
    """All Levenshtein automata of a lexicon, intersected with its trie and determinised on demand.

    A state is the set of (trie node, edits left) reached so far; transitions
    are kept once computed, so a word costs one lookup per character and most
    words die after a few.  Terms shorter than ``near`` letters are matched
    exactly, from there on with one edit, from ``far`` letters with two.  With
    ``swaps``, two neighbouring letters that changed places are one edit.
    """

    def __init__(self, terms: list[str], near: int = 5, far: int = 10, swaps: bool = False):
        self.near, self.far, self.swaps = near, far, swaps
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.start = {}
        for term in sorted(terms):
            node = 0
            edits = self._allowed(term)
            # One trie per number of edits allowed, below a marker edge.
            for c in (f"<{edits}>", *term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = term
        # A state holds (node, letter that a swap still has to read, edits left).
        first = {(n, "", k) for k in (0, 1, 2) for n in [self.children[0].get(f"<{k}>")] if n is not None}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.initial = self._state(self._closure(first))

    def _allowed(self, term: str) -> int:
        return 0 if len(term) < self.near else 1 if len(term) < self.far else 2

    def _closure(self, reached: set[tuple[int, str, int]]) -> frozenset:
        """Adds states reached by leaving out letters of a term; keeps the most edits left per node."""
        best: dict[tuple[int, str], int] = {}
        todo = list(reached)
        while todo:
            node, owed, left = todo.pop()
            if best.get((node, owed), -1) >= left:
                continue
            best[node, owed] = left
            if left and not owed:
                todo += [(child, "", left - 1) for child in self.children[node].values()]
        return frozenset((node, owed, left) for (node, owed), left in best.items())

    def _state(self, key: frozenset) -> int:
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            hits = []
            for node, owed, left in key:
                term = self.ends[node]
                if term is not None and not owed:
                    hits.append((self._allowed(term) - left, term))
            self.accepts.append((min(hits)[1], min(hits)[0]) if hits else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        moved: set[tuple[int, str, int]] = set()
        for node, owed, left in self.sets[state]:
            if owed:
                if c == owed:
                    moved.add((node, "", left))
                continue
            kids = self.children[node]
            if c in kids:
                moved.add((kids[c], "", left))
            if left:
                moved.add((node, "", left - 1))
                moved.update((child, "", left - 1) for child in kids.values())
                if self.swaps:
                    moved.update((self.children[child][c], x, left - 1) for x, child in kids.items() if x != c and c in self.children[child])
        target = self._state(self._closure(moved)) if moved else -1
        self.next[state][c] = target
        return target

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term, ties by term; None without one."""
        state = self.initial
        for c in word:
            follow = self.next[state].get(c)
            if follow is None:
                if len(self.sets) > 200_000:  # memory bound of the cache; it fills again
                    self.__dict__.update(LevenshteinTrie([t for t in self.ends if t], self.near, self.far, self.swaps).__dict__)
                    return self.match(word)
                follow = self._step(state, c)
            if follow < 0:
                return None
            state = follow
        return self.accepts[state]


class Matcher:
    """Weight of one word: (exact term or stem, misspelled term); at most one of them is not zero."""

    NONE = (0.0, 0.0)

    def __init__(self, model: Model):
        self.model = model
        self.trie = LevenshteinTrie(list(model.words), near=4, swaps=True)
        self.cache: dict[str, tuple] = {}

    def weight(self, token: str) -> tuple[float, float]:
        word = EDGE.sub("", token).lower()
        if len(word) < 3:
            return self.NONE
        m = self.model
        best = m.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if len(word) > n:
                best = max(best, m.stems.get(word[:n], 0.0))
        if best:
            return best, 0.0
        hit = self.trie.match(word)
        return (0.0, min(m.words[hit[0]] * EDIT_SHARE ** (hit[1] - 1), m.near.get(word, math.inf))) if hit else self.NONE

    def read(self, token: str) -> tuple[int, tuple]:
        """Number of words of a token, and its hits as (first word, last word, key, weight).

        Words are cut as in learning.  A token of several words without a hit is
        read whole as well, for signs put inside a term: first without its signs
        as an exact term, then with them.
        """
        words = PIECE.findall(token)
        hits = tuple((k, k, word.lower(), w) for k, word in enumerate(words) if (w := self.weight(word)) != self.NONE)
        if hits or len(words) < 2:
            return len(words), hits
        bare = "".join(words).lower()
        w = (self.model.words[bare], 0.0) if bare in self.model.words else self.weight(token)
        return len(words), ((0, len(words) - 1, EDGE.sub("", token).lower(), w),) if w != self.NONE else ()

    def evidence(self, text: str) -> tuple[float, float, int, int]:
        """Evidence of exact and of misspelled terms after the context windows, number of hits, number of words.

        Occurrences of the same word count with diminishing weight.
        """
        m, cache = self.model, self.cache
        if len(cache) > 400_000:
            cache.clear()
        tokens = text.split()
        found, n = [], 0
        for t in tokens:
            r = cache.get(t)
            if r is None:
                r = cache[t] = self.read(t)
            if r[1]:
                found += [(n + first, n + last, key, w) for first, last, key, w in r[1]]
            n += r[0]
        if not found:
            return 0.0, 0.0, 0, n
        bare: list[str] = []
        opens, closes = [0] * (n + 1), [0] * (n + 1)  # quotes that open before a word, or close after it
        for t in tokens:
            words = PIECE.findall(t)
            opens[len(bare)] |= t[:1] in QUOTES
            bare += [word.lower() for word in words]
            closes[len(bare) - 1 if bare else n] |= t.rstrip(".,;:!?")[-1:] in QUOTES
        best: dict[str, list[float]] = {}
        for first, last, key, (exact, fuzzy) in found:
            lo, hi = max(0, first - m.window), min(n, last + m.window + 1)
            around = bare[lo:hi]
            factor = 1.0
            if any(opens[lo:first + 1]) and any(closes[last:hi]):
                factor = m.quoted * (0.5 if any(b in REPORTING for b in around) else 1.0)
            elif any(b in DIRECT for b in around):
                factor = m.direct
            entry = best.setdefault(key, [0.0, 0.0, 0])
            entry[0], entry[1], entry[2] = max(entry[0], exact * factor), max(entry[1], fuzzy * factor), entry[2] + 1
        grown = [(e, f, 1 + math.log(c)) for e, f, c in best.values()]
        return sum(e * g for e, _, g in grown), sum(f * g for _, f, g in grown), len(found), n

    def score(self, text: str) -> tuple[float, int]:
        exact, fuzzy, hits, n = self.evidence(text)
        a, b, c, d = self.model.curve
        z = a * exact + b * fuzzy + c * math.log1p(n) + d
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, per_class: int) -> DataFrame:
    """At most about ``per_class`` labelled texts of each class, drawn by hash: the documented bound of the fit."""
    seen = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id"))
    ).dropDuplicates(["_id"])
    sizes = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("toxic") == value) & (draw < min(1_000_000, math.ceil(1_000_000 * per_class / max(1, n)))))
    # At most about 2 * per_class narrow rows: bounded by the parameter, so it may be broadcast.
    sample = F.broadcast(seen.where(keep))
    return docs.join(sample, "_id").select("_text", "toxic")


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    per_class: int = 8_000, min_texts: int = 3, max_terms: int = 3000, min_odds: float = 8.0,
) -> Model:
    """Lexicon and curve from the labelled rows that are not held out.

    Counts are per distinct text (copies count once).  A term (a word, or a
    stem of some first letters) needs ``min_texts`` toxic texts and odds of
    ``min_odds``.  Terms are then chosen greedily by how many toxic texts they
    explain, so words that merely share a text with telling ones drop out.
    The driver sees at most ``max_terms`` candidates and, of the bounded
    sample, which toxic text holds which candidate.
    """
    ship_code()
    rows = training_rows(id_and_text(docs, id_col, text_col), labels, id_col, per_class)
    rows = rows.select(F.lower("_text").alias("_text"), "toxic").groupBy("_text").agg(F.max("toxic").alias("toxic"))
    rows = materialise(rows, "toxicity-sample")
    words = F.filter(F.array_distinct(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))), lambda x: F.char_length(x).between(3, 40))
    bag = rows.select("toxic", F.xxhash64("_text").alias("_t"), F.explode(words).alias("word"))
    stems = F.array_distinct(F.concat(*[
        F.when(F.char_length("word") > n, F.array(F.concat(F.substring("word", 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in STEM_LENGTHS
    ], F.array("word")))
    # Few distinct terms a text: a text's repeated stems meet in one row before they are counted.
    spread = bag.select("toxic", "_t", F.explode(stems).alias("term")).distinct()
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, {}, examples=n_toxic + n_clean)
    counts = spread.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = materialise(counts.where((F.col("t") >= min_texts) | ((F.col("c") >= min_texts) & ~F.col("term").endswith("*"))), "toxicity-counts")
    odds = ((F.col("t") + 0.5) / (n_toxic + 1.0)) / ((F.col("c") + 0.5) / (n_clean + 1.0))
    picked = materialise(
        counts.where(F.col("t") >= min_texts).select("term", F.log(odds).alias("w"), "t").where(F.col("w") >= math.log(min_odds))
        .orderBy(F.desc(F.col("t") * F.col("w")), "term").limit(max_terms), "toxicity-terms")
    weight = {r["term"]: r["w"] for r in picked.collect()}
    # At most max_terms rows: bounded, so they may be broadcast.
    held = spread.where("toxic = 1").join(F.broadcast(picked.select("term")), "term").groupBy("_t").agg(F.collect_list("term").alias("has"))
    chosen = greedy([frozenset(r["has"]) for r in held.orderBy("_t").collect()], weight)
    stem_weight = {t[:-1]: weight[t] for t in chosen if t.endswith("*")}
    word_weight = {t: weight[t] for t in chosen if not t.endswith("*")}
    # Frequent words of a chosen stem join the trie, so that their misspellings are met too.
    for t, w in weight.items():
        if not t.endswith("*") and any(t.startswith(s) for s in stem_weight):
            word_weight.setdefault(t, w)
    model = Model(word_weight, stem_weight, examples=n_toxic + n_clean)
    clean = counts.where((F.col("c") >= min_texts) & ~F.col("term").endswith("*")).select("term", F.log(odds).alias("w"))
    model.near = near_words(clean, model)
    return calibrate(rows, model)


def near_words(clean: DataFrame, model: Model) -> dict[str, float]:
    """Of ``clean`` (term, w), the words that pass for a misspelled term, with their own weight (not below 0).

    At most the words of the bounded sample that lie a few edits from one of the bounded terms.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(model)
        for batch in batches:
            yield batch.filter(pa.array([matcher.weight(word.as_py())[1] > 0 for word in batch.column("term")], pa.bool_()))

    return {r["term"]: max(0.0, r["w"]) for r in clean.mapInArrow(run, "term string, w double").collect()}


def greedy(texts: list[frozenset], weight: dict[str, float], least: int = 3, need: int = 2) -> list[str]:
    """Terms by how many toxic texts they newly explain; a text asks for ``need`` terms of different stems."""
    open_for = [need] * len(texts)
    holders: dict[str, list[int]] = {}
    for k, has in enumerate(texts):
        for t in has:
            holders.setdefault(t, []).append(k)
    chosen: list[str] = []
    left = dict.fromkeys(sorted(holders))
    while left:
        gain = {t: sum(open_for[k] > 0 for k in holders[t]) for t in left}
        best = max(left, key=lambda t: (gain[t] * weight[t], t))
        if gain[best] < least:
            break
        chosen.append(best)
        stem = best.rstrip("*")
        for k in holders[best]:
            open_for[k] -= 1
        left = {t: None for t in left if gain[t] >= least and not t.startswith(stem) and not stem.startswith(t.rstrip("*"))}
    return chosen


def calibrate(rows: DataFrame, model: Model) -> Model:
    """Logistic regression on the evidence of the bounded sample; both classes weigh the same."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.evidence(text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *[pa.array([float(f[k]) for f in found], pa.float64()) for k in (0, 1, 3)]], ["toxic", "e", "f", "n"])

    sample = rows.select("toxic", "_text").mapInArrow(run, "toxic int, e double, f double, n double").toPandas()
    # A misspelled hit weighs a fixed share of its term: the sample holds too few of them to fit one.
    x = np.column_stack([sample["e"] + EDIT_SHARE * sample["f"], np.log1p(sample["n"]), np.ones(len(sample))])
    y = sample["toxic"].to_numpy(float)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    ridge = np.diag([1e-4, 1e-4, 1e-6])
    w = np.array([0.5, 0.0, -2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - ridge @ w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        w += 0.5 * np.linalg.solve(h, g)
    model.curve = (float(w[0]), EDIT_SHARE * float(w[0]), float(w[1]), float(w[2]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), ``n_hits``.

    Null and empty texts get the score of no evidence; repeated rows each get
    a row; whole texts are read.  Rows are independent: no shuffle.  ``keep``
    carries input columns along (prefixed ``in_``).
    """
    ship_code()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"in_{c}") for c in keep])
    kept = [f"in_{c}" for c in keep]
    types = dict(rows.dtypes)
    schema = ", ".join([f"_id {types['_id']}", *[f"`{c}` {types[c]}" for c in kept], "score double, predicted int, n_hits int"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget_worker_caches()
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.score(text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[batch.column(c) for c in kept], pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())],
                ["_id", *kept, "score", "predicted", "n_hits"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
