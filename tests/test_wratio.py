"""The weighted ratio against its definition, and its candidate filters against all pairs of small tables."""
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import label
from corpusloom.operators.qgrams import piece_candidates
from corpusloom.operators.wratio import lcs, places, window_ratio, word_ratio, wratio, wratio_candidates


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def plain_ratio(a, b):
    return 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def plain_windows(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    def of(x, y):
        spans = {y[i:i + len(x)] for i in range(len(y))} | {y[:i] for i in range(1, len(x))}
        return max(plain_ratio(x, s) for s in spans)
    return max(of(a, b), of(b, a)) if len(a) == len(b) else of(a, b)


def plain_words(a, b):
    wa, wb = a.split(), b.split()
    if not wa or not wb:
        return 0.0
    s, x, y = (" ".join(sorted(w)) for w in (set(wa) & set(wb), set(wa) - set(wb), set(wb) - set(wa)))
    best = plain_ratio(" ".join(sorted(wa)), " ".join(sorted(wb)))
    if s and (not x or not y):
        return 100.0
    if not s:
        return max(best, plain_ratio(x, y))
    # The shared words stand for themselves, so the distance is that of the others.
    d = len(x) + len(y) - 2 * plain_lcs(x, y)
    total = 2 * len(s) + 2 + len(x) + len(y)
    return max(best, 100 * (total - d) / total, plain_ratio(s, s + " " + x), plain_ratio(s, s + " " + y))


def plain(a, b):
    if not a or not b:
        return 0.0
    m, n = sorted((len(a), len(b)))
    if n / m < 1.5:
        return max(plain_ratio(a, b), 0.95 * plain_words(a, b))
    p = 0.9 if n / m <= 8 else 0.6
    wa, wb = sorted(a.split()), sorted(b.split())
    words = 100.0 if set(wa) & set(wb) else max(plain_windows(" ".join(wa), " ".join(wb)), plain_windows(" ".join(sorted(set(wa))), " ".join(sorted(set(wb)))))
    return max(plain_ratio(a, b), p * plain_windows(a, b), 0.95 * p * words)


def some_text(rnd, words):
    pick = [rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 2, 3, 4, 6]))]
    s = list(rnd.choice([" ", " ", "  "]).join(pick))
    for _ in range(rnd.choice([0, 0, 1, 1, 2])):
        i = rnd.randrange(len(s) + 1)
        s[i:i + rnd.choice([0, 1])] = rnd.choice(["", "a", "n", "é"])
    return "".join(s)


def test_parts_of_the_score():
    assert lcs(places("abcbdab"), 7, "bdcaba") == 4 and lcs({}, 0, "x") == 0
    assert wratio("acute myocardial infarction", "myocardial infarction, acute") > 86
    assert wratio("infarction acute myocardial", "acute myocardial infarction") == 95
    assert wratio("asthma", "asthma attack") == 90 and wratio("a" * 2, "a" * 17) == 60
    assert wratio("asthma", "Asthma") < 86 and wratio("", "x") == 0 and wratio(" ", "\t") == 0
    assert word_ratio("a b", "b a c") == 100 and word_ratio("", "a") == 0 and window_ratio("", "") == 0
    assert window_ratio("ab", "xax") == plain_windows("ab", "xax") == 50


def test_score_equals_the_definition():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeinst") for _ in range(rnd.choice([1, 2, 3, 5, 8]))) for _ in range(12)]
    for _ in range(1500):
        a, b = some_text(rnd, words), some_text(rnd, words)
        assert wratio(a, b) == pytest.approx(plain(a, b), abs=1e-9), (a, b)


@pytest.mark.parametrize("cutoff", [86, 93, 100])
def test_topk_equals_all_pairs(spark, cutoff):
    rnd = random.Random(cutoff)
    words = ["".join(rnd.choice("aeinstr") for _ in range(rnd.choice([1, 2, 4, 6, 9, 14]))) for _ in range(14)]
    terms = list(dict.fromkeys(some_text(rnd, words) for _ in range(70))) + ["x", "xy", " ", "stra" * 12]
    texts = [some_text(rnd, words) for _ in range(90)] + ["x", "xy", "xyz", " ", "", None, "stra" * 12 + "nn", "stra" * 6 + "n" + "stra" * 6 + " tail of it all " * 3, "x" * 5000]
    texts += [t[: max(1, len(t) // 2)] for t in terms[:30]] + texts[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocab = label.vocab_from_rows(spark, [("s", t, [t]) for t in terms])
    got = {}
    for r in label.fuzzy_topk(df, vocab, limit=1000, cutoff=cutoff, scorer="wratio").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["score"]
    hits = 0
    known = {}
    for i, text in enumerate(texts):
        if text not in known:
            known[text] = {p: s for p, t in enumerate(terms) if text and len(text) < 5000 for s in [wratio(text, t)] if s >= cutoff}
        hits += len(known[text])
        assert got.get(i, {}) == known[text], text
    assert hits > (60 if cutoff == 86 else 10)


def test_long_strings_may_hold_a_changed_term(spark):
    """Terms of 40 letters and more with as many edits as the cutoff allows, anywhere in a longer text."""
    rnd = random.Random(3)
    terms, texts = [], []
    for _ in range(30):
        t = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(12, 70))).strip() or "t"
        terms.append(t)
        s = list(t)
        for _ in range(rnd.randrange(0, 1 + len(t) // 22)):
            s[rnd.randrange(len(s))] = rnd.choice("abcdefgh")
        pad = "".join(rnd.choice("abcdefgh") for _ in range(len(t)))
        texts.append(pad[: len(t) // 3] + "".join(s) + pad[len(t) // 3:])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    vocab = label.vocab_from_rows(spark, [("s", t, []) for t in terms])
    got = {(r["id"], r["pos"]) for r in label.fuzzy_topk(df, vocab, limit=99, scorer="wratio").collect()}
    assert got == {(i, p) for i, a in enumerate(texts) for p, b in enumerate(terms) if wratio(a, b) >= 86} and len(got) > 12
    # Turned round, terms are the longer side.
    back = {(r["id"], r["pos"]) for r in label.fuzzy_topk(spark.createDataFrame(list(enumerate(terms)), "id long, text string"),
                                                          label.vocab_from_rows(spark, [("s", t, []) for t in texts]), limit=99, scorer="wratio").collect()}
    assert back == {(p, i) for i, p in got}


def test_candidates_are_few_and_joined_by_key(spark):
    rnd = random.Random(8)
    syllables = ["".join(p) for p in zip("bcdfghklmnprstvz" * 4, "aeiou" * 13)][:60]
    name = lambda: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.choice([2, 3, 4]))) for _ in range(rnd.choice([1, 2, 3])))
    terms = [name() for _ in range(20000)]
    texts = [rnd.choice(terms) + rnd.choice(["", "s", " " + name()]) for _ in range(100)]
    t = spark.createDataFrame([(x, x) for x in set(texts)], "_id string, _t string").withColumn("m", F.length("_t"))
    v = label.vocab_from_rows(spark, [("s", x, []) for x in terms]).select("system", "pos", "term", F.length("term").alias("n"))
    cand = wratio_candidates(t, v, 86)
    assert "CartesianProduct" not in cand._jdf.queryExecution().toString() and "NestedLoop" not in cand._jdf.queryExecution().toString()
    assert cand.count() / t.count() < 0.15 * len(terms)
    assert piece_candidates(t, v, 2 * (1 - 86 / 90)).count() / t.count() < 0.02 * len(terms)


def test_scorer_function_and_mapping(spark):
    texts = spark.createDataFrame([(1, "chronic asthma"), (1, "asthma"), (None, "asthma"), (2, None)], "id long, text string")
    vocab = label.vocab_from_rows(spark, [("icd10", "asthma", ["J45"]), ("icd10", "asthma, chronic", ["J45.9"])])
    exact = label.fuzzy_topk(texts, vocab, scorer=lambda a, b: 100.0 if a == b else 0.0).collect()
    assert sorted(((r["id"] or 0), r["pos"], r["score"]) for r in exact) == [(0, 0, 100.0), (1, 0, 100.0)]
    codes = label.map_icd10(texts, vocab, scorer="wratio").collect()
    assert sorted((r["id"] or 0, r["codes"]) for r in codes) == [(0, ["J45", "J45.9"]), (1, ["J45", "J45.9"]), (1, ["J45", "J45.9"]), (2, [])]   # the word is inside both
    with pytest.raises(ValueError):
        label.fuzzy_topk(texts, vocab, scorer="wratio", cutoff=85)
    none = label.fuzzy_topk(texts, vocab.limit(0), scorer="wratio")
    assert none.collect() == [] and none.columns == ["id", "system", "pos", "term", "score", "rank"]
    assert label.fuzzy_topk(texts.limit(0), vocab, scorer="wratio").collect() == []
