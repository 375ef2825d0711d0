"""Operators over the whole corpus: repeated strings, conversation trie, collocations, each against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocation, prefixtrie, suffixdedup
from corpusloom.llm.common import join_hot


def key(row):
    return tuple((v is not None, v) for v in row)


def test_hot_keys_join_like_any_other(spark):
    big = spark.createDataFrame([(1, i) for i in range(4000)] + [(i, 0) for i in range(2, 900)], "k long, v long")
    unique = big.groupBy("k").agg(F.count("v").alias("n")).where("k < 500")
    got = join_hot(big, unique, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(unique, "k").collect()))
    assert join_hot(big.where("k < 0"), unique.where("k < 0"), ["k"], "n").collect() == []


# --- repeated strings

def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def spans_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("s"), "kept_sha256").collect()), key=key)


def awkward_texts(rnd):
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(450))
    noise = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 300)))
    texts = ["a" * 700, "ab" * 250, None, "", "x" * 199, "x" * 200, "é" * 150 + "tail", "z" * 50, "\x00" * 230, "\x00" * 210 + "end"]
    return texts + [noise() + passage[rnd.randint(0, 200):rnd.randint(250, 450)] + noise() for _ in range(40)] + [passage, passage]


@pytest.mark.parametrize("bucket", [40_000, 150])
def test_repeats_equal_brute_force(spark, bucket):
    texts = awkward_texts(random.Random(3))
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, pos int").repartition(3)
    rows = docs.collect()
    want = sorted(((r[0], *w) for r, w in zip(rows, plain_repeats([r[1] for r in rows], 200))), key=key)
    assert spans_of(suffixdedup.remove_repeats(docs, bucket_suffixes=bucket)) == want


def test_repeats_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r[0], *w) for r, w in zip(rows, plain_repeats([r[1] for r in rows], 200))), key=key)
    assert spans_of(suffixdedup.remove_repeats(docs, bucket_suffixes=500)) == want
    assert sum(w[2] for w in want) > 0


def test_kept_bytes_and_other_lengths(spark):
    texts = ["one two three four five six seven eight nine ten. " * k + tail for k, tail in ((1, "A"), (2, "B"), (1, "C"))] + ["", None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs, length=40, keep_text=True).collect()}
    for i, (size, removed, runs, sha) in enumerate(plain_repeats(texts, 40)):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == (size, removed, runs, sha)
        assert hashlib.sha256(r["kept"]).hexdigest() == sha
        data = (texts[i] or "").encode()
        assert removed == sum(s["stop"] - s["start"] for s in r["spans"])
        assert all(data[s["start"]:s["stop"]] not in bytes(r["kept"]) for s in r["spans"])


def test_repeats_of_awkward_rows(spark, edge_docs, edge_rows, no_docs):
    want = sorted(((i, *w) for (i, _), w in zip(edge_rows, plain_repeats([t for _, t in edge_rows], 200))), key=key)
    assert spans_of(suffixdedup.remove_repeats(edge_docs)) == want
    assert spans_of(suffixdedup.remove_repeats(no_docs)) == []


def test_long_text_is_read_whole(spark):
    rnd = random.Random(5)
    body = "".join(rnd.choices("abcdefghij klmnop", k=3 * suffixdedup.CHUNK))
    far = body[2 * suffixdedup.CHUNK - 150:2 * suffixdedup.CHUNK + 150]
    docs = spark.createDataFrame([(1, body), (2, "q" * 10 + far + "r" * 10)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs).collect()}
    assert out[1]["n_removed"] == out[2]["n_removed"] == 300
    assert tuple(out[1]["spans"][0]) == (2 * suffixdedup.CHUNK - 150, 2 * suffixdedup.CHUNK + 150)


def test_multikey_quicksort_orders_rows():
    rng = np.random.default_rng(1)
    for n, d, high in ((1, 3, 5), (500, 4, 3), (300, 2, 1), (800, 3, 2**64 - 1)):
        words = rng.integers(0, high, (n, d), dtype=np.uint64, endpoint=True)
        order = suffixdedup.multikey_quicksort(words)
        assert sorted(order) == list(range(n))
        assert words[order].tolist() == sorted(words.tolist())


def test_equal_strings_choose_the_same_suffix():
    rnd = random.Random(7)
    core = bytes(rnd.choices(b"abcd", k=200))
    places = []
    for head in (0, 1, 57, 300):
        raw = np.frombuffer(bytes(rnd.choices(b"abcd", k=head)) + core + bytes(rnd.choices(b"abcd", k=90)), np.uint8)
        valid = np.zeros(len(raw), bool)
        valid[head] = True
        place, _ = suffixdedup.suffix_places(raw, valid, 200)
        places.append((place - head).tolist())
    assert len(places[0]) == 1 and all(p == places[0] for p in places)


# --- conversation trie

def plain_trie(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    sequences = {}
    for c, turns in own.items():
        turns.sort()
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 4
            head = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
            turns = sorted(head)[:h] + turns[h:]
        sequences[c] = tuple((r, t) for _, r, t in turns)
    members, children = {}, {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        below = children.get(s, [])
        leaves[s] = sum(leaves[b] for b in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[b] for b in below)
        ends = ",".join(str(c) for c in sorted(c for c in members[s] if len(sequences[c]) == len(s)))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(below), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def trie_rows(df, **options):
    return sorted(map(tuple, prefixtrie.prefix_trie(df, **options).collect()), key=key)


@pytest.mark.parametrize("task_turns", [200_000, 25])
def test_trie_of_the_given_conversations(spark, sf, task_turns):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie_rows(df, task_turns=task_turns) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


SCHEMA = "conv_id long, turn long, role string, text string, q int, h1 string, weight long, pid string"


def awkward_conversations():
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "bot", None]), rnd.choice(["one", "two words", "", None, "three\x0bwords here"])) for c in range(60) for t in rnd.sample([None, 0, 1, 2, 3, 4], rnd.randint(1, 6))]
    rows += [(-25, 1, "user", "x"), (-40, 0, "user", "one"), (None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += [(1, 1, "user", "again"), (1, 1, "user", "again"), (2, None, None, None), (2, None, "a", "b"), (2, None, "a", "a")]    # repeated rows, ties
    rows += [(100, i, "user", f"turn {i % 3}") for i in range(400)] + [(101, i, "user", f"turn {i % 3}") for i in range(300)]       # deep
    rows += [(200 + i, 0, "user", "hello there") for i in range(150)]                                                              # wide and hot
    return [(*r, 1, "clash", 2, "clash") for r in rows]


@pytest.mark.parametrize("task_turns, rebuild", [(200_000, True), (120, True), (60, False)])
def test_trie_of_awkward_conversations(spark, task_turns, rebuild):
    rows = awkward_conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert trie_rows(df, task_turns=task_turns, rebuild=rebuild) == plain_trie([r[:4] for r in rows], rebuild)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_rows(empty) == []
    only = spark.createDataFrame([(7, 0, "user", "x", 1, "", 1, "")], SCHEMA)
    assert trie_rows(only) == plain_trie([(7, 0, "user", "x")])


def test_centroid_totals_are_subtree_sums():
    rng = np.random.default_rng(4)
    for shape in ("random", "path", "star", "forest"):
        n = 300
        parent = np.array([-1] + [{"random": int(rng.integers(0, i)), "path": i - 1, "star": 0, "forest": int(rng.integers(-1, i))}[shape] for i in range(1, n)])
        values = rng.integers(0, 9, (n, 2))
        want = values.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert (prefixtrie.centroid_totals(parent, values) == want).all(), shape


# --- collocations

def plain_collocations(rows, min_count, max_words=3, top=None):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        scored = []
        for p, a in counts.items():
            if len(p) < 2 or a < min_count:
                continue
            around = [b for q, b in counts.items() if len(q) > len(p) and b >= min_count and any(q[i:i + len(p)] == p for i in range(len(q)))] if max_words > 2 else []
            if any(100 * b >= 50 * a for b in around):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(docs, **options):
    return sorted(map(tuple, collocation.collocations(docs, **options).collect()))


def small_texts():
    rnd = random.Random(2)
    words = ["the", "The", "of", "a\x00b", "naïve", "東京", "x-ray", "ÉTÉ", "b"]
    texts = [(rnd.choice(["en", "de", None, "und", "a b\nc"]), "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", "\n", "; ", " "]) for _ in range(rnd.randint(0, 60)))) for _ in range(80)]
    return texts + [("en", None), (None, None), ("en", ""), ("fr", " \t "), ("en", ".,;:!?"), ("en", "the of " * 300), ("en", "the of " * 300)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "part_keys": 50}, {"max_words": 5}, {"max_words": 2, "top": 3}])
def test_collocations_equal_brute_force(spark, options):
    rows = small_texts()
    docs = spark.createDataFrame([(i, lang, t, "clash", 1, "clash") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int, block string").repartition(3)
    want = plain_collocations(rows, 10, options.get("max_words", 3), options.get("top"))
    assert want and mined(docs, min_count=10, **options) == want


def test_collocations_of_awkward_rows(spark, edge_docs, edge_rows, no_docs):
    assert mined(edge_docs, min_count=2) == plain_collocations([("x", t) for _, t in edge_rows], 2)
    assert mined(no_docs) == []
    assert mined(edge_docs.select(F.lit("").alias("text"), "lang")) == []


def test_scores_pass_64_bits(spark):
    docs = spark.createDataFrame([("en", "p q " * 70_000)] * 45, "lang string, text string")
    row, = [r for r in mined(docs, max_words=2) if r[2] == "p q"]
    n = 70_000 * 45
    assert row[3:] == (n, n, n, 2 * n, 1_000_000) and 1_000_000 * n * n > 2**62


def test_long_texts_are_cut_at_piece_ends():
    data = b"one two\nthree four five\n" * 50 + b"tail of the text"
    parts = list(collocation.slices(data, 100))
    assert b"".join(parts) == data and len(parts) > 5 and all(p.endswith(b"\n") for p in parts[:-1])
    assert list(collocation.slices(b"x" * 1000, 10)) == [b"x" * 1000]


def test_packed_numbers_are_read_back():
    rng = np.random.default_rng(0)
    for x in ([], [0], [5, 0, 2**62], rng.integers(0, 70_000, 1000), np.arange(300)):
        x = np.array(x, np.int64)
        assert (collocation.unpack(collocation.pack(x)) == x).all()
        assert (collocation.unpack(collocation.pack(np.sort(x), ascending=True)) == np.sort(x)).all()
