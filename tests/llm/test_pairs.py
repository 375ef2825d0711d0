"""Operators over pairs and placements: near-duplicates, nearest codes, shards, and the pipeline."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import dartminhash, mih, quality, reshard, secrets, toxicity
from corpusloom.llm.common import materialise, shared_folder


def key(value):
    return (value is not None, value or 0)


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts, threshold=0.8):
    """Least index of the component of each text."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if (texts[a] or "") == (texts[b] or "") or (x and y and len(x & y) >= threshold * len(x | y)):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(texts))]


def test_collision_rate_is_weighted_similarity():
    rng = np.random.default_rng(4)
    n, t = 80, 2000
    element = rng.integers(0, 2**63, n).astype(np.uint64)
    x = rng.choice([0.5, 1.0, 2.5, 4.0], n)
    y = np.where(rng.random(n) < 0.7, x, rng.choice([0.0, 1.0, 3.0], n))
    some = y > 0
    owner = np.concatenate([np.zeros(n, int), np.ones(int(some.sum()), int)])
    s = dartminhash.signatures(owner, np.concatenate([element, element[some]]), np.concatenate([x, y[some]]), 2, t)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05
    alone = dartminhash.signatures(np.zeros(n, int), element, x, 1, t)
    assert (alone[0] == s[0]).all()  # a signature does not depend on its batch


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[k][0]: rows[c][0] for k, c in enumerate(brute_classes([t for _, t in rows]))}
    got = {r["doc_id"]: r for r in dartminhash.near_duplicates(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = collections.Counter(want.values())
    assert all(r["class_rows"] == sizes[r["class_id"]] for r in got.values())


def test_a_large_group_of_near_copies_and_a_chain(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(5000)]
    base = list(rng.choice(words, 120))
    texts = []
    for _ in range(150):  # near copies of one text: every bucket of theirs is large
        copy = list(base)
        copy[int(rng.integers(0, 120))] = str(rng.choice(words))
        texts.append(" ".join(copy))
    chain = list(rng.choice(words, 100))
    for k in range(8):    # neighbours are alike, the ends are not
        texts.append(" ".join(chain[3 * k:3 * k + 76]))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(40)] + [texts[0]] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)
    kept = sorted(r["doc_id"] for r in dartminhash.deduplicate(docs).collect())
    assert kept == sorted(set(got.values()))


def test_near_duplicates_of_awkward_rows(edge_docs, edge_rows, no_docs):
    rows = dartminhash.near_duplicates(edge_docs).collect()
    assert sorted(key(r["doc_id"]) for r in rows) == sorted(key(i) for i, _ in edge_rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["class_rows"] == 3
    assert by[3]["class_id"] == by[4]["class_id"] == 3 and by[5]["class_id"] == 5
    assert by[None]["class_id"] is None
    kept = sorted((r["doc_id"] for r in dartminhash.deduplicate(edge_docs).collect()), key=key)
    assert kept == [None, 1, 3, 5, 6, 7, 8, 9]
    assert dartminhash.near_duplicates(no_docs).collect() == [] and dartminhash.deduplicate(no_docs).collect() == []


def test_components_of_links(spark):
    rng = np.random.default_rng(9)
    links = [(bytes([a]), bytes([b])) for a, b in rng.integers(0, 120, (70, 2)).tolist() if a != b] + [(bytes([200 + k]), bytes([201 + k])) for k in range(40)]
    root = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    frame = spark.createDataFrame(links, "a binary, b binary")
    assert {bytes(r["h"]): bytes(r["root"]) for r in dartminhash.components(frame).collect()} == root


# --- nearest codes

def brute_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        near = sorted((sum((a >= 0) != (b >= 0) for a, b in zip(v, w, strict=True)), i) for i, w in rows)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "n", "k"), [(64, 300, 5), (20, 200, 7), (100, 60, 3), (8, 4, 10)])
def test_top_k_is_exact(spark, bits, n, k):
    rng = np.random.default_rng(bits)
    base = rng.normal(size=(max(2, n // 8), bits))
    rows = [(i, [float(x) for x in base[i % len(base)] + rng.normal(scale=0.4, size=bits)]) for i in range(n)]
    rows[-1] = (n - 1, rows[0][1])  # a tie
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("distance", F.lit("clash"))
    got = mih.top_k(df, df.where("vec_id % 3 = 0"), k=k, shard_rows=70, block_rows=11).collect()
    rows32 = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == brute_nearest(rows32, [r for r in rows32 if r[0] % 3 == 0], k)


def test_top_k_of_awkward_rows(spark):
    rows = [(1, [1.0, -1.0]), (2, None), (None, [1.0, 1.0]), (3, []), (4, [1.0, -1.0]), (4, [1.0, -1.0]), (5, [1.0]), (6, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mih.top_k(df, df.where("vec_id = 1"), k=3).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 4, 0), (1, 3, 4, 0)]
    none = df.where("false")
    assert mih.top_k(none, none).collect() == [] and mih.top_k(df, none).collect() == []


def test_top_k_of_repeated_query_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [(3, rows[3][1])] * 3 + [(8, rows[8][1])] * 2 + [(11, rows[11][1]), (11, rows[40][1]), (11, rows[41][1]), (11, rows[11][1])]
    got = mih.top_k(df, spark.createDataFrame(asked, df.schema), k=6, shard_rows=25, block_rows=2).collect()
    want = brute_nearest(rows, [rows[3], rows[8]], 6)
    # An id with several codes: the distance to the nearest of them.
    each = {}
    for _, _, i, d in brute_nearest(rows, [rows[11], rows[40], rows[41]], 60):
        each[i] = min(d, each.get(i, d))
    want += [(11, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in each.items())[:6])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == sorted(want)


# --- shards

def test_flow_is_cheapest():
    rng = np.random.default_rng(8)
    for _ in range(20):
        supply, room = rng.integers(0, 5, 3).tolist(), rng.integers(0, 6, 3).tolist()
        if sum(room) < sum(supply):
            room[0] += sum(supply) - sum(room)
        cost = rng.integers(0, 6, (3, 3)).tolist()
        flow = reshard.min_cost_flow(supply, room, cost)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= room[j] for j in range(3))
        found = sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(3))

        def splits(n):
            return [(a, b, n - a - b) for a in range(n + 1) for b in range(n - a + 1)]

        best = min(
            sum(cost[i][j] * f[i][j] for i in range(3) for j in range(3))
            for f in itertools.product(*map(splits, supply)) if all(sum(x[j] for x in f) <= room[j] for j in range(3)))
        assert found == best


def test_plan_moves_no_more_than_needed():
    blocks = [(old, b, 1, 10) for old in range(4) for b in range(30 if old == 0 else 10)]
    made = reshard.solve(blocks, 4)
    assert made.sizes == [150] * 4 and made.moved == 150  # shard 0 has 300, the others 100
    still = reshard.solve([(old, b, 1, 10) for old in range(3) for b in range(5)], 3)
    assert still.moved == 0 and still.affected == frozenset()


@pytest.mark.parametrize("new", [3, 8])
def test_reshard_places_all_rows(spark, sf, new):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = reshard.reshard(docs, F.pmod(F.col("doc_id"), F.lit(5)), new, shared_folder(spark, "test-shards")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in out} == texts and len(out) == len(texts)
    size = collections.Counter()
    for r in out:
        size[r["shard"]] += len(r["text"].encode()) + 8
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= max(len(t.encode()) + 8 for t in texts.values())


def test_unaffected_shards_stay(spark):
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(12)], "doc_id long, text string")
    folder = shared_folder(spark, "test-shards")
    out = reshard.reshard(docs, F.pmod(F.col("doc_id"), F.lit(3)), 3, folder).collect()
    assert all(r["shard"] == r["doc_id"] % 3 for r in out)
    assert spark.read.schema("doc_id long").parquet(folder).count() == 0


def test_reshard_of_awkward_rows(spark, edge_docs, edge_rows, no_docs):
    old = F.pmod(F.xxhash64("source"), F.lit(2))
    out = reshard.reshard(edge_docs, old, 3, shared_folder(spark, "test-shards")).collect()
    assert sorted((key(r["doc_id"]), r["text"] or "") for r in out) == sorted((key(i), t or "") for i, t in edge_rows)
    assert reshard.reshard(no_docs, old, 3, shared_folder(spark, "test-shards")).collect() == []


# --- pipeline

def test_pipeline_stages_do_what_their_operators_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality rules", "near duplicates", "secrets", "packing"]

    def run(name, frame):
        return materialise(stages[name](spark, frame, sf), "test-stage")

    calm = run("toxicity", docs)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    matcher = toxicity.Matcher(model)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in calm.collect()} == {i for i, r in rows.items() if matcher.score(r["text"])[0] < 0.7}
    good = run("quality rules", calm)
    kept = {r["doc_id"] for r in quality.quality_rules(calm).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    single = run("near duplicates", good)
    left = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert [r["doc_id"] for r in single.orderBy("doc_id").collect()] == sorted({left[c][0] for c in brute_classes([t for _, t in left])})
    clean = run("secrets", single)
    assert clean.count() == single.count() and calm.columns == good.columns == single.columns == clean.columns == docs.columns
    assert [f.dataType for f in clean.schema] == [f.dataType for f in docs.schema]
    field = secrets.train(single)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        text, base = before[r["doc_id"]], secrets.base_spans(before[r["doc_id"]])
        out, at = "", 0
        for s, _, e in sorted(base + secrets.added_spans(text, base, field)):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
    packed = run("packing", clean).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}
    total = corpus_pipeline.run(spark, sf)
    want = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in total.collect()) == want
    assert zlib.crc32(b"") == 0


def test_deduplicate_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, _h int, _hash string")
    assert [tuple(r) for r in dartminhash.deduplicate(docs).collect()] == [(1, "a b c d e f", 5, "x")]
