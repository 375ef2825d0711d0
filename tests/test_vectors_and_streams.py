"""Pruned exact search, stateful stream dedup: each against a plain computation."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import streaming as W
from corpusloom.operators import retrieve, vectors
from corpusloom.session import ship_code


def plain_topk(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted(((-float(np.dot(q, v)), i is None, i or 0, i) for i, v in rows), key=lambda x: x[:3])[:k]
        out += [(qid, r, i, round(-s, 9)) for r, (s, _, _, i) in enumerate(scored, 1)]
    return sorted(out, key=str)


def rounded(df):
    return sorted(((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect()), key=str)


def test_pruned_search_equals_brute_force(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = e.select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    built = vectors.ClusteredIndex.build(index, str(tmp_path / "ix"), clusters=12)
    stats = {}
    want = plain_topk([(r["id"], np.array(r["embedding"], float)) for r in index.collect()], [(r["query_id"], np.array(r["embedding"], float)) for r in queries.collect()], 5)
    assert rounded(built.search(queries, 5, stats=stats)) == want
    assert rounded(retrieve.knn_topk(index, queries, 5)) == want
    assert 0 < stats["share_read"] <= 1


def test_pruning_reads_few_clusters_of_clustered_data(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 8)) * 10
    data = [(int(i), (centres[i % 10] + rng.normal(size=8) * 0.1).tolist()) for i in range(1000)] + [(None, centres[0].tolist()), (3, None), (3, centres[1].tolist())]
    index = spark.createDataFrame(data, "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, data[i][1]) for i in range(0, 1000, 25)] + [(0, data[7][1]), (9, None)], "query_id long, embedding array<double>")
    stats = {}
    built = vectors.ClusteredIndex.build(index, str(tmp_path / "ix"), clusters=10)
    want = plain_topk([(i, np.array(v)) for i, v in data if v is not None], [(r["query_id"], np.array(r["embedding"])) for r in queries.collect() if r["embedding"]], 3)
    assert rounded(built.search(queries, 3, stats=stats)) == want
    assert stats["share_read"] < 0.6
    assert len(built.search(queries, 2000).select("query_id").distinct().collect()) == 40
    empty = vectors.ClusteredIndex.build(index.limit(0), str(tmp_path / "none"))
    assert empty.search(queries, 3).collect() == []


# --- stateful first-wins

SPAN, LATE = 60, 90      # minutes


def plain_episodes(files):
    """Files in order: rows the watermark has passed before their file are late; the rest as one batch."""
    seen, top, late = [], None, []
    for f in files:
        mark = None if top is None else top - LATE
        for row in f:
            (late if mark is not None and row[1] < mark else seen).append(row)
        top = max([top if top is not None else -10**9, *[r[1] for r in f]])
    mark, out, groups = top - LATE, [], {}
    for r in seen:
        groups.setdefault(r[0], []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: r[1])
        end, episode = None, []
        for r in [*rows, None]:
            if end is not None and (r is None or r[1] >= end):
                if end <= mark:
                    out.append(min(episode, key=lambda x: (x[2] is None, x[2] or 0, x[1])))
                end = None
            if r is not None and end is None:
                end, episode = r[1] + SPAN, []
            if r is not None:
                episode.append(r)
    return sorted(map(str, out)), late


def run_stream(spark, folder, files):
    start = dt.datetime(2024, 1, 1)
    os.makedirs(f"{folder}/in")
    for i, f in enumerate(files):
        name = f"{folder}/in/{i:03d}.json"
        with open(name, "w") as o:
            o.writelines(json.dumps({"k": k, "ts": (start + dt.timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S"), "n": n, "m": m}) + "\n" for k, m, n in f)
        os.utime(name, (1000 + i, 1000 + i))
    ship_code()
    stream = spark.readStream.schema("k string, ts timestamp, n long, m long").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    kept = W.stateful_first_wins(stream, ["k"], "ts", "n", f"{SPAN} minutes", f"{LATE} minutes")
    assert kept.schema.simpleString() == stream.schema.simpleString()
    q = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return sorted(str((r["k"], r["m"], r["n"])) for r in spark.read.schema("k string, ts timestamp, n long, m long").parquet(f"{folder}/out").collect())


def test_winner_is_the_least_key_whatever_arrives_first(spark, tmp_path):
    files = [
        [("a", 0, 5), ("a", 10, 3), ("b", 5, 1)],
        [("a", 8, 9), ("a", 30, 1), ("b", 200, 7)],
        [("a", 120, 0), ("a", 210, 4), (None, 215, None)],            # out of order, within the bound
        [("a", 1, -1), ("b", 230, 2), ("a", 600, 8)],                 # late; after the eviction
        [("z", 5000, 0)],
    ]
    want, late = plain_episodes(files)
    assert late == [("a", 1, -1)]
    assert run_stream(spark, str(tmp_path), files) == want


def test_result_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), m, rnd.randint(0, 10**6)) for m in rnd.sample(range(600), 80)]
    # Rows move by less than the bound, so none is late.
    moved = sorted(rows, key=lambda r: r[1] + rnd.randint(0, LATE // 2))
    files = [moved[i:i + 27] for i in range(0, len(moved), 27)] + [[("z", 5000, 0)]]
    want, late = plain_episodes(files)
    assert late == []
    assert run_stream(spark, str(tmp_path), files) == want


def test_order_key_must_be_comparable(spark):
    stream = spark.readStream.format("rate").load().select("timestamp", F.array("value").alias("v"), F.lit(1).alias("k"))
    with pytest.raises(ValueError):
        W.stateful_first_wins(stream, ["k"], "timestamp", "v")


# --- evaluation in rag mode

def test_rag_mode_gives_each_item_its_own_evidence(spark):
    from corpusloom.operators import clean, evalqa

    passages = [("p1", "aspirin thins the blood"), ("p2", "steam engines have boilers"), ("p3", "zinc is a metal")]
    table = retrieve.build_retrieval_table(clean.unify(spark.createDataFrame(passages, "id string, text string")))
    rows = [(1, "short", "what has boilers in steam engines", "", "p2"), (1, "short", "aspirin thins the blood", "", "p1"), (None, "yn", "zinc is a metal", "", "yes")]
    items = spark.createDataFrame(rows, "id long, type string, question string, context string, answer string").withColumn("label", F.lit(None).cast("int"))
    ids = {t: i for i, t in passages}

    def predictor(prompts):
        out = []
        for p in prompts:
            first = next(line for line in p.split("\n") if line.startswith("[1] ("))
            found = next(i for t, i in ids.items() if t in first)
            out.append("yes" if found == "p3" else found)
        return out

    scores = sorted((r["id"] or 0, r["metric"], r["score"]) for r in evalqa.evaluate(items, predictor, table=table, k=2).collect())
    assert scores == [(0, "acc", 1.0), (1, "em", 1.0), (1, "em", 1.0), (1, "f1", 1.0), (1, "f1", 1.0)]
    nothing = evalqa.evaluate(items, lambda ps: ["yes" if "[1] (" not in p else "no" for p in ps], table=table.limit(0))
    assert {r["score"] for r in nothing.where("metric = 'acc'").collect()} == {1.0}
