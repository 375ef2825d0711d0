"""One fixture of awkward schema-v2 records through the operators: rows in = rows out, no clash, no crash."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clean, dedup, label, language, numerics, retrieve, split
from corpusloom.session import free_name, join_hot, row_hash

TEXT = "the quick brown fox jumps over the lazy dog near the river bank today"


@pytest.fixture(scope="module")
def records(spark):
    """Maps in columns, null and repeated ids, null texts, columns named like helpers."""
    rows = [("b", TEXT), ("a", TEXT), (None, TEXT), ("c", "w eta theta"), ("c", "z eps zeta"), ("c", "z eps zeta"), (None, "w eta theta"), ("d", None), ("d", ""), (None, None)]
    df = clean.unify(spark.createDataFrame(rows, "id string, text string"))
    extra = {"_k": F.lit(1), "_ord": F.lit("x"), "_draw": F.lit(2.5), "_o": F.lit(None).cast("string"), "_row": F.lit(3), "extra": F.create_map(F.lit("k"), F.lit("v"))}
    return df.withColumns(extra)


def test_limits_and_samples_of_records_with_maps(records):
    assert "map" in dict(records.dtypes)["labels"]
    n = records.count()
    for take in (1, 4, n - 1, n, n + 5):
        assert split.limit_rows(records, take).count() == min(take, n)
        got = split.sample_shuffled(records, take)
        assert got.count() == min(take, n) and got.columns == records.columns
    first = split.limit_rows(records, 3).collect()
    assert [r["id"] for r in first] == [None] * 3


def test_row_hash_of_maps_does_not_depend_on_their_order(spark):
    one = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("m"))
    two = spark.range(1).select(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)).alias("m"))
    assert one.select(row_hash(one)).first() == two.select(row_hash(two)).first()
    assert free_name(["_k", "_K_"], "_k") == "_k__"


def test_dedup_keeps_helper_named_columns(records):
    for kept in (dedup.dedup_exact(records), dedup.dedup_first_wins(records)):
        rows = kept.collect()
        assert kept.columns == records.columns and all(r["_k"] == 1 and r["_ord"] == "x" for r in rows)
        assert sum(r["text"] == TEXT for r in rows) == 1 and sum(not r["text"] for r in rows) == 3


def test_exact_dedup_reads_and_processes_the_text_once(spark, sf):
    plan = dedup.dedup_exact(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", carry=["doc_id", "source"])._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("md5(") <= 1 and final.count("Join") == 0


def test_signatures_take_any_key(spark):
    df = spark.createDataFrame([("doc_1", "abcdefgh"), (None, None)], "id string, proc string")
    assert {r["ord"]: r["n_shingles"] for r in dedup.shingle_count(df, "id", "proc").collect()} == {"doc_1": 4, None: 0}
    assert {r["ord"]: len(r["sig"]) for r in dedup.signature_table(df, "id", "proc").collect()} == {"doc_1": 128, None: 128}


def test_search_answers_each_row_with_its_own_text(spark, records):
    table = retrieve.build_retrieval_table(records)
    queries = spark.createDataFrame([(1, "w eta theta"), (1, "z eps zeta"), (None, "w eta theta")], "query_id long, query string")
    hits = retrieve.search(table, queries, k=1).collect()
    assert sorted((r["query_id"] or 0, r["text"], round(r["score"], 6)) for r in hits) == [(0, "w eta theta", 1.0), (1, "w eta theta", 1.0), (1, "z eps zeta", 1.0)]


def test_knn_with_nulls_and_repeats(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0]), (None, [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 1.0])], "id string, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = sorted(((r["query_id"] or 0, r["rank"], r["id"], r["score"]) for r in retrieve.knn_topk(index, queries, k=3).collect()), key=str)
    assert got == sorted([(0, 1, "a", 1.0), (0, 2, "b", 1.0), (0, 3, None, 1.0), (7, 1, "a", 1.0), (7, 1, "d", 1.0), (7, 2, "a", 0.0), (7, 2, "b", 1.0), (7, 3, "b", 0.0), (7, 3, None, 1.0)], key=str)
    assert retrieve.knn_topk(index.limit(0), queries).collect() == [] and retrieve.knn_topk(index, queries.limit(0)).collect() == []


def test_requests_with_repeated_ids_keep_their_rows(spark, records):
    table = retrieve.build_retrieval_table(records)
    requests = spark.createDataFrame(
        [(1, "patient", "w eta theta", None), (1, "clinician", "z eps zeta", "ibuprofen, warfarin"), (None, "patient", "w eta theta", "aspirin")],
        "query_id long, role string, query string, drugs string")
    out = retrieve.answer_requests(requests, table, lambda prompts: ["x"] * len(prompts)).collect()
    assert len(out) == 3 and sorted(str(r["query_id"]) for r in out) == ["1", "1", "None"]
    assert all(r["ddi"] == [] for r in out if r["role"] == "patient")


def test_volumes_with_null_keys_keep_their_rows(spark):
    rows = [("s", "t1", 0, 1.0), ("s", "t1", 1, 2.0), (None, "t1", 0, 5.0), (None, "t1", 1, 9.0), (None, None, 0, 3.0)]
    vox = spark.createDataFrame(rows, "subject string, modality string, z int, v double")
    assert numerics.robust_scale(vox).count() == 5
    assert sorted(r["v"] for r in numerics.center_slice(vox).collect()) == [2.0, 3.0, 9.0]


def test_rows_meet_many_groups_without_copies_of_the_groups(spark):
    rows = [("hot", i % 9) for i in range(3000)] + [(None if i % 50 == 0 else f"s{i % 700}", i % 5) for i in range(2100)]
    df = spark.createDataFrame(rows, "subject string, z int")
    tops = df.groupBy("subject").agg(F.max("z").alias("top"))
    want = {}
    for s, z in rows:
        want[s] = max(z, want.get(s, 0))
    joined = numerics._join_groups(df, tops, ["subject"], wide=0)
    assert sorted((r["subject"] or "", r["z"], r["top"]) for r in joined.collect()) == sorted((s or "", z, want[s]) for s, z in rows)
    assert "Generate" not in joined._jdf.queryExecution().toString()


def test_fuzzy_answers_every_row_and_each_term_once(spark):
    texts = spark.createDataFrame([(1, "aspirin"), (1, "ibuprofen"), (None, "aspirin"), (2, "x" * 5000)], "id long, text string")
    vocab = spark.createDataFrame([("s", 0, "aspirin", ["A"]), ("s", 0, "aspirin", ["A"]), ("s", 1, "ibuprofen", ["B"])], label.VOCAB_SCHEMA)
    got = sorted(((r["id"] or 0, r["term"], r["rank"]) for r in label.fuzzy_topk(texts, vocab).collect()))
    assert got == [(0, "aspirin", 1), (1, "aspirin", 1), (1, "ibuprofen", 1)]
    assert label.map_codes(texts, vocab, "s").count() == 4


# --- components, incremental dedup

def plain_first_wins(rows):
    of = {}
    for o, b in rows:
        of.setdefault(o, set()).add(b)
    taken, kept = set(), set()
    for o in sorted(of):
        if taken.isdisjoint(of[o]):
            kept.add(o)
            taken |= of[o]
    return kept


def status_kept(spark, rows, **options):
    status = dedup.first_wins_status(spark.createDataFrame(rows, "ord long, bucket binary"), **options)
    out = {r["ord"]: r["st"] for r in status.collect()}
    assert set(out) == {o for o, _ in rows} and set(out.values()) <= {dedup.KEPT, dedup.DROPPED}
    return {o for o, st in out.items() if st == dedup.KEPT}


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(k, str(b).encode()) for k in range(5000) for b in (k, k + 1)]
    stats = {}
    assert status_kept(spark, rows, stats=stats) == plain_first_wins(rows)
    assert stats["rounds"] <= dedup.ROUNDS_FIRST


@pytest.mark.parametrize("one_task", [100, 500_000])
def test_components_of_any_size_equal_plain_order(spark, one_task):
    rng = np.random.default_rng(3)
    rows = [(int(o), str(b).encode()) for o in range(400) for b in rng.integers(0, 350, 2)] + [(o, b"hot") for o in range(300, 400)]
    rows += [(1000 + k, f"c{b}".encode()) for k in range(60) for b in (k, k + 1)] + [(2000, b"alone")]
    assert status_kept(spark, rows, one_task=one_task) == plain_first_wins(rows)


def test_components_are_found(spark):
    links = [(k, k + 1) for k in range(0, 300) if k % 50 != 49] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: k // 50 * 50 for k in range(300)}, **{k: 1000 for k in range(1000, 1200)}}


def test_batches_keep_what_one_run_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    empty = spark.createDataFrame([(10_000, "", "s"), (10_000, None, "s")], docs.schema)
    docs = docs.unionByName(empty)
    want = sorted(str(tuple(r)) for r in dedup.dedup_first_wins(docs, "doc_id").collect())
    spark.sql("DROP TABLE IF EXISTS bands_of_batches")
    index = dedup.BandIndex(spark, "bands_of_batches", table_buckets=4)
    cuts = [(0, 60), (60, 130), (130, 20_000)]
    got = []
    for batch, (a, b) in enumerate(cuts):
        part = docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        got += [str(tuple(r)) for r in index.add(part, batch, "doc_id").collect()]
    assert sorted(got) == want
    # A batch that is added again keeps the same rows and adds nothing twice.
    size = spark.table("bands_of_batches").count()
    again = index.add(docs.where("doc_id >= 60 and doc_id < 130"), 1, "doc_id").collect()
    assert {str(tuple(r)) for r in again} <= set(got) and spark.table("bands_of_batches").count() == size
    assert index.add(docs.limit(0), 3, "doc_id").collect() == []
    spark.sql("DROP TABLE bands_of_batches")


def test_hot_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(4000)] + [(i, 0) for i in range(2, 900)], "k long, v long")
    unique = big.groupBy("k").agg(F.count("v").alias("n")).where("k < 500")
    assert sorted(map(tuple, join_hot(big, unique, ["k"], "n").collect())) == sorted(map(tuple, big.join(unique, "k").collect()))


def test_phrases_are_linked_row_by_row(spark):
    vocab = spark.createDataFrame([("s", 0, "High Fever", ["F"]), ("s", 1, "fever", ["G", "F"]), ("s", 2, "high fever of unknown origin", ["U"]), ("s", 3, "fever", ["H"]), ("s", 4, "!!", ["X"])], label.VOCAB_SCHEMA)
    rows = [(1, "A high   fever, of unknown ORIGIN; high-fever!"), (1, "no"), (None, "fever fever"), (2, None), (3, ""), (4, "high " * 50_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    plain = lambda df: sorted(((r["id"] or 0, r["codes"], r["n_mentions"]) for r in df.collect()), key=str)
    got = label.link_phrases(docs, vocab)
    assert plain(got) == sorted([(0, ["F", "G", "H"], 2), (1, [], 0), (1, ["F", "G", "H", "U"], 5), (2, [], 0), (3, [], 0), (4, [], 0)], key=str)
    assert plain(label.link_phrases_joined(docs, vocab)) == plain(got)
    assert plain(label.link_phrases(docs, vocab, max_n=1)) == plain(label.link_phrases_joined(docs, vocab, max_n=1))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert plain(label.link_phrases(docs, vocab.limit(0))) == sorted([(i or 0, [], 0) for i, _ in rows], key=str)


# --- language from text

def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = F.udf(lambda i: zlib.crc32(str(i).encode()) % 3 == 1, "boolean")
    model = language.learn_languages(docs.where(~held("doc_id")))
    assert set(model.languages) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    rows = language.detect_language(docs.where(held("doc_id")), model).collect()
    long = [r for r in rows if len(r["text"]) >= 200]
    assert len(long) > 30 and sum(r["lang_found"] == r["lang"] for r in long) / len(long) >= 0.97
    kept = language.language_allow_by_text(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), ["en"], model, F.col("lang"))
    english = {r["doc_id"] for r in docs.where("lang = 'en' and length(text) >= 200").collect()}
    assert len(english - {r["doc_id"] for r in kept.collect()}) <= 0.05 * len(english) and kept.columns == docs.columns


def test_language_of_awkward_texts(spark):
    rows = [(1, "the cat and the dog of the house", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 34", None), (6, "the house", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language.learn_languages(df)
    got = {r["id"]: r["lang_found"] for r in language.detect_language(df, model).collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "en"}
    assert language.detect_language(df.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        language.learn_languages(df.where("lang is null"))


def test_stream_requests_with_repeated_and_null_ids(spark):
    from corpusloom import streaming as W
    from corpusloom.operators import interactions as ddi

    rows = [(1, "clinician", "ibuprofen, warfarin"), (1, "patient", None), (None, "clinician", "aspirin"), (None, "clinician", None)]
    out = W.enrich_requests(spark.createDataFrame(rows, "query_id long, role string, drugs string"), spark, ddi.Rules(spark)).collect()
    assert sorted((str(r["query_id"]), r["role"]) for r in out) == sorted((str(i), role) for i, role, _ in rows)


def test_latest_counts_keep_null_keys(spark, tmp_path):
    from corpusloom import streaming as W

    df = spark.createDataFrame([(None, 1, 0), (None, 3, 1), ("a", 2, 0)], "k string, n long, batch_id long")
    df.write.parquet(str(tmp_path / "c"))
    assert sorted(map(str, map(tuple, W.latest_counts(spark, str(tmp_path / "c"), ["k"]).collect()))) == ["('a', 2)", "(None, 3)"]


def test_a_large_vocabulary_gives_few_candidates(spark):
    import random

    rnd = random.Random(8)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    name = lambda: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4))) for _ in range(rnd.randint(1, 3)))
    terms = [name() for _ in range(50_000)]
    texts = []
    for k in range(200):
        t = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz ")
        texts.append((k, "".join(t)))
    vocab = spark.createDataFrame([("s", i, t, [str(i)]) for i, t in enumerate(terms)], label.VOCAB_SCHEMA)
    df = spark.createDataFrame(texts, "id long, text string")

    def distance(a, b, most):
        if abs(len(a) - len(b)) > most:
            return most + 1
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) > most:
                return most + 1
        return row[-1]

    got = {}
    for r in label.fuzzy_topk(df, vocab, limit=1000).collect():
        got.setdefault(r["id"], set()).add(r["pos"])
    for k, text in rnd.sample(texts, 12):
        want = {i for i, t in enumerate(terms) if abs(len(t) - len(text)) <= 0.14 * max(len(t), len(text)) and (1 - distance(text, t, int(0.14 * max(len(t), len(text)))) / max(len(t), len(text))) * 100 >= 86}
        assert got.get(k, set()) == want, (text, [terms[i] for i in want])
    t = df.select(F.col("text").alias("_id"), F.col("text").alias("_t"), F.length("text").alias("m")).distinct()
    v = vocab.select("system", "pos", "term", F.length("term").alias("n"))
    # 630 candidates a text of 50,000 terms over 60 syllables, where nearly every pair shares a bigram.
    assert label.prefix_candidates(t, v, 14).count() / 200 < 0.02 * len(terms)


# --- dropped records with what they are like

def test_dropped_records_name_a_kept_one_and_their_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, "abc"), (9002, "xyz"), (9003, ""), (9004, None), (9005, docs.first()["text"])], docs.schema)
    docs = docs.unionByName(extra)
    kept = {r["doc_id"] for r in dedup.dedup_first_wins(docs, "doc_id").collect()}
    rows = dedup.dropped_records(docs, "doc_id").collect()
    all_ids = [r["doc_id"] for r in docs.collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(set(all_ids) - kept) and len(rows) > 5
    proc = {r["doc_id"]: r["p"] for r in docs.select("doc_id", dedup.default_process("text").alias("p")).collect()}
    buckets = {r["doc_id"]: set(r["b"]) for r in dedup.lsh_memberships(docs, "doc_id", collapse=False).groupBy(F.col("ord.key").alias("doc_id")).agg(F.collect_set(F.hex("bucket")).alias("b")).collect()}
    cut = lambda t: {t[i:i + 5] for i in range(len(t) - 4)}
    for r in rows:
        a, b = cut(proc[r["doc_id"]]), cut(proc[r["kept_key"]])
        assert r["kept_key"] == min(k for k in kept if k in buckets and k < r["doc_id"] and buckets[k] & buckets[r["doc_id"]])
        assert abs(r["jaccard"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert dedup.dropped_records(docs.limit(0), "doc_id").collect() == []
