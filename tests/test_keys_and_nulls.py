"""Keys of any type, nulls, repeats and ties: rows in = rows out, exact cuts."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clean, dedup, evalqa, label, retrieve, split, vocab

TEXT_A = "the quick brown fox jumps over the lazy dog near the river bank today"
TEXT_B = "an entirely different sentence about steam engines and their boilers"


def test_first_n_is_exact_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (3, "d")], "id int, v string")
    assert sorted(r["v"] for r in split.limit_rows(df, 2).collect()) == ["a", "b"]
    assert split.limit_rows(df, 9).count() == 4 and split.limit_rows(df, None).count() == 4
    ties = spark.createDataFrame([(1, v) for v in "abc"], "id int, v string")
    assert split.limit_rows(ties, 1).count() == 1
    same = spark.createDataFrame([(1, "x")] * 5, "id int, v string")
    assert split.limit_rows(same, 3).count() == 3


def test_first_n_beyond_the_small_top(spark, monkeypatch):
    monkeypatch.setattr(split, "SMALL_TOP", 10)
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("id"))
    assert sorted(r["id"] for r in split.limit_rows(df, 123).collect()) == list(range(123))
    assert split.limit_rows(df, 500).count() == 500 and split.limit_rows(df, 501).count() == 500


def test_sample_comes_in_drawn_order(spark):
    df = spark.range(300).withColumnRenamed("id", "id")
    got = [r["id"] for r in split.sample_shuffled(df, 100).collect()]
    assert len(got) == 100 and got != sorted(got) and got == [r["id"] for r in split.sample_shuffled(df.repartition(5), 100).collect()]


def test_null_stratum_is_a_stratum(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "s") for k in range(200)], "id int, s string")
    n = {(r["s"], r["split"]): r["count"] for r in split.split_stratified(df, "s").groupBy("s", "split").count().collect()}
    assert n == {(s, p): c for s in (None, "s") for p, c in (("train", 80), ("val", 10), ("test", 10))}


def test_dedup_on_string_null_and_repeated_ids(spark):
    rows = [("doc_2", TEXT_A), ("doc_1", TEXT_A), (None, TEXT_A), ("doc_3", TEXT_B), ("doc_3", TEXT_B), ("doc_4", ""), ("doc_4", ""), (None, None)]
    df = spark.createDataFrame(rows, "id string, text string")
    want = sorted([("doc_1", TEXT_A), ("doc_3", TEXT_B), ("doc_4", ""), ("doc_4", ""), ("", None)], key=str)
    for kept in (dedup.dedup_first_wins(df), dedup.dedup_exact(df)):
        assert sorted(((r["id"] or "", r["text"]) for r in kept.collect()), key=str) == want
    unified = dedup.dedup_first_wins(clean.unify(df)).collect()
    assert len(unified) == 5


def test_first_wins_with_a_third_of_the_rows_in_one_bucket(spark):
    rows = [(k, b"hot") for k in range(300)] + [(k, bytes([k % 251])) for k in range(900)]
    status = dedup.first_wins_status(spark.createDataFrame(rows, "ord long, bucket binary"))
    kept = {r["ord"] for r in status.where(F.col("st") == dedup.KEPT).collect()}
    want, buckets = set(), {}
    for k in range(900):
        mine = [bytes([k % 251])] + ([b"hot"] if k < 300 else [])
        if not any(buckets.get(b) for b in mine):
            want.add(k)
            for b in mine:
                buckets[b] = True
    assert kept == want


def test_rounds_that_run_out_are_an_error(spark):
    mem = spark.createDataFrame([(1, b"a"), (2, b"a"), (2, b"b"), (3, b"b"), (3, b"c"), (4, b"c")], "ord long, bucket binary")
    with pytest.raises(RuntimeError):
        dedup.first_wins_status(mem, max_rounds=1)


def test_minhash_runs_once_for_candidates(spark):
    df = spark.createDataFrame([(k, TEXT_A + f" number {k}") for k in range(20)], "id long, text string")
    out = dedup.lsh_candidates(df)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20


VOCAB = [("icd10", "brown fox", ["X1"]), ("icd10", "brown foxes", ["X2"]), ("snomed", "brown fox", ["S1"])]


def test_labels_belong_to_texts_not_to_ids(spark):
    v = label.vocab_from_rows(spark, VOCAB)
    rows = [("x", "brown fox"), ("x", "brown fox"), (None, "brown foxes"), (None, None), ("y", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = sorted(((r["id"] or "", ",".join(r["codes"])) for r in label.map_icd10(df, v).collect()))
    assert got == sorted([("x", "X1"), ("x", "X1"), ("", "X2"), ("", ""), ("y", "")])


def test_unify_then_label_keeps_given_codes_and_unknown_fields(spark):
    v = label.vocab_from_rows(spark, VOCAB)
    df = spark.createDataFrame([("a", "  brown   fox ", {"icd10": ["KEEP"]}, ("pubmed", "w1")), (None, "brown fox", {}, ("x", "w2"))],
                               "id string, text string, labels map<string,array<string>>, meta struct<source:string,own:string>").withColumn("extra", F.lit(7))
    out = {r["meta"]["own"]: r for r in clean.unify(df, vocab=v).collect()}
    assert out["w1"]["labels"] == {"icd10": ["KEEP"], "snomed": ["S1"]} and out["w1"]["text"] == "brown fox"
    assert out["w2"]["labels"] == {"icd10": ["X1"], "snomed": ["S1"]} and out["w2"]["extra"] == 7


def test_phrase_counted_once_whatever_the_vocabulary_repeats(spark):
    v = label.vocab_from_rows(spark, VOCAB + [("icd10", "brown fox", ["X9"])])
    docs = spark.createDataFrame([("x", TEXT_A), ("x", TEXT_A), (None, None)], "id string, text string")
    got = sorted((r["id"] or "", r["codes"], r["n_mentions"]) for r in label.link_phrases(docs, v).collect())
    assert got == [("", [], 0), ("x", ["S1", "X1", "X9"], 1), ("x", ["S1", "X1", "X9"], 1)]
    none = label.link_phrases(docs, v.limit(0)).collect()
    assert len(none) == 3 and all(r["codes"] == [] for r in none)


def test_fuzzy_refuses_cutoffs_it_cannot_answer(spark):
    texts = spark.createDataFrame([(1, "ab")], "id long, text string")
    with pytest.raises(ValueError):
        label.fuzzy_topk(texts, label.vocab_from_rows(spark, [("s", "ac", ["1"])]), cutoff=50)


def test_f1_per_row_for_repeated_ids(spark):
    df = spark.createDataFrame([(100, "a b", "a b"), (100, "a b", "c"), (None, "x x y", "x y y"), (1, "", ""), (2, "a", "")], "id long, pred string, gold string")
    got = sorted((r["id"] or 0, round(r["f1"], 6)) for r in evalqa.token_f1(df, "id", "pred", "gold").collect())
    assert got == [(0, 0.666667), (1, 1.0), (2, 0.0), (100, 0.0), (100, 1.0)]


def test_runs_with_a_null_role_are_kept(spark):
    scores = spark.createDataFrame([(1, "d", "rag", None, "acc", 1.0), (2, "d", "rag", None, "acc", 0.0), (3, "d", "rag", None, "f1", 0.5), (3, "d", "rag", None, "em", 0.0)],
                                   "id int, dataset string, mode string, role string, metric string, score double")
    (run,) = evalqa.run_result(scores, 5).collect()
    assert run["n"] == 3 and run["metrics"] == {"acc": 0.5, "f1": 0.5, "em": 0.0}


def test_whole_texts_are_encoded_and_indexed(spark):
    long = "alpha " * 500 + "omega"
    df = spark.createDataFrame([(None, long), ("a", "x"), ("a", "x"), ("b", None)], "id string, text string").withColumn("meta", clean.meta_struct("s", "l"))
    vecs = retrieve.encode_text(df).collect()
    assert len(vecs) == 4 and max(sum(map(abs, r["embedding"])) for r in vecs) == 501
    t = retrieve.build_retrieval_table(df, max_chars=1000).collect()
    assert sorted((r["id"] or "", r["passage_no"]) for r in t) == [("", 0), ("", 1), ("", 2), ("", 3), ("a", 0), ("a", 0)]
    assert "".join(r["text"] for r in sorted((r for r in t if r["id"] is None), key=lambda r: r["passage_no"])) == long
    plan = retrieve.encode_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_l2_normalize_is_linear_in_the_dimension(spark):
    took = {}
    for dim in (64, 1024):
        df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
        best = []
        for _ in range(3):
            t0 = time.perf_counter()
            df.select(F.aggregate(retrieve.l2_normalize("v"), F.lit(0.0), lambda a, x: a + x * x).alias("s")).agg(F.max("s"), F.min("s")).collect()
            best.append(time.perf_counter() - t0)
        took[dim] = min(best)
    assert took[1024] < 16 * 4 * max(took[64], 0.05)


def test_vocabulary_statistics_read_every_line(spark):
    docs = spark.createDataFrame([(k, "w") for k in range(50)], "id long, text string")
    assert vocab.tokenizer_lines(docs).count() == 50 and vocab.tokenizer_lines(docs, max_lines=7).count() == 7


def test_query_blocks_give_the_same_hits(spark, monkeypatch):
    index = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * k).cast("double") for k in range(1, 9)]).alias("embedding"))
    queries = index.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    hits = lambda: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieve.knn_topk(index, queries, k=4).collect())
    whole = hits()
    monkeypatch.setattr(retrieve, "MAX_BROADCAST_QUERY_VALUES", 20)
    assert hits() == whole
