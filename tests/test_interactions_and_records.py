"""Basket rules, records and payload traps."""

from pyspark.sql import functions as F

from corpusloom.operators import clean, flatten
from corpusloom.operators import interactions as ddi


def check(spark, baskets):
    rules = ddi.Rules(spark)
    rows = [(b, i, name) for b, names in baskets.items() for i, name in enumerate(names)]
    items = spark.createDataFrame(rows, "basket long, pos int, name string")
    allb = spark.createDataFrame([(b,) for b in baskets], "basket long")
    return {r["basket"]: r["ddi"] for r in ddi.check_interactions(items, rules, allb).collect()}


def test_class_rule_is_ordered(spark):
    r = check(spark, {1: ["simvastatin", "clarithromycin"], 2: ["clarithromycin", "simvastatin"], 3: []})
    pair = "clarithromycin + simvastatin: ↑ statin levels (rhabdomyolysis risk) — avoid"
    cls = ("clarithromycin (class macrolide) + simvastatin (class statin): "
           "Some macrolides ↑ statin levels — prefer pravastatin or hold statin")
    assert r[1] == [pair]
    assert r[2] == sorted([pair, cls])
    assert r[3] == []


def test_synonyms_and_blanks(spark):
    rules = ddi.Rules(spark)
    items = spark.createDataFrame([(1, 0, " Advil "), (1, 1, None), (1, 2, " "), (1, 3, "Coumadin")],
                                  "basket long, pos int, name string")
    got = [r["drug"] for r in ddi.canonical_name(items, rules).orderBy("pos").collect()]
    assert got == ["ibuprofen", "", "warfarin"]
    r = check(spark, {7: ["Advil", "COUMADIN"]})
    assert r[7] == ["ibuprofen + warfarin: ↑ bleeding risk (avoid or monitor INR)"]


def test_parse_med_list(spark):
    df = spark.createDataFrame([("a, b ,",), ("",), (None,)], "s string")
    got = [r["l"] for r in df.select(ddi.parse_med_list("s").alias("l")).collect()]
    assert got == [["a", "b", ""], [], []]


def test_unify_blank_text_and_defaults(spark):
    df = spark.createDataFrame([("x", "   "), ("y", " a  b ")], "id string, text string")
    r = {x["id"]: x for x in clean.unify(df).collect()}
    assert r["x"]["text"] == "" and r["x"]["labels"] == {}
    assert r["y"]["text"] == "a b" and r["y"]["labels"] == {"icd10": [], "snomed": []}
    assert r["y"]["modality"] == ["text"] and r["y"]["split"] == "train" and r["y"]["meta"]["source"] == "unknown"


def test_unify_strict_presence_keeps_explicit_null(spark):
    df = spark.createDataFrame([('{"id":"a","task":null}', "a", None), ('{"id":"b"}', "b", None)],
                               "raw string, id string, task string")
    r = {x["id"]: x["task"] for x in clean.unify(df, strict_presence=True).collect()}
    assert r == {"a": None, "b": "summarize"}


def test_flatten_spl_last_duplicate_wins(spark):
    payload = ('{"data":{"title":"T","sections":[{"code":"34073-7","text":"first"},'
               '{"code":"34067-9 Indications & Usage","text":"' + "x" * 700 + '"},'
               '{"code":"34073-7","text":"second"}]}}')
    df = spark.createDataFrame([(payload,)], "payload string")
    text = flatten.flatten_spl(df).collect()[0]["text"]
    assert text == "T. Indications: " + "x" * 600 + ". Interactions: second"


def test_flatten_labels_empty_brand_falls_through(spark):
    p = '{"openfda":{"brand_name":[],"generic_name":["gen"]},"boxed_warning":["bw1","bw2"]}'
    df = spark.createDataFrame([(p,), ('{"spl_set_id":"s"}',)], "payload string")
    texts = [r["text"] for r in flatten.flatten_labels(df).collect()]
    assert texts[0] == "Label for gen. Indications: . Boxed warning: bw1. Adverse reactions: "
    assert texts[1].startswith("Label for unknown.")


def test_pubmed_skips_missing_and_empty(spark):
    p = '{"result":{"uids":["1","2","3"],"1":{"title":"A","authors":[{"name":"x"}]},"2":{}}}'
    rows = flatten.flatten_pubmed(spark.createDataFrame([(p,)], "payload string")).collect()
    assert [(r["pmid"], r["title"], r["authors"]) for r in rows] == [("1", "A", ["x"])]


def test_join_image_path(spark):
    df = spark.createDataFrame([("root", "a\\b.jpg"), ("root/", "c.png"), ("r", "/abs/x.png")], "r string, p string")
    got = [x["j"] for x in df.select(clean.join_image_path("r", "p").alias("j")).collect()]
    assert got == ["root/a/b.jpg", "root/c.png", "/abs/x.png"]
    assert F is not None


def test_observe_counts_single_pass(spark):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "id string, text string")
    observed, obs = clean.observe_counts(df, "ingest")
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "empty_text": 2}


def test_redact_pii(spark):
    df = spark.createDataFrame([("mail a.b@x.org or call +1 (743) 555-3824 from 10.0.0.12 now",)], "text string")
    r = clean.redact_pii(df).collect()[0]
    assert r["text"] == "mail [EMAIL] or call [PHONE] from [IP] now"
    assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)
