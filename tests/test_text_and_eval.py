"""Trap cases for text normalisation and QA metrics (hand-computed expectations)."""

from pyspark.sql import functions as F

from corpusloom.functions import default_process, normalize_answer, normalize_text, strip_ws
from corpusloom.operators import evalqa


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("r")).collect()[0]["r"]


def test_normalize_text_unicode_whitespace(spark):
    assert one(spark, normalize_text("a"), " a \tb\x1c") == "a b"
    assert one(spark, normalize_text("a"), " x  y　") == "x y"
    assert one(spark, normalize_text("a"), "   ") == ""


def test_whitespace_class_equals_python_isspace(spark):
    chars = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF)
    left = one(spark, F.regexp_replace("a", r"[\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}]", ""), chars)
    assert len(chars) - len(left) == sum(1 for c in chars if c.isspace())
    assert one(spark, strip_ws("a"), "\x1c\x85 ab  ") == "ab"


def test_default_process(spark):
    assert one(spark, default_process("a"), "  Héllo, World!! ") == "héllo  world"
    assert one(spark, default_process("a"), None) == ""


def test_answer_normalisation_and_em(spark):
    assert one(spark, normalize_answer("a"), "Yes!") == "yes "
    assert one(spark, evalqa.exact_match("a", "b"), "yes!", "yes", schema="a string, b string") == 0.0
    assert one(spark, evalqa.exact_match("a", "b"), "Yes.", " yes.", schema="a string, b string") == 1.0


def test_token_f1_edges(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "a", ""), (3, "the cat the", "the the dog"), (4, "x", "y")],
                               "id int, p string, g string")
    r = {x["id"]: x["f1"] for x in evalqa.token_f1(df, "id", "p", "g").collect()}
    assert r[1] == 1.0 and r[2] == 0.0 and r[4] == 0.0
    assert abs(r[3] - 2 / 3) < 1e-12          # 2 shared of 3 and 3


def test_extract_and_accuracy(spark):
    assert one(spark, evalqa.extract_yesno("a"), "I know that") == "no"
    assert one(spark, evalqa.extract_yesno("a"), "Unknown") == "no"
    assert one(spark, evalqa.extract_yesno("a"), "   maybe  yes") == "unknown"   # 'yes' after 10 chars
    assert one(spark, evalqa.extract_letter("a"), "  B) because") == 1
    assert one(spark, evalqa.extract_letter("a"), "") == -1
    assert one(spark, evalqa.mcq_accuracy("a", "b"), -1, -1, schema="a int, b int") == 1.0
    assert one(spark, evalqa.yesno_accuracy("a", "b"), "unknown", "maybe", schema="a string, b string") == 1.0


def test_prompts_keep_percent_and_skip_empty_context(spark):
    p = one(spark, evalqa.prompt_short("q", "c"), "100% sure?", "", schema="q string, c string")
    assert p == "Answer the medical question briefly and factually.\nQuestion: 100% sure?\nAnswer:"
    m = one(spark, evalqa.prompt_mcq("q", F.array(F.lit("x"), F.lit("y"))), "Q", schema="q string")
    assert m.endswith("Question: Q\nA) x\nB) y\nAnswer:")


def test_score_items_and_run_result(spark):
    items = spark.createDataFrame([
        (1, "mcq", "b", None, 1, "d"), (2, "yn", "no way", "maybe", None, "d"),
        (3, "short", "Paris", "paris!", None, "d")],
        "id long, type string, pred string, answer string, label int, dataset string")
    items = items.withColumn("mode", F.lit("rag")).withColumn("role", F.lit("clinician"))
    s = {(r["id"], r["metric"]): r["score"] for r in evalqa.score_items(items).collect()}
    assert s == {(1, "acc"): 1.0, (2, "acc"): 0.0, (3, "f1"): 1.0, (3, "em"): 0.0}
    rr = evalqa.run_result(evalqa.score_items(items), 0).collect()[0]
    assert rr["n"] == 3 and rr["metrics"]["acc"] == 0.5
    board = evalqa.leaderboard(evalqa.run_result(evalqa.score_items(items), 0)).collect()[0]
    assert board["Acc"] == "0.500" and board["EM"] == "0.000" and board["Timestamp"] == "1970-01-01 00:00"
