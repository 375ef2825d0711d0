"""Registered queries: one per operator of the inventory.

Each takes (spark, sf_dir) and returns a DataFrame with scalar columns whose
names equal those of the matching SQL in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import sources as S
from .. import streaming as W
from ..functions import default_process, mint_id, normalize_answer, normalize_text, strip_ws
from ..operators import clean, dedup, evalqa, flatten, label, language, numerics, retrieve, roles, split, vectors, vocab
from ..operators import interactions as ddi
from ..sources import pages
from .fixtures import (BASKET_RULES, FUZZY_VOCAB, PHRASE_VOCAB, basket_items, benchmark_records,
                       conversation_records, documents_records, label_payloads, landed_responses, load,
                       png_folder, props_with_controls, pubmed_pages, qa_turns, scratch_dir, spl_payloads, trial_payloads)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _docs(spark, sf):
    return load(spark, sf, "documents")


# --------------------------------------------------------------------------- corpus build
def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: documents -> unify -> language -> min length -> exact dedup -> split -> counts."""
    recs = clean.unify(documents_records(spark, sf))
    recs = clean.language_allow(recs)
    recs = clean.min_text_len(recs)
    recs = dedup.dedup_exact(recs, order_col="doc_id", carry=["doc_id", "meta"])
    recs = split.split_random(recs, key="doc_id")
    return (recs.groupBy(F.col("meta.source").alias("source"), "split")
                .agg(F.count(F.lit(1)).alias("n")))


register("corpus_build")(corpus_counts)


@register("unify")
def q_unify(spark, sf):
    return clean.flat_records(clean.unify(documents_records(spark, sf)), keep=["doc_id"])


@register("merge_sources")
def q_merge_sources(spark, sf):
    docs = documents_records(spark, sf).select("id", "text", F.col("meta.source").alias("source"))
    return clean.merge_sources(docs, benchmark_records(spark, sf), conversation_records(spark, sf)) \
        .select("id", "text", "source", "role")


@register("normalize_text")
def q_normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize_text("text").alias("text"))


@register("nonempty_text")
def q_nonempty_text(spark, sf):
    recs = conversation_records(spark, sf).withColumn("text", normalize_text("text"))
    return clean.nonempty_text(recs).select("id")


@register("language_allow")
def q_language_allow(spark, sf):
    return clean.language_allow(_docs(spark, sf)).select("doc_id", "lang")


@register("language_from_text")
def q_language_from_text(spark, sf):
    """Every document's language by its text, learned from two thirds of the rows that say theirs."""
    docs = _docs(spark, sf)
    model = language.learn_languages(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return language.detect_language(docs.select("doc_id", "text"), model).select("doc_id", "lang_found")


@register("min_text_len")
def q_min_text_len(spark, sf):
    d = _docs(spark, sf).select("doc_id", normalize_text("text").alias("text"))
    return clean.min_text_len(d).select("doc_id", F.length("text").cast("long").alias("n"))


@register("license_allow")
def q_license_allow(spark, sf):
    recs = documents_records(spark, sf)
    return clean.license_allow(recs).select("doc_id", F.col("meta.license").alias("license"))


@register("truncate_text")
def q_truncate_text(spark, sf):
    return clean.truncate_text(_docs(spark, sf), K.INDEX_TEXT_CHARS).select("doc_id", "text")


@register("corpus_profile")
def q_corpus_profile(spark, sf):
    recs = split.split_random(clean.unify(documents_records(spark, sf)), key="doc_id")
    return clean.corpus_profile(recs.withColumn("source", F.col("meta.source")), "unified")


@register("concat_fields")
def q_concat_fields(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"),
                                       F.col("p_brand").alias("abstract"), F.col("p_type").alias("body"))
    return clean.concat_fields(p).select("p_partkey", "text")


@register("redact_pii")
def q_redact_pii(spark, sf):
    r = clean.redact_pii(_docs(spark, sf))
    return r.select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in ("n_email", "n_ip", "n_phone")])


# --------------------------------------------------------------------------- dedup
@register("default_process")
def q_default_process(spark, sf):
    return _docs(spark, sf).select("doc_id", default_process("text").alias("proc"))


@register("char_shingles")
def q_char_shingles(spark, sf):
    d = _docs(spark, sf).select("doc_id", default_process("text").alias("proc"))
    return dedup.shingle_count(d, "doc_id", "proc").withColumnRenamed("ord", "doc_id")


@register("minhash_signature")
def q_minhash_signature(spark, sf):
    d = _docs(spark, sf).select("doc_id", default_process("text").alias("proc"))
    s = dedup.signature_table(d, "doc_id", "proc")
    return s.select(F.col("ord").alias("doc_id"), F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@register("lsh_candidates")
def q_lsh_candidates(spark, sf):
    return dedup.lsh_candidates(_docs(spark, sf), order_col="doc_id")


@register("dedup_first_wins")
def q_dedup_first_wins(spark, sf):
    return dedup.dedup_first_wins(_docs(spark, sf), order_col="doc_id").select("doc_id")


@register("dedup_dropped")
def q_dedup_dropped(spark, sf):
    out = dedup.dropped_records(_docs(spark, sf), order_col="doc_id")
    return out.select("doc_id", "kept_key", F.round("jaccard", 9).alias("jaccard"))


@register("dedup_incremental")
def q_dedup_incremental(spark, sf):
    """Three batches in key order against one growing band table keep what one run keeps."""
    name = f"bands_{uuid.uuid4().hex}"
    index, docs, kept = dedup.BandIndex(spark, name), _docs(spark, sf), []
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    for batch, (low, high) in enumerate(((None, top // 3), (top // 3, 2 * top // 3), (2 * top // 3, None))):
        part = docs if low is None else docs.where(F.col("doc_id") >= low)
        kept.append(index.add(part if high is None else part.where(F.col("doc_id") < high), batch, "doc_id").select("doc_id"))
    spark.sql(f"DROP TABLE {name}")
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@register("dedup_exact")
def q_dedup_exact(spark, sf):
    return dedup.dedup_exact(_docs(spark, sf), order_col="doc_id").select("doc_id")


# --------------------------------------------------------------------------- splits
@register("split_random")
def q_split_random(spark, sf):
    return split.split_random(_docs(spark, sf), key="doc_id").select("doc_id", "split")


# --------------------------------------------------------------------------- QA evaluation

RUN_TS = 1_700_000_000


def qa_items(spark, sf):
    """Scored items from conversation turns (dataset = item type, mode rag, role clinician)."""
    t = qa_turns(spark, sf)
    return t.select(
        "id", "type", "question", "pred",
        F.when(F.col("type") == "yn", F.lower(strip_ws(F.col("gold")))).otherwise(F.col("gold")).alias("answer"),
        evalqa.extract_letter("question").alias("label"),
        F.col("type").alias("dataset"), F.lit("rag").alias("mode"), F.lit("clinician").alias("role"),
    )


def mcq_rows(spark, sf):
    o = load(spark, sf, "orders")
    cop = F.element_at(F.array(*[F.lit(x) for x in ["a", "B", " c ", "d", "x", ""]]),
                       (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("question"),
                    F.col("o_orderstatus").alias("opa"), F.col("o_orderpriority").alias("opb"),
                    F.col("o_custkey").cast("string").alias("opc"), F.lit("").alias("opd"), cop.alias("cop"))


@register("load_pubmedqa")
def q_load_pubmedqa(spark, sf):
    c = load(spark, sf, "conversations")
    raw = c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("question"),
        F.col("text").alias("ques"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit("")).alias("context"),
        F.col("role").alias("abstract"),
        F.when(F.col("turn") % 3 == 0, F.lit(" Yes ")).alias("answer"),
        F.upper(F.col("role")).alias("final_decision"),
    )
    return evalqa.load_pubmedqa(raw)


@register("load_mcq")
def q_load_mcq(spark, sf):
    m = evalqa.load_mcq(mcq_rows(spark, sf))
    return m.select("id", "type", "question", F.array_join("options", "|").alias("options"), "label")


@register("load_shortqa")
def q_load_shortqa(spark, sf):
    c = load(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"),
        F.col("role").alias("context"))
    return evalqa.load_shortqa(c)


@register("prompt_mcq")
def q_prompt_mcq(spark, sf):
    m = evalqa.load_mcq(mcq_rows(spark, sf))
    return m.select("id", evalqa.prompt_mcq("question", "options").alias("prompt"))


@register("prompt_short")
def q_prompt_short(spark, sf):
    return qa_turns(spark, sf).select("id", evalqa.prompt_short("question", "pred").alias("prompt"))


@register("prompt_yesno")
def q_prompt_yesno(spark, sf):
    return qa_turns(spark, sf).select("id", evalqa.prompt_yesno("question", "pred").alias("prompt"))


@register("extract_letter")
def q_extract_letter(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", evalqa.extract_letter("text").alias("letter"))


@register("extract_yesno")
def q_extract_yesno(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", evalqa.extract_yesno("text").alias("yn"))


@register("normalize_answer")
def q_normalize_answer(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", normalize_answer("text").alias("norm"))


@register("exact_match")
def q_exact_match(spark, sf):
    return qa_turns(spark, sf).select("id", evalqa.exact_match("pred", "gold").alias("em"))


@register("token_f1")
def q_token_f1(spark, sf):
    f = evalqa.token_f1(qa_turns(spark, sf), "id", "pred", "gold")
    return f.select("id", F.round("f1", 6).alias("f1"))


@register("mcq_accuracy")
def q_mcq_accuracy(spark, sf):
    t = qa_turns(spark, sf)
    return t.select("id", evalqa.mcq_accuracy(evalqa.extract_letter("pred"), evalqa.extract_letter("question"))
                    .alias("acc"))


@register("yesno_accuracy")
def q_yesno_accuracy(spark, sf):
    t = qa_turns(spark, sf)
    return t.select("id", evalqa.yesno_accuracy(evalqa.extract_yesno("pred"), F.lower(strip_ws("question")))
                    .alias("acc"))


@register("score_items")
def q_score_items(spark, sf):
    s = evalqa.score_items(qa_items(spark, sf))
    return s.select("id", "metric", F.round("score", 6).alias("score"))


@register("aggregate_metrics")
def q_aggregate_metrics(spark, sf):
    a = evalqa.aggregate_metrics(evalqa.score_items(qa_items(spark, sf)))
    return a.select("dataset", "mode", "role", "metric", F.round("mean", 6).alias("mean"))


def _run_results(spark, sf):
    return evalqa.run_result(evalqa.score_items(qa_items(spark, sf)), RUN_TS)


@register("run_result")
def q_run_result(spark, sf):
    r = _run_results(spark, sf)
    m = lambda k: F.round(F.try_element_at("metrics", F.lit(k)), 6).alias(k)
    return r.select("dataset", "mode", "role", "n", m("acc"), m("f1"), m("em"), "timestamp")


@register("leaderboard")
def q_leaderboard(spark, sf):
    return evalqa.leaderboard(_run_results(spark, sf))


@register("leaderboard_markdown")
def q_leaderboard_markdown(spark, sf):
    return evalqa.leaderboard_markdown(evalqa.leaderboard(_run_results(spark, sf)))


@register("vision_accuracy")
def q_vision_accuracy(spark, sf):
    gold = load(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit("1.0")).otherwise(F.lit("0.0")).alias("cardiomegaly"))
    seen = F.when(F.col("doc_id") % 4 == 0, F.lit(" Mild CARDIOmegaly.")).otherwise(F.lit(""))
    preds = load(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), seen).alias("finding"))
    r = evalqa.vision_accuracy(gold, preds, "doc_id", "cardiomegaly", "finding")
    return r.select("n", F.round("acc", 6).alias("acc"))


# --------------------------------------------------------------------------- interactions and roles


@register("parse_med_list")
def q_parse_med_list(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws(", ", "o_orderstatus", F.concat(F.lit(" "), "o_orderpriority"), F.lit("")).alias("meds"))
    return o.select("o_orderkey", F.array_join(ddi.parse_med_list("meds"), "|").alias("meds"),
                    F.size(ddi.parse_med_list("meds")).alias("n"))


@register("canonical_name")
def q_canonical_name(spark, sf):
    rules = ddi.Rules(spark, BASKET_RULES)
    return ddi.canonical_name(basket_items(spark, sf), rules).select("basket", "pos", "drug")


@register("drug_classes")
def q_drug_classes(spark, sf):
    rules = ddi.Rules(spark, BASKET_RULES)
    c = ddi.drug_classes(ddi.canonical_name(basket_items(spark, sf), rules), rules)
    return c.select("drug", F.array_join("classes", ",").alias("classes"))


@register("pair_rules")
def q_pair_rules(spark, sf):
    rules = ddi.Rules(spark, BASKET_RULES)
    return ddi.pair_rules(ddi.canonical_name(basket_items(spark, sf), rules), rules)


@register("class_rules")
def q_class_rules(spark, sf):
    rules = ddi.Rules(spark, BASKET_RULES)
    return ddi.class_rules(ddi.canonical_name(basket_items(spark, sf), rules), rules)


def _checked(spark, sf):
    rules = ddi.Rules(spark, BASKET_RULES)
    baskets = load(spark, sf, "orders").select(F.col("o_orderkey").alias("basket"))
    return ddi.check_interactions(basket_items(spark, sf), rules, baskets)


@register("check_interactions")
def q_check_interactions(spark, sf):
    c = _checked(spark, sf)
    return c.select("basket", F.size("ddi").cast("long").alias("n_msgs"), F.array_join("ddi", "\n").alias("messages"))


@register("append_findings")
def q_append_findings(spark, sf):
    c = _checked(spark, sf)
    text = F.concat(F.lit("Answer for order "), F.col("basket").cast("string"))
    return c.select("basket", ddi.append_findings(text, "ddi").alias("answer"))


def _role_of(conv_id):
    return F.element_at(F.array(*[F.lit(r) for r in ("patient", "clinician", "pharma", "student", "visitor")]),
                        (conv_id % 5 + 1).cast("int"))


@register("disclaimer")
def q_disclaimer(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", _role_of(F.col("conv_id")).alias("role")).select(
        "conv_id", "turn", "role", roles.disclaimer("role").alias("disclaimer"))


@register("route")
def q_route(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", _role_of(F.col("conv_id")).alias("role"))
    return roles.route(c, spark).select("conv_id", "turn", "role", "use_rag", "use_ddi")


@register("bmi")
def q_bmi(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.round(roles.bmi(F.col("p_size") / 20.0, F.col("p_retailprice") / 10.0), 6)
                    .alias("bmi"))


def _named_sources(spark, sf):
    names = [s for _, s, _ in K.DATA_SOURCES]
    d = load(spark, sf, "documents")
    idx = (F.substring("source", 4, 10).cast("int") % len(names) + 1).cast("int")
    return d.select("doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), idx).alias("source"))


@register("enabled_sources")
def q_enabled_sources(spark, sf):
    return roles.enabled_sources(_named_sources(spark, sf), spark).select("doc_id", "source")


# --------------------------------------------------------------------------- retrieval


def _index(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", retrieve.l2_normalize("embedding").alias("embedding"))


def _queries(spark, sf):
    """One query per label: the normalised mean of that label's index vectors."""
    m = retrieve.mean_vector(_index(spark, sf), "label", "embedding")
    return m.select(F.col("label").cast("long").alias("query_id"), retrieve.l2_normalize("embedding").alias("embedding"))


def _store(spark, sf):
    """Passage store keyed like the index: vector id -> document text/source/license."""
    from .fixtures import license_of
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return e.join(d, "id", "left").withColumn("license", license_of(F.col("source")))


def _hits(spark, sf):
    h = retrieve.knn_topk(_index(spark, sf), _queries(spark, sf))
    return retrieve.hit_metadata(h, _store(spark, sf))


@register("l2_normalize")
def q_l2_normalize(spark, sf):
    v = _index(spark, sf)
    return v.select(F.col("id").alias("vec_id"), F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sum_sq"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_v"))


@register("knn_topk")
def q_knn_topk(spark, sf):
    h = retrieve.knn_topk(_index(spark, sf), _queries(spark, sf))
    return h.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _all_queries(spark, sf):
    """Every index row whose id is divisible by 50 is a query."""
    return _index(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@register("knn_all_queries")
def q_knn_all_queries(spark, sf):
    return retrieve.knn_topk(_index(spark, sf), _all_queries(spark, sf)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("knn_pruned")
def q_knn_pruned(spark, sf):
    """The same search over a clustered index: only the clusters whose bound reaches a query's k-th score are read."""
    index = vectors.ClusteredIndex.build(_index(spark, sf), scratch_dir(spark, "clustered"))
    return index.search(_all_queries(spark, sf)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("hit_metadata")
def q_hit_metadata(spark, sf):
    h = _hits(spark, sf)
    return h.select("query_id", "rank", "id", F.coalesce("source", F.lit("unknown")).alias("source"), "license",
                    F.length("text").cast("long").alias("text_len"))


@register("evidence_block")
def q_evidence_block(spark, sf):
    return retrieve.evidence_block(_hits(spark, sf))


@register("format_citations")
def q_format_citations(spark, sf):
    return retrieve.format_citations(_hits(spark, sf))


def _requests(spark, sf):
    q = _queries(spark, sf).select("query_id")
    return q.select("query_id", F.concat(F.lit("Which passages resemble group "), F.col("query_id").cast("string"),
                                         F.lit("? (100% sure)")).alias("query"),
                    F.lit("clinician").alias("role"))


@register("build_prompt")
def q_build_prompt(spark, sf):
    r = retrieve.no_hit_fallback(_requests(spark, sf), retrieve.evidence_block(_hits(spark, sf)))
    return r.select("query_id", retrieve.build_prompt("query", "evidence").alias("prompt"))


@register("answer_batch")
def q_answer_batch(spark, sf):
    req = _requests(spark, sf).withColumn("generated", F.concat(F.lit("Answer to: "), F.col("query")))
    a = retrieve.answer_batch(req, _hits(spark, sf))
    return a.select("query_id", "role", "answer", "citations", F.size("ddi").cast("long").alias("n_ddi"), "disclaimer")


@register("encode_text")
def q_encode_text(spark, sf):
    e = retrieve.encode_text(_docs(spark, sf), "text", "doc_id")
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)).cast("long").alias("l1"),
                    F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).cast("long").alias("probe"))


# --------------------------------------------------------------------------- labelling


def _part_texts(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def _codes_query(system):
    def q(spark, sf):
        v = label.vocab_from_rows(spark, FUZZY_VOCAB)
        c = label.map_codes(_part_texts(spark, sf), v, system)
        return c.select("id", F.array_join("codes", ",").alias("codes"))
    return q


register("map_icd10")(_codes_query("icd10"))
register("map_snomed")(_codes_query("snomed"))
register("map_rxnorm")(_codes_query("rxnorm"))
register("map_meddra")(_codes_query("meddra"))


@register("fuzzy_topk")
def q_fuzzy_topk(spark, sf):
    v = label.vocab_from_rows(spark, FUZZY_VOCAB)
    h = label.fuzzy_topk(_part_texts(spark, sf), v)
    return h.select("id", "system", "pos", "term", F.round("score", 6).alias("score"), "rank")


@register("auto_label")
def q_auto_label(spark, sf):
    v = label.vocab_from_rows(spark, FUZZY_VOCAB)
    p = load(spark, sf, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text"),
        F.when(F.col("p_size") % 4 == 0, F.create_map(F.lit("icd10"), F.array(F.lit("KEEP"))))
         .otherwise(F.create_map().cast("map<string,array<string>>")).alias("labels"))
    r = clean.unify(p, vocab=v)
    return clean.flat_records(r).select("id", "text", "labels_icd10", "labels_snomed")


@register("link_phrases")
def q_link_phrases(spark, sf):
    v = label.vocab_from_rows(spark, PHRASE_VOCAB)
    r = label.link_phrases(_docs(spark, sf), v, id_col="doc_id")
    return r.select("doc_id", F.array_join("codes", ",").alias("codes"), "n_mentions")


# --------------------------------------------------------------------------- payload -> record

def _rec(df, *extra):
    return df.select(*[c for c in ("id", "text", "task", "image_path", "answer") if c in df.columns],
                     F.col("meta.source").alias("source"), F.col("meta.license").alias("license"), *extra)


@register("flatten_pubmed")
def q_flatten_pubmed(spark, sf):
    r = flatten.flatten_pubmed(pubmed_pages(spark, sf))
    return r.select("pmid", "title", "pubdate", F.array_join("authors", ",").alias("authors"), "journal", "source")


@register("flatten_trials")
def q_flatten_trials(spark, sf):
    return _rec(flatten.flatten_trials(trial_payloads(spark, sf)), F.col("meta.nct").alias("nct"))


@register("flatten_labels")
def q_flatten_labels(spark, sf):
    return _rec(flatten.flatten_labels(label_payloads(spark, sf)), F.col("meta.spl_set_id").alias("spl_set_id"))


@register("flatten_spl")
def q_flatten_spl(spark, sf):
    return _rec(flatten.flatten_spl(spl_payloads(spark, sf)))


@register("flatten_chexpert")
def q_flatten_chexpert(spark, sf):
    lab = load(spark, sf, "labels")
    rows = lab.select(
        F.concat(F.lit("patient"), F.col("doc_id").cast("string"), F.lit("\\study1\\view1_frontal.jpg")).alias("Path"),
        F.when(F.col("toxic") == 1, F.lit("1.0")).when(F.col("quality") == 0, F.lit("-1.0")).otherwise(F.lit(""))
         .alias("Cardiomegaly"))
    return _rec(flatten.flatten_chexpert(rows, "/data/chexpert"))


def _isic_rows(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    return p.select(
        F.concat(F.lit("ISIC_"), k).alias("isic_id"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat("p_name", F.lit(".jpg"))).alias("file_name"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("img"), k, F.lit(".png"))).alias("image"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("n"), k)).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("diagnosis_3"),
        F.col("p_brand").alias("diagnosis"))


@register("flatten_isic_csv")
def q_flatten_isic_csv(spark, sf):
    return _rec(flatten.flatten_isic_csv(_isic_rows(spark, sf), "data/images/isic"), F.col("meta.isic_id").alias("isic_id"))


@register("flatten_ham10000")
def q_flatten_ham10000(spark, sf):
    p = load(spark, sf, "part")
    meta = p.select(F.concat(F.lit("ISIC_"), F.col("p_partkey").cast("string")).alias("image_id"),
                    F.col("p_type").alias("dx"),
                    F.when(F.col("p_size") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") * 1.5).alias("age"),
                    F.col("p_brand").alias("sex"), F.col("p_name").alias("localization"))
    inv = load(spark, sf, "lineitem").select(
        F.concat(F.lit("ISIC_"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("name"))
    r = flatten.flatten_ham10000(meta, inv, "data/images/isic")
    return _rec(r, F.col("meta.age").alias("age"), F.col("meta.sex").alias("sex"), F.col("meta.site").alias("site"))


@register("group_subject_modalities")
def q_group_subject_modalities(spark, sf):
    li = load(spark, sf, "lineitem")
    mod = F.element_at(F.array(*[F.lit(m) for m in ("flair", "t1ce", "t1", "t2", "seg")]),
                       (F.col("l_linenumber") % 5 + 1).cast("int"))
    k = F.col("l_orderkey").cast("string")
    files = li.select(F.concat(F.lit("cases/subj"), k, F.lit("/subj"), k, F.lit("_"), mod, F.lit(".nii.gz")).alias("path"))
    r = flatten.group_subject_modalities(files, "/out/png")
    return r.select("id", "image_path", F.array_join("meta.modalities", ",").alias("modalities"),
                    "src_flair", "src_t1ce", "src_t1", "src_t2")


@register("mint_id")
def q_mint_id(spark, sf):
    return _docs(spark, sf).select("doc_id", mint_id("doc", "doc_id").alias("id"))


# --------------------------------------------------------------------------- sources and sinks

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@register("read_jsonl")
def q_read_jsonl(spark, sf):
    """Documents written as JSON Lines (half plain, half gzip) and read back with a schema."""
    d = _docs(spark, sf)
    path = scratch_dir(spark, "jsonl")
    S.write_jsonl(d.filter(F.col("doc_id") % 2 == 0), f"{path}/plain")
    S.write_jsonl(d.filter(F.col("doc_id") % 2 == 1), f"{path}/gz", compression="gzip")
    return S.read_jsonl(spark, [f"{path}/plain", f"{path}/gz"], DOC_SCHEMA)


@register("read_jsonl_dirs")
def q_read_jsonl_dirs(spark, sf):
    """Three source folders; only plain JSON files match the glob, gzip files are skipped."""
    path = scratch_dir(spark, "dirs")
    S.write_jsonl(_docs(spark, sf).select("doc_id", "text", "source"), f"{path}/a")
    S.write_jsonl(load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text",
                                                       F.lit("benchmark").alias("source")), f"{path}/b")
    S.write_jsonl(load(spark, sf, "labels").select("doc_id", F.lit("x").alias("text"), F.lit("gz").alias("source")),
                  f"{path}/c", compression="gzip")
    r = S.read_jsonl_dirs(spark, [f"{path}/a", f"{path}/b", f"{path}/c"],
                          "doc_id bigint, text string, source string", glob="*.json")
    return r.select("doc_id", "text", "source")


@register("read_csv_records")
def q_read_csv_records(spark, sf):
    """part written as header CSV (with quotes and a multi-line field) and read back as strings."""
    p = load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.concat(F.col("p_name"), F.lit(', "quoted"\nsecond line')).alias("p_name"), "p_brand",
        F.col("p_size").cast("string").alias("p_size"))
    path = scratch_dir(spark, "csv")
    p.write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    return S.read_csv_records(spark, path)


@register("parse_json_tolerant")
def q_parse_json_tolerant(spark, sf):
    r = S.parse_json_tolerant(props_with_controls(spark, sf), "raw", T.StructType([T.StructField("k", T.LongType())]))
    return r.select("event_id", F.col("parsed.k").alias("k"), F.col("parse_status").alias("status"))


@register("triage_responses")
def q_triage_responses(spark, sf):
    return S.triage_responses(landed_responses(spark, sf)).select("page_id", "status", "reason", "action")


@register("ingest_cap")
def q_ingest_cap(spark, sf):
    return S.ingest_cap(_docs(spark, sf), 100, "doc_id").select("doc_id", "source")


@register("leaderboard_html")
def q_leaderboard_html(spark, sf):
    return evalqa.leaderboard_html(evalqa.leaderboard(_run_results(spark, sf)))


# --------------------------------------------------------------------------- tokenizer corpus and vocabulary


def _lines(spark, sf):
    return vocab.tokenizer_lines(_docs(spark, sf), order_by="doc_id")


@register("tokenizer_lines")
def q_tokenizer_lines(spark, sf):
    lines = vocab.tokenizer_lines(_docs(spark, sf), order_by="doc_id", max_lines=K.TOKENIZER_MAX_LINES)
    return lines.select("doc_id", "line")


@register("word_frequency")
def q_word_frequency(spark, sf):
    return vocab.word_frequency(_lines(spark, sf))


@register("char_coverage")
def q_char_coverage(spark, sf):
    return vocab.char_coverage(_lines(spark, sf))


@register("bpe_pair_counts")
def q_bpe_pair_counts(spark, sf):
    """Round-1 input of the merge learner: adjacent character pairs weighted by word count."""
    wf = vocab.word_frequency(_lines(spark, sf))
    sy = wf.select(vocab.chars("word").alias("sy"), "n")
    k = F.greatest(F.size("sy") - 1, F.lit(0))
    p = sy.select(F.explode(F.arrays_zip(F.slice("sy", 1, k), F.slice("sy", 2, k))).alias("p"), "n")
    return p.groupBy(F.col("p")["0"].alias("a"), F.col("p")["1"].alias("b")).agg(F.sum("n").alias("c"))


@register("bpe_merges")
def q_bpe_merges(spark, sf):
    return vocab.bpe_merges(vocab.word_frequency(_lines(spark, sf)))


@register("vocab_table")
def q_vocab_table(spark, sf):
    lines = _lines(spark, sf)
    return vocab.vocab_table(vocab.char_coverage(lines), vocab.bpe_merges(vocab.word_frequency(lines)))


@register("sample_shuffled")
def q_sample_shuffled(spark, sf):
    return split.sample_shuffled(_lines(spark, sf), 300, key="doc_id").select("doc_id")


@register("limit_rows")
def q_limit_rows(spark, sf):
    return split.limit_rows(_lines(spark, sf), 50, order_by="doc_id").select("doc_id", "line")


@register("split_stratified")
def q_split_stratified(spark, sf):
    d = _docs(spark, sf).join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("quality", F.coalesce(F.col("quality"), F.lit(-1)))
    return split.split_stratified(d, ["source", "quality"], key="doc_id").select("doc_id", "source", "quality", "split")


# --------------------------------------------------------------------------- volume numerics
def _voxels(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("subject"), F.lit("t1").alias("modality"),
                     (F.col("l_partkey") % 7).alias("x"), (F.col("l_suppkey") % 5).alias("y"),
                     (F.col("l_linenumber") - 1).alias("z"), F.col("l_extendedprice").alias("v"))


@register("center_slice")
def q_center_slice(spark, sf):
    return numerics.center_slice(_voxels(spark, sf)).select("subject", "x", "y", "z", "v")


@register("robust_scale")
def q_robust_scale(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("event_type").alias("subject"),
                                         F.lit("t1").alias("modality"), F.col("value").alias("v"))
    return numerics.robust_scale(e).select("event_id", "u8")


@register("composite_offsets")
def q_composite_offsets(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("modality_pos"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("long").alias("width"), (F.col("l_extendedprice") / 100).cast("long").alias("height"))
    li = li.groupBy("subject", "modality_pos").agg(F.min("width").alias("width"), F.min("height").alias("height"))
    return numerics.composite_offsets(li).select("subject", "modality_pos", "width", "x_offset", "crop_height")


# --------------------------------------------------------------------------- streaming


def _events_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                 .option("maxFilesPerTrigger", 1).parquet(sf))


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    base = scratch_dir(spark, "ingest")
    recs = documents_records(spark, sf).drop("doc_id", "lang")
    S.write_jsonl(recs, f"{base}/landing")
    q = W.stream_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", f"{base}/quarantine")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return clean.flat_records(out)


def _landed_pages(spark, sf):
    """Documents landed as pages: one line for 20 neighbouring ids, records in a nested list."""
    base = scratch_dir(spark, "pages")
    docs = load(spark, sf, "documents").select("doc_id", F.struct("doc_id", "source", "text").alias("r"))
    page = docs.groupBy(F.floor(F.col("doc_id") / 20).alias("page")).agg(F.array_sort(F.collect_list("r")).alias("list"))
    S.write_jsonl(page.select("page", F.struct("list").alias("result")), f"{base}/landing")
    return base, {"items": "result.list", "id": "doc_id", "text": "text"}


def _page_rows(rows):
    return rows.select(F.col("id").cast("long").alias("doc_id"), "status", F.md5("text").alias("text_md5"), F.get_json_object("body", "$.source").alias("source"))


@register("landed_pages")
def q_landed_pages(spark, sf):
    base, options = _landed_pages(spark, sf)
    return _page_rows(spark.read.format(pages.register(spark)).options(**options).load(f"{base}/landing"))


@register("stream_landed_pages")
def q_stream_landed_pages(spark, sf):
    base, options = _landed_pages(spark, sf)
    rows = spark.readStream.format(pages.register(spark)).options(**options, settleSeconds=0).load(f"{base}/landing")
    q = (rows.writeStream.foreachBatch(W._batch_sink(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return _page_rows(spark.read.parquet(f"{base}/out"))


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    base = scratch_dir(spark, "dedup")
    d = W.stream_dedup(_events_stream(spark, sf), ["user_id", "event_type"], "ts")
    q = (d.writeStream.foreachBatch(W._batch_sink(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt")
          .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


@register("stream_first_wins")
def q_stream_first_wins(spark, sf):
    """Of a user's events of one type within six hours of the first, the one of the least value."""
    base = scratch_dir(spark, "first-wins")
    # The clock of the data is kept: its times are read as UTC, whatever the time zone of the session.
    tz = spark.conf.get("spark.sql.session.timeZone")
    events = _events_stream(spark, sf).select("user_id", "event_type", "event_id", "value", W.as_utc_wallclock("ts", tz).alias("ts"))
    d = W.stateful_first_wins(events, ["user_id", "event_type"], "ts", "value", "6 hours", "1 hour")
    q = (d.writeStream.foreachBatch(W._batch_sink(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt")
          .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", "event_id")


@register("stream_counts")
def q_stream_counts(spark, sf):
    base = scratch_dir(spark, "counts")
    q = W.run_counts(spark, _events_stream(spark, sf), "ts", ["event_type"], f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    r = W.latest_counts(spark, f"{base}/out", ["window_start", "event_type"])
    return r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# FIXED VALUES: medication lists typed by users of the request stream fixture
MED_LISTS = ["Advil, coumadin", "biaxin,zocor", "simvastatin, clarithromycin", "", "erythromycin, lovastatin, Motrin",
             " warfarin ,ibuprofen, , azithromycin", "paracetamol", "zocor, biaxin, atorvastatin"]


@register("stream_requests")
def q_stream_requests(spark, sf):
    base = scratch_dir(spark, "requests")
    o = load(spark, sf, "orders")
    req = o.select(F.col("o_orderkey").alias("query_id"), _role_of(F.col("o_orderkey")).alias("role"),
                   F.element_at(F.array(*[F.lit(m) for m in MED_LISTS]),
                                (F.col("o_orderkey") % len(MED_LISTS) + 1).cast("int")).alias("drugs"))
    req.write.parquet(f"{base}/requests")
    stream = spark.readStream.schema(req.schema).parquet(f"{base}/requests")
    q = W.stream_requests(spark, stream, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    r = spark.read.parquet(f"{base}/out")
    return r.select("query_id", "role", "use_rag", "use_ddi", F.size("ddi").cast("long").alias("n_ddi"),
                    F.array_join("ddi", "\n").alias("ddi"), "disclaimer")


@register("join_image_path")
def q_join_image_path(spark, sf):
    """Image paths from page URLs: the URL path (backslashes allowed) joined under an image root."""
    p = load(spark, sf, "pages")
    rel = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/", "\\\\")
    return p.select("page_id", clean.join_image_path(F.lit("data/images"), rel).alias("image_path"))


@register("build_retrieval_table")
def q_build_retrieval_table(spark, sf):
    recs = clean.unify(documents_records(spark, sf))
    t = retrieve.build_retrieval_table(recs, id_col="doc_id")
    probe = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return t.select(F.col("id").alias("doc_id"), "passage_no", F.length("text").cast("long").alias("text_len"), "source", "license",
                    F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sum_sq"), F.round(probe, 6).alias("probe"))


# --------------------------------------------------------------------------- sinks read back, files, maps


@register("write_jsonl")
def q_write_jsonl(spark, sf):
    """Documents with an all-null column written as JSON Lines; every line is read back as text."""
    path = scratch_dir(spark, "write-jsonl")
    S.write_jsonl(_docs(spark, sf).withColumn("note", F.lit(None).cast("string")), path)
    line = spark.read.text(path)
    r = F.from_json("value", DOC_SCHEMA)
    return line.select(r["doc_id"].alias("doc_id"), r["text"].alias("text"), F.col("value").contains('"note":null').alias("null_kept"))


def _json_map_file(spark, rows: DataFrame, name: str) -> str:
    """(key, values) rows -> one JSON object in key order, in one file (a vocabulary file is one object)."""
    path = scratch_dir(spark, name)
    entries = rows.agg(F.array_sort(F.collect_list(F.struct("key", "codes"))).alias("e"))
    entries.select(F.to_json(F.map_from_entries("e")).alias("value")).coalesce(1).write.text(path)
    return path


def _type_map(spark, sf) -> DataFrame:
    return load(spark, sf, "part").groupBy(F.col("p_type").alias("key")).agg(F.array_sort(F.collect_set("p_brand")).alias("codes"))


@register("read_json_map")
def q_read_json_map(spark, sf):
    r = S.read_json_map(spark, _json_map_file(spark, _type_map(spark, sf), "json-map"))
    return r.select("pos", "key", F.array_join("value", ",").alias("value"))


@register("load_vocab")
def q_load_vocab(spark, sf):
    nations = load(spark, sf, "nation").select(F.col("n_name").alias("key"), F.array(F.col("n_regionkey").cast("string")).alias("codes"))
    paths = {"types": _json_map_file(spark, _type_map(spark, sf), "vocab"), "nations": _json_map_file(spark, nations, "vocab"),
             "absent": scratch_dir(spark, "no-such-vocab")}
    r = label.load_vocab(spark, paths)
    return r.select("system", "pos", "term", F.array_join("codes", ",").alias("codes"))


@register("read_results")
def q_read_results(spark, sf):
    """Run results appended in two writes and read back."""
    path = scratch_dir(spark, "results")
    runs = _run_results(spark, sf)
    S.write_result_json(runs.where("dataset = 'mcq'"), path)
    S.write_result_json(runs.where("dataset <> 'mcq'"), path)
    m = lambda k: F.round(F.try_element_at("metrics", F.lit(k)), 6).alias(k)
    return S.read_results(spark, path).select("dataset", "mode", "role", "n", m("acc"), m("f1"), m("em"), "timestamp")


def _relative(path="path"):
    return F.regexp_extract(path, "(n[0-9]+/[^/]+)$", 1)


@register("list_files")
def q_list_files(spark, sf):
    return S.list_files(spark, png_folder(spark, sf)).select(_relative().alias("path"), "name")


@register("flatten_isic_files")
def q_flatten_isic_files(spark, sf):
    files = S.list_files(spark, png_folder(spark, sf)).select(F.concat(F.lit("img\\"), F.translate(_relative(), "/", "\\")).alias("path"))
    return _rec(flatten.flatten_isic_files(files))


@register("image_min_resolution")
def q_image_min_resolution(spark, sf):
    return S.image_min_resolution(spark, png_folder(spark, sf)).select(_relative().alias("path"), "width", "height", "ok")


@register("write_retrieval_table")
def q_write_retrieval_table(spark, sf):
    path = scratch_dir(spark, "retrieval")
    S.write_retrieval_table(retrieve.build_retrieval_table(clean.unify(documents_records(spark, sf)), id_col="doc_id"), path)
    t = S.read_retrieval_table(spark, path)
    return t.select(F.col("id").alias("doc_id"), "passage_no", F.length("text").cast("long").alias("text_len"), "source", "license")


@register("write_tokenizer_corpus")
def q_write_tokenizer_corpus(spark, sf):
    path = scratch_dir(spark, "tokenizer-corpus")
    S.write_tokenizer_corpus(_lines(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("write_splits")
def q_write_splits(spark, sf):
    path = scratch_dir(spark, "splits")
    split.write_splits(split.split_random(_docs(spark, sf).select("doc_id", "source"), key="doc_id"), path)
    return spark.read.schema("doc_id bigint, source string, split string").json(path)


@register("no_hit_fallback")
def q_no_hit_fallback(spark, sf):
    """Requests of which some have hits and some have none."""
    req = load(spark, sf, "orders").select((F.col("o_orderkey") % 25).cast("int").alias("query_id")).distinct()
    return retrieve.no_hit_fallback(req, retrieve.evidence_block(_hits(spark, sf)))


# --------------------------------------------------------------------------- composed paths


@register("fuzzy_token_sort")
def q_fuzzy_token_sort(spark, sf):
    """Part names with their words reversed against the vocabulary: only the token-sorted scorer meets them."""
    v = label.vocab_from_rows(spark, FUZZY_VOCAB)
    words = F.array_join(F.reverse(F.split("text", " ")), " ")
    h = label.fuzzy_topk(_part_texts(spark, sf).withColumn("text", words), v, scorer="token_sort")
    return h.select("id", "system", "pos", "term", F.round("score", 6).alias("score"), "rank")


@register("fuzzy_wratio")
def q_fuzzy_wratio(spark, sf):
    """Part names against the vocabulary by the weighted ratio: words in any order, terms inside names."""
    v = label.vocab_from_rows(spark, FUZZY_VOCAB)
    h = label.fuzzy_topk(_part_texts(spark, sf), v, scorer="wratio")
    return h.select("id", "system", "pos", "term", F.round("score", 6).alias("score"), "rank")


def _passage_table(spark, sf):
    return retrieve.build_retrieval_table(clean.unify(documents_records(spark, sf)))


def _typed_requests(spark, sf):
    b = load(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "patient").otherwise("clinician").alias("role"),
                    F.col("text").alias("query"),
                    F.element_at(F.array(*[F.lit(m) for m in MED_LISTS]), (F.col("item_id") % len(MED_LISTS) + 1).cast("int")).alias("drugs"))


@register("search_text")
def q_search_text(spark, sf):
    """Benchmark passages as query texts over the passages of all documents (ranks and scores; ties have equal scores)."""
    h = retrieve.search(_passage_table(spark, sf), _typed_requests(spark, sf))
    return h.select("query_id", "rank", F.round("score", 6).alias("score"))


def _echo(prompts: list[str]) -> list[str]:
    """A predictor that answers with the query it finds in the prompt."""
    return ["Answer: " + p.split("User Query:\n", 1)[1].split("\n\nEvidence:\n", 1)[0] for p in prompts]


@register("answer_requests")
def q_answer_requests(spark, sf):
    a = retrieve.answer_requests(_typed_requests(spark, sf), _passage_table(spark, sf), _echo)
    return a.select("query_id", "role", "answer", F.size("ddi").cast("long").alias("n_ddi"), "disclaimer")


def _letters(prompts: list[str]) -> list[str]:
    """A predictor: 'yes' to yes/no prompts, the letter B to choices, else the question's own words."""
    out = []
    for p in prompts:
        if p.startswith(K.YESNO_PROMPT_HEAD):
            out.append("Yes.")
        elif p.startswith(K.MCQ_PROMPT_HEAD):
            out.append("B")
        else:
            out.append(p.split("Question: ", 1)[1].rsplit("\nAnswer:", 1)[0])
    return out


@register("evaluate")
def q_evaluate(spark, sf):
    """Items made from orders so that every branch of every metric runs."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("mcq"), F.lit("yn"), F.lit("short")), (k % 3 + 1).cast("int"))
    gold = F.when(k % 3 == 1, F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (F.col("o_custkey") % 3 + 1).cast("int"))) \
        .otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    items = o.select(k.alias("id"), kind.alias("type"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("question"),
                     F.lit("").alias("context"), F.array(*[F.lit(x) for x in "wxyz"]).alias("options"), gold.alias("answer"),
                     (F.col("o_custkey") % 4).cast("int").alias("label"), kind.alias("dataset"), F.lit("plain").alias("mode"), F.lit("clinician").alias("role"))
    s = evalqa.evaluate(items, _letters)
    return evalqa.aggregate_metrics(s).select("dataset", "mode", "role", "metric", F.round("mean", 6).alias("mean"))
