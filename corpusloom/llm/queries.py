"""Registered queries of the training-data operators: thin wrappers that fix parameters and digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, collocation, dartminhash, html, mih, packing, prefixtrie, quality, reshard, secrets, suffixdedup, tokenfile, toxicity
from corpusloom.llm.common import shared_folder, table
from corpusloom.llm.hf import Vocabulary
from corpusloom.session import ship_code

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.Ranks.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"), "byte_level")
    folder = shared_folder(spark, "token-ids")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, vocabulary, end_id=2)
    out = tokenfile.read(spark, folder)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"), "words")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=1, capacity=4096)


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The layout before: 16 shards by source, as uneven as the sources are.
    old = F.pmod(F.xxhash64("source"), F.lit(16)).cast("int")
    out = reshard.reshard(docs, old, new_shards=24, folder=shared_folder(spark, "shards"))
    return out.select(
        "doc_id", reshard.size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=10)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined("spans", ("assign", "access", "hex")), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), min_count=10, max_words=3, top=2000)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_id_files": op3_token_id_files,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_flow_resharding": op5_flow_resharding,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_multi_index_hashing": op7_multi_index_hashing,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_phrase_collocations": op13_phrase_collocations,
}


def registry() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code()
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}
