"""A training-data pipeline over ``documents``: five stages, each one operator of ``corpusloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All stages but the
last return the columns of their input, whatever their names.

Null and empty texts score as clean, fail the quality base and go there.  Null ids and
repeated rows pass the first two stages row by row; of rows that are near-duplicates one
stays, that of the least id (a null id only where there is no other), so of repeated rows one.
A tie in the least id goes to the least hash of the text.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import dartminhash, packing, quality, secrets, toxicity
from corpusloom.llm.common import materialise, table
from corpusloom.llm.hf import Vocabulary


def _restored(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a result that carried all but the id under ``in_``."""
    return result.select(*[F.col(c if c == "doc_id" else f"in_{c}").alias(c) for c in docs.columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _restored(toxicity.score(docs, model, keep=_others(docs)).where("predicted = 0"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or the threshold table go."""
    return _restored(quality.quality_rules(docs, keep=_others(docs)).where("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least doc_id."""
    return dartminhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; no document goes."""
    clean = secrets.redact(docs, secrets.train(docs), count_col=None)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenized and packed into sequences of at most 4096 ids."""
    vocabulary = Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"), "words")
    return packing.pack_documents(docs, vocabulary, end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# The learned stages and the packing are no SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on everything its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
