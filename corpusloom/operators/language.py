"""Language of a text from its characters: hashed character trigrams, learned from labelled rows.

The language check of the cleaner goes by a record's language field; many records
have none.  A multinomial model over trigrams of code points (hashed to
``SLOTS`` numbers) fills it in: learned from a bounded sample of rows that say their
language, applied row by row from a broadcast table of SLOTS x languages weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nonempty
from ..session import ship_code

SLOTS = 1 << 16


def trigram_slots(text: str) -> np.ndarray:
    """The slot of every run of three code points of the lower-cased text, white space as single spaces, one at both ends."""
    cp = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(cp) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ cp[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ cp[2:]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray          # (SLOTS, languages) log shares
    prior: np.ndarray            # (languages,) log shares

    def scores(self, text: str) -> np.ndarray:
        return self.prior + self.weights[trigram_slots(text)].sum(axis=0)

    def language(self, text: str) -> str | None:
        """The likeliest language; ties go to the first name; None for a text without letters."""
        if not any(c.isalpha() for c in text):
            return None
        return self.languages[int(self.scores(text).argmax())]


def learn_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, max_languages: int = 100) -> LanguageModel:
    """A model of the ``max_languages`` most frequent languages, from about ``sample_rows`` rows drawn by hash (the documented bound of the fit).

    Rows without text or language are left out; a row's trigrams count once each, so long texts do not outweigh others.
    """
    rows = df.where(nonempty(text_col) & nonempty(lang_col)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages).collect()
    if not sizes:
        raise ValueError("no row says its language")
    total = sum(r["count"] for r in sizes)
    languages = tuple(sorted(r["l"] for r in sizes))
    share = min(1_000_000, -(-1_000_000 * sample_rows // total))
    drawn = rows.where(F.col("l").isin(*languages) & (F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share))

    def count(batches):
        import pyarrow as pa

        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                tables.setdefault(lang, np.zeros(SLOTS, np.int64))[np.unique(trigram_slots(text))] += 1
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at])], names=["l", "slot", "n"])

    ship_code()
    # At most SLOTS x languages rows.
    counted = drawn.mapInArrow(count, "l string, slot int, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).collect()
    table = np.full((SLOTS, len(languages)), 0.5)
    place = {lang: k for k, lang in enumerate(languages)}
    for r in counted:
        table[r["slot"], place[r["l"]]] += r["n"]
    rows_of = {r["l"]: r["count"] for r in sizes}
    prior = np.log(np.array([rows_of[lang] for lang in languages], float) / total)
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), prior)


def detect_language(df: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "lang_found") -> DataFrame:
    """All rows and columns of ``df`` with the language of their whole text (null without letters); row-local, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(out, T.StringType())])
    at = columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [None if t is None else shared.value.language(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    ship_code()
    return df.select(*columns).mapInArrow(run, schema)


def language_allow_by_text(df: DataFrame, allowed: list[str], model: LanguageModel, lang: Column, text_col: str = "text") -> DataFrame:
    """C05 for records of which some do not say their language: those are judged by their text."""
    from ..session import free_name

    found, said = free_name(df.columns, "_found"), free_name(df.columns, "_said")
    known = df.withColumn(said, lang)
    told = known.where(nonempty(said) & F.col(said).isin(*allowed)).select(*df.columns)
    silent = detect_language(known.where(~nonempty(said) | F.col(said).isNull()).drop(said), model, text_col, found)
    return told.unionByName(silent.where(F.col(found).isin(*allowed)).select(*df.columns))


__all__ = ["LanguageModel", "detect_language", "language_allow_by_text", "learn_languages", "trigram_slots"]
