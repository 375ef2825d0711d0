"""Labelling with code vocabularies (term -> codes).

* ``fuzzy_topk``: best <= limit terms per text with score >= cutoff, ties by
  vocabulary position.  Candidates come from an exact q-gram filter, not from
  a cross join: with the normalised Levenshtein score,
  score >= c  <=>  d <= (1 - c/100) * L  (L = longer length),
  and the q-gram lemma says two strings at edit distance d share at least
  L - 1 - 2d bigrams (with multiplicity).  For c = 86 that bound is >= 1 for
  every L >= 2, so every qualifying pair shares a bigram (length-1 strings
  must be equal).  Only the rarest 2d + 1 bigrams of each side are joined
  (``qgrams.prefix_candidates``), so large vocabularies give few candidates.
* ``link_phrases``: whole documents -> 1..n-word n-grams -> broadcast hash
  join with the vocabulary -> codes per document.  Linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import default_process, nonempty
from ..session import broadcast_if_small, ship_code
from .qgrams import prefix_candidates
from .wratio import LEAST_CUTOFF, score_pairs, wratio, wratio_candidates

VOCAB_SCHEMA = "system string, pos int, term string, codes array<string>"


def read_json_map(spark: SparkSession, path: str, value_type: str = "array<string>") -> DataFrame:
    """Whole-file JSON object -> (pos, key, value) rows in file order; absent file -> empty."""
    schema = f"pos int, key string, value {value_type}"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as err:         # only a missing file means an empty map
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    m = raw.select(F.from_json("value", f"map<string,{value_type}>").alias("m"))
    return m.select(F.posexplode("m").alias("pos", "key", "value")).select(
        F.col("pos").cast("int"), "key", "value")


def load_vocab(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """{system: json path} -> (system, pos, term, codes)."""
    out = spark.createDataFrame([], VOCAB_SCHEMA)
    for system, path in paths.items():
        m = read_json_map(spark, path)
        out = out.unionByName(m.select(F.lit(system).alias("system"), "pos", F.col("key").alias("term"),
                                       F.col("value").alias("codes")))
    return out


def vocab_from_rows(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(system, term, codes) rows in order -> vocabulary table with positions per system."""
    pos: dict[str, int] = {}
    data = []
    for system, term, codes in rows:
        data.append((system, pos.get(system, 0), term, list(codes)))
        pos[system] = pos.get(system, 0) + 1
    return spark.createDataFrame(data, VOCAB_SCHEMA)


def sorted_tokens(c) -> Column:
    """The processed words of a text in sorted order, single-spaced."""
    return F.array_join(F.array_sort(F.filter(F.split(default_process(c), " "), lambda w: F.length(w) > 0)), " ")


def fuzzy_topk(texts: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
               limit: int = K.FUZZY_LIMIT, cutoff: int = K.FUZZY_CUTOFF, scorer: str | Callable[[str, str], float] = "ratio") -> DataFrame:
    """(id, system, pos, term, score, rank) for the best terms per text.

    score = 100 * (1 - lev / max(len)); kept when score >= cutoff; case sensitive.
    ``scorer``: "ratio" compares the strings as they are, "token_sort" with their
    processed words in sorted order, so reordered words still match.
    The bigram filter is exact from a cutoff of 67 on (see module doc); a lower
    one is refused rather than answered with hits missing.

    "wratio" is the weighted score of ``operators.wratio`` (whole strings, words in any order, words of
    one side inside the other, and the shorter inside the longer), exact from a cutoff of 86 on.  A function
    (text, term) -> score is asked about all pairs that "wratio" looks at for this cutoff: it is
    answered whole if it is nowhere at the cutoff where the weighted score is below it.

    Null and empty texts and terms have no row; a repeated id has the answers of each of its texts.
    """
    weighted = scorer == "wratio" or callable(scorer)
    if weighted and cutoff < LEAST_CUTOFF:
        raise ValueError(f"fuzzy_topk needs a cutoff of {LEAST_CUTOFF} or more for this scorer: below it parts of words in any order can qualify")
    if cutoff < 67:
        raise ValueError("fuzzy_topk needs a cutoff of 67 or more: below it terms without a common bigram can qualify")
    keep = 100 - cutoff
    if not weighted and scorer not in ("ratio", "token_sort"):
        raise ValueError(f"unknown scorer {scorer!r}")
    form = sorted_tokens if scorer == "token_sort" else F.col
    # A position that repeats in a vocabulary counts once, with its least term.
    v = vocab.filter(nonempty("term")).groupBy("system", "pos").agg(F.min("term").alias("_term")).select(
        "system", "pos", "_term", form("_term").alias("term")).filter(nonempty("term"))
    names = v.select("system", "pos", "_term")
    v = v.select("system", "pos", "term", F.length("term").alias("n"))
    maxlen = v.agg(F.max("n")).collect()[0][0] or 0
    longest = 8 * maxlen if weighted else 100 * maxlen // (100 - keep)
    # Texts too long for any term go before anything is shuffled; the rest is compared once, whoever holds it.
    rows = texts.filter(nonempty(text_col)).select(F.col(id_col).alias("_row"), form(text_col).alias("_text"))
    rows = rows.filter(nonempty("_text") & (F.length("_text") <= F.lit(longest)))
    t = rows.select(F.col("_text").alias("_id")).distinct().select("_id", F.col("_id").alias("_t"), F.length("_id").alias("m"))
    if weighted:
        pairs = wratio_candidates(t, v, cutoff).join(broadcast_if_small(v.select("system", "pos", "term")), ["system", "pos"])
        scored = score_pairs(pairs, wratio if scorer == "wratio" else scorer).filter(F.col("score") >= cutoff)
    else:
        scored = _levenshtein_scores(t, v, cutoff)
    w = Window.partitionBy("_id", "system").orderBy(F.col("score").desc(), F.col("pos").asc())
    best = scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).drop("term")
    named = best.join(broadcast_if_small(names), ["system", "pos"])
    return rows.join(named, F.col("_text") == F.col("_id")).select(
        F.col("_row").alias(id_col), "system", "pos", F.col("_term").alias("term"), "score", "rank")


def _levenshtein_scores(t: DataFrame, v: DataFrame, cutoff: int) -> DataFrame:
    cand = prefix_candidates(t, v, 100 - cutoff)
    ones = t.filter(F.col("m") == 1).join(broadcast_if_small(v.filter(F.col("n") == 1)),
                                          F.col("_t") == F.col("term"))
    ones = ones.select("_id", "_t", "m", "system", "pos", "term", "n")
    cand = cand.unionByName(ones)
    L = F.greatest("m", "n")
    scored = cand.withColumn("d", F.levenshtein("_t", "term")).filter((L - F.col("d")) * 100 >= L * cutoff)
    return scored.withColumn("score", (L - F.col("d")) * 100.0 / L)


def map_codes(texts: DataFrame, vocab: DataFrame, system: str, id_col: str = "id", text_col: str = "text",
              out: str = "codes", scorer: str = "ratio") -> DataFrame:
    """Codes of the best <= 3 terms, distinct and sorted; null/'' text -> []."""
    text = F.col(text_col)
    found = codes_of_texts(texts.select(text.alias("text")), vocab.filter(F.col("system") == system), scorer).select("text", F.col("codes").alias(out))
    # By text, not by id: repeated and null ids keep their own rows.
    return texts.select(id_col, text.alias("_text")).join(found, F.col("_text") == found["text"], "left").select(
        id_col, F.coalesce(out, F.array().cast(T.ArrayType(T.StringType()))).alias(out))


def codes_of_texts(texts: DataFrame, vocab: DataFrame, scorer: str = "ratio") -> DataFrame:
    """(text, codes) of the distinct texts with hits, all systems in ``vocab`` together; codes distinct and sorted."""
    distinct = texts.filter(nonempty("text")).select("text").distinct()
    hits = fuzzy_topk(distinct.select(F.col("text").alias("id"), "text"), vocab, scorer=scorer)
    codes = hits.join(broadcast_if_small(vocab.select("system", "pos", "codes")), ["system", "pos"])
    return codes.groupBy(F.col("id").alias("text")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def map_icd10(texts, vocab, **kw):
    return map_codes(texts, vocab, "icd10", **kw)


def map_snomed(texts, vocab, **kw):
    return map_codes(texts, vocab, "snomed", **kw)


def map_rxnorm(texts, vocab, **kw):
    return map_codes(texts, vocab, "rxnorm", **kw)


def map_meddra(texts, vocab, **kw):
    return map_codes(texts, vocab, "meddra", **kw)


def auto_label(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """Set labels.icd10 / labels.snomed only when the key is absent and text non-empty.

    Codes belong to texts and are joined by text, so rows in = rows out for any ids.
    """
    none = F.array().cast(T.ArrayType(T.StringType()))
    r = records
    for system in ("icd10", "snomed"):
        found = codes_of_texts(records.select("text"), vocab.filter(F.col("system") == system)).select(F.col("text").alias("_t"), F.col("codes").alias(f"_{system}"))
        r = r.join(found, F.col("text") == F.col("_t"), "left").drop("_t")
    added = F.map_filter(F.create_map(*[x for s in ("icd10", "snomed") for x in (F.lit(s), F.coalesce(f"_{s}", none))]),
                         lambda k, v: ~F.map_contains_key(F.col("labels"), k))
    labels = F.when(nonempty("text"), F.map_concat(F.col("labels"), added)).otherwise(F.col("labels"))
    return r.withColumn("labels", labels).drop("_icd10", "_snomed")


def phrase_key(c) -> Column:
    """Normalised phrase: non-word characters -> space, lower case, single spaces."""
    return F.array_join(F.filter(F.split(default_process(c), " "), lambda w: F.length(w) > 0), " ")


class TokenTrie:
    """Phrases as paths of words: all phrases that begin at a position are met by one walk down."""

    END = ""

    def __init__(self, phrases: list[tuple[str, list[str]]]):
        self.root: dict = {}
        self.codes: list[list[str]] = []
        for phrase, codes in phrases:
            node = self.root
            for word in phrase.split(" "):
                node = node.setdefault(word, {})
            node[self.END] = len(self.codes)
            self.codes.append(codes)

    def link(self, text: str) -> tuple[list[str], int]:
        """(sorted distinct codes, number of mentions) of all phrases in a processed text, overlaps included."""
        words = [w for w in text.split(" ") if w]
        found: set[int] = set()
        mentions = 0
        for at, word in enumerate(words):
            node = self.root.get(word)
            while node is not None:
                here = node.get(self.END)
                if here is not None:
                    found.add(here)
                    mentions += 1
                at += 1
                node = node.get(words[at]) if at < len(words) else None
        return sorted({c for k in found for c in self.codes[k]}), mentions


MAX_TRIE_PHRASES, MAX_TRIE_CHARS = 1_000_000, 32 << 20


def _phrases(vocab: DataFrame) -> DataFrame:
    v = vocab.select(phrase_key("term").alias("phrase"), "codes").filter(F.length("phrase") > 0)
    return v.groupBy("phrase").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))   # a mention counts once


def link_phrases(docs: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
                 max_n: int | None = None) -> DataFrame:
    """(id, codes, n_mentions) of every document from exact n-gram matches (1..max_n words) of the whole text.

    The vocabulary, its size checked, is broadcast as a trie of words and every text is matched where
    it is, in one walk: no text and no word enters an exchange, and rows are answered each for itself,
    whatever their ids.  A vocabulary beyond the bound is joined instead (``link_phrases_joined``).
    """
    v = _phrases(vocab)
    if max_n is not None:
        v = v.filter(F.size(F.split("phrase", " ")) <= max_n)
    size = v.limit(MAX_TRIE_PHRASES + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("c")).first()
    if size["n"] > MAX_TRIE_PHRASES or size["c"] > MAX_TRIE_CHARS:
        return link_phrases_joined(docs, vocab, id_col, text_col, max_n)
    trie = docs.sparkSession.sparkContext.broadcast(TokenTrie([(r["phrase"], list(r["codes"])) for r in v.collect()]))
    rows = docs.select(F.col(id_col).alias("id"), default_process(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    schema = T.StructType([rows.schema["id"], T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("n_mentions", T.LongType())])

    def run(batches):
        import pyarrow as pa

        link = trie.value.link
        for batch in batches:
            found = [link(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())], names=["id", "codes", "n_mentions"])

    ship_code()
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def link_phrases_joined(docs: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text", max_n: int | None = None) -> DataFrame:
    """L08 for vocabularies that are too large to broadcast as a trie: the n-grams of each distinct text meet the phrases in joins.

    Every word position becomes one row holding the next max_n words
    (``arrays_zip`` of shifted slices, no lambdas); positions whose first word
    starts no vocabulary phrase are dropped by a semi join before any n-gram string is built.
    """
    none = F.array().cast(T.ArrayType(T.StringType()))
    v = _phrases(vocab).withColumn("nw", F.size(F.split("phrase", " ")))
    if max_n is None:
        max_n = v.agg(F.max("nw")).collect()[0][0] or 0
    if max_n == 0:
        return docs.select(id_col, none.alias("codes"), F.lit(0).cast("long").alias("n_mentions"))
    first = broadcast_if_small(v.select(F.split("phrase", " ")[0].alias("w1")).distinct())
    # Equal texts share one answer, so repeated or null ids keep their own rows.
    texts = docs.select(id_col, F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_text"))
    key = "_h"
    words = texts.select("_h", "_text").dropDuplicates(["_h"]).select(
        "_h", F.filter(F.split(default_process("_text"), " "), lambda w: F.length(w) > 0).alias("w"))
    n = F.size("w")
    shifted = [F.slice("w", k, F.greatest(n - k + 1, F.lit(0))) for k in range(1, max_n + 1)]
    pos = words.select(key, F.explode(F.arrays_zip(*shifted)).alias("z"))
    cols = [F.col("z")[str(k)].alias(f"w{k + 1}") for k in range(max_n)]
    pos = pos.select(key, *cols).join(first, "w1", "left_semi")
    grams = [F.col("w1")]
    for k in range(2, max_n + 1):
        full = F.concat_ws(" ", *[F.col(f"w{j}") for j in range(1, k + 1)])
        grams.append(F.when(F.col(f"w{k}").isNotNull(), full))
    ng = pos.select(key, F.explode(F.array(*grams)).alias("phrase")).filter(F.col("phrase").isNotNull())
    vocab_b = broadcast_if_small(v.select("phrase", "codes"))
    # one pass: mentions per (record, phrase) are partially aggregated, then each record
    # gathers its distinct phrases (at most the vocabulary size) with their codes
    per_phrase = ng.join(vocab_b.select("phrase"), "phrase", "left_semi").groupBy(key, "phrase") \
        .agg(F.count(F.lit(1)).alias("c"))
    per_phrase = per_phrase.join(vocab_b, "phrase")
    linked = per_phrase.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"),
        F.sum("c").alias("n_mentions"))
    return texts.select(id_col, key).join(linked, key, "left").select(
        id_col, F.coalesce("codes", none).alias("codes"), F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"))
