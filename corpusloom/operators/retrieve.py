"""Dense retrieval: encode, normalise, exact top-k, evidence, citations, prompt.

Exact top-k runs where the index lives: the query matrix is broadcast (after
a size check; larger query sets are processed in broadcast-sized blocks), each
index partition emits its own top-k per query with numpy, and a window over
the (query_id) key keeps the global top-k.  Only partitions*k rows per query
cross the shuffle; the index itself is never moved.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import fmt3, truncate
from ..functions.text import col_
from ..session import broadcast_if_small, cut_lineage, ship_code

MAX_BROADCAST_QUERY_VALUES = 8_000_000    # ~64 MB of float64 per broadcast query block


# --------------------------------------------------------------------------- R01 encoder
def _embed(df: DataFrame, text, embed: Callable[[], Callable[[list[str]], np.ndarray]], batch: int, unit: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus ``embedding`` of the text expression: row-local, Arrow batches, no shuffle.

    ``embed`` is called once per task and returns texts -> (n, d) array.  ``unit``: vectors as ``l2_normalize`` gives them, to the last bit.
    """
    src = df.withColumn("_t", F.coalesce(text, F.lit("")))
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        encode = embed()
        for rb in batches:
            for at in range(0, rb.num_rows, batch):
                part = rb.slice(at, batch)
                vecs = np.asarray(encode(part.column("_t").to_pylist()), dtype=np.float64)
                if unit and vecs.ndim > 1:
                    norm = np.sqrt(np.cumsum(vecs * vecs, axis=1)[:, -1:])        # summed in order
                    vecs = np.divide(vecs, norm, out=vecs.copy(), where=~(norm <= 0))
                flat = pa.array(vecs.reshape(-1), pa.float64())
                ends = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * (vecs.shape[1] if vecs.ndim > 1 else 0), pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(ends, flat)], [*keep, "embedding"])

    ship_code()
    return src.mapInArrow(run, schema)


def hashing_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of space-separated words: slot = md5(word)[:8 hex] mod dim, + when the 9th hex digit is even."""
    import hashlib

    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
        return int(h[:8], 16) % dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        if len(known) > 500_000:
            known.clear()
        for row, text in zip(out, texts):
            for word in text.split(" "):
                if word:
                    at = known.get(word)
                    if at is None:
                        at = known[word] = place(word)
                    row[at[0]] += at[1]
        return out

    return encode


def encode_text(df: DataFrame, text_col: str = "text", id_col: str = "id",
                encoder: Callable[[list[str]], np.ndarray] | None = None,
                max_chars: int | None = None, batch: int = K.ENCODE_BATCH, dim: int = 256) -> DataFrame:
    """(id, embedding array<double>) of every text, one row per input row whatever its id.

    Without an encoder the words of the processed text are hashed; a user
    encoder (texts -> (n, d) array, e.g. a sentence model) is fed batches of
    ``batch`` rows.  The whole text counts; ``max_chars`` cuts it first where a
    model asks for that (an index takes passages instead).
    """
    text = F.col(text_col) if max_chars is None else truncate(text_col, max_chars)
    rows = df.select(id_col, text.alias("_src"))
    return _encoded(rows, F.col("_src"), encoder, batch, dim).drop("_src")


def _encoded(rows: DataFrame, text: Column, encoder, batch: int, dim: int, unit: bool = False) -> DataFrame:
    from ..functions import default_process

    if encoder is None:
        return _embed(rows, default_process(text), lambda: hashing_encoder(dim), batch, unit)
    return _embed(rows, text, lambda: encoder, batch, unit)


# --------------------------------------------------------------------------- R02
def l2_normalize(v) -> Column:
    """V / ||v|| in double; a zero vector stays as it is.

    The squared norm is folded once; the fold's finish step divides by it, so
    the work is linear in the dimension.
    """
    vd = col_(v).cast("array<double>")
    return F.aggregate(vd, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x,
                       lambda acc: F.when(acc > 0, F.transform(vd, lambda x: x / F.sqrt(acc))).otherwise(vd))


def mean_vector(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """Per-key element-wise mean (used to derive query vectors from the data)."""
    e = df.select(key, F.posexplode(vec_col).alias("pos", "x"))
    m = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec_col))


# --------------------------------------------------------------------------- R03
def knn_topk(index: DataFrame, queries: DataFrame, k: int = K.TOP_K, id_col: str = "id",
             vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Exact inner-product top-k per query row -> (query_id, rank, id, score).

    Fewer than k hits when the index is smaller than k; ties go to the lower id, null ids last.
    Rows without a vector have no score and are left out, queries without one have no hits; every
    query row is answered for itself, also where an id repeats.
    The query side is broadcast only below MAX_BROADCAST_QUERY_VALUES numbers;
    above it the queries are hashed into blocks that each fit.  Blocks are
    answered one after the other, each answer written to the checkpoint folder
    and its broadcast released, so the driver holds one block at a time.
    ``carry``: columns of the index that come along with each hit (rows of one id must be equal in them); each task
    holds them for its own top k only.
    """
    qid_type = queries.schema[qid_col].dataType
    q = queries.where(F.col(qvec_col).isNotNull()).select(qid_col, qvec_col).persist()      # sized, then collected: computed once
    total = _query_values(q, qvec_col)
    nblocks = max(1, int(np.ceil(total / MAX_BROADCAST_QUERY_VALUES)))
    parts = []
    for b in range(nblocks):
        blk = q if nblocks == 1 else q.filter(F.pmod(F.xxhash64(qid_col, qvec_col), F.lit(nblocks)) == b)
        part, shared = _knn_broadcast(index, blk.collect(), qid_type, k, id_col, vec_col, qid_col, carry or [])
        if nblocks > 1:
            part = cut_lineage(part)
            shared.unpersist()
        parts.append(part)
    q.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _query_values(queries: DataFrame, qvec_col: str) -> int:
    r = queries.agg(F.sum(F.size(qvec_col)).alias("n")).collect()[0]["n"]
    return int(r or 0)


def _vectors(column) -> np.ndarray:
    """An Arrow list column without nulls as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tie_order(ids: list) -> np.ndarray:
    """Places of the ids in ascending order, nulls last, as numbers that break ties."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]) if ids[i] is not None else (True, 0))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


class TopK:
    """Running top k of several queries over blocks of rows: best score first, ties by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.ids: list[list] = [[] for _ in range(len(queries))]
        self.scores: list[np.ndarray] = [np.zeros(0) for _ in range(len(queries))]

    def add(self, ids: list, rows: np.ndarray, only: np.ndarray | None = None) -> None:
        """``only``: the queries to answer (all by default)."""
        who = np.arange(len(self.queries)) if only is None else only
        if not len(ids) or not len(who):
            return
        scores = self.queries[who] @ rows.T
        kk = min(self.k, len(ids))
        floor = -np.partition(-scores, kk - 1, axis=1)[:, kk - 1]
        for row, q, least in zip(scores, who.tolist(), floor):
            if len(self.scores[q]) == self.k:
                least = max(least, self.scores[q][-1])
            near = np.flatnonzero(row >= least)
            if not len(near):
                continue
            all_ids = self.ids[q] + [ids[i] for i in near]
            all_scores = np.concatenate([self.scores[q], row[near]])
            best = np.lexsort((_tie_order(all_ids), -all_scores))[:self.k]
            self.ids[q], self.scores[q] = [all_ids[i] for i in best], all_scores[best]


def _answers(top: TopK, qids: list, numbers: list, id_type, qid_type, qid_col: str, id_col: str):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    counts = [len(i) for i in top.ids]
    rep = [i for i, n in enumerate(counts) for _ in range(n)]
    return pa.RecordBatch.from_arrays(
        [pa.array([numbers[i] for i in rep], pa.int64()), pa.array([qids[i] for i in rep], to_arrow_type(qid_type)),
         pa.array([x for ids in top.ids for x in ids], to_arrow_type(id_type)), pa.array(np.concatenate([*top.scores, np.zeros(0)]), pa.float64())],
        names=["_qn", qid_col, id_col, "score"])


def _answer_schema(qid_col: str, qid_type, id_col: str, id_type) -> T.StructType:
    return T.StructType([T.StructField("_qn", T.LongType()), T.StructField(qid_col, qid_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])


def _best(found: DataFrame, k: int, qid_col: str, id_col: str, carry: list[str] | tuple = ()) -> DataFrame:
    """The k best of each query row's answers from all tasks."""
    w = Window.partitionBy("_qn").orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(qid_col, "rank", id_col, "score", *carry)


def _knn_broadcast(index: DataFrame, qrows, qid_type, k: int, id_col: str, vec_col: str, qid_col: str, carry: list[str]):
    import pyarrow as pa

    spark = index.sparkSession
    id_type = index.schema[id_col].dataType
    qids = [r[0] for r in qrows]
    qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in qrows]) if qrows else np.zeros((0, 0))
    bq = spark.sparkContext.broadcast((qids, qmat))

    def run(batches):
        ids_q, qm = bq.value
        if not len(ids_q):
            return
        top = TopK(qm, k)
        held: list = []                                        # what the ids in the top k carry, by id
        step = max(1, 8_000_000 // len(ids_q))                 # bound the (queries x rows) score block
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = part.column(0).to_pylist()
                top.add(ids, _vectors(part.column(1)))
                if carry:
                    held = _held(top, held, ids, part)
        answers = _answers(top, ids_q, list(range(len(ids_q))), id_type, qid_type, qid_col, id_col)
        if carry and len(answers):
            rows = pa.Table.from_batches([b for _, b in held])
            place = {x: i for i, x in enumerate(x for ids, _ in held for x in ids)}
            rows = rows.take(pa.array([place[x] for ids in top.ids for x in ids], pa.int64())).combine_chunks()
            answers = pa.RecordBatch.from_arrays([*answers.columns, *(c.chunk(0) for c in rows.columns)], names=[*answers.schema.names, *carry])
        elif carry:
            return
        yield answers

    ship_code()
    schema = T.StructType([*_answer_schema(qid_col, qid_type, id_col, id_type), *(index.schema[c] for c in carry)])
    local = index.where(F.col(vec_col).isNotNull()).select(id_col, vec_col, *carry).mapInArrow(run, schema)
    return _best(local, k, qid_col, id_col, carry), bq


def _held(top: TopK, held: list, ids: list, part) -> list:
    """(ids, rows of the carried columns) of every id now in a top k: those held before and those new in ``part``."""
    import pyarrow as pa

    now = {x for found in top.ids for x in found}
    out = []
    for own, rows in [*held, (ids, part.select(part.schema.names[2:]))]:
        at = []
        for i, x in enumerate(own):
            if x in now:
                now.discard(x)
                at.append(i)
        if at:
            out.append(([own[i] for i in at], rows.take(pa.array(at, pa.int64()))))
    return out


def passages(df: DataFrame, text_col: str, max_chars: int) -> DataFrame:
    """One row per stretch of ``max_chars`` characters of the text, with ``passage_no`` from 0; the whole text is covered."""
    n = F.ceil(F.length(text_col) / F.lit(max_chars)).cast("int")
    rows = df.withColumn("passage_no", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)))
    return rows.withColumn(text_col, F.substring(F.col(text_col), F.col("passage_no") * max_chars + 1, F.lit(max_chars)))


def build_retrieval_table(records: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None,
                          id_col: str = "id", text_col: str = "text", source: Column | None = None,
                          license: Column | None = None, max_chars: int = K.INDEX_TEXT_CHARS, dim: int = 256) -> DataFrame:
    """Index build: the passages of all non-empty texts, encoded, L2-normalised, with source/license
    metadata ('unknown' when missing), keyed by (id, passage_no) (S10 writes it).

    Row-local throughout: null and repeated ids keep their rows.
    """
    from ..functions import nonempty

    src = source if source is not None else F.col("meta.source")
    lic = license if license is not None else F.col("meta.license")
    base = records.filter(nonempty(text_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(src, F.lit(K.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(lic, F.lit(K.DEFAULT_LICENSE)).alias("license"))
    cut = passages(base, "text", max_chars).select("id", "passage_no", "text", "source", "license")
    return _encoded(cut, F.col("text"), encoder, K.ENCODE_BATCH, dim, unit=True)


# --------------------------------------------------------------------------- R04-R08
def hit_metadata(hits: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach text/source/license to hits.  A plain join: the hits are computed once and AQE broadcasts them when they are few."""
    return store.join(hits, id_col)


def evidence_block(hits: DataFrame, qid_col: str = "query_id", max_chars: int = K.EVIDENCE_TEXT_CHARS) -> DataFrame:
    """Per query, '[rank] (source) text[:800]' lines in rank order."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("),
                    F.coalesce(F.col("source"), F.lit(K.DEFAULT_SOURCE)), F.lit(") "),
                    truncate(F.coalesce(F.col("text"), F.lit("")), max_chars))
    return _ordered_join(hits.withColumn("_line", line), qid_col, "_line", "\n", "evidence")


def format_citations(hits: DataFrame, qid_col: str = "query_id") -> DataFrame:
    """R06: '[source] score=0.000' joined by ' | ' in rank order."""
    c = F.concat(F.lit("["), F.coalesce(F.col("source"), F.lit(K.DEFAULT_SOURCE)), F.lit("] score="), fmt3("score"))
    return _ordered_join(hits.withColumn("_c", c), qid_col, "_c", K.CITATION_JOIN, "citations")


def _ordered_join(df: DataFrame, key: str, col: str, sep: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda s: s[col]), sep)
        .alias(out))


def build_prompt(query, evidence) -> Column:
    """Fixed template (concat, so '%' or braces in user text are safe)."""
    return F.concat(F.lit(K.PROMPT_TEMPLATE_HEAD), col_(query), F.lit(K.PROMPT_TEMPLATE_MID), col_(evidence),
                    F.lit(K.PROMPT_TEMPLATE_TAIL))


def no_hit_fallback(queries: DataFrame, evidence: DataFrame, qid_col: str = "query_id") -> DataFrame:
    """Queries without hits get the fixed fallback evidence."""
    return queries.join(evidence, qid_col, "left").withColumn(
        "evidence", F.coalesce(F.col("evidence"), F.lit(K.NO_HIT_EVIDENCE)))


def answer_batch(requests: DataFrame, hits: DataFrame, ddi: DataFrame | None = None,
                 predictor: Callable[[list[str]], list[str]] | None = None,
                 qid_col: str = "query_id") -> DataFrame:
    """Retrieval -> prompt -> predictor -> interaction suffix -> (role, answer, citations, ddi).

    ``requests``: (query_id, role, query[, generated]).  ``hits``: top-k hits with metadata.
    ``predictor`` maps prompts to generated texts and runs in ``mapInPandas``; without it the
    requests must carry a ``generated`` column.  ``ddi``: (query_id, ddi array) or None.
    """
    from .interactions import append_findings
    from .roles import disclaimer

    ev = evidence_block(hits, qid_col)
    cites = format_citations(hits, qid_col)
    r = no_hit_fallback(requests, ev, qid_col).join(cites, qid_col, "left")
    r = r.withColumn("prompt", build_prompt("query", "evidence"))
    if predictor is not None:
        fn = predictor
        schema = T.StructType(r.schema.fields + [T.StructField("generated", T.StringType())])

        def run(batches):
            for pdf in batches:
                pdf = pdf.copy()
                pdf["generated"] = list(fn(pdf["prompt"].tolist()))
                yield pdf

        r = r.drop("generated") if "generated" in r.columns else r
        ship_code()
        r = r.mapInPandas(run, schema)
    if ddi is not None:
        r = r.join(ddi, qid_col, "left")
    else:
        r = r.withColumn("ddi", F.array().cast(T.ArrayType(T.StringType())))
    r = r.withColumn("ddi", F.coalesce("ddi", F.array().cast(T.ArrayType(T.StringType()))))
    return r.select(qid_col, "role", append_findings(F.coalesce("generated", F.lit("")), "ddi").alias("answer"),
                    F.coalesce("citations", F.lit("")).alias("citations"), "ddi",
                    disclaimer("role").alias("disclaimer"))


# --------------------------------------------------------------------------- text search end to end
CARRIED_HITS = 10_000      # up to so many hits, each task sends the rows of its own hits along with them


def search(table: DataFrame, queries: DataFrame, k: int = K.TOP_K, encoder: Callable[[list[str]], np.ndarray] | None = None,
           qid_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """Query texts -> encode -> exact top-k over a stored retrieval table -> hits with metadata.

    Returns (query_id, rank, score, id, passage_no, text, source, license); the
    query vectors come from the same encoder as the table's.
    """
    vecs = encode_text(queries, query_col, qid_col, encoder=encoder)
    # Queries are numbered, so each row is answered for itself.
    vecs = cut_lineage(vecs.select(F.col(qid_col).alias("_q"), l2_normalize("embedding").alias("embedding"), F.monotonically_increasing_id().alias("_n")))
    # A key that says what the row holds, led by id and passage for ties: rows with one key are equal, whatever ids repeat.
    what = F.md5(F.to_json(F.struct("id", "passage_no", "text", "source", "license")))
    keyed = table.withColumn("_key", F.concat_ws("#", F.coalesce(F.col("id").cast("string"), F.lit("")), F.lpad(F.col("passage_no").cast("string"), 9, "0"), what))
    columns = ["id", "passage_no", "text", "source", "license"]
    out = [F.col("_q").alias(qid_col), "rank", "score", *columns]
    if vecs.count() * k <= CARRIED_HITS:
        # Few hits bring their rows along: the table, which may be encoded as it is read, is read once.
        return cut_lineage(knn_topk(keyed, vecs, k, id_col="_key", qid_col="_n", carry=columns).join(vecs.select("_n", "_q"), "_n").select(*out))
    hits = cut_lineage(knn_topk(keyed, vecs, k, id_col="_key", qid_col="_n").join(vecs.select("_n", "_q"), "_n"))
    # Only what was hit is gathered; of equal rows one is enough for each hit.
    found = keyed.drop("embedding").join(broadcast_if_small(hits), "_key").dropDuplicates(["_n", "rank"])
    return cut_lineage(found.select(*out))


def answer_requests(requests: DataFrame, table: DataFrame, predictor: Callable[[list[str]], list[str]], rules=None,
                    encoder: Callable[[list[str]], np.ndarray] | None = None, k: int = K.TOP_K, qid_col: str = "query_id") -> DataFrame:
    """R09 as one composition: (query_id, role, query, drugs) -> search -> prompt -> predictor -> interaction findings.

    ``drugs`` is the typed medication list of the request (null: none).
    Requests without any hit get the fixed fallback evidence.
    """
    from . import interactions

    rules = rules or interactions.Rules(requests.sparkSession)
    # Parts meet by the number of the request, not by its id: ids may repeat or be null.
    numbered = cut_lineage(requests.withColumn("_request", F.monotonically_increasing_id()))
    items = interactions.explode_baskets(numbered.select(F.col("_request").alias("qid"), interactions.parse_med_list("drugs").alias("l")), "qid", "l")
    found = interactions.check_interactions(items, rules, numbered.select(F.col("_request").alias("basket"))).withColumnRenamed("basket", "_request")
    answers = answer_batch(numbered, search(table, numbered, k, encoder, "_request"), found, predictor, "_request")
    return answers.join(numbered.select("_request", qid_col), "_request").select(qid_col, *[c for c in answers.columns if c != "_request"])
