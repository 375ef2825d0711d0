"""Near-duplicate removal: shingles -> MinHash -> LSH buckets -> first-wins.

Design for scale:
* MinHash is row-local (``mapInPandas`` + numpy).  Shingle hashes are a
  polynomial hash of the 5 code points mod p = 2^31-1; the 128 slots use the
  multiply-shift family ``((a_k*h + b_k) mod 2^64) >> 32`` with odd 64-bit
  a_k, which numpy computes with wrapping uint64 arithmetic (no division).
  Both are plain integer arithmetic, so the SQL oracle reproduces them exactly.
* Records with an identical signature are collapsed to the lowest order key
  before any bucket work (they share every neighbour, so first-wins keeps at
  most the lowest one); this also removes the hottest buckets.
* First-wins is decided in rounds over bucket *aggregates* (min undecided /
  min kept order key per bucket), never over candidate pairs, so a bucket
  holding a third of all records costs one partial aggregate, not n^2 pairs.
  After two rounds the rest is decided by connected components, each in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import default_process, nonempty
from ..session import cut_lineage, evaluate_once, free_name, join_hot, ship_code

# FIXED VALUES (our own portable hash family)
MERSENNE_P = 2147483647          # 2^31 - 1
SHINGLE_BASE = 1000003           # polynomial base over code points
EMPTY_SLOT = 1 << 32             # slot value of a text without shingles (above every real value)


def slot_params(num_perm: int = K.DEDUP_NUM_PERM) -> tuple[np.ndarray, np.ndarray]:
    """a_k = md5('a'k)[:16 hex] | 1 (odd), b_k = md5('b'k)[:16 hex]: independent 64-bit slots."""
    a = [int(hashlib.md5(f"a{k}".encode()).hexdigest()[:16], 16) | 1 for k in range(num_perm)]
    b = [int(hashlib.md5(f"b{k}".encode()).hexdigest()[:16], 16) for k in range(num_perm)]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5):
    """(bands, rows) minimising weighted false-positive + false-negative area of the
    S-curve 1-(1-s^r)^b around the threshold (standard LSH parameter choice)."""
    best = None
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            lo = np.linspace(0.0, threshold, 1001)
            hi = np.linspace(threshold, 1.0, 1001)
            fp = np.trapezoid(1 - (1 - lo ** r) ** b, lo)
            fn = np.trapezoid((1 - hi ** r) ** b, hi)
            err = fp_weight * fp + fn_weight * fn
            if best is None or err < best[0]:
                best = (err, b, r)
    return best[1], best[2]


def shingle_hashes(text: str, n: int = K.DEDUP_SHINGLE) -> np.ndarray:
    """Distinct polynomial hashes of all n-code-point windows (empty if shorter than n)."""
    if text is None or len(text) < n:
        return np.empty(0, dtype=np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    m = len(cp) - n + 1
    h = cp[n - 1:].copy()
    for j in range(1, n):
        h += cp[n - 1 - j:n - 1 - j + m] * pow(SHINGLE_BASE, j, MERSENNE_P)   # < 2^21 * 2^31 each
        if j % 256 == 0:
            h %= MERSENNE_P                   # 256 terms: < 2^60, fits int64
    h = ((h & MERSENNE_P) + (h >> 31)).astype(np.uint32)      # congruent mod p, < 2p
    np.minimum(h, h - np.uint32(MERSENNE_P), out=h)           # canonical residue: h < p wraps to a larger value
    h.sort()
    new = np.ones(m, dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new].astype(np.int64)


def signature(text: str, num_perm: int = K.DEDUP_NUM_PERM, n: int = K.DEDUP_SHINGLE, params=None) -> np.ndarray:
    """128-slot MinHash; a text without shingles gets every slot = 2^32 (they all collide)."""
    a, b = params if params is not None else slot_params(num_perm)
    h = shingle_hashes(text, n)
    if h.size == 0:
        return np.full(num_perm, EMPTY_SLOT, dtype=np.int64)
    return _min_multiply_shift(h, a, b)


def _min_multiply_shift(h: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 2048, slots: int = 32) -> np.ndarray:
    """min over h of ((a_k*h + b_k) mod 2^64) >> 32 for every slot k (wrapping uint64 math, in-place ops).

    A block is ``slots`` slots by ``chunk`` hashes, so inner loops are long and stay in the cache.
    The shift keeps the order and is done once, on the minima.
    """
    hu = h.astype(np.uint64)
    out = np.full(a.size, np.uint64(2 ** 64 - 1), dtype=np.uint64)
    a, b = a[:, None], b[:, None]
    for s in range(0, hu.size, chunk):
        part = hu[s:s + chunk]
        buf = np.empty((slots, part.size), dtype=np.uint64)
        for k in range(0, a.size, slots):
            x = buf[:a.size - k]
            np.multiply(part, a[k:k + slots], out=x)
            np.add(x, b[k:k + slots], out=x)
            np.minimum(out[k:k + slots], x.min(axis=1), out=out[k:k + slots])
    return (out >> np.uint64(32)).astype(np.int64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[bytes]:
    """One 16-byte key per band: md5 of 'band:v1,v2,...' (collisions negligible)."""
    keys = []
    slots = [str(v) for v in sig.tolist()]
    for bi in range(bands):
        vals = ",".join(slots[bi * rows:(bi + 1) * rows])
        keys.append(hashlib.md5(f"{bi}:{vals}".encode()).digest())
    return keys


def order_key(order_col: str, text_col: str) -> Column:
    """The order of records as a sortable value of any key type: (key is null, key, hash of the text).

    Null keys come last.  Records equal in key and text count as one; records
    with equal keys and different texts are ordered by the hash of their text.
    """
    return F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("key"),
                    F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))


def minhash_buckets(df: DataFrame, ord_col: str, proc_col: str, num_perm: int, bands: int,
                    rows: int, n: int = K.DEDUP_SHINGLE) -> DataFrame:
    """D03+D04 map side: (ord, signature key, band bucket keys), row-local, Arrow batches; ord of any type."""

    def run(batches):
        import pyarrow as pa

        params = slot_params(num_perm)
        for rb in batches:
            sigkeys, bks = [], []
            for t in rb.column("proc").to_pylist():
                sig = signature(t, num_perm, n, params)
                sigkeys.append(hashlib.md5(sig.tobytes()).digest())
                bks.append(band_keys(sig, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [rb.column("ord"), pa.array(sigkeys, pa.binary()), pa.array(bks, pa.list_(pa.binary()))], ["ord", "sigkey", "buckets"])

    ship_code()
    src = _spread(df.select(F.col(ord_col).alias("ord"), F.col(proc_col).alias("proc")))
    schema = T.StructType([T.StructField("ord", src.schema["ord"].dataType), T.StructField("sigkey", T.BinaryType()),
                           T.StructField("buckets", T.ArrayType(T.BinaryType()))])
    return src.mapInArrow(run, schema)


def _spread(df: DataFrame) -> DataFrame:
    """Hash-spread the (key, processed text) rows over at least 2x the cores.

    MinHash costs far more CPU per input character than moving the character
    once, so an even spread wins even when the input files are few or
    unbalanced (a row group is a task).  The number comes from the
    configuration: asking the plan for it would run its upstream shuffles.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, "ord")


def _per_text(df: DataFrame, ord_col: str, proc_col: str, name: str, value_type: T.DataType, compute) -> DataFrame:
    """(ord, value of the processed text), row-local; ord of any type."""
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([compute(t) for t in rb.column(1).to_pylist()], to_arrow_type(value_type))], ["ord", name])

    ship_code()
    src = df.select(F.col(ord_col).alias("ord"), F.col(proc_col).alias("proc"))
    return src.mapInArrow(run, T.StructType([T.StructField("ord", src.schema["ord"].dataType), T.StructField(name, value_type)]))


def signature_table(df: DataFrame, ord_col: str, proc_col: str, num_perm: int = K.DEDUP_NUM_PERM,
                    n: int = K.DEDUP_SHINGLE) -> DataFrame:
    """(ord, sig) with the MinHash signature (for inspection/checks); a null text has no shingles."""
    params = slot_params(num_perm)
    return _per_text(df, ord_col, proc_col, "sig", T.ArrayType(T.LongType()), lambda t: signature(t, num_perm, n, params).tolist())


def shingle_count(df: DataFrame, ord_col: str, proc_col: str, n: int = K.DEDUP_SHINGLE) -> DataFrame:
    """Number of distinct n-code-point shingles per record."""
    return _per_text(df, ord_col, proc_col, "n_shingles", T.LongType(), lambda t: len({t[i:i + n] for i in range(len(t) - n + 1)}) if t else 0)


def _params(threshold, num_perm, bands, rows):
    if bands is None or rows is None:
        bands, rows = optimal_bands(threshold, num_perm)
    return bands, rows


def _nonempty_processed(df: DataFrame, order_col: str, text_col: str) -> DataFrame:
    return (df.filter(nonempty(text_col))
              .select(order_key(order_col, text_col).alias("ord"), default_process(text_col).alias("proc")))


def lsh_memberships(df: DataFrame, order_col: str = "id", text_col: str = "text",
                    threshold: float = K.DEDUP_THRESHOLD, num_perm: int = K.DEDUP_NUM_PERM,
                    bands: int | None = None, rows: int | None = None, collapse: bool = True) -> DataFrame:
    """(ord, bucket) for every non-empty record (collapsed to signature representatives)."""
    bands, rows = _params(threshold, num_perm, bands, rows)
    sig = minhash_buckets(_nonempty_processed(df, order_col, text_col), "ord", "proc", num_perm, bands, rows)
    if collapse:
        sig = sig.groupBy("sigkey").agg(F.min("ord").alias("ord"), F.any_value("buckets").alias("buckets"))
    return sig.select("ord", F.explode("buckets").alias("bucket"))


def lsh_candidates(df: DataFrame, order_col: str = "id", text_col: str = "text",
                   threshold: float = K.DEDUP_THRESHOLD, num_perm: int = K.DEDUP_NUM_PERM,
                   bands: int | None = None, rows: int | None = None) -> DataFrame:
    """D04 without materialising pairs: per record that shares a bucket with anyone,
    the number of such buckets and its lowest colliding neighbour.

    Two bucket aggregates (min, then min excluding that min) replace the pair
    self-join; both are partial aggregations, safe with a hot bucket.
    """
    # The signatures are computed once; everything below reads the table.
    mem = cut_lineage(lsh_memberships(df, order_col, text_col, threshold, num_perm, bands, rows, collapse=False))
    b1 = mem.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("m1"))
    b1 = b1.filter("size >= 2")
    m = _join_buckets(mem, b1)
    b2 = m.filter(F.col("ord") != F.col("m1")).groupBy("bucket").agg(F.min("ord").alias("m2"))
    m = _join_buckets(m, b2)
    nb = F.when(F.col("ord") == F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    return (m.groupBy("ord")
             .agg(F.count(F.lit(1)).alias("n_buckets"), F.min(nb).alias("first"))
             .select(F.col("ord.key").alias(order_col), "n_buckets", F.col("first.key").alias("first_neighbor")))


SALTS = 16


def _join_buckets(members: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """members x one row per bucket, where a bucket with very many members is spread over ``SALTS`` tasks."""
    wide = per_bucket.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("_s", F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int"))
    return salted.join(wide, ["bucket", "_s"]).drop("_s")


def dedup_exact(df: DataFrame, order_col: str = "id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Records whose processed text is identical collapse to the lowest order key.

    Empty texts are not collapsed (they are always kept).  One pass: the text is
    processed and hashed once, and one aggregate by the hash keeps the row of the least
    key (partially aggregated, so a text held by a third of all rows sends one row per map
    task).  Keys of any type; null keys come last; of rows equal in key
    and text one stays.  ``carry`` limits the columns of the result, and so what is shuffled.
    """
    cols = list(carry) if carry is not None else list(df.columns)
    if order_col not in cols:
        cols = [order_col, *cols]
    hashed = free_name(df.columns, "_k")
    text = F.when(nonempty(text_col), F.unhex(F.md5(default_process(text_col))))
    keyed = evaluate_once(df.select(*cols, text.alias(hashed)), hashed)
    # A record without text is a group of its own, by its number.
    rows = keyed.select(
        F.col(hashed).alias("k"), F.when(F.col(hashed).isNull(), F.monotonically_increasing_id()).alias("own"),
        F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("key")).alias("o"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).alias("r"))
    best = rows.groupBy("k", "own").agg(F.min_by("r", "o").alias("r"))
    return best.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cols)])


U, KEPT, DROPPED = 0, 1, 2
HOT_BUCKET = 10_000        # members from which a bucket is spread over SALTS tasks
ONE_TASK = 500_000         # memberships that one task decides
ROUNDS_FIRST, ROUNDS_BETWEEN = 2, 8   # rounds before components are looked for, and between


def first_wins_status(mem: DataFrame, max_rounds: int = 1_000, stats: dict | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Lexicographically-first maximal independent set of the bucket-sharing graph.

    ``mem``: (ord, bucket) memberships.  A record is kept iff no kept record
    with a lower order key shares a bucket with it.  Returns (ord, st) of every record.

    A few rounds over bucket aggregates decide most records: an undecided
    record is dropped if some bucket has a kept record below it, and kept if no bucket
    has an undecided record below it.  What is left falls into connected components of
    buckets and records; components of up to ``one_task`` memberships are decided
    by one task each, in key order, however long their chains are.  Larger ones take further
    rounds, which cut them to pieces.  Rounds are written to the checkpoint folder; running out of
    ``max_rounds`` is an error, never a guess.
    """
    mem = mem.select("ord", "bucket")
    sizes = cut_lineage(mem.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2"))
    spread = F.when(F.col("size") > HOT_BUCKET, SALTS).otherwise(1)
    state = cut_lineage(join_hot(mem, sizes, ["bucket"], "size").select("ord", "bucket", F.lit(U).alias("st"), spread.alias("salts")))
    alone = mem.select("ord").distinct().join(state.select("ord").distinct(), "ord", "left_anti").select("ord", F.lit(KEPT).alias("st"))
    decided = [alone]
    for rnd in range(1, max_rounds + 1):
        nxt = cut_lineage(_round(state))
        decided.append(nxt.filter(F.col("new") != U).select("ord", F.col("new").alias("st")).distinct())
        state = nxt.filter(F.col("new") != DROPPED).select("ord", "bucket", F.greatest("st", "new").alias("st"), "salts")
        if stats is not None:
            stats["rounds"] = rnd
        left = state.filter(F.col("st") == U).count()
        if left == 0:
            break
        if rnd >= ROUNDS_FIRST and (rnd - ROUNDS_FIRST) % ROUNDS_BETWEEN == 0:
            # Buckets that still have an undecided member, with all they hold.
            open_ = state.filter(F.col("st") == U).select("bucket").distinct()
            live = cut_lineage(state.join(open_, "bucket", "left_semi"))
            done, state = _by_component(live, one_task)
            decided.append(done)
            if state is None:
                break
    else:
        raise RuntimeError(f"records still undecided after {max_rounds} rounds")
    # A record kept in an earlier round shows up again where its buckets were still open.
    return cut_lineage(_union_all(decided).groupBy("ord").agg(F.max("st").alias("st")))


def _round(state: DataFrame) -> DataFrame:
    """The state rows with what the round decides of their record (``new``)."""
    agg = state.groupBy("bucket").agg(
        F.min(F.when(F.col("st") == U, F.col("ord"))).alias("min_u"),
        F.min(F.when(F.col("st") == KEPT, F.col("ord"))).alias("min_k"), F.max("salts").alias("salts"))
    wide = agg.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = state.filter(F.col("st") == U).withColumn("_s", F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int"))
    per = salted.join(wide, ["bucket", "_s"]).groupBy("ord").agg(
        F.max(F.coalesce(F.col("min_k") < F.col("ord"), F.lit(False))).alias("any_k"),
        F.max(F.coalesce(F.col("min_u") < F.col("ord"), F.lit(False))).alias("any_u"))
    new = per.select("ord", F.when(F.col("any_k"), F.lit(DROPPED)).when(~F.col("any_u"), F.lit(KEPT)).otherwise(F.lit(U)).alias("new"))
    return state.join(new, "ord", "left").withColumn("new", F.coalesce("new", "st"))


def _in_key_order(table):
    """Decides the rows (ord, bucket, st) of whole components: records in ascending order, each against the kept ones below."""
    import pyarrow as pa

    taken: set = set()
    out, st = [], []
    rows: dict = {}
    for o, b, s in zip(*(table.column(c).to_pylist() for c in ("ord", "bucket", "st"))):
        rows.setdefault(o, ([], s))[0].append(b)
    for o in sorted(rows, key=_sortable):
        buckets, s = rows[o]
        kept = s == KEPT or taken.isdisjoint(buckets)
        if kept:
            taken.update(buckets)
        out.append(o)
        st.append(KEPT if kept else DROPPED)
    return pa.table({"ord": pa.array(out, table.schema.field("ord").type), "st": pa.array(st, pa.int32())})


def _sortable(o):
    return tuple((v is None, v if v is not None else 0) for v in o.values()) if isinstance(o, dict) else o


def _by_component(live: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame | None]:
    """(decided records of components that fit a task, the rows of larger components or None)."""
    schema = T.StructType([live.schema["ord"], T.StructField("st", T.IntegerType())])
    ship_code()
    rows = live.select("ord", "bucket", "st")
    if live.count() <= one_task:
        return cut_lineage(rows.withColumn("_c", F.lit(0)).groupBy("_c").applyInArrow(_in_key_order, schema)), None
    # Every record is linked with the least one of its buckets.
    least = live.groupBy("bucket").agg(F.min("ord").alias("v"), F.max("salts").alias("salts")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    links = live.withColumn("_s", F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int")).join(least, ["bucket", "_s"]).select(F.col("ord").alias("u"), "v").where("u != v").distinct()
    of = components(links)
    placed = cut_lineage(live.join(of.withColumnRenamed("node", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord")))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > one_task).select("root")        # fewer than memberships / one_task
    small = placed.join(F.broadcast(large), "root", "left_anti")
    done = cut_lineage(small.select("root", "ord", "bucket", "st").groupBy("root").applyInArrow(_in_key_order, schema))
    rest = cut_lineage(placed.join(F.broadcast(large), "root", "left_semi").select("ord", "bucket", "st", "salts"))
    return done, None if rest.isEmpty() else rest


def components(links: DataFrame) -> DataFrame:
    """(node, root): least node of each connected component of the links (u, v), by alternating large and small stars.

    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = join_hot(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        down = join_hot(large, least, ["u"], "n")
        edges = cut_lineage(down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        mark = now


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _representatives(df: DataFrame, order_col: str, text_col: str, num_perm: int, bands: int, rows: int) -> DataFrame:
    """(n, ord, buckets): one record per signature, the least, numbered in key order (8 bytes stand for the key from here on)."""
    sig = minhash_buckets(_nonempty_processed(df, order_col, text_col), "ord", "proc", num_perm, bands, rows)
    reps = cut_lineage(sig.groupBy("sigkey").agg(F.min("ord").alias("ord"), F.any_value("buckets").alias("buckets")))
    ranked = reps.repartitionByRange("ord").sortWithinPartitions("ord")
    return cut_lineage(ranked.select(F.monotonically_increasing_id().alias("n"), "ord", "buckets"))


def _memberships(reps: DataFrame) -> DataFrame:
    return reps.select(F.col("n").alias("ord"), F.explode("buckets").alias("bucket"))


def _keep_rows(df: DataFrame, kept: DataFrame, order_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose order key is in ``kept`` (ord), one of each, and all rows without text."""
    name = free_name(df.columns, "_ord")
    keyed = df.withColumn(name, order_key(order_col, text_col))
    empty = df.where(~nonempty(text_col) | F.col(text_col).isNull())
    rows = keyed.where(nonempty(text_col)).join(kept.withColumnRenamed("ord", name), name, "left_semi").dropDuplicates([name])
    return rows.drop(name).unionByName(empty)


def dedup_first_wins(df: DataFrame, order_col: str = "id", text_col: str = "text",
                     threshold: float = K.DEDUP_THRESHOLD, num_perm: int = K.DEDUP_NUM_PERM,
                     bands: int | None = None, rows: int | None = None) -> DataFrame:
    """Near-duplicate removal, first record (by ``order_col``) wins.

    Empty text is always kept; a record is dropped iff it collides in some LSH
    band with an already kept record.  Keys of any type, null keys last; of
    rows equal in key and text one stays.  Returns the kept rows of ``df``.
    """
    bands, rows = _params(threshold, num_perm, bands, rows)
    reps = _representatives(df, order_col, text_col, num_perm, bands, rows)
    status = first_wins_status(_memberships(reps))
    kept = reps.select(F.col("n"), F.col("ord").alias("_o")).join(status.filter(F.col("st") == KEPT).select(F.col("ord").alias("n")), "n").select(F.col("_o").alias("ord"))
    return _keep_rows(df, kept, order_col, text_col)


class BandIndex:
    """Incremental D04/D05: the band buckets of all kept records, as a bucketed table that batches probe and extend.

    ``add`` takes the next batch: its records are hashed (no earlier one is), those that
    share a bucket with a record kept before are dropped, the rest is decided among itself, and the
    buckets of what is kept join the table under the batch's number.  So batches in key order keep
    what one run over all of them keeps.  A batch that is added again replaces what it had added.
    The table is bucketed by the band bucket, so a probe shuffles the batch and not the table.
    """

    def __init__(self, spark, table: str, threshold: float = K.DEDUP_THRESHOLD, num_perm: int = K.DEDUP_NUM_PERM,
                 bands: int | None = None, rows: int | None = None, table_buckets: int = 64):
        self.spark, self.table, self.num_perm, self.table_buckets = spark, table, num_perm, table_buckets
        self.bands, self.rows = _params(threshold, num_perm, bands, rows)

    def _known(self, batch: int) -> DataFrame | None:
        """Buckets of the batches before."""
        if not self.spark.catalog.tableExists(self.table):
            return None
        return self.spark.table(self.table).where(F.col("batch") < batch).select("bucket")

    def add(self, df: DataFrame, batch: int, order_col: str = "id", text_col: str = "text") -> DataFrame:
        """The rows of batch number ``batch`` that stay; records without text always do."""
        reps = _representatives(df, order_col, text_col, self.num_perm, self.bands, self.rows)
        mem = _memberships(reps)
        known = self._known(batch)
        if known is not None:
            met = mem.join(known, "bucket", "left_semi").select("ord").distinct()
            mem = cut_lineage(mem.join(met, "ord", "left_anti"))
        status = first_wins_status(mem)
        kept = cut_lineage(status.filter(F.col("st") == KEPT).select("ord"))
        added = mem.join(kept, "ord", "left_semi").select("bucket").distinct().withColumn("batch", F.lit(batch).cast("long"))
        if known is None:
            added.write.partitionBy("batch").bucketBy(self.table_buckets, "bucket").sortBy("bucket").saveAsTable(self.table)
        else:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (batch = {int(batch)})")
            added.write.partitionBy("batch").bucketBy(self.table_buckets, "bucket").sortBy("bucket").mode("append").saveAsTable(self.table)
        keys = reps.select(F.col("n"), F.col("ord").alias("_o")).join(kept.withColumnRenamed("ord", "n"), "n").select(F.col("_o").alias("ord"))
        return _keep_rows(df, cut_lineage(keys), order_col, text_col)


def dropped_records(df: DataFrame, order_col: str = "id", text_col: str = "text", threshold: float = K.DEDUP_THRESHOLD,
                    num_perm: int = K.DEDUP_NUM_PERM, bands: int | None = None, rows: int | None = None, n: int = K.DEDUP_SHINGLE) -> DataFrame:
    """(key, kept_key, jaccard), one row per record that first-wins drops.

    kept_key: the least kept record that shares a band with it (with the first
    record of its signature, where it has the signature of an earlier one); jaccard: the exact similarity of
    their sets of ``n``-character shingles (two texts without any: 1).  Texts meet per
    kept record: its text comes first and those of its partners stream past it, so a
    hub costs memory for one text; its partners are spread over ``SALTS`` tasks.
    Records equal in key and text are one record; records without text are never dropped.
    """
    bands, rows = _params(threshold, num_perm, bands, rows)
    sig = cut_lineage(minhash_buckets(_nonempty_processed(df, order_col, text_col), "ord", "proc", num_perm, bands, rows).dropDuplicates(["ord"]))
    least = sig.groupBy("sigkey").agg(F.min("ord").alias("ord"), F.any_value("buckets").alias("buckets"), F.count(F.lit(1)).alias("size"))
    reps = cut_lineage(least.repartitionByRange("ord").sortWithinPartitions("ord").select(F.monotonically_increasing_id().alias("n"), "ord", "sigkey", "buckets", "size"))
    mem = cut_lineage(_memberships(reps))
    status = first_wins_status(mem)
    kept, gone = (status.filter(F.col("st") == st).select("ord") for st in (KEPT, DROPPED))
    sizes = mem.join(gone, "ord", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    lowest = cut_lineage(mem.join(kept, "ord", "left_semi").groupBy("bucket").agg(F.min("ord").alias("kept")).join(sizes, "bucket"))
    by_rep = join_hot(cut_lineage(mem.join(gone, "ord", "left_semi")), lowest, ["bucket"], "size").groupBy("ord").agg(F.min("kept").alias("kept"))
    by_rep = by_rep.unionByName(kept.select("ord", F.col("ord").alias("kept"))).withColumnRenamed("ord", "n")
    of_sig = cut_lineage(reps.select("n", "sigkey", "size").join(by_rep, "n").select("n", "sigkey", "size", "kept"))
    pairs = join_hot(sig.select("ord", "sigkey"), of_sig, ["sigkey"], "size").join(reps.select(F.col("n").alias("kept"), F.col("ord").alias("kept_ord")), "kept")
    pairs = cut_lineage(pairs.where(F.col("ord") != F.col("kept_ord")).select("ord", "kept", "kept_ord", F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int").alias("s")))
    texts = _nonempty_processed(df, order_col, text_col).dropDuplicates(["ord"])
    first = pairs.select("kept", "kept_ord", "s").distinct()
    routes = first.select("kept", "s", F.lit(0).alias("role"), F.col("kept_ord").alias("ord")).unionByName(pairs.select("kept", "s", F.lit(1).alias("role"), "ord"))
    met = routes.join(texts, "ord").repartition("kept", "s").sortWithinPartitions("kept", "s", "role").select("kept", "role", "ord", "proc")
    types = met.schema
    schema = T.StructType([types["ord"], types["kept"], T.StructField("jaccard", T.DoubleType())])

    def shingles(t: str) -> set:
        return {t[i:i + n] for i in range(len(t) - n + 1)}

    def run(batches):
        import pyarrow as pa

        who, own = None, set()
        for rb in batches:
            at, score = [], []
            for i, (k, role, t) in enumerate(zip(rb.column("kept").to_pylist(), rb.column("role").to_pylist(), rb.column("proc").to_pylist())):
                if role == 0:
                    who, own = k, shingles(t)
                    continue
                if who != k:
                    raise RuntimeError("a record met no kept text")
                other = shingles(t)
                union = len(own | other)
                at.append(i)
                score.append(len(own & other) / union if union else 1.0)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column("ord").take(take), rb.column("kept").take(take), pa.array(score, pa.float64())], ["ord", "kept", "jaccard"])

    ship_code()
    scored = met.mapInArrow(run, schema)
    return scored.join(reps.select(F.col("n").alias("kept"), F.col("ord.key").alias("kept_key")), "kept").select(F.col("ord.key").alias(order_col), "kept_key", "jaccard")
