"""Exact top-k vector search that reads only the parts of an index that can still matter.

The index is clustered around centroids and stored by cluster, cut into parts of
bounded size, each cluster with its radius (the largest distance of a row from its
centroid).  For a query q and a cluster (c, r) no row scores more than
q.c + |q| * r.  A first pass reads the clusters with the best bounds and gives each
query a k-th best score; a second one reads the clusters whose bound reaches that
score, and no others.  So the answer is exact, however good or bad the
clustering is; that decides only how much is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import cut_lineage, ship_code
from .retrieve import TopK, _best, _vectors

PART_ROWS = 20_000       # rows of an index part, about
QUERY_BLOCK = 5_000      # queries that meet a part at a time, about
SLACK = 1e-9             # a bound may be short of a score by rounding


def fit_centroids(sample: np.ndarray, clusters: int, rounds: int = 8, seed: int = K.SEED) -> np.ndarray:
    """Centroids of a bounded sample, by Lloyd's rounds from drawn rows."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(clusters, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(sample, centroids)[0]
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, distance to it) of each row."""
    out, dist = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for at in range(0, len(rows), 4096):
        x = rows[at:at + 4096]
        d = (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
        out[at:at + 4096] = d.argmin(axis=1)
        dist[at:at + 4096] = np.sqrt(((x - centroids[out[at:at + 4096]]) ** 2).sum(axis=1))
    return out, dist


class ClusteredIndex:
    """An index written to ``path``: every row with a vector, by cluster and part."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType):
        self.spark, self.path, self.id_type = spark, path, id_type
        self.parts = spark.read.schema(f"part int, id {id_type.simpleString()}, vec array<double>, cluster int").parquet(f"{path}/rows")
        # ``clusters`` rows: a parameter of the build.
        meta = spark.read.schema("cluster int, n long, radius double, parts int, centroid array<double>").parquet(f"{path}/clusters").orderBy("cluster").collect()
        self.numbers = [r["cluster"] for r in meta]
        self.centroids = np.array([r["centroid"] for r in meta], np.float64)
        self.radius = np.array([r["radius"] for r in meta], np.float64)
        self.n_parts = [r["parts"] for r in meta]

    @classmethod
    def build(cls, index: DataFrame, path: str, clusters: int = 64, sample_rows: int = 20_000, id_col: str = "id", vec_col: str = "embedding") -> "ClusteredIndex":
        """Centroids from at most about ``sample_rows`` rows drawn by hash (the documented bound of the fit); all rows are indexed.

        Rows without a vector are left out; ids may be null or repeat.
        """
        spark = index.sparkSession
        rows = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        total = rows.count()
        share = min(1_000_000, -(-1_000_000 * sample_rows // max(1, total)))
        drawn = [r[0] for r in rows.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < share).select("vec").limit(2 * sample_rows).collect()]
        centroids = fit_centroids(np.array(drawn, np.float64), clusters) if drawn else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centroids)
        schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())])

        def place(batches):
            import pyarrow as pa

            for batch in batches:
                if len(batch):
                    c, d = _nearest(_vectors(batch.column(1)), shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c, pa.int32()), pa.array(d)], names=["id", "vec", "cluster", "dist"])

        ship_code()
        placed = cut_lineage(rows.mapInArrow(place, schema))
        sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
        sizes = sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        names = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cluster int, centroid array<double>")
        sizes.join(names, "cluster").write.mode("overwrite").parquet(f"{path}/clusters")
        # At most ``clusters`` rows, so it may be broadcast.
        cut = placed.join(F.broadcast(sizes.select("cluster", "parts")), "cluster")
        cut.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int")).select("cluster", "part", "id", "vec").repartition("cluster", "part") \
            .write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
        return cls(spark, path, rows.schema["id"].dataType)

    def search(self, queries: DataFrame, k: int = K.TOP_K, qid_col: str = "query_id", qvec_col: str = "embedding", id_col: str = "id", probes: int = 2, stats: dict | None = None) -> DataFrame:
        """(query_id, rank, id, score), exact; ties by id, nulls last.  Every query row is answered for itself.

        ``stats`` takes the share of (query, cluster) pairs that were read.
        """
        qid_type = queries.schema[qid_col].dataType
        asked = queries.where(F.col(qvec_col).isNotNull()).select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qvec"))
        asked = cut_lineage(asked.withColumn("qn", F.monotonically_increasing_id()))
        if not self.numbers:
            return asked.limit(0).select(F.col("qid").alias(qid_col), F.lit(0).cast("long").alias("rank"), F.lit(None).cast(self.id_type).alias(id_col), F.lit(0.0).alias("score"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        routes = cut_lineage(asked.mapInArrow(self._routes(probes), T.StructType([*asked.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("first", T.BooleanType())])))
        first = cut_lineage(self._scan(routes.where("first"), blocks, k, qid_type))
        # The k-th best score so far; fewer than k hits leave every cluster open.
        kth = _best(first.withColumnRenamed("qn", "_qn"), k, "_qn", "id").groupBy(F.col("_qn").alias("qn")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        open_ = routes.where("not first").join(kth, "qn", "left").where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("bound") + SLACK * (1 + F.abs("bound")) >= F.col("least"))).select(routes.columns)
        open_ = cut_lineage(open_)
        if stats is not None:
            pairs = routes.count()
            stats["share_read"] = (routes.where("first").count() + open_.count()) / max(1, pairs)
        hits = first.unionByName(self._scan(open_, blocks, k, qid_type)).withColumnRenamed("qn", "_qn")
        return _best(hits, k, "qid", "id").select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), "score")

    def _routes(self, probes: int):
        numbers, centroids, radius = np.array(self.numbers), self.centroids, self.radius

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not len(batch):
                    continue
                q = _vectors(batch.column(1))
                bound = q @ centroids.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
                first = np.zeros(bound.shape, bool)
                best = np.argsort(-(q @ centroids.T), axis=1)[:, :probes]
                np.put_along_axis(first, best, True, axis=1)
                take = pa.array(np.repeat(np.arange(len(q)), len(numbers)))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in batch.columns], pa.array(np.tile(numbers, len(q)), pa.int32()), pa.array(bound.ravel()), pa.array(first.ravel())],
                    names=[*batch.schema.names, "cluster", "bound", "first"])

        ship_code()
        return run

    def _scan(self, routes: DataFrame, blocks: int, k: int, qid_type: T.DataType) -> DataFrame:
        """(qn, qid, id, score): the k best rows of each part for each query that is sent to it.

        A part meets the queries in blocks; both sides of a meeting are bounded.
        """
        sizes = dict(zip(self.numbers, self.n_parts))
        parts = self.spark.createDataFrame([(c, p) for c, n in sizes.items() for p in range(n)], "cluster int, part int")
        sent = routes.select("cluster", "qn", "qid", "qvec", F.pmod(F.xxhash64("qn"), F.lit(blocks)).cast("int").alias("block")).join(F.broadcast(parts), "cluster")
        wanted = sent.select("cluster", "part", F.expr("block + 0").alias("meeting")).distinct()
        # Only parts that a query is sent to are read on.
        rows = self.parts.join(wanted, ["cluster", "part"])
        schema = T.StructType([T.StructField("qn", T.LongType()), T.StructField("qid", qid_type), T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())])

        def meet(left, right):
            import pyarrow as pa

            if not len(left) or not len(right):
                return pa.table({f.name: pa.array([], left.schema.field("id").type if f.name == "id" else right.schema.field(f.name).type if f.name in ("qn", "qid") else pa.float64()) for f in schema})
            vec, qvec = _vectors(left.column("vec").combine_chunks()), _vectors(right.column("qvec").combine_chunks())
            top = TopK(qvec, k)
            step = max(1, 8_000_000 // len(qvec))
            ids = left.column("id").to_pylist()
            for at in range(0, len(vec), step):
                top.add(ids[at:at + step], vec[at:at + step])
            rep = pa.array([i for i, found in enumerate(top.ids) for _ in found], pa.int64())
            return pa.table({"qn": right.column("qn").take(rep), "qid": right.column("qid").take(rep),
                             "id": pa.array([x for found in top.ids for x in found], left.schema.field("id").type), "score": pa.array(np.concatenate(top.scores))})

        ship_code()
        return rows.groupBy("cluster", "part", "meeting").cogroup(sent.groupBy("cluster", "part", "block")).applyInArrow(meet, schema)


__all__ = ["ClusteredIndex", "fit_centroids"]
