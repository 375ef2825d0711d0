"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of D bits is cut into m segments.  Codes within Hamming distance
m * s + a of a query agree with it in one of the first a + 1 segments within s
bits, or in one of the others within s - 1 (pigeonhole).  So a search looks up
segment values at growing radii, one segment at a time, verifies whatever it
meets by full distance, and ends as soon as the k-th best distance is not
larger than what is provably covered.

Spark deals the codes out into index shards and the queries into blocks; a task gets a
shard, builds its segment tables and answers blocks as they stream by, and the answers of the
shards are merged per query.  With fewer shards than cores the blocks of a shard are shared by
several tasks; otherwise every shard is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from corpusloom.session import ship_code


def to_codes(vectors: np.ndarray) -> np.ndarray:
    """Sign bits (1 for >= 0), packed to bytes, first dimension first."""
    return np.packbits(vectors >= 0, axis=1)


LEAST_QUERIES = 100  # for which building a shard's tables once more pays


class SegmentIndex:
    """Segment tables of one shard: codes sorted by segment value, found by binary search."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int, segments: int):
        self.codes, self.ids, self.bits = codes, ids, bits
        unpacked = np.unpackbits(codes, axis=1)[:, :bits]
        edges = np.linspace(0, bits, segments + 1).astype(int)
        self.spans = [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for a, b in self.spans:
            values = self.values(unpacked, a, b)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))
        self.words = self._words(codes)

    @staticmethod
    def values(unpacked: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros(len(unpacked), np.int64)
        for k in range(a, b):
            out = out << 1 | unpacked[:, k]
        return out

    @staticmethod
    def _words(codes: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
        padded[:, :codes.shape[1]] = codes
        return padded.view(np.uint64)

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (distance, id) of this shard, ties by id."""
        query = self._words(code[None])[0]
        unpacked = np.unpackbits(code[None], axis=1)[:, :self.bits]
        own = [int(self.values(unpacked, a, b)[0]) for a, b in self.spans]
        met = np.zeros(len(self.codes), bool)
        best_d, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        longest = max(b - a for a, b in self.spans)
        for radius in range(longest + 1):
            for segment, (a, b) in enumerate(self.spans):
                if radius <= b - a:
                    flips = np.array([sum(1 << p for p in c) for c in combinations(range(b - a), radius)], np.int64)
                    values, order = self.tables[segment]
                    probes = own[segment] ^ flips
                    lo, hi = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
                    n = hi - lo
                    if n.any():
                        at = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        at = at[~met[at]]
                        met[at] = True
                        if len(at):
                            d = np.bitwise_count(self.words[at] ^ query).sum(axis=1).astype(np.int64)
                            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, self.ids[at]])
                            keep = np.lexsort((best_i, best_d))[:k]
                            best_d, best_i = best_d[keep], best_i[keep]
                covered = len(self.spans) * radius + segment  # every code up to this distance has been met
                if len(best_d) == min(k, len(self.codes)) and len(best_d) and best_d[-1] <= covered:
                    return best_d, best_i
        return best_d, best_i


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 200_000, block_rows: int = 2_000, segment_bits: int = 14,
) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest codes of each query by Hamming distance, ties by id.

    Codes are the signs of the components.  Exact for every query; a query that
    is a row of ``vectors`` meets itself too.  Null or empty vectors, vectors
    of another dimension than the most frequent one and null ids have no code
    and are left out on both sides.  Repeated rows of ``vectors`` each count; a
    query id is answered once, however often its row occurs, and one with
    several codes has to each row the distance of its nearest code.  Fewer rows
    than ``k`` give all; an empty table gives none.  A shard holds at most about
    ``shard_rows`` codes, a block ``block_rows`` queries.
    """
    ship_code()
    spark = vectors.sparkSession
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    found = vectors.where(usable).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, {id_col} long, distance int"
    if found is None:
        return spark.createDataFrame([], schema)
    bits, total = found["d"], found["count"]
    shards = -(-total // shard_rows)

    def packed(df: DataFrame, groups: int, name: str, dealt: list, collect) -> DataFrame:
        """Rows (group, ids, codes): the codes of a group as one value of bounded size."""
        rows = df.where(usable & (F.size(vector_col) == bits)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        rows = rows.withColumn(name, F.pmod(F.xxhash64(*dealt), F.lit(groups)).cast("int")).mapInArrow(encode(name), f"{name} int, id long, code binary")
        return rows.groupBy(name).agg(F.sort_array(collect(F.struct("id", "code"))).alias(f"{name}_rows"))

    def encode(name: str):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, bits)
                    codes = to_codes(np.nan_to_num(flat, nan=-1.0))
                    yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], [name, "id", "code"])
        return run

    index = packed(vectors, shards, "shard", ["id", F.col("v").getItem(0)], F.collect_list)
    asked = queries.where(usable).count()
    # All codes of a query id meet in one block, each once.
    # So many tasks share a shard's blocks: never more than there are cores for all shards.
    groups = max(1, min(spark.sparkContext.defaultParallelism // shards, -(-asked // LEAST_QUERIES)))
    blocks = packed(queries, max(1, groups, -(-asked // block_rows)), "block", ["id"], F.collect_set)
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.col("block_rows").alias("rows"))
    blocks = blocks.withColumn("slot", F.col("shard") * groups + F.col("block") % groups)
    index = index.select("shard", F.lit(-1).alias("block"), F.col("shard_rows").alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("slot"))
    # A shard's codes come first (block -1), then the blocks that its task answers.
    dealt = index.withColumn("slot", F.col("shard") * groups + F.col("slot")).unionByName(blocks).repartitionByRange(shards * groups, "slot").sortWithinPartitions("slot", "block")

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = -(-bits // 8)

        def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            ids = rows.field("id").to_numpy(zero_copy_only=False)
            return ids, np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(ids), width)

        shard, table = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                if batch.column("block")[n].as_py() < 0:
                    shard = batch.column("shard")[n].as_py()
                    ids, codes = unpack(batch.column("rows")[n].values)
                    segments = max(1, round(bits / min(segment_bits, max(4, int(np.log2(len(ids) + 1))))))
                    table = SegmentIndex(codes, np.arange(len(ids)), bits, segments)  # rows are sorted by id: ties by row are ties by id
                    continue
                if shard != batch.column("shard")[n].as_py():
                    continue  # a shard without codes
                q_out, i_out, d_out = [], [], []
                asked_ids, asked_codes = unpack(batch.column("rows")[n].values)
                starts = np.flatnonzero(np.r_[True, asked_ids[1:] != asked_ids[:-1]])
                for first, end in zip(starts, [*starts[1:], len(asked_ids)], strict=True):
                    found = [table.search(code, k) for code in asked_codes[first:end]]
                    d, row = found[0]
                    if len(found) > 1:
                        d, row = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                        order = np.lexsort((d, row))
                        order = order[np.r_[True, row[order][1:] != row[order][:-1]]]
                        order = order[np.lexsort((row[order], d[order]))][:k]
                        d, row = d[order], row[order]
                    q_out.append(np.full(len(d), asked_ids[first])), i_out.append(ids[row]), d_out.append(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(q_out)), pa.array(np.concatenate(i_out)), pa.array(np.concatenate(d_out).astype(np.int32))], ["query_id", "id", "distance"])

    hits = dealt.mapInArrow(answer, "query_id long, id long, distance int")
    # Each shard has answered a query id once; repeated index rows are reported as often as they occur.
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "distance")
