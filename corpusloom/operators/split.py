"""Splits, samples and limits.  Every draw is a hash of (seed, key), so the
result does not depend on partitioning, retries or executor loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import hash_uniform
from ..session import cut_lineage, free_name, row_hash


def split_random(df: DataFrame, key: str = "id", ratios=K.SPLIT_RATIOS, seed: int = K.SEED,
                 out: str = "split") -> DataFrame:
    """One uniform draw per record; x<r0 train, x<r0+r1 val, else test."""
    r0, r1 = float(ratios[0]), float(ratios[0]) + float(ratios[1])
    x = hash_uniform(key, seed)
    return df.withColumn(out, F.when(x < F.lit(r0), "train").when(x < F.lit(r1), "val").otherwise("test"))


def _join_null_safe(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where null equals null; AQE broadcasts the table when it is small."""
    renamed = table.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    on = [df[k].eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(renamed, cond, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def split_stratified(df: DataFrame, strata, key: str = "id", ratios=K.SPLIT_RATIOS,
                     seed: int = K.SEED, out: str = "split", max_bucket_rows: int = 1_000_000) -> DataFrame:
    """The same ratios inside every stratum, with exact quotas.

    Records are ranked by their hash draw inside the stratum; the first
    floor(r0*n) go to train, the next floor((r0+r1)*n) - floor(r0*n) to val.
    The rank is computed without sorting a whole stratum in one task: each
    stratum is cut into draw-range buckets of about ``max_bucket_rows`` records
    (draws are uniform), bucket counts give the rank offset, and the sort runs
    per (stratum, bucket).  A null stratum is a stratum of its own.
    """
    strata = [strata] if isinstance(strata, str) else list(strata)
    r0, r1 = float(ratios[0]), float(ratios[0]) + float(ratios[1])
    d = df.withColumn("_u", hash_uniform(key, seed))
    counts = d.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(max_bucket_rows))))
    d = _join_null_safe(d, counts, strata)
    d = d.withColumn("_b", F.floor(F.col("_u") * F.col("_nb")).cast("long"))
    bc = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*strata).orderBy("_b")
    bc = bc.withColumn("_before", F.coalesce(F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0))).drop("_bn")
    d = _join_null_safe(d, bc, strata + ["_b"])
    w = Window.partitionBy(*strata, "_b").orderBy("_u", key)
    rn = F.col("_before") + F.row_number().over(w)
    return (d.withColumn("_rn", rn)
             .withColumn(out, F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(r0)), "train")
                               .when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(r1)), "val")
                               .otherwise("test"))
             .drop("_u", "_n", "_nb", "_b", "_before", "_rn"))


SMALL_TOP = 100_000


def first_n_by(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """Exactly the first n rows in ascending order of ``order_cols`` (all rows when there are fewer).

    Nulls sort first.  Rows with equal keys are told apart by a hash of the
    whole row, so a tie at the cut-off is cut as well; identical rows are
    interchangeable.  Only the keys are ranked: the cut-off key is found by a
    top-n (small n) or by counting range partitions of the keys, and applied
    as a filter where the rows already are.
    """
    if n <= 0:
        return df.limit(0)
    key = free_name(df.columns, "_k")
    keyed = df.withColumn(key, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)], row_hash(df).alias("row")))
    last, same = _cut_off(keyed.select(F.col(key).alias("_k")), n)
    if last is None:                         # fewer than n rows
        return df
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(keyed.schema[key].dataType.fields, last, strict=True)])
    # Rows equal to the cut-off in key and hash: only as many as still fit (identical rows but for hash accidents).
    below = keyed.where(F.col(key) < at)
    return below.unionByName(keyed.where(F.col(key) == at).limit(same)).drop(key)


def _cut_off(keys: DataFrame, n: int):
    """(n-th smallest key, how many rows of that key belong to the first n); (None, 0) with fewer than n rows."""
    spark = keys.sparkSession
    if n <= SMALL_TOP:
        top = keys.orderBy("_k").limit(n)
        row = top.agg(F.max("_k").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if row["n"] < n:
            return None, 0
        pool, before = keys, 0
        last = row["last"]
    else:
        # Range partitions of the keys are counted; only the one that holds the n-th key is looked into.
        ranged = cut_lineage(keys.repartitionByRange("_k").select("_k", F.spark_partition_id().alias("_p")))
        before = 0
        for part in ranged.groupBy("_p").count().orderBy("_p").collect():
            if before + part["count"] >= n:
                pool = ranged.where(F.col("_p") == part["_p"]).select("_k")
                last = pool.orderBy("_k").limit(n - before).agg(F.max("_k").alias("last")).first()["last"]
                break
            before += part["count"]
        else:
            return None, 0
    schema = pool.schema["_k"].dataType
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields, last, strict=True)])
    return last, n - before - pool.where(F.col("_k") < at).count()


def sample_shuffled(df: DataFrame, n: int, key: str = "id", seed: int = K.SEED) -> DataFrame:
    """At most n records in a seeded random order (hash draw; only keys are ranked), returned in that order."""
    draw = free_name(df.columns, "_draw")
    d = df.withColumn(draw, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    return first_n_by(d, [draw, key], n).orderBy(draw, key).drop(draw)


def limit_rows(df: DataFrame, n: int | None, order_by: str = "id") -> DataFrame:
    """First n records in key order; 0/None keeps all."""
    if not n:
        return df
    return first_n_by(df, [order_by], n)


def write_splits(df: DataFrame, path: str, fmt: str = "json", split_col: str = "split") -> None:
    """One output folder per split value."""
    (df.write.mode("overwrite").partitionBy(split_col).format(fmt)
       .option("ignoreNullFields", "false").save(path))
