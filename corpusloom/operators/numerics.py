"""Volume numerics on a long voxel table (volume keys, x, y, z, v).

Images are re-aimed to rows so slices, percentiles and composites are joins,
aggregates and small windows.  Per-volume statistics are computed with
``groupBy`` and joined back (no window over a whole volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import HOT_SHARE, broadcast_if_small, cut_lineage

EPS = 1e-6


def _join_groups(df: DataFrame, per_group: DataFrame, keys: list[str], wide: int = 1_000_000) -> DataFrame:
    """Rows with the values of their group; a null key is a group like any other.

    Groups are few against rows: broadcast when their number allows.  Otherwise groups that hold more than
    1/``HOT_SHARE`` of all rows, which are fewer than ``HOT_SHARE``, are broadcast and their rows stay where they
    are; all others are joined by a shuffle in which a row and a group move once.
    """
    per_group = cut_lineage(per_group)          # counted, then joined
    right = per_group.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in per_group.columns if c not in keys])
    drop = [f"_g_{k}" for k in keys]

    def same(left: str, other: str):
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"{left}{k}").eqNullSafe(F.col(f"{other}{k}"))
        return cond

    if per_group.count() <= wide:
        return df.join(F.broadcast(right), same("", "_g_")).drop(*drop)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut_lineage(sizes.where(F.col("_rows") > df.count() // HOT_SHARE + 1).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    names = F.broadcast(hot)
    of_hot = F.broadcast(right.join(names, same("_g_", "_h_"), "left_semi"))
    rest = df.join(names, same("", "_h_"), "left_anti").join(right, same("", "_g_"))
    return df.join(of_hot, same("", "_g_")).unionByName(rest).drop(*drop)


def center_slice(vox: DataFrame, keys=("subject", "modality"), z: str = "z") -> DataFrame:
    """Per volume keep z == floor(nz / 2) with nz = max(z) + 1."""
    keys = list(keys)
    nz = vox.groupBy(*keys).agg((F.max(z) + 1).alias("_nz"))
    j = _join_groups(vox, nz, keys)
    return j.filter(F.col(z) == F.floor(F.col("_nz") / 2)).drop("_nz")


def exact_percentiles(df: DataFrame, keys, v: str, probs) -> DataFrame:
    """Exact linear-interpolated percentiles per group without holding a group in one task.

    Values are range-partitioned on (keys, v), so a group holding a third of
    all rows is spread over many tasks; each row's rank in its group is the
    group's row count in earlier partitions plus its offset inside its own
    partition (consecutive ids after a per-partition sort).  Only the rows at
    the needed ranks are kept.  The ranked table is checkpointed so the
    sampled range bounds and ids stay fixed.  Returns keys + p0, p1, ...
    """
    keys = list(keys)
    s = (df.select(*keys, F.col(v).cast("double").alias("_v"))
           .repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")
           .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    cnt = s.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_pid")
    cnt = cnt.withColumns({
        "_off": F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum("_c").over(Window.partitionBy(*keys)),
    }).drop("_c")
    # A partition holds few groups: joined by partition and null-safe keys.
    small = broadcast_if_small(cnt.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_pid").alias("_gp"), "_m0", "_off", "_n"))
    same = F.col("_pid") == F.col("_gp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    r = s.join(small, same).drop("_gp", *[f"_g_{k}" for k in keys]).withColumn("_rank", F.col("_off") + F.col("_mid") - F.col("_m0"))
    wanted = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        r = r.withColumns({f"_lo{i}": F.floor(pos), f"_hi{i}": F.ceil(pos)})
        wanted += [F.col("_rank") == F.col(f"_lo{i}"), F.col("_rank") == F.col(f"_hi{i}")]
    cond = wanted[0]
    for c in wanted[1:]:
        cond = cond | c
    picked = r.filter(cond)
    aggs = []
    for i, p in enumerate(probs):
        aggs += [F.max(F.when(F.col("_rank") == F.col(f"_lo{i}"), F.col("_v"))).alias(f"_vl{i}"),
                 F.max(F.when(F.col("_rank") == F.col(f"_hi{i}"), F.col("_v"))).alias(f"_vh{i}"),
                 F.first(F.lit(float(p)) * (F.col("_n") - 1)).alias(f"_pos{i}")]
    g = picked.groupBy(*keys).agg(*aggs)
    outs = []
    for i in range(len(probs)):
        lo, hi, pos = F.col(f"_vl{i}"), F.col(f"_vh{i}"), F.col(f"_pos{i}")
        fl, ce = F.floor(pos), F.ceil(pos)
        outs.append(F.when(fl == ce, lo).otherwise((ce - pos) * lo + (pos - fl) * hi).alias(f"p{i}"))
    return g.select(*keys, *outs)


def robust_scale(vox: DataFrame, keys=("subject", "modality"), v: str = "v", lo: float = 0.01, hi: float = 0.99,
                 out: str = "u8") -> DataFrame:
    """clip((v - p1) / (p99 - p1 + 1e-6), 0, 1) * 255 truncated, per group, with exact
    linear-interpolated percentiles (see ``exact_percentiles``) joined back."""
    keys = list(keys)
    pct = exact_percentiles(vox, keys, v, [lo, hi]).withColumnRenamed("p0", "_p1").withColumnRenamed("p1", "_p99")
    j = _join_groups(vox, pct, keys)
    scaled = (F.col(v).cast("double") - F.col("_p1")) / (F.col("_p99") - F.col("_p1") + F.lit(EPS))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))
    return j.withColumn(out, (clipped * 255).cast("int")).drop("_p1", "_p99")


def composite_offsets(slices: DataFrame, subject: str = "subject", order: str = "modality_pos",
                      width: str = "width", height: str = "height") -> DataFrame:
    """Side-by-side composite: every slice cropped to the subject's minimum height,
    x offset = total width of the slices before it.  Window per subject (a handful of rows)."""
    w = Window.partitionBy(subject).orderBy(order)
    return slices.withColumns({
        "x_offset": F.coalesce(F.sum(width).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "crop_height": F.min(height).over(Window.partitionBy(subject)),
    })
