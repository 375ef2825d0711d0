"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir, ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    Tables written here cut lineage and survive lost executors.  They live as
    long as results read from them may be used; the owner of the checkpoint
    folder clears it, as for reliable RDD checkpoints.
    """
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (reliable lineage cut)."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two needed columns, under fixed names; a null text counts as empty.

    Whatever else the input carries (also columns named like an operator's own)
    is left behind here, so names cannot clash later.
    """
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


HOT_SHARE = 1000


def join_hot(big: DataFrame, unique: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Inner join of ``big`` with rows unique by ``keys`` that say in ``count_col`` how many rows of ``big`` meet them.

    Keys that hold more than 1/``HOT_SHARE`` of those rows are fewer than ``HOT_SHARE`` however large the
    tables are; they are broadcast and their rows stay where they are, all others are joined by a shuffle.
    Both inputs are read twice, so they should be tables.
    """
    total = unique.agg(F.coalesce(F.sum(count_col), F.lit(0))).first()[0]
    hot = unique.where(F.col(count_col) > total // HOT_SHARE + 1)
    names = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(names, keys, "left_anti").join(unique.join(names, keys, "left_anti"), keys))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks.

    Task functions are shipped by value, so module globals would start empty in
    every task; entries here only save repeated work and never change results.
    """
    import sys
    import types

    mod = sys.modules.get("_corpusloom_worker_cache")
    if mod is None:
        mod = sys.modules.setdefault("_corpusloom_worker_cache", types.ModuleType("_corpusloom_worker_cache"))
        mod.store = {}
    return mod.store.setdefault(name, {})


def forget_worker_caches() -> None:
    """Drops what earlier tasks of this Python worker kept: called by operators that need the memory themselves."""
    import sys

    mod = sys.modules.get("_corpusloom_worker_cache")
    if mod is not None:
        for cache in mod.store.values():
            cache.clear()


def file_bytes(path: str, limit: int = 16 << 20) -> bytes:
    """A vocabulary file's bytes for a broadcast; its size is checked against ``limit``."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is larger than the {limit} bytes that may be broadcast")
    return data


def release_memory() -> None:
    """Give memory that Arrow no longer needs back to the system (a worker's pool keeps it otherwise)."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


__all__ = ["ensure_checkpoint_dir", "file_bytes", "forget_worker_caches", "free_name", "id_and_text", "join_hot", "materialise", "release_memory", "shared_folder", "ship_code", "table", "worker_cache"]
