"""Deterministic hash-based draws and ids (stable under any partitioning)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def hash_uniform(key, seed: int) -> Column:
    """Uniform [0,1) draw from md5(seed ':' key): first 32 bits / 2^32.

    The same value comes out of any engine with md5, so splits are reproducible
    and independent of partitioning (unlike rand(seed)).
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string"))), 1, 8), 16, 10)
    return h.cast("bigint").cast("double") / F.lit(4294967296.0)


def mint_id(prefix: str, *key_cols) -> Column:
    """Prefixed record id from the natural key: prefix_<16 hex of md5>."""
    natural = F.concat_ws("\u0001", *[col_(c).cast("string") for c in key_cols])
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(natural), 1, 16))


def hex7_int(c) -> Column:
    """First 7 hex digits of md5 as a non-negative integer (< 2^28)."""
    return F.conv(F.substring(F.md5(col_(c)), 1, 7), 16, 10).cast("bigint")
