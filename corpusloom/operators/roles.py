"""Roles, routing, data-source switches and scalar tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import col_


def disclaimer(role) -> Column:
    """Patient text vs research text."""
    return F.when(col_(role) == "patient", F.lit(K.DISCLAIMER_PATIENT)).otherwise(F.lit(K.DISCLAIMER_OTHER))


def routing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ROUTING, "route_role string, use_rag boolean, use_ddi boolean")


def route(df: DataFrame, spark: SparkSession, role_col: str = "role",
          default_rag: bool = True, default_ddi: bool = False) -> DataFrame:
    """use_rag / use_ddi flags per role (broadcast literal dimension); unknown role -> defaults."""
    r = F.broadcast(routing_table(spark))
    j = df.join(r, df[role_col] == r["route_role"], "left").drop("route_role")
    return j.withColumns({"use_rag": F.coalesce("use_rag", F.lit(default_rag)),
                          "use_ddi": F.coalesce("use_ddi", F.lit(default_ddi))})


def bmi(height_m, weight_kg) -> Column:
    """Weight / height^2; null when the height is 0 or null."""
    h = F.nullif(col_(height_m).cast("double"), F.lit(0.0))
    return col_(weight_kg).cast("double") / (h * h)


def sources_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.DATA_SOURCES, "kind string, source string, enabled boolean")


def enabled_sources(df: DataFrame, spark: SparkSession, source_col: str = "source") -> DataFrame:
    """Keep records from enabled sources (left-semi join to a literal dimension)."""
    en = F.broadcast(sources_table(spark).filter("enabled").select(F.col("source").alias("_src")))
    return df.join(en, df[source_col] == en["_src"], "left_semi")
