"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricway.session import released, written

#: Rows up to which a side whose number of rows is known is broadcast.
SMALL_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow side of `rows` rows when that is a proven small number; else leave it to Spark."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


__all__ = ["SMALL_ROWS", "released", "small", "table", "utf8_bytes", "written"]
