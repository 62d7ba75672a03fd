"""Parquet tables of one data folder, read with only the columns a plan names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table. ``columns`` narrows it, which also fixes the scan's ReadSchema."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
