"""The input tables and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; zone-less times become instants, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df
