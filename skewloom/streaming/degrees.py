"""Degrees of a growing edge table, as a streaming aggregate with state in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Edges ``src dst`` from Parquet files that arrive in a folder."""
    return spark.readStream.schema("src long, dst long").parquet(folder)


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id degree`` so far; write it in ``update`` or ``complete`` mode."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
