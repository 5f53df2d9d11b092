"""Readers of the input tables and the views over them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per environment: env_id, the frame that holds it, and its feature vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("env_id"),
        F.col("label").cast("long").alias("frame_id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
