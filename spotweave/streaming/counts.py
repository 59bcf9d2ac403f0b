"""The count table over a stream of indexed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_points(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of point files (Parquet) that land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_counts(points: DataFrame, instance: str, feature: str) -> DataFrame:
    """(instance, feature, n) as points come; write it in complete or update mode. State is one number for each pair that occurs."""
    return points.filter(F.col(instance).isNotNull()).groupBy(instance, feature).agg(F.count("*").alias("n"))
