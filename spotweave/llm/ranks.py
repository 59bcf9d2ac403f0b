"""Gapless ranks inside groups that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_ROWS = 1 << 17


def gapless_rank(df: DataFrame, key: str, row_id: str, largest: int, out: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each key 0, 1, 2 ... in an order that a hash of row_id decides.

    Each key is cut into buckets by the hash, of about bucket_rows rows for the largest key, and only a bucket
    is sorted in one task. A table of bucket sizes (one row for each key and bucket) gives each bucket its
    first number. row_id must be unique and stable (see scratch.materialize).
    """
    buckets = max(1, -(-largest // bucket_rows))
    chaos: Column = F.xxhash64(F.col(row_id), F.lit(seed))
    df = df.withColumn("__bucket", F.pmod(chaos, F.lit(buckets)).cast("int"))
    sizes = df.groupBy(key, "__bucket").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(key, "__bucket").orderBy(F.xxhash64(F.col(row_id), F.lit(seed + 1)), row_id)
    ranked = df.withColumn("__inside", F.row_number().over(inside) - 1)
    return ranked.join(sizes, [key, "__bucket"]).withColumn(out, F.col("__first") + F.col("__inside")).drop("__bucket", "__first", "__inside")
