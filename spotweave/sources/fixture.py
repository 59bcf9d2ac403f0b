"""A spatial dataset derived from the tables supplier, lineitem and part: one cell a supplier, one point a line item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import SpatialDataset
from ..operators.prep import colocate, count_table, prep

CELL, NUCLEUS, GENE, POINTS = "cell_boundaries", "nucleus_boundaries", "feature_name", "transcripts"
#: Ring templates, fixed values; each vertex is shifted by (1/256, 1/512), off the points' grid.
CELL_RING = [(8, 1), (42, 1), (50, 9), (50, 41), (42, 49), (8, 49), (1, 41), (1, 9)]
NUCLEUS_RING = [(20, 16), (30, 16), (36, 22), (36, 30), (30, 36), (20, 36), (14, 30), (14, 22)]
SHIFT = (1 / 256, 1 / 512)


def _origin(key: Column) -> tuple[Column, Column]:
    return (key % 32 * 64).cast("double"), (F.floor(key / 32) * 64).cast("double")


def _ring(template: list[tuple[int, int]], key: Column) -> Column:
    ox, oy = _origin(key)
    return F.array(F.array(*(F.struct((ox + F.lit(x + SHIFT[0])).alias("x"), (oy + F.lit(y + SHIFT[1])).alias("y")) for x, y in template)))


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, feature_name). point_id numbers the rows of the file."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_extendedprice")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    ox, oy = _origin(F.col("l_suppkey"))
    x = ox + F.col("l_quantity") + F.col("l_linenumber") / F.lit(8.0)
    y = oy + F.round(F.col("l_extendedprice") * 100).cast("bigint") % 6400 / F.lit(128.0)
    placed = items.select(F.monotonically_increasing_id().alias("point_id"), "l_partkey", x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = placed.join(part, F.col("l_partkey") == F.col("p_partkey")).select("point_id", "x", "y", F.col("p_brand").alias(GENE))
    # The fixture's files are a row group or two; tests against rings are work by row. Larger inputs have splits enough.
    cores = spark.sparkContext.defaultParallelism
    return points.repartition(cores, "point_id") if items.rdd.getNumPartitions() < cores else points


def raw_shapes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    cells = supplier.select(key.cast("string").alias("shape_id"), _ring(CELL_RING, key).alias("rings"), F.when(key % 2 == 0, "A").otherwise("B").alias("phenotype"), F.col("s_acctbal").cast("double").alias("acctbal"), F.col("s_nationkey").cast("string").alias("batch"))
    nuclei = supplier.filter(key % 5 != 0).select(F.concat(F.lit("n"), key.cast("string")).alias("shape_id"), _ring(NUCLEUS_RING, key).alias("rings"))
    return {CELL: cells, NUCLEUS: nuclei}


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("source"), F.col("p_brand").alias("target"), F.lit(1.0).alias("weight")).distinct()


def unindexed(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    return SpatialDataset(points={POINTS: raw_points(spark, sf_dir)}, shapes=raw_shapes(spark, sf_dir))


_indexed: dict[tuple[str, str], SpatialDataset] = {}


def load(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    """The indexed dataset; its elements are kept for the session, as a user who runs several analyses would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexed:
        ds = colocate(prep(unindexed(spark, sf_dir), POINTS, GENE, CELL, [NUCLEUS]))
        ds = ds.with_table("table", count_table(ds.points[POINTS], CELL, GENE))
        _indexed[key] = ds.persist()
    return _indexed[key]
