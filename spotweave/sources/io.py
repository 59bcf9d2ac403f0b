"""Datasets as folders of Parquet tables, and gene sets from CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import SpatialDataset

GENE_SET_SCHEMA = "source string, target string, weight double"


def write_dataset(ds: SpatialDataset, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Points go into `bucket` folders by a hash of the instance, so that a cell's points lie together and readers prune."""
    instance = ds.attrs.get("instance_key")
    for key, df in ds.points.items():
        if instance in df.columns:
            df = df.withColumn("bucket", F.pmod(F.xxhash64(instance), F.lit(buckets)).cast("int"))
            df.repartition(buckets, "bucket").sortWithinPartitions(instance).write.mode(mode).partitionBy("bucket").parquet(f"{path}/points/{key}")
        else:
            df.write.mode(mode).parquet(f"{path}/points/{key}")
    for kind, items in (("shapes", ds.shapes), ("tables", ds.tables)):
        for key, df in items.items():
            df.write.mode(mode).parquet(f"{path}/{kind}/{key}")
    names = {"points": list(ds.points), "shapes": list(ds.shapes), "tables": list(ds.tables), "attrs": dict(ds.attrs)}
    spark = next(iter((*ds.points.values(), *ds.shapes.values()))).sparkSession
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_dataset(spark: SparkSession, path: str) -> SpatialDataset:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    load = lambda kind: {k: spark.read.parquet(f"{path}/{kind}/{k}").drop("bucket") for k in meta[kind]}
    return SpatialDataset(load("points"), load("shapes"), load("tables"), meta["attrs"])


def read_gene_sets(spark: SparkSession, files: dict[str, str], name: str) -> DataFrame:
    """(source, target, weight) of the named file; a missing weight is 1. KeyError for an unknown name."""
    if name not in files:
        raise KeyError(f"gene set {name!r}; there are {sorted(files)}")
    df = spark.read.csv(files[name], header=True, inferSchema=False)
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    return df.select("source", "target", F.coalesce(weight, F.lit(1.0)).alias("weight"))
