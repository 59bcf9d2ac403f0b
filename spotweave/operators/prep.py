"""Indexing of a dataset, count table, accessors, filters and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dataset import SpatialDataset
from .spatial_join import TILE, map_shapes, merge_children, points_in_shapes


def unique_ids(shapes: DataFrame) -> DataFrame:
    """String ids; the second and later rows of one id get a suffix _1, _2 ..."""
    shapes = shapes.withColumn("shape_id", F.col("shape_id").cast("string"))
    order = Window.partitionBy("shape_id").orderBy(F.hash("rings"))
    n = F.row_number().over(order) - 1
    return shapes.withColumn("__n", n).withColumn("shape_id", F.when(F.col("__n") == 0, F.col("shape_id")).otherwise(F.concat_ws("_", "shape_id", "__n"))).drop("__n")


def count_table(points: DataFrame, instance_key: str, feature_key: str) -> DataFrame:
    """(instance, feature, n) of the pairs that occur."""
    return points.groupBy(instance_key, feature_key).agg(F.count("*").alias("n"))


def dense_counts(table: DataFrame, instance_key: str, feature_key: str) -> DataFrame:
    """All pairs of an instance and a feature that occur at all, with n = 0 where a pair does not."""
    # A product of two dimension lists, as wide as the dense matrix that is asked for.
    pairs = table.select(instance_key).distinct().join(table.select(feature_key).distinct())
    return pairs.join(table, [instance_key, feature_key], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def count_matrix(table: DataFrame, instance_key: str, feature_key: str, features: Sequence[str]) -> DataFrame:
    """Wide view: a row for each instance and a column for each of the given features."""
    return table.groupBy(instance_key).pivot(feature_key, list(features)).agg(F.sum("n")).fillna(0, list(features))


def transform_points(points: DataFrame, scale: tuple[float, float] = (1.0, 1.0), translate: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    return points.withColumn("x", F.col("x") * scale[0] + translate[0]).withColumn("y", F.col("y") * scale[1] + translate[1])


def prep(ds: SpatialDataset, points_key: str, feature_key: str, instance_key: str, shape_keys: Sequence[str], instance_map_type: str | dict[str, str] = "1to1", tile: float = TILE) -> SpatialDataset:
    """Index points and shapes and count: shapes get the instance that covers them, instances their shape, points the shapes that hold them.

    Points of no instance are dropped. Only columns that are not there yet are joined. instance_map_type may name a
    type for each shape key. tables["table"] is the count table.
    """
    if points_key not in ds.points or instance_key not in ds.shapes:
        raise KeyError(f"no points {points_key!r} or shapes {instance_key!r}")
    others = [k for k in dict.fromkeys(shape_keys) if k != instance_key]
    shapes = {k: unique_ids(ds.shapes[k]) for k in (instance_key, *others)}
    for k in others:
        if instance_key in shapes[k].columns:
            continue
        mode = instance_map_type.get(k, "1to1") if isinstance(instance_map_type, dict) else instance_map_type
        up, down = map_shapes(shapes[instance_key], shapes[k], mode, tile)
        if mode == "1tomany":
            shapes[k] = merge_children(shapes[k], up).withColumnRenamed("parent", instance_key)
            links = shapes[k].select(F.col(instance_key).alias("__parent"), F.col("shape_id").alias(k))
        else:
            shapes[k] = shapes[k].join(up.withColumnRenamed("child", "shape_id").withColumnRenamed("parent", instance_key), "shape_id", "left")
            links = down.select(F.col("parent").alias("__parent"), F.col("child").alias(k))
        shapes[instance_key] = shapes[instance_key].join(links, F.col("shape_id") == F.col("__parent"), "left").drop("__parent")
    points = ds.points[points_key]
    if "point_id" not in points.columns:
        points = points.withColumn("point_id", F.monotonically_increasing_id())
    for k in (instance_key, *others):
        if k not in points.columns:
            points = points_in_shapes(points, shapes[k], k, tile)
            if k == instance_key:
                points = points.filter(F.col(k).isNotNull())
    out = SpatialDataset({**ds.points, points_key: points}, {**ds.shapes, **shapes}, ds.tables, ds.attrs)
    out = out.with_table("table", count_table(points, instance_key, feature_key))
    return out.with_attrs(points_key=points_key, feature_key=feature_key, instance_key=instance_key, shape_keys=[instance_key, *others])


def colocate(ds: SpatialDataset, partitions: int | None = None) -> SpatialDataset:
    """Points dealt to partitions by their instance, once: groups and self-joins by instance then need no shuffle.

    The number is explicit, so that adaptive execution does not merge partitions that are small in bytes but make many pairs.
    """
    key, instance = ds.attrs["points_key"], ds.attrs["instance_key"]
    spark = ds.points[key].sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return ds.with_points(key, ds.points[key].repartition(n, instance))


# Accessors -------------------------------------------------------------------------------------------------------------


def get_points(ds: SpatialDataset, key: str, astype: str = "spark", sync: bool = True):
    """The points; with sync only those of an instance. astype 'pandas' collects them."""
    if key not in ds.points:
        raise ValueError(f"no points {key!r}")
    df = sync_points(ds, key).points[key] if sync else ds.points[key]
    if astype == "spark":
        return df
    if astype == "pandas":
        return df.toPandas()
    raise ValueError(f"astype {astype!r}; there are 'spark' and 'pandas'")


def get_shape(ds: SpatialDataset, key: str, sync: bool = True) -> DataFrame:
    """(shape_id, rings); with sync, of other shapes than instances only those of an instance."""
    if key not in ds.shapes:
        raise ValueError(f"no shapes {key!r}")
    df, instance = ds.shapes[key], get_instance_key(ds)
    if sync and key != instance:
        df = df.filter(F.col(instance).isNotNull())
    return df.select("shape_id", "rings")


def _columns(df: DataFrame, keys: str | Sequence[str], first: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return df.select(first, *keys)


def get_points_metadata(ds: SpatialDataset, key: str, columns: str | Sequence[str]) -> DataFrame:
    return _columns(get_points(ds, key, sync=False), columns, "point_id")


def get_shape_metadata(ds: SpatialDataset, key: str, columns: str | Sequence[str]) -> DataFrame:
    if key not in ds.shapes:
        raise ValueError(f"no shapes {key!r}")
    return _columns(ds.shapes[key], columns, "shape_id")


def _attach(df: DataFrame, values: DataFrame, by: str) -> DataFrame:
    new = [c for c in values.columns if c != by]
    return df.drop(*new).join(values, by, "left")


def set_points_metadata(ds: SpatialDataset, key: str, values: DataFrame) -> SpatialDataset:
    """Attach the columns of values (point_id, ...) by point_id; points without a row get NULL."""
    return ds.with_points(key, _attach(get_points(ds, key, sync=False), values, "point_id"))


def set_shape_metadata(ds: SpatialDataset, key: str, values: DataFrame) -> SpatialDataset:
    """Attach the columns of values (shape_id, ...) by shape_id; shapes without a row get NULL."""
    if key not in ds.shapes:
        raise ValueError(f"no shapes {key!r}")
    return ds.with_shapes(key, _attach(ds.shapes[key], values, "shape_id"))


def get_instance_key(ds: SpatialDataset) -> str:
    return ds.attrs["instance_key"]


def get_feature_key(ds: SpatialDataset) -> str:
    return ds.attrs["feature_key"]


def sync_points(ds: SpatialDataset, key: str) -> SpatialDataset:
    """Only points whose instance is one of the shapes."""
    instance = get_instance_key(ds)
    ids = ds.shapes[instance].select(F.col("shape_id").alias(instance))
    return ds.with_points(key, ds.points[key].join(ids, instance, "left_semi"))


def sync_shapes(ds: SpatialDataset, key: str) -> SpatialDataset:
    """Only shapes whose instance is one of the instance shapes."""
    instance = get_instance_key(ds)
    ids = ds.shapes[instance].select(F.col("shape_id").alias(instance))
    return ds if key == instance else ds.with_shapes(key, ds.shapes[key].join(ids, instance, "left_semi"))


def filter_by_gene(ds: SpatialDataset, min_count: int = 10) -> SpatialDataset:
    """Keep features that reach min_count in some instance, in the points and in the table."""
    a = ds.attrs
    feature = a["feature_key"]
    kept = ds.tables["table"].groupBy(feature).agg(F.max("n").alias("n")).filter(F.col("n") >= min_count).select(feature)
    ds = ds.with_points(a["points_key"], ds.points[a["points_key"]].join(kept, feature, "left_semi"))
    return ds.with_table("table", ds.tables["table"].join(kept, feature, "left_semi"))


def bounding_box(ds: SpatialDataset, minx: float, miny: float, maxx: float, maxy: float) -> SpatialDataset:
    """Points in the box, and shapes whose bounds meet it."""
    from ..functions import geom

    points = {k: p.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy)) for k, p in ds.points.items()}
    b = geom.bounds(F.col("rings"))
    meets = (b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny)
    return SpatialDataset(points, {k: s.filter(meets) for k, s in ds.shapes.items()}, ds.tables, ds.attrs)


def with_shape_columns(points: DataFrame, shapes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """points with columns of the shape that their id column `key` names, NULL where there is none; names that clash get the key in front."""
    named = {c: c if c not in points.columns else f"{key}_{c}" for c in columns}
    side = shapes.select(F.col("shape_id").alias("__id"), *(F.col(c).alias(n) for c, n in named.items()))
    return points.join(side, F.col(key) == F.col("__id"), "left").drop("__id")


def to_api(df: DataFrame) -> DataFrame:
    """Strings with '' for a missing id, as tools that know no NULL want them."""
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
