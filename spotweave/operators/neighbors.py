"""Counts of features in the neighbourhood of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial_join import nearest, radius_pairs


def neighbor_pairs(points: DataFrame, key: str, feature: str, n_neighbors: int | None = None, radius: float | None = None, queries: DataFrame | None = None, query_id: str = "point_id") -> DataFrame:
    """(query_id, q_<feature> if queries have it, feature, ...) by k nearest or by radius; exactly one of them is given."""
    if (n_neighbors is None) == (radius is None):
        raise ValueError("give one of n_neighbors and radius")
    if n_neighbors is not None:
        return nearest(points, key, n_neighbors, [feature], queries, query_id)
    return radius_pairs(points, key, radius, [feature], queries, query_id)


def count_neighbors(points: DataFrame, key: str, feature: str, n_neighbors: int | None = None, radius: float | None = None, queries: DataFrame | None = None, query_id: str = "point_id", agg: str | None = None) -> DataFrame:
    """Neighbours by feature. A point is its own neighbour.

    agg None: (key, query_id, feature, n); 'binary': n is 1 where there are any; 'feature': (key, source, neighbor, n), the
    neighbours of the first point (by x, y, point_id) of each feature of the key.
    """
    if agg not in (None, "binary", "feature"):
        raise ValueError(f"agg {agg!r}; there are None, 'binary' and 'feature'")
    if agg == "feature":
        first = Window.partitionBy(key, feature).orderBy("x", "y", "point_id")
        queries = points.withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
        pairs = neighbor_pairs(points, key, feature, n_neighbors, radius, queries, "point_id")
        return pairs.groupBy(key, F.col(f"q_{feature}").alias("source"), F.col(feature).alias("neighbor")).agg(F.count("*").alias("n"))
    pairs = neighbor_pairs(points, key, feature, n_neighbors, radius, queries, query_id)
    if agg == "binary":
        return pairs.select(key, "query_id", feature).distinct().withColumn("n", F.lit(1).cast("long"))
    return pairs.groupBy(key, "query_id", feature).agg(F.count("*").alias("n"))
