"""Shares of a feature's points in each kind of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import SpatialDataset


def compositions(points: DataFrame, instance: str, feature: str, shapes: Sequence[str], groups: Sequence[str] = (), n_cells: Column | None = None) -> DataFrame:
    """Per feature (and group): of each shape key the mean over instances, in which the feature occurs, of the share of its points inside; logcounts and cell_fraction."""
    cells = points.groupBy(*groups, instance, feature).agg(F.count("*").alias("__n"), *(F.count_if(F.col(s).isNotNull()).alias(f"__{s}") for s in shapes))
    total = points.groupBy(*groups).agg(F.count_distinct(instance).alias("__cells"))
    out = cells.groupBy(*groups, feature).agg(*(F.avg(F.col(f"__{s}") / F.col("__n")).alias(s) for s in shapes), F.sum("__n").alias("__sum"), F.count("*").alias("__in"))
    out = out.join(total, list(groups)) if groups else out.join(total)
    return out.select(*groups, feature, *shapes, F.log2(F.col("__sum") + 1).alias("logcounts"), (100 * F.col("__in") / F.col("__cells")).alias("cell_fraction"))


def comp(ds: SpatialDataset, shapes: Sequence[str]) -> SpatialDataset:
    """Table 'comp_stats'."""
    a = ds.attrs
    return ds.with_table("comp_stats", compositions(ds.points[a["points_key"]], a["instance_key"], a["feature_key"], shapes))


def comp_diff(ds: SpatialDataset, shapes: Sequence[str], groupby: str, reference: str, missing: float = 1e-10) -> SpatialDataset:
    """Table 'comp_diff' (feature, group, distance): the 1-D Wasserstein distance between a group's composition, its shares as a sample, and the reference group's.

    Features that a group lacks have `missing` for each share. Samples are of equal size, so the distance is the mean difference of
    the sorted shares.
    """
    a = ds.attrs
    feature = a["feature_key"]
    stats = compositions(ds.points[a["points_key"]], a["instance_key"], feature, shapes, [groupby])
    sample = F.array_sort(F.array(*(F.col(s) for s in shapes))).alias("sample")
    stats = stats.select(F.col(groupby).alias("group"), feature, sample)
    empty = F.array(*(F.lit(missing) for _ in shapes))
    base = stats.filter(F.col("group") == reference).select(feature, F.col("sample").alias("__base"))
    every = stats.select(feature).distinct()
    groups = stats.select("group").distinct().filter(F.col("group") != reference)
    full = every.join(groups).join(stats, [feature, "group"], "left").join(base, feature, "left")
    pairs = F.zip_with(F.coalesce("sample", empty), F.coalesce("__base", empty), lambda p, q: F.abs(p - q))
    return ds.with_table("comp_diff", full.select(feature, "group", (F.aggregate(pairs, F.lit(0.0), lambda t, v: t + v) / len(shapes)).alias("distance")))
