"""Overlay of two sets of shapes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import RINGS, SpatialDataset
from ..functions import geom
from . import polygons
from .prep import prep
from .spatial_join import TILE, tile_of

HOWS = ("intersection", "union", "difference", "symmetric_difference")


def _candidates(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(a_id, b_id) of shapes with bounds that meet, by tiles."""

    def boxed(df: DataFrame, p: str) -> DataFrame:
        box = geom.bounds(F.col("rings"))
        df = df.select(F.col("shape_id").alias(f"{p}_id"), *(c.alias(f"{p}_{k}") for k, c in box.items()))
        df = df.withColumn(f"{p}_tx", F.explode(F.sequence(tile_of(F.col(f"{p}_minx"), tile), tile_of(F.col(f"{p}_maxx"), tile))))
        return df.withColumn(f"{p}_ty", F.explode(F.sequence(tile_of(F.col(f"{p}_miny"), tile), tile_of(F.col(f"{p}_maxy"), tile))))

    on = "a_tx = b_tx and a_ty = b_ty and a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy"
    return boxed(a, "a").join(boxed(b, "b"), F.expr(on)).select("a_id", "b_id").distinct()


@F.pandas_udf(RINGS)
def _intersect(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([polygons.from_rings(polygons.overlay(polygons.to_rings(p), polygons.to_rings(q), "intersection")) for p, q in zip(a, b)])


@F.pandas_udf(RINGS)
def _subtract(a: pd.Series, others: pd.Series) -> pd.Series:
    out = []
    for p, many in zip(a, others):
        rings = polygons.to_rings(p)
        for q in many if many is not None else []:
            if rings:
                rings = polygons.overlay(rings, polygons.to_rings(q), "difference")
        out.append(polygons.from_rings(rings))
    return pd.Series(out)


def _difference(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(shape_id, rings) of each shape of a without all of b."""
    near = _candidates(a, b, tile).join(b.select(F.col("shape_id").alias("b_id"), "rings"), "b_id").groupBy("a_id").agg(F.collect_list("rings").alias("__others"))
    joined = a.select("shape_id", "rings").join(near, F.col("shape_id") == F.col("a_id"), "left")
    cut = F.when(F.col("__others").isNull(), F.col("rings")).otherwise(_subtract(F.col("rings"), F.col("__others")))
    return joined.select("shape_id", cut.alias("rings"))


def overlay_shapes(a: DataFrame, b: DataFrame, how: str, tile: float = TILE) -> DataFrame:
    """(shape_id, rings) of intersection, union, difference or symmetric_difference.

    Rows are those of a map overlay: a piece for each pair that meets, and for each shape what no shape of the other side
    covers. Ids are the shapes' ids: 'a|b' for pairs, 'a|' and '|b' for the rest. Shapes meet by tile, so work follows the pairs that meet.
    """
    if how not in HOWS:
        raise ValueError(f"how {how!r}; there are {HOWS}")
    parts = []
    if how in ("intersection", "union"):
        pairs = _candidates(a, b, tile).join(a.select(F.col("shape_id").alias("a_id"), F.col("rings").alias("ra")), "a_id").join(b.select(F.col("shape_id").alias("b_id"), F.col("rings").alias("rb")), "b_id")
        parts.append(pairs.select(F.concat_ws("|", "a_id", "b_id").alias("shape_id"), _intersect("ra", "rb").alias("rings")))
    if how != "intersection":
        parts.append(_difference(a, b, tile).withColumn("shape_id", F.concat("shape_id", F.lit("|"))))
    if how in ("union", "symmetric_difference"):
        parts.append(_difference(b, a, tile).withColumn("shape_id", F.concat(F.lit("|"), "shape_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.size("rings") > 0)


def overlay(ds: SpatialDataset, s1: str, s2: str, name: str, how: str = "intersection", instance_map_type: str = "1to1") -> SpatialDataset:
    """The overlay as shapes `name`, indexed like others."""
    ds = ds.with_shapes(name, overlay_shapes(ds.shapes[s1], ds.shapes[s2], how))
    a = ds.attrs
    return prep(ds, a["points_key"], a["feature_key"], a["instance_key"], [*a["shape_keys"], name], {name: instance_map_type})


def outside_mask(shapes: DataFrame, margin: float) -> DataFrame:
    """(shape_id, rings) of one shape: the bounding box, wider by margin, with the shapes as holes of an even-odd area."""
    box = geom.bounds(F.col("rings"))
    b = shapes.agg(F.min(box["minx"]).alias("x0"), F.min(box["miny"]).alias("y0"), F.max(box["maxx"]).alias("x1"), F.max(box["maxy"]).alias("y1")).first()
    x0, y0, x1, y1 = b["x0"] - margin, b["y0"] - margin, b["x1"] + margin, b["y1"] + margin
    frame = geom.ring_of([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    first = shapes.sparkSession.range(1).select(F.lit("outside").alias("shape_id"), F.lit(0).alias("part"), F.array(frame).alias("rings"))
    # One row for each hole: the mask as a whole would be as large as the element.
    holes = shapes.select(F.lit("outside").alias("shape_id"), F.lit(1).alias("part"), F.transform("rings", lambda r: F.reverse(r)).alias("rings"))
    return first.unionByName(holes)
