"""Features of shapes; each writes {shape_key}_{name}, all asked for in one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import SpatialDataset
from ..functions import geom
from .polygons import opening_column

EDGES = "__edges"
CX, CY = "__cx", "__cy"


def _edge() -> Column:
    return F.col(EDGES)


def _radius() -> Column:
    return geom.radius(F.col("rings"), F.col(CX), F.col(CY))


def with_geometry(shapes: DataFrame) -> DataFrame:
    """shapes with their edges and centroid as __edges, __cx and __cy."""
    g = F.col("__geometry")
    shapes = shapes.withColumn("__geometry", geom.edges_and_centroid(F.col("rings")))
    return shapes.withColumns({EDGES: g["edges"], CX: g["cx"], CY: g["cy"]}).drop("__geometry")


def grids(shapes: DataFrame, step: float) -> DataFrame:
    """(shape_id, __edges, __cx, __cy, __xs, __ys, __empty): the grid over the bounds of each shape, and whether the shape holds none of its points."""
    b = geom.bounds(F.col("rings"))
    base = with_geometry(shapes.select("shape_id", "rings")).select("shape_id", EDGES, CX, CY, geom.grid(b["minx"], b["maxx"], step).alias("__xs"), geom.grid(b["miny"], b["maxy"], step).alias("__ys"))
    held = F.exists("__xs", lambda x: F.exists("__ys", lambda y: geom.inside(_edge(), x, y)))
    return base.withColumn("__empty", ~F.coalesce(held, F.lit(False)))


def raster(shapes: DataFrame, step: float = 1.0) -> DataFrame:
    """(shape_id, x, y): grid points inside each shape, from int(minimum) on; the centroid if there is none.

    Exploded in two steps, x and then y, so a task holds one column of the grid at a time.
    """
    base = grids(shapes, step)
    cells = base.filter(~F.col("__empty")).withColumn("x", F.explode("__xs")).withColumn("y", F.explode("__ys"))
    found = cells.filter(geom.inside(_edge(), F.col("x"), F.col("y"))).select("shape_id", "x", "y")
    return found.unionByName(base.filter("__empty").select("shape_id", F.col(CX).alias("x"), F.col(CY).alias("y")))


def raster_points(ds: SpatialDataset, key: str, step: float = 1.0) -> SpatialDataset:
    """The raster of the shapes as points `{key}_raster` (x, y, key)."""
    return ds.with_points(f"{key}_raster", raster(ds.shapes[key], step).withColumnRenamed("shape_id", key))


def _merged(shapes: DataFrame, values: DataFrame) -> DataFrame:
    return shapes.join(values, "shape_id", "left")


def _second_moment(ds: SpatialDataset, key: str, shapes: DataFrame) -> DataFrame:
    centre = with_geometry(shapes.select("shape_id", "rings")).select("shape_id", CX, CY)
    d2 = (F.col("x") - F.col(CX)) ** 2 + (F.col("y") - F.col(CY)) ** 2
    return _merged(shapes, raster(shapes).join(centre, "shape_id").groupBy("shape_id").agg(F.avg(d2).alias(f"{key}_moment")))


def _density(ds: SpatialDataset, key: str, shapes: DataFrame) -> DataFrame:
    points = ds.points[ds.attrs["points_key"]]
    n = points.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("shape_id")).agg(F.count("*").alias("__n"))
    area = geom.area(geom.edges(F.col("rings")))
    return _merged(shapes, n).withColumn(f"{key}_density", F.try_divide(F.col("__n").cast("double"), area)).drop("__n")


def opening(ds: SpatialDataset, key: str, proportion: float) -> SpatialDataset:
    """{key}_open_{proportion}_shape: the rings of the shape eroded and dilated by proportion times its radius."""
    shapes = with_geometry(ds.shapes[key])
    rings = opening_column(F.col("rings"), proportion * _radius())
    return ds.with_shapes(key, shapes.withColumn(f"{key}_open_{proportion}_shape", rings).drop(EDGES, CX, CY))


#: Columns as expressions over rings, __edges, __cx and __cy; or functions of (dataset, key, shapes) that join a result.
Expressions = Callable[[], dict[str, Column]]
_EXPRESSIONS: dict[str, Expressions] = {
    "area": lambda: {"area": geom.area(_edge())},
    "aspect_ratio": lambda: {"aspect_ratio": geom.aspect_ratio(F.col("rings"))},
    "bounds": lambda: geom.bounds(F.col("rings")),
    "perimeter": lambda: {"perimeter": geom.perimeter(_edge())},
    "radius": lambda: {"radius": _radius()},
    "span": lambda: {"span": geom.span(F.col("rings"))},
    "centroid": lambda: {"centroid_x": F.col(CX), "centroid_y": F.col(CY)},
}
_JOINED: dict[str, Callable[[SpatialDataset, str, DataFrame], DataFrame]] = {"density": _density, "second_moment": _second_moment}
_DATASET: dict[str, Callable[..., SpatialDataset]] = {"opening": opening, "raster": raster_points}
_COLUMN = {"second_moment": "moment"}
_DOC = {
    "area": "area", "aspect_ratio": "long to short side of the smallest rotated rectangle", "bounds": "minx, miny, maxx, maxy", "centroid": "area centroid",
    "density": "points to area", "opening": "eroded and dilated shape", "perimeter": "length of the border", "radius": "mean distance of vertices from the centroid",
    "raster": "grid points inside", "second_moment": "mean squared distance of grid points from the centroid", "span": "greatest distance of vertices, as an integer",
}


def list_shape_features() -> dict[str, str]:
    return dict(_DOC)


def register_shape_feature(name: str, feature: Expressions | Callable[[SpatialDataset, str, DataFrame], DataFrame], joined: bool = False, doc: str = "") -> None:
    """Add a feature: a function that returns columns over rings, __edges, __cx, __cy; or, joined, one from (dataset, key, shapes) to shapes."""
    (_JOINED if joined else _EXPRESSIONS)[name] = feature
    _DOC[name] = doc


def analyze_shapes(ds: SpatialDataset, shape_keys: str | Sequence[str], feature_names: str | Sequence[str], feature_kws: dict[str, dict] | None = None, recompute: bool = False) -> SpatialDataset:
    """Features x shapes. Expressions of one shape element go into a single projection; columns that are there stay unless recompute."""
    shape_keys = [shape_keys] if isinstance(shape_keys, str) else list(shape_keys)
    names = [feature_names] if isinstance(feature_names, str) else list(feature_names)
    if unknown := [n for n in names if n not in _DOC]:
        raise KeyError(f"no shape features {unknown}")
    for key in shape_keys:
        shapes = ds.shapes[key]
        new: dict[str, Column] = {}
        for name in names:
            if name in _EXPRESSIONS:
                for column, value in _EXPRESSIONS[name]().items():
                    if recompute or f"{key}_{column}" not in shapes.columns:
                        new[f"{key}_{column}"] = value
        if new:
            shapes = with_geometry(shapes).withColumns(new).drop(EDGES, CX, CY)
        for name in names:
            column = f"{key}_{_COLUMN.get(name, name)}"
            if name in _JOINED and (recompute or column not in shapes.columns):
                shapes = _JOINED[name](ds, key, shapes.drop(column))
        ds = ds.with_shapes(key, shapes)
        for name in names:
            if name in _DATASET:
                ds = _DATASET[name](ds, key, **(feature_kws or {}).get(name, {}))
    return ds


def shape_stats(ds: SpatialDataset) -> SpatialDataset:
    """area, aspect_ratio and density of the instances, and of nuclei if there are any."""
    keys = [ds.attrs["instance_key"], *(k for k in ds.attrs["shape_keys"] if k == "nucleus_boundaries")]
    return analyze_shapes(ds, keys, ["area", "aspect_ratio", "density"])
