"""Spatial statistics of the points of an instance and a group; everything asked for is one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import SpatialDataset
from ..functions import geom
from .shape_features import CX, CY, EDGES, analyze_shapes, raster, with_geometry


@dataclass(frozen=True)
class Context:
    """Columns that features may use, for one shape key."""

    shape: str
    instance: str

    @property
    def x(self) -> Column:
        return F.col("x")

    @property
    def y(self) -> Column:
        return F.col("y")

    @property
    def inner(self) -> Column:
        """Whether the point is in any shape of the key; all points are in the instance."""
        return F.lit(True) if self.shape == self.instance else F.col(self.shape).isNotNull()

    @property
    def radius(self) -> Column:
        return F.col(f"{self.instance}_radius")

    def boundary(self) -> Column:
        return F.col(f"__{self.shape}_boundary")

    def centre(self) -> Column:
        """Distance of the point from the shape's centroid."""
        return geom.distance(self.x, self.y, F.col(f"__{self.shape}_cx"), F.col(f"__{self.shape}_cy"))


@dataclass(frozen=True)
class PointFeature:
    """aggregates(context) gives aggregate columns by name; per_point(context) columns they use, made before the aggregation.

    requires: shape features of the instance. raster: whether moments of the instance's raster are used. grouped: a
    function of a pandas frame of one group instead, with the fields it returns.
    """

    aggregates: Callable[[Context], dict[str, Column]] | None = None
    per_point: Callable[[Context], dict[str, Column]] = field(default=lambda c: {})
    requires: tuple[str, ...] = ()
    raster: bool = False
    grouped: Callable[[pd.DataFrame], dict[str, float]] | None = None
    fields: tuple[str, ...] = ()
    doc: str = ""


def _boundary(c: Context) -> dict[str, Column]:
    return {f"__{c.shape}_boundary": geom.boundary_distance(F.col(f"__{c.shape}_edges"), c.x, c.y)}


def _sides(c: Context, value: Column, name: str, scale: Callable[[Column], Column], empty: Column | None) -> dict[str, Column]:
    out = {}
    for side, where in (("inner", c.inner), ("outer", ~c.inner)):
        v = scale(F.avg(F.when(where, value)))
        if empty is not None:
            # No shape at all is NULL; a shape without points on this side has the value for empty.
            v = F.when(F.max(F.col(f"__{c.shape}_cx")).isNotNull(), F.coalesce(v, empty))
        out[f"{c.shape}_{side}_{name}"] = v
    return out


def _proximity(c: Context) -> dict[str, Column]:
    r = F.first(c.radius)
    return _sides(c, c.boundary(), "proximity", lambda m: F.try_divide(r - m, r), F.lit(0.0))


def _asymmetry(c: Context) -> dict[str, Column]:
    return _sides(c, c.centre(), "asymmetry", lambda m: F.try_divide(m, F.first(c.radius)), F.lit(0.0))


def _spread() -> Column:
    # About the instance's own corner: sums of squares of large coordinates lose digits.
    return F.var_pop("__lx") + F.var_pop("__ly")


def _raster_about(x: Column, y: Column) -> Column:
    """Mean squared distance of the instance's raster from a point, by its moments."""
    mx, my, s2 = F.first("__rmx"), F.first("__rmy"), F.first("__rms")
    return s2 - 2 * (x * mx + y * my) + x * x + y * y


def _point_dispersion_norm(c: Context) -> dict[str, Column]:
    return {"point_dispersion_norm": F.try_divide(_spread(), _raster_about(F.avg("__lx"), F.avg("__ly")))}


def _shape_moment(c: Context) -> Column:
    return F.avg((c.x - F.col(f"__{c.shape}_cx")) ** 2 + (c.y - F.col(f"__{c.shape}_cy")) ** 2)


def _shape_dispersion_norm(c: Context) -> dict[str, Column]:
    cx, cy = F.first(F.col(f"__{c.shape}_cx") - F.col("__ox"), ignorenulls=True), F.first(F.col(f"__{c.shape}_cy") - F.col("__oy"), ignorenulls=True)
    return {f"{c.shape}_dispersion_norm": F.try_divide(_shape_moment(c), _raster_about(cx, cy))}


def ripley(x: np.ndarray, y: np.ndarray, area: float, span: float) -> dict[str, float]:
    """Ripley's H without edge correction at radii linspace(1, span / 2, int(span / 2)), and five numbers of its course."""
    names = ("l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius")
    n, steps = len(x), int(span / 2) if span == span else 0
    if n < 2 or steps < 1 or not area > 0:
        return dict.fromkeys(names, math.nan)
    radii = np.linspace(1, span / 2, steps)
    quarter = span / 4
    wanted = np.append(radii, quarter)
    pairs = np.zeros(len(wanted))
    for first in range(0, n, 1024):  # rows of the distance matrix a block at a time
        part = np.hypot(x[first : first + 1024, None] - x, y[first : first + 1024, None] - y).ravel()
        part.sort()
        pairs += np.searchsorted(part, wanted, side="left")
    # Each pair twice, and each point with itself where the radius is above 0.
    h_all = np.sqrt(area * (pairs - n * (wanted > 0)) / (n * (n - 1)) / np.pi) - wanted
    stats = h_all[:-1]
    smooth = np.convolve(stats, np.ones(5) / 5, "valid") if steps >= 5 else np.zeros(0)
    gradient = np.gradient(smooth) if len(smooth) >= 2 else np.zeros(1)
    ranks = pd.Series(stats).rank().to_numpy()
    order = np.arange(1, steps + 1, dtype=float)
    spread = np.std(ranks) * np.std(order)
    monotony = float(np.mean((ranks - ranks.mean()) * (order - order.mean())) / spread) if spread else math.nan
    return dict(zip(names, (float(stats.max()), float(gradient.max()), float(gradient.min()), monotony, float(h_all[-1]))))


_FEATURES: dict[str, PointFeature] = {
    "proximity": PointFeature(_proximity, _boundary, ("radius",), doc="nearness to the border, to the cell radius, inside and outside"),
    "asymmetry": PointFeature(_asymmetry, requires=("radius",), doc="mean distance from the centroid, to the cell radius, inside and outside"),
    "point_dispersion_norm": PointFeature(_point_dispersion_norm, raster=True, doc="second moment about the points' centroid to that of the cell"),
    "shape_dispersion_norm": PointFeature(_shape_dispersion_norm, raster=True, doc="second moment about the shape's centroid to that of the cell"),
    "distance": PointFeature(lambda c: _sides(c, c.boundary(), "distance", lambda m: m, None), _boundary, doc="mean distance from the border, inside and outside"),
    "offset": PointFeature(lambda c: _sides(c, c.centre(), "offset", lambda m: m, None), doc="mean distance from the centroid, inside and outside"),
    "point_dispersion": PointFeature(lambda c: {"point_dispersion": _spread()}, doc="second moment about the points' centroid"),
    "shape_dispersion": PointFeature(lambda c: {f"{c.shape}_dispersion": _shape_moment(c)}, doc="second moment about the shape's centroid"),
    "ripley": PointFeature(grouped=lambda g: ripley(g["x"].to_numpy(), g["y"].to_numpy(), g["__area"].iloc[0], g["__span"].iloc[0]), fields=("l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius"), requires=("area", "span"), doc="Ripley's L and its course"),
    "shape_enrichment": PointFeature(lambda c: {f"{c.shape}_enrichment": F.avg(c.inner.cast("double"))}, doc="share of points inside"),
}


def list_point_features() -> dict[str, str]:
    return {k: f.doc for k, f in _FEATURES.items()}


def register_point_feature(name: str, feature: PointFeature) -> None:
    """Add a feature. One with aggregates joins the single aggregation; a grouped one becomes a pass of its own over the groups."""
    _FEATURES[name] = feature


def _shape_side(ds: SpatialDataset, key: str, instance: str) -> DataFrame:
    """(instance id, edges, centroid) of the key's shape; of several shapes in an instance the last by id."""
    shapes = with_geometry(ds.shapes[key])
    owner = F.col("shape_id") if key == instance else F.col(instance)
    out = shapes.select(owner.alias("__owner"), F.col("shape_id").alias("__id"), F.col(EDGES).alias(f"__{key}_edges"), F.col(CX).alias(f"__{key}_cx"), F.col(CY).alias(f"__{key}_cy")).filter(F.col("__owner").isNotNull())
    if key == instance:
        return out.drop("__id")
    columns = [c for c in out.columns if c not in ("__owner", "__id")]
    return out.groupBy("__owner").agg(*(F.max_by(c, "__id").alias(c) for c in columns))


def analyze_points(ds: SpatialDataset, shape_keys: str | Sequence[str], feature_names: str | Sequence[str], groupby: str | Sequence[str] | None = None, points_key: str | None = None) -> SpatialDataset:
    """Features of the points of each instance and group, as table '{instance}_{groups}_features'.

    The features are compiled to what they need: shape geometry and radius are joined once for each shape key (one row an
    instance), per-point columns are made once, and all aggregates are one groupBy. Grouped features (Ripley) run over
    groups in Arrow and are joined.
    """
    instance = ds.attrs["instance_key"]
    shape_keys = [shape_keys] if isinstance(shape_keys, str) else list(shape_keys)
    names = [feature_names] if isinstance(feature_names, str) else list(feature_names)
    groups = [] if groupby is None else [groupby] if isinstance(groupby, str) else list(groupby)
    if unknown := [n for n in names if n not in _FEATURES]:
        raise KeyError(f"no point features {unknown}")
    if unknown := [k for k in shape_keys if k not in ds.shapes]:
        raise KeyError(f"no shapes {unknown}")
    points = ds.points[points_key or ds.attrs["points_key"]].filter(F.col(instance).isNotNull())
    if unknown := [g for g in groups if g not in points.columns]:
        raise KeyError(f"no point columns {unknown}")
    features = [_FEATURES[n] for n in names]
    needs = sorted({r for f in features for r in f.requires})
    cells = analyze_shapes(ds, instance, ["bounds", *needs]).shapes[instance]
    side = cells.select(F.col("shape_id").alias("__cell"), F.col(f"{instance}_minx").alias("__ox"), F.col(f"{instance}_miny").alias("__oy"), *(F.col(f"{instance}_{r}") for r in needs))
    if any(f.raster for f in features):
        r = raster(ds.shapes[instance]).join(side.select("__cell", "__ox", "__oy"), F.col("shape_id") == F.col("__cell"))
        lx, ly = F.col("x") - F.col("__ox"), F.col("y") - F.col("__oy")
        moments = r.groupBy("__cell").agg(F.avg(lx).alias("__rmx"), F.avg(ly).alias("__rmy"), F.avg(lx * lx + ly * ly).alias("__rms"))
        side = side.join(moments, "__cell", "left")
    for key in shape_keys:
        side = side.join(_shape_side(ds, key, instance).withColumnRenamed("__owner", "__cell"), "__cell", "left")
    keys = [instance, *groups]
    wide = points.select("x", "y", *dict.fromkeys([*keys, *(k for k in shape_keys if k in points.columns)])).join(side, F.col(instance) == F.col("__cell"))
    wide = wide.withColumn("__lx", F.col("x") - F.col("__ox")).withColumn("__ly", F.col("y") - F.col("__oy"))
    made: dict[str, Column] = {}
    aggregates: dict[str, Column] = {}
    for f in features:
        for key in shape_keys:
            c = Context(key, instance)
            made |= f.per_point(c)
            if f.aggregates:
                aggregates |= f.aggregates(c)
    out = wide.withColumns(made) if made else wide
    result: DataFrame | None = None
    if aggregates:
        result = out.groupBy(*keys).agg(*(v.alias(k) for k, v in aggregates.items()))
    for f in features:
        if f.grouped:
            part = _run_grouped(wide, keys, f, instance)
            result = part if result is None else result.join(part, keys, "full_outer")
    return ds.with_table("_".join([*keys, "features"]), result)


def _run_grouped(wide: DataFrame, keys: list[str], f: PointFeature, instance: str) -> DataFrame:
    columns = ["x", "y", *(F.col(f"{instance}_{r}").cast("double").alias(f"__{r}") for r in f.requires)]
    schema = ", ".join([*(f"{k} string" for k in keys), *(f"{c} double" for c in f.fields)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for group, part in frame.groupby(keys, sort=False, dropna=False):
            values = f.grouped(part)
            rows.append([*group, *(values.get(c, math.nan) for c in f.fields)])
        return pd.DataFrame(rows, columns=[*keys, *f.fields])

    # One frame an instance: its groups are many and small.
    done = wide.select(*keys, *columns).groupBy(keys[0]).applyInPandas(run, schema)
    return done.select(*keys, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in f.fields))


def all_features() -> Iterable[str]:
    return tuple(_FEATURES)
