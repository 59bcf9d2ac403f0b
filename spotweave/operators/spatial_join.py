"""Spatial joins as equi-joins on square tiles with an exact test behind."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom

TILE = 64.0
#: Children are tested this much smaller, so that shared borders do not matter.
EROSION = 1e-5


def tile_of(v: Column, tile: float = TILE) -> Column:
    return F.floor(v / F.lit(float(tile))).cast("bigint")


def tiled(shapes: DataFrame, tile: float = TILE) -> DataFrame:
    """A row for each shape and tile that its bounds touch, with __tx, __ty, __edges and __minx ... __maxy."""
    b = geom.bounds(F.col("rings"))
    out = shapes.withColumn("__edges", geom.edges(F.col("rings")))
    for k, c in b.items():
        out = out.withColumn(f"__{k}", c)
    out = out.withColumn("__tx", F.explode(F.sequence(tile_of(F.col("__minx"), tile), tile_of(F.col("__maxx"), tile))))
    return out.withColumn("__ty", F.explode(F.sequence(tile_of(F.col("__miny"), tile), tile_of(F.col("__maxy"), tile))))


def points_in_shapes(points: DataFrame, shapes: DataFrame, out: str, tile: float = TILE, point_id: str = "point_id", overlap: bool | None = None) -> DataFrame:
    """points with `out`: the shape that holds the point, its border included, the smallest shape_id of several, NULL of none.

    Points join the shapes of their tile and are tested by even-odd parity, or for lying on an edge; no point is sent
    anywhere but to its tile. Only where shapes overlap are the hits of a point aggregated, in the same pass over the points. A
    shape side within the session's broadcast threshold spares the shuffle; a crowded tile is split by AQE. overlap: whether
    shapes may overlap, where the caller knows; else a job over the shapes finds out.
    """
    points = points.drop(out)
    sides = tiled(shapes.select("shape_id", "rings"), tile).drop("rings")
    x, y = F.col("x"), F.col("y")
    keyed = points.withColumn("__px", tile_of(x, tile)).withColumn("__py", tile_of(y, tile))
    box = x.between(F.col("__minx"), F.col("__maxx")) & y.between(F.col("__miny"), F.col("__maxy"))
    held = geom.inside(F.col("__edges"), x, y) | geom.on_edge(F.col("__edges"), x, y)
    hits = (F.col("__px") == F.col("__tx")) & (F.col("__py") == F.col("__ty")) & box & held
    joined = keyed.join(sides, hits, "left").withColumnRenamed("shape_id", out)
    kept = [*points.columns, out]
    joined = joined.select(kept)
    if overlapping(shapes, tile) if overlap is None else overlap:
        rest = [F.first(c).alias(c) for c in points.columns if c != point_id]
        return joined.groupBy(point_id).agg(*rest, F.min(out).alias(out)).select(kept)
    return joined


def overlapping(shapes: DataFrame, tile: float = TILE, grown: float = 0.0) -> bool:
    """Whether the bounds of any two shapes, moved out by `grown`, meet; only then can a point be in two. One small job over the shapes."""
    b = geom.bounds(F.col("rings"))
    boxes = shapes.select("shape_id", *((c - grown if k.startswith("min") else c + grown).alias(k) for k, c in b.items()))
    keyed = boxes.withColumn("tx", F.explode(F.sequence(tile_of(F.col("minx"), tile), tile_of(F.col("maxx"), tile)))).withColumn("ty", F.explode(F.sequence(tile_of(F.col("miny"), tile), tile_of(F.col("maxy"), tile))))
    l, r = keyed.alias("l"), keyed.alias("r")
    meet = (F.col("l.tx") == F.col("r.tx")) & (F.col("l.ty") == F.col("r.ty")) & (F.col("l.shape_id") < F.col("r.shape_id"))
    meet &= (F.col("l.minx") <= F.col("r.maxx")) & (F.col("r.minx") <= F.col("l.maxx")) & (F.col("l.miny") <= F.col("r.maxy")) & (F.col("r.miny") <= F.col("l.maxy"))
    return not l.join(r, meet).limit(1).isEmpty()


def covers(parents: DataFrame, children: DataFrame, tile: float = TILE, erosion: float = EROSION) -> DataFrame:
    """(parent, child) where the parent holds the child's vertices, moved by `erosion` to the child's centroid, and no edges cross."""
    # Both sides are a row a shape; kept, so that the join's own null checks do not compute the geometry again.
    p = tiled(parents.select(F.col("shape_id").alias("parent"), "rings"), tile).drop("rings").persist()

    def moved(g: Column) -> Column:
        def shrunk(v: Column) -> Column:
            d = geom.distance(v["x"], v["y"], g["cx"], g["cy"])
            k = F.when(d > erosion, 1 - F.lit(erosion) / d).otherwise(0.0)
            return F.struct((g["cx"] + k * (v["x"] - g["cx"])).alias("x"), (g["cy"] + k * (v["y"] - g["cy"])).alias("y"))

        return F.transform(F.col("rings"), lambda ring: F.transform(ring, shrunk))

    own = children.select(F.col("shape_id").alias("child"), geom.let(geom.edges_and_centroid(F.col("rings")), moved).alias("__small")).persist()
    own = own.withColumn("__flat", F.flatten("__small")).withColumn("__ce", geom.edges(F.col("__small")))
    own = own.withColumn("__kx", tile_of(F.col("__flat")[0]["x"], tile)).withColumn("__ky", tile_of(F.col("__flat")[0]["y"], tile))
    b = geom.bounds(F.col("__small"))
    for k, c in b.items():
        own = own.withColumn(f"__k{k}", c)
    near = (F.col("__kx") == F.col("__tx")) & (F.col("__ky") == F.col("__ty"))
    near &= (F.col("__minx") <= F.col("__kminx")) & (F.col("__maxx") >= F.col("__kmaxx")) & (F.col("__miny") <= F.col("__kminy")) & (F.col("__maxy") >= F.col("__kmaxy"))
    holds = F.forall("__flat", lambda v: geom.inside(F.col("__edges"), v["x"], v["y"]))

    def side(e: Column, x: Column, y: Column) -> Column:
        return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

    def crosses(e: Column, f: Column) -> Column:
        one = side(e, f["ax"], f["ay"]) * side(e, f["bx"], f["by"])
        two = side(f, e["ax"], e["ay"]) * side(f, e["bx"], e["by"])
        return (one < 0) & (two < 0)

    apart = ~F.exists("__ce", lambda e: F.exists("__edges", lambda f: crosses(e, f)))
    return own.join(p, near & holds & apart).select("parent", "child")


def map_shapes(parents: DataFrame, children: DataFrame, mode: str = "1to1", tile: float = TILE) -> tuple[DataFrame, DataFrame]:
    """Links of children to parents: (child, parent) with one parent each, and (parent, child).

    1to1: a child has its first parent by id, a parent its last child by id. 1tomany: all children of a parent stay.
    """
    if mode not in ("1to1", "1tomany"):
        raise ValueError(f"instance_map_type {mode!r}; there are '1to1' and '1tomany'")
    pairs = covers(parents, children, tile)
    up = pairs.groupBy("child").agg(F.min("parent").alias("parent"))
    if mode == "1tomany":
        return up, up.select("parent", "child")
    return up, up.groupBy("parent").agg(F.max("child").alias("child"))


def merge_children(children: DataFrame, up: DataFrame) -> DataFrame:
    """1tomany: one shape for each parent, of all rings of its children; children without a parent are left out."""
    joined = children.join(up, F.col("shape_id") == F.col("child"))
    return joined.groupBy("parent").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("child", "rings"))), lambda c: c["rings"])).alias("rings")).withColumn("shape_id", F.col("parent")).select("shape_id", "rings", F.col("parent"))


def radius_pairs(points: DataFrame, key: str, r: float, carry: list[str], queries: DataFrame | None = None, query_id: str = "point_id") -> DataFrame:
    """Ordered pairs (query, neighbour) of one key at a distance of at most r, a point itself included.

    The plane is cut into squares of width 2 r. A query is in its own, a point in all that a circle of r around it
    touches (two and a quarter on average), so every pair meets once, in an equi-join by key and square: the pairs tested follow the
    density of points, not the size of a key, and a crowded key is spread over tasks.
    """
    queries = points if queries is None else queries
    side, reach = F.lit(2.0 * r), F.lit(float(r) * (1 + 1e-9))

    def squares(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / side).cast("bigint"), F.floor((F.col(c) + reach) / side).cast("bigint"))

    q = queries.select(F.col(key).alias("__key"), F.col(query_id).alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), *(F.col(c).alias(f"q_{c}") for c in carry if c in queries.columns))
    q = q.withColumn("__qi", F.floor(F.col("qx") / side).cast("bigint")).withColumn("__qj", F.floor(F.col("qy") / side).cast("bigint"))
    p = points.select(key, "point_id", "x", "y", *carry).withColumn("__pi", F.explode(squares("x"))).withColumn("__pj", F.explode(squares("y")))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    meet = (F.col("__key") == F.col(key)) & (F.col("__qi") == F.col("__pi")) & (F.col("__qj") == F.col("__pj"))
    return q.join(p, meet & (dx * dx + dy * dy <= F.lit(float(r) * float(r)))).drop("__key", "__qi", "__qj", "__pi", "__pj")


def nearest(points: DataFrame, key: str, k: int, carry: list[str], queries: DataFrame | None = None, query_id: str = "point_id", block: int = 512) -> DataFrame:
    """(key, query_id, qx, qy, q_<carry>, carry, x, y, d2, rank): the k nearest points of the same key for each query (all if fewer), rank 1 the nearest; ties go by x, y, carry, point_id.

    A key's points and queries meet in one task, in Arrow; distances are made for `block` queries at a time, and of a query's
    only those up to the k-th smallest are put in order.
    """
    queries = points if queries is None else queries
    own = [c for c in carry if c in queries.columns]
    q = queries.select(key, F.lit(1).alias("__side"), F.col(query_id).alias("__id"), "x", "y", *(F.col(c).cast("string").alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in carry))
    p = points.select(key, F.lit(0).alias("__side"), F.col("point_id").alias("__id"), "x", "y", *(F.col(c).cast("string").alias(c) for c in carry))
    fields = [f"{key} string", "query_id bigint", "qx double", "qy double", *(f"q_{c} string" for c in own), *(f"{c} string" for c in carry), "point_id bigint", "x double", "y double", "d2 double", "`rank` int"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["__side"].to_numpy()
        # In the order of ties: a stable sort by distance keeps it.
        near = frame[side == 0].sort_values(["x", "y", *carry, "__id"], kind="stable").reset_index(drop=True)
        ask = frame[side == 1].reset_index(drop=True)
        n = min(k, len(near))
        rows, picks, squares = [], [], []
        x, y = near["x"].to_numpy(), near["y"].to_numpy()
        for first in range(0, len(ask) if n else 0, block):
            part = ask.iloc[first : first + block]
            dx, dy = x - part["x"].to_numpy()[:, None], y - part["y"].to_numpy()[:, None]
            d2 = dx * dx + dy * dy
            # All up to the k-th distance, ties included, then in order of distance and of ties.
            row, at = np.nonzero(d2 <= np.partition(d2, n - 1, axis=1)[:, n - 1 : n])
            d = d2[row, at]
            order = np.lexsort((at, d, row))
            row, at, d = row[order], at[order], d[order]
            first_of = np.searchsorted(row, np.arange(len(part)))
            taken = (first_of[:, None] + np.arange(n)).ravel()
            rows.append(np.repeat(part.index.to_numpy(), n))
            picks.append(at[taken])
            squares.append(d[taken])
        row, pick = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, picks))
        a, b = ask.iloc[row].reset_index(drop=True), near.iloc[pick].reset_index(drop=True)
        out = {key: a[key], "query_id": a["__id"], "qx": a["x"], "qy": a["y"], **{f"q_{c}": a[c] for c in own}, **{c: b[c] for c in carry}, "point_id": b["__id"], "x": b["x"], "y": b["y"]}
        return pd.DataFrame({**out, "d2": np.concatenate(squares) if squares else np.zeros(0), "rank": np.tile(np.arange(1, n + 1), len(ask)) if n else np.zeros(0, int)})

    return p.unionByName(q).groupBy(key).applyInPandas(run, ", ".join(fields))


__all__ = ["covers", "map_shapes", "merge_children", "nearest", "points_in_shapes", "radius_pairs", "tiled"]
