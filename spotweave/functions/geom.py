"""Planar geometry as Spark columns over rings (array<array<struct<x, y>>>) and their edges; all of it stays in the JVM.

Exteriors run against the clock and holes with it, so signed sums over all edges are right for several rings.
Coordinates are moved to the first vertex before products, to keep magnitudes small. What is undefined is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(rings: Column) -> Column:
    """All edges as array<struct<ax, ay, bx, by>>."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def edge(p: Column, i: Column) -> Column:
            q = F.element_at(ring, F.pmod(i + 1, n) + 1)
            return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

        return F.transform(ring, edge)

    return F.flatten(F.transform(rings, of_ring))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, e: total + term(e))


def _cross(e: Column, x0: Column, y0: Column) -> Column:
    return (e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0)


def signed_area(edge: Column) -> Column:
    """Half the sum over all edges. They are made once: a term that names their expression would make all of them again for each edge."""
    return let(edge, lambda own: _sum(own, lambda e: _cross(e, own[0]["ax"], own[0]["ay"])) / 2)


def area(edge: Column) -> Column:
    return F.abs(signed_area(edge))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: plans that move columns into filters would otherwise repeat it at each use."""
    return F.transform(F.array(value), body)[0]


def edges_and_centroid(rings: Column) -> Column:
    """struct<edges, cx, cy>."""

    def of(edge: Column) -> Column:
        cx, cy = centroid(edge)
        return F.struct(edge.alias("edges"), cx.alias("cx"), cy.alias("cy"))

    return let(edges(rings), of)


def centroid(edge: Column) -> tuple[Column, Column]:
    """x and y of the area centroid; NULL for an area of zero."""
    x0, y0 = edge[0]["ax"], edge[0]["ay"]
    six = 6 * signed_area(edge)
    x = _sum(edge, lambda e: (e["ax"] + e["bx"] - 2 * x0) * _cross(e, x0, y0))
    y = _sum(edge, lambda e: (e["ay"] + e["by"] - 2 * y0) * _cross(e, x0, y0))
    return x0 + F.try_divide(x, six), y0 + F.try_divide(y, six)


def perimeter(edge: Column) -> Column:
    return _sum(edge, lambda e: distance(e["ax"], e["ay"], e["bx"], e["by"]))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def bounds(rings: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def radius(rings: Column, cx: Column, cy: Column) -> Column:
    """Mean distance of the exterior's vertices from (cx, cy); the first vertex closes the ring and counts twice."""
    ring = rings[0]
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return _sum(closed, lambda p: distance(p["x"], p["y"], cx, cy)) / F.size(closed)


def span(rings: Column) -> Column:
    """The greatest distance between vertices, cut to an integer."""
    flat = F.flatten(rings)
    far = F.aggregate(flat, F.lit(0.0), lambda most, p: F.greatest(most, F.aggregate(flat, F.lit(0.0), lambda m, q: F.greatest(m, (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))))
    return F.sqrt(far).cast("int")


def inside(edge: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return F.when(((e["ay"] > y) != (e["by"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(edge, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def boundary_distance(edge: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest point of any edge."""

    def squared(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        t = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        px, py = x - e["ax"] - t * dx, y - e["ay"] - t * dy
        return px * px + py * py

    return F.sqrt(F.aggregate(edge, F.lit(float("inf")), lambda least, e: F.least(least, squared(e))))


def on_edge(edge: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge, ends included, exactly."""

    def holds(e: Column) -> Column:
        side = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (side == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    return F.exists(edge, holds)


def aspect_ratio(rings: Column) -> Column:
    """Long to short side of the smallest rotated rectangle around the exterior; NULL if the short side is zero.

    The rectangle has a side along an edge of the convex hull; hull edges are the vertex pairs with all other
    vertices on one side.
    """
    ring = rings[0]
    n = F.size(ring)

    def boxes(p: Column) -> Column:
        def box(q: Column) -> Column:
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            norm = F.sqrt(dx * dx + dy * dy)
            along = F.transform(ring, lambda r: F.try_divide((r["x"] - p["x"]) * dx + (r["y"] - p["y"]) * dy, norm))
            off = F.transform(ring, lambda r: F.try_divide((r["y"] - p["y"]) * dx - (r["x"] - p["x"]) * dy, norm))
            length, width = F.array_max(along) - F.array_min(along), F.array_max(off) - F.array_min(off)
            hull = (F.array_min(off) >= -1e-9 * norm) & (norm > 0)
            return F.when(hull, F.struct((length * width).alias("a"), F.greatest(length, width).alias("l"), F.least(length, width).alias("s")))

        return F.transform(ring, box)

    every = F.filter(F.flatten(F.transform(ring, boxes)), lambda b: b.isNotNull())
    best = F.array_min(every)
    return F.when(n >= 3, F.try_divide(best["l"], best["s"]))


def grid(low: Column, high: Column, step: float) -> Column:
    """int(low) + k * step below int(high) + step."""
    first, last = low.cast("int"), high.cast("int")
    count = F.ceil((last - first + F.lit(float(step))) / F.lit(float(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: first + k * F.lit(float(step)))


def ring_of(points: list[tuple[float, float]]) -> Column:
    """A literal ring."""
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def regular_ring(n: int, r: float = 1.0, cx: float = 0.0, cy: float = 0.0) -> list[tuple[float, float]]:
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
