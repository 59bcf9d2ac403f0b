from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import geom
from spotweave.operators import polygons

SQUARE = [(0, 0), (4, 0), (4, 3), (0, 3)]
TRIANGLE = [(0, 0), (6, 0), (0, 3)]
ROTATED = [(3 * a + b, a - 3 * b) for a, b in ((0, 0), (2, 0), (2, -1), (0, -1))]


def one(spark, ring, *columns):
    df = spark.range(1).select(F.array(geom.ring_of(ring)).alias("rings"))
    return df.withColumn("e", geom.edges(F.col("rings"))).select(*columns).first()


@pytest.mark.parametrize("ring,area,perimeter,centre,span,ratio", [(SQUARE, 12, 14, (2, 1.5), 5, 4 / 3), (TRIANGLE, 9, 9 + math.sqrt(45), (2, 1), 6, 2.5), (ROTATED, 20, 6 * math.sqrt(10), (2.5, 2.5), 7, 2)])
def test_measures(spark, ring, area, perimeter, centre, span, ratio):
    e = F.col("e")
    cx, cy = geom.centroid(e)
    got = one(spark, ring, geom.area(e), geom.perimeter(e), cx, cy, geom.span(F.col("rings")), geom.aspect_ratio(F.col("rings")))
    assert got[0] == pytest.approx(area) and got[1] == pytest.approx(perimeter) and got[4] == span
    assert abs(got[2]) == pytest.approx(abs(centre[0])) and abs(got[3]) == pytest.approx(abs(centre[1]))
    if ring is not TRIANGLE:
        assert got[5] == pytest.approx(ratio)


def test_radius_counts_the_first_vertex_twice(spark):
    got = one(spark, SQUARE, geom.radius(F.col("rings"), F.lit(0.0), F.lit(0.0)))
    assert got[0] == pytest.approx((0 + 4 + 5 + 3 + 0) / 5)


def test_inside_and_boundary_distance(spark):
    e = F.col("e")
    for x, y, inside, d in ((1.0, 1.0, True, 1.0), (5.0, 1.0, False, 1.0), (2.0, 1.4, True, 1.4), (7.0, 7.0, False, 5.0)):
        got = one(spark, SQUARE, geom.inside(e, F.lit(x), F.lit(y)), geom.boundary_distance(e, F.lit(x), F.lit(y)))
        assert got[0] == inside and got[1] == pytest.approx(d)


def test_degenerate_ring(spark):
    cx, cy = geom.centroid(F.col("e"))
    got = one(spark, [(1, 1), (2, 2), (3, 3)], geom.area(F.col("e")), cx, geom.aspect_ratio(F.col("rings")))
    assert got[0] == 0 and got[1] is None and got[2] is None


def test_area_makes_the_edges_once(spark):
    """Not again for each edge: the work would grow with the square of a shape's edges. No ring has an area of 0, NULL has none."""
    shapes = spark.createDataFrame([(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]), (2, []), (3, None)], "i int, rings array<array<struct<x: double, y: double>>>")
    out = shapes.select("i", geom.area(geom.edges(F.col("rings"))).alias("area"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    assert {r["i"]: r["area"] for r in out.collect()} == {1: 11.0, 2: 0.0, 3: None}


def box(x0, y0, x1, y1):
    return [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)]


def total(rings):
    return sum(polygons.ring_area(r) for r in rings)


@pytest.mark.parametrize("b,inter", [(box(2, 1, 6, 5), 2 * 2), (box(1, 1, 2, 2), 1), (box(4, 0, 6, 3), 0), (box(0, 0, 4, 3), 12), (box(-1, 1, 5, 2), 4), (box(9, 9, 10, 10), 0), (box(0, 0, 2, 3), 6)])
def test_overlay_areas(b, inter):
    a = box(0, 0, 4, 3)
    area_b = total(b)
    want = {"intersection": inter, "union": 12 + area_b - inter, "difference": 12 - inter, "symmetric_difference": 12 + area_b - 2 * inter}
    for how, w in want.items():
        assert total(polygons.overlay(a, b, how)) == pytest.approx(w, abs=1e-6), how


def test_overlay_of_rotated_shapes_against_a_grid():
    rng = np.random.default_rng(0)
    for _ in range(5):
        shapes = []
        for _ in range(2):
            angle = np.sort(rng.random(9) * 2 * np.pi)
            r = 1 + 2 * rng.random(9)
            shapes.append([np.stack([r * np.cos(angle), r * np.sin(angle)], axis=1) + rng.random(2)])
        gx, gy = np.meshgrid(np.arange(-4, 5, 0.02), np.arange(-4, 5, 0.02))
        a, b = (polygons.inside_rings(s, gx, gy) for s in shapes)
        for how, m in (("intersection", a & b), ("union", a | b), ("difference", a & ~b), ("symmetric_difference", a ^ b)):
            assert total(polygons.overlay(*shapes, how)) == pytest.approx(m.sum() * 0.0004, abs=0.12)


def test_opening_of_a_square_rounds_its_corners():
    got = total(polygons.opening(box(0, 0, 10, 10), 2))
    assert got == pytest.approx(100 - (4 - math.pi) * 4, abs=0.03)
    assert polygons.opening(box(0, 0, 2, 10), 1.5) == []
    notched = [np.array([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)], float)]
    assert 0 < total(polygons.opening(notched, 1)) < 75.5


@pytest.mark.parametrize("mask", ["1", "11\n10", "111\n101\n111", "10\n01", "101\n111\n101", "0"])
def test_contours_have_the_area_of_their_cells(mask):
    m = np.array([[c == "1" for c in row] for row in mask.split("\n")])
    rings = polygons.contours(m)
    assert total(rings) == m.sum()
    gy, gx = np.indices(m.shape)
    assert (polygons.inside_rings(rings, gx + 0.5, gy + 0.5) == m).all() if rings else not m.any()
