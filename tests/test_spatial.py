from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.dataset import SHAPES, SpatialDataset
from spotweave.operators import coloc, flux, neighbors, overlay, patterns, plotdata, point_features, prep, shape_features, spatial_join

CELL, NUC, GENE = "cell_boundaries", "nucleus_boundaries", "feature_name"


def rect(x0, y0, x1, y1):
    return [[(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]]


def shapes(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in rows], SHAPES)


POINTS = [(2.5, 2.5, "g1"), (4.5, 4.5, "g1"), (8.5, 8.5, "g2"), (8.6, 8.5, "g1"), (25.0, 5.0, "g2"), (25.5, 5.0, "g2"), (99.0, 99.0, "g1")]


@pytest.fixture(scope="module")
def ds(spark):
    cells = shapes(spark, [("c0", rect(0, 0, 10, 10)), ("c1", rect(20, 0, 30, 10)), ("c2", rect(200, 0, 210, 10))])
    nuclei = shapes(spark, [("n0", rect(3, 3, 6, 6)), ("n1", rect(40, 40, 42, 42)), ("n2", rect(20, 0, 30, 10))])
    points = spark.createDataFrame(POINTS, f"x double, y double, {GENE} string")
    return prep.prep(SpatialDataset({"transcripts": points}, {CELL: cells, NUC: nuclei}), "transcripts", GENE, CELL, [NUC])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_prep_maps_points_and_shapes(ds):
    assert rows(ds.points["transcripts"], "x", CELL, F.coalesce(NUC, F.lit(""))) == [(2.5, "c0", ""), (4.5, "c0", "n0"), (8.5, "c0", ""), (8.6, "c0", ""), (25.0, "c1", "n2"), (25.5, "c1", "n2")]
    assert rows(prep.to_api(ds.shapes[CELL]), "shape_id", NUC) == [("c0", "n0"), ("c1", "n2"), ("c2", "")]
    assert rows(prep.to_api(ds.shapes[NUC]), "shape_id", CELL) == [("n0", "c0"), ("n1", ""), ("n2", "c1")]
    assert rows(ds.tables["table"], CELL, GENE, "n") == [("c0", "g1", 3), ("c0", "g2", 1), ("c1", "g2", 2)]
    assert ds.attrs["instance_key"] == CELL and prep.get_feature_key(ds) == GENE


def test_a_shape_on_the_border_is_covered(spark):
    parents, children = shapes(spark, [("p", rect(0, 0, 9, 9))]), shapes(spark, [("in", rect(0, 0, 4, 4)), ("across", rect(5, 5, 12, 8)), ("same", rect(0, 0, 9, 9))])
    assert rows(spatial_join.covers(parents, children), "parent", "child") == [("p", "in"), ("p", "same")]


def test_points_in_overlapping_shapes_have_the_first(spark):
    points = spark.createDataFrame([(0, 5.0, 5.0), (1, 1.0, 1.0), (2, 50.0, 50.0)], "point_id bigint, x double, y double")
    both = shapes(spark, [("b", rect(0, 0, 10, 10)), ("a", rect(4, 4, 20, 20))])
    out = spatial_join.points_in_shapes(points, both, "s")
    assert rows(out, "point_id", F.coalesce("s", F.lit(""))) == [(0, "a"), (1, "b"), (2, "")]


def test_duplicate_ids_get_suffixes(spark):
    out = prep.unique_ids(shapes(spark, [("a", rect(0, 0, 1, 1)), ("a", rect(2, 2, 3, 3)), ("b", rect(4, 4, 5, 5))]))
    assert rows(out, "shape_id") == [("a",), ("a_1",), ("b",)]


def test_one_to_many_merges_children(spark):
    parents = shapes(spark, [("p", rect(0, 0, 20, 20)), ("q", rect(50, 0, 60, 10))])
    children = shapes(spark, [("a", rect(1, 1, 2, 2)), ("b", rect(4, 4, 6, 6)), ("x", rect(90, 90, 91, 91))])
    ds = prep.prep(SpatialDataset({"t": spark.createDataFrame([(1.5, 1.5, "g"), (5.0, 5.0, "g")], f"x double, y double, {GENE} string")}, {CELL: parents, "spots": children}), "t", GENE, CELL, ["spots"], {"spots": "1tomany"})
    assert rows(ds.shapes["spots"], "shape_id", F.size("rings")) == [("p", 2)]
    assert rows(ds.points["t"], "spots") == [("p",), ("p",)]
    with pytest.raises(ValueError):
        spatial_join.map_shapes(parents, children, "many")


def test_accessors(ds):
    assert prep.get_points(ds, "transcripts", "pandas").shape[0] == 6
    assert prep.get_shape(ds, NUC).count() == 2 and prep.get_shape(ds, NUC, sync=False).count() == 3
    for bad in (lambda: prep.get_points(ds, "no"), lambda: prep.get_points(ds, "transcripts", "dask"), lambda: prep.get_shape(ds, "no"), lambda: prep.get_points_metadata(ds, "transcripts", "no")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        prep.get_instance_key(SpatialDataset())
    new = prep.set_shape_metadata(ds, CELL, ds.shapes[CELL].filter("shape_id = 'c0'").select("shape_id", F.lit(7).alias("k")))
    assert rows(prep.get_shape_metadata(new, CELL, "k").fillna(0), "shape_id", "k") == [("c0", 7), ("c1", 0), ("c2", 0)]
    marked = prep.set_points_metadata(ds, "transcripts", ds.points["transcripts"].select("point_id", (F.col("x") > 20).alias("far")))
    assert rows(prep.get_points_metadata(marked, "transcripts", ["far", "x"]), "x", "far")[-1] == (25.5, True)


def test_filters(ds):
    assert rows(prep.filter_by_gene(ds, 3).tables["table"], GENE, "n") == [("g1", 3)]
    assert prep.bounding_box(ds, 0, 0, 5, 5).points["transcripts"].count() == 2
    dense = prep.dense_counts(ds.tables["table"], CELL, GENE)
    assert rows(dense, CELL, GENE, "n") == [("c0", "g1", 3), ("c0", "g2", 1), ("c1", "g1", 0), ("c1", "g2", 2)]
    assert rows(prep.count_matrix(ds.tables["table"], CELL, GENE, ["g1", "g2"]), CELL, "g1", "g2") == [("c0", 3, 1), ("c1", 0, 2)]


def test_shape_features(ds):
    out = shape_features.analyze_shapes(ds, [CELL, NUC], ["area", "bounds", "density", "perimeter", "radius", "span", "aspect_ratio", "second_moment", "opening", "raster"], {"opening": {"proportion": 0.5}})
    r = {x["shape_id"]: x for x in out.shapes[CELL].collect()}["c0"]
    assert (r[f"{CELL}_area"], r[f"{CELL}_perimeter"], r[f"{CELL}_span"], r[f"{CELL}_aspect_ratio"]) == (100, 40, 14, 1)
    assert r[f"{CELL}_radius"] == pytest.approx(math.sqrt(50)) and r[f"{CELL}_density"] == 0.04
    assert {x["shape_id"]: x[f"{CELL}_density"] for x in out.shapes[CELL].collect()}["c2"] is None
    assert r[f"{CELL}_open_0.5_shape"] and out.points[f"{CELL}_raster"].filter(f"{CELL} = 'c0'").count() == 100
    again = shape_features.analyze_shapes(out.with_shapes(CELL, out.shapes[CELL].withColumn(f"{CELL}_area", F.lit(-1.0))), CELL, "area")
    assert rows(again.shapes[CELL], f"{CELL}_area")[0] == (-1.0,)
    with pytest.raises(KeyError):
        shape_features.analyze_shapes(ds, CELL, "no")
    shape_features.register_shape_feature("corners", lambda: {"corners": F.size(shape_features.EDGES)})
    assert rows(shape_features.analyze_shapes(ds, CELL, "corners").shapes[CELL], f"{CELL}_corners")[0] == (4,)
    assert "corners" in shape_features.list_shape_features()


def test_raster_of_a_sliver_is_its_centroid(spark):
    out = shape_features.raster(shapes(spark, [("s", rect(0.2, 0.2, 0.8, 0.4))]))
    assert rows(out, F.round("x", 6), F.round("y", 6)) == [(0.5, 0.3)]


def test_point_features(ds):
    out = point_features.analyze_points(ds, [CELL, NUC], list(point_features.all_features()), GENE)
    t = {(r[CELL], r[GENE]): r for r in out.tables[f"{CELL}_{GENE}_features"].collect()}
    g = t["c0", "g1"]
    xs, ys = np.array([2.5, 4.5, 8.6]), np.array([2.5, 4.5, 8.5])
    assert g["point_dispersion"] == pytest.approx(xs.var() + ys.var())
    assert g[f"{CELL}_inner_offset"] == pytest.approx(np.hypot(xs - 5, ys - 5).mean())
    assert g[f"{NUC}_inner_offset"] == pytest.approx(0) and g[f"{NUC}_outer_offset"] == pytest.approx(np.hypot([2.0, 4.1], [2.0, 4.0]).mean())
    assert g[f"{NUC}_enrichment"] == pytest.approx(1 / 3) and g[f"{CELL}_enrichment"] == 1
    assert g[f"{CELL}_outer_proximity"] == 0 and g[f"{CELL}_outer_distance"] is None
    r = math.sqrt(50)
    assert g[f"{CELL}_inner_proximity"] == pytest.approx((r - (2.5 + 4.5 + 1.4) / 3) / r)
    assert t["c0", "g2"]["l_max"] is None and g["l_max"] is not None
    with pytest.raises(KeyError):
        point_features.analyze_points(ds, "no", "offset")
    point_features.register_point_feature("extent", point_features.PointFeature(lambda c: {"extent": F.max("x") - F.min("x")}))
    point_features.register_point_feature("tail", point_features.PointFeature(grouped=lambda f: {"tail": float(f["x"].max())}, fields=("tail",)))
    both = point_features.analyze_points(ds, CELL, ["extent", "tail"]).tables[f"{CELL}_features"]
    assert rows(both, CELL, F.round("extent", 6), "tail") == [("c0", 6.1, 8.6), ("c1", 0.5, 25.5)]


def test_ripley_of_a_grid():
    x, y = np.meshgrid(np.arange(10.0), np.arange(10.0))
    got = point_features.ripley(x.ravel(), y.ravel(), 100.0, 14.0)
    d = np.hypot(x.ravel()[:, None] - x.ravel(), y.ravel()[:, None] - y.ravel())[np.triu_indices(100, 1)]
    radii = np.linspace(1, 7, 7)
    h = np.sqrt(np.array([(d < r).sum() for r in radii]) * 2 * 100 / (100 * 99) / np.pi) - radii
    assert got["l_max"] == pytest.approx(h.max()) and -1 <= got["l_monotony"] <= 1
    assert all(math.isnan(v) for v in point_features.ripley(np.zeros(1), np.zeros(1), 1.0, 5.0).values())


def test_neighbours(ds):
    points = ds.points["transcripts"]
    out = neighbors.count_neighbors(points, CELL, GENE, radius=0.5)
    assert sorted(r["n"] for r in out.collect()) == [1, 1, 1, 1, 1, 1, 2, 2]
    assert rows(neighbors.count_neighbors(points, CELL, GENE, radius=0.5, agg="feature"), CELL, "source", "neighbor", "n")[0] == ("c0", "g1", "g1", 1)
    assert neighbors.count_neighbors(points, CELL, GENE, n_neighbors=99).agg(F.sum("n")).first()[0] == 4 * 4 + 2 * 2
    for kws in ({}, {"radius": 1, "n_neighbors": 1}):
        with pytest.raises(ValueError):
            neighbors.count_neighbors(points, CELL, GENE, **kws)


def test_clq_by_hand(spark):
    points = spark.createDataFrame([("c", "a", i, float(i), 0.0) for i in range(4)] + [("c", "b", 10 + i, float(2 * i), 0.1) for i in range(2)], f"{CELL} string, {GENE} string, point_id int, x double, y double")
    out = {(r[GENE], r["neighbor"]): r for r in coloc.clq(points, CELL, GENE, radius=0.5, min_points=2).collect()}
    ab = out["a", "b"]
    assert ab["clq"] == pytest.approx((2 / 4) / (2 / 6)) and ab["log_clq"] == pytest.approx(math.log2(1.5))
    assert ab["ci_upper"] - ab["clq"] == pytest.approx(1.96 * math.sqrt(1 / 2 + 1 / 4 + 1 / 2 + 1 / 6))
    assert coloc.clq(points, CELL, GENE, radius=0.5, min_points=3).count() == 0


def test_parafac_recovers_a_rank_one_tensor():
    a, b, c = np.array([1.0, 2.0]), np.array([1.0, 3.0, 2.0]), np.array([2.0, 1.0])
    full = np.einsum("i,j,k->ijk", a, b, c)
    coords = np.argwhere(full > 0)
    _, error = coloc.parafac(coords, full[full > 0], full.shape, 1, 0)
    assert error < 1e-4


def test_logit_effects():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 2)).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))).astype(float)
    first, second = patterns.logit_effects(x, y)
    assert first["dy/dx"] == pytest.approx(y[x[:, 0] == 1].mean() - y[x[:, 0] == 0].mean(), abs=0.01) and first["pvalue"] < 1e-9
    assert second["pvalue"] > 1e-4 and first["ci_low"] < first["dy/dx"] < first["ci_high"]
    assert patterns.logit_effects(np.ones((10, 1)), np.arange(10) % 2.0) is None
    assert patterns.logit_effects((np.arange(10) % 2.0)[:, None], np.arange(10) % 2.0) is None


def test_patterns_warn(spark):
    found = spark.createDataFrame([("c", "g", 0, 0, 0, 0, 0)], f"{CELL} string, {GENE} string, " + ", ".join(f"{p} int" for p in patterns.PATTERNS))
    with pytest.warns(UserWarning):
        assert patterns.lp_diff_discrete(found, spark.createDataFrame([("c", 1.0)], f"{CELL} string, phenotype double"), CELL, GENE) is None


def test_lp_warns_of_absent_patterns(ds):
    with pytest.warns(UserWarning):
        out = patterns.lp(ds, patterns.rule_model(CELL, NUC), NUC)
    assert set(out.tables["lp"].columns) == {CELL, GENE, *patterns.PATTERNS} and out.tables["lpp"].count() == 3


def test_flux_and_domains(ds):
    out = flux.flux(ds, radius=3.0, res=0.5)
    raster = out.points[f"{CELL}_raster"]
    assert raster.count() == 75 and out.attrs["flux_features"] == ["g1", "g2"]
    first = raster.first()
    assert len(first["flux"]) == 2 and len(first["flux_color"]) == 9
    mapped = flux.fluxmap(out, n_clusters=2, min_count=1, num_iterations=200)
    labels = mapped.points[f"{CELL}_raster"].groupBy("fluxmap").count().collect()
    n = {r["fluxmap"]: r["count"] for r in labels}
    from spotweave.functions import geom

    area = sum(mapped.shapes[f"fluxmap{i}"].agg(F.sum(F.coalesce(geom.area(geom.edges(F.col("rings"))), F.lit(0.0)))).first()[0] for i in (1, 2))
    assert area == pytest.approx(4 * (75 - n.get(0, 0)))
    net = ds.points["transcripts"].sparkSession.createDataFrame([("s", "g1", 1.0), ("s", "g2", 2.0), ("t", "zz", 1.0)], "source string, target string, weight double")
    scored = flux.fe(out, net, times=4)
    assert "flux_s" in scored.points[f"{CELL}_raster"].columns and "flux_t" not in scored.points[f"{CELL}_raster"].columns
    assert rows(scored.tables["fe_ngenes"], "source", "n") == [("s", 2)]


def test_svd_and_elbow():
    assert flux.elbow([2, 3, 4, 5, 6], [10, 4, 3, 2.5, 2.2]) == 3
    assert flux.elbow([2, 3, 4], [3, 2, 1]) is None


def test_overlay_in_a_dataset(ds):
    out = overlay.overlay(ds, CELL, NUC, "cytoplasm", "difference")
    assert rows(out.points["transcripts"].filter(F.col("cytoplasm").isNotNull()), "x") == [(2.5,), (8.5,), (8.6,)]
    with pytest.raises(ValueError):
        overlay.overlay_shapes(ds.shapes[CELL], ds.shapes[NUC], "no")
    assert overlay.outside_mask(ds.shapes[CELL], 1.0).count() == 4


def test_figure_data(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 1.0)], "k string, p double, q double")
    assert rows(plotdata.radviz(df, "k", ["p", "q"]), "k", F.round("rx", 6)) == [("a", 1.0), ("b", -1.0), ("c", 0.0)]
    assert rows(plotdata.entropy_topn(df, "k", ["p", "q"], 2), "k") == [("a",), ("b",)]
    assert plotdata.dimension_order(df, ["p", "q"]) == ["p", "q"]
    assert rows(plotdata.zscored(df, [], "p"), "k", F.round("z", 4))[0] == ("a", 0.7071)


def test_write_and_read(ds, tmp_path):
    from spotweave.sources import io

    io.write_dataset(ds, str(tmp_path / "ds"), buckets=4)
    back = io.read_dataset(ds.points["transcripts"].sparkSession, str(tmp_path / "ds"))
    assert rows(back.points["transcripts"], "x", CELL) == rows(ds.points["transcripts"], "x", CELL) and back.attrs == dict(ds.attrs)


def test_gene_sets(spark, tmp_path):
    from spotweave.sources import io

    path = tmp_path / "sets.csv"
    path.write_text("source,target\nER,g1\nER,g2\n")
    assert rows(io.read_gene_sets(spark, {"mine": str(path)}, "mine"), "target", "weight") == [("g1", 1.0), ("g2", 1.0)]
    with pytest.raises(KeyError):
        io.read_gene_sets(spark, {}, "mine")


def test_streamed_counts(ds, tmp_path):
    from spotweave.streaming.counts import stream_counts, stream_points

    points = ds.points["transcripts"]
    points.write.parquet(str(tmp_path / "in"))
    stream = stream_counts(stream_points(points.sparkSession, str(tmp_path / "in"), points.schema), CELL, GENE)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(points.sparkSession.table("streamed"), CELL, GENE, "n") == rows(ds.tables["table"], CELL, GENE, "n")


def test_points_on_a_border_are_inside(spark):
    """Concave rings, holes, several rings: parity inside, and every point of an edge belongs to the shape."""
    concave = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]]
    holed = [*rect(20, 0, 30, 10), *rect(24, 4, 26, 6)]
    two = [*rect(40, 0, 42, 2), *rect(46, 0, 48, 2)]
    kinds = shapes(spark, [("concave", concave), ("holed", holed), ("two", two)])
    want = {
        (5.0, 5.0): "concave", (2.5, 7.5): "concave", (5.0, 7.0): None, (0.0, 10.0): "concave", (10.0, 3.0): "concave", (0.0, 5.0): "concave", (3.0, 0.0): "concave", (9.0, 8.0): "concave",
        (25.0, 5.0): None, (24.0, 5.0): "holed", (26.0, 6.0): "holed", (22.0, 5.0): "holed", (30.0, 10.0): "holed", (30.0, 10.5): None,
        (41.0, 1.0): "two", (44.0, 1.0): None, (42.0, 1.0): "two", (46.0, 0.0): "two", (48.0, 2.0): "two", (47.0, 2.0): "two",
    }
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(want)], "point_id bigint, x double, y double")
    for tile in (64.0, 3.0):
        got = {(r["x"], r["y"]): r["s"] for r in spatial_join.points_in_shapes(points, kinds, "s", tile).collect()}
        assert got == want


def test_radius_pairs_of_a_crowded_cell(spark):
    """One cell of 50,000 points: pairs follow the density, not the square of the cell."""
    rng = np.random.default_rng(1)
    xy = np.round(rng.uniform(-200, 200, (50_000, 2)), 1)
    points = spark.createDataFrame([(i, "c", float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, cell string, x double, y double")
    pairs = spatial_join.radius_pairs(points, "cell", 1.0, [])
    got = pairs.count()
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(xy):
        cells.setdefault((int(x // 1), int(y // 1)), []).append(i)
    want = 0
    for (a, b), own in cells.items():
        near = np.array([j for p in (-1, 0, 1) for q in (-1, 0, 1) for j in cells.get((a + p, b + q), [])])
        d = xy[own][:, None, :] - xy[near][None, :, :]
        want += int(((d**2).sum(axis=2) <= 1.0).sum())
    assert got == want
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "__qi" in text and "__pi" in text


def test_nearest_with_ties(spark):
    grid = [(i, "c", float(i % 7), float(i // 7), f"g{i % 3}") for i in range(49)]
    points = spark.createDataFrame(grid, "point_id bigint, cell string, x double, y double, g string")
    got = {}
    for r in spatial_join.nearest(points, "cell", 6, ["g"], block=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["point_id"]
    for i, _, x, y, _ in grid:
        want = sorted(grid, key=lambda p: ((p[2] - x) ** 2 + (p[3] - y) ** 2, p[2], p[3], p[4], p[0]))[:6]
        assert [got[i][k] for k in range(1, 7)] == [p[0] for p in want]


def test_parafac_by_joins_is_the_same(spark):
    """The distributed updates give the driver's factors, from the same start; and larger tensors take that way."""
    rng = np.random.default_rng(2)
    full = np.round(rng.uniform(0, 2, (2, 5, 4)) * (rng.random((2, 5, 4)) < 0.7), 3)
    coords = np.argwhere(full > 0)
    values = full[full > 0]
    begun = [rng.random((n, 2)) + 0.1 for n in full.shape]
    want, error = coloc.parafac(coords, values, full.shape, 2, 0, iterations=4, start=[b.copy() for b in begun])
    entries = spark.createDataFrame([(f"c{a}", f"i{b}", f"p{c}|q{c}", float(v)) for (a, b, c), v in zip(coords, values)], "compartment string, instance string, pair string, value double")
    names = [lambda i: f"c{i}", lambda i: f"i{i}", lambda i: f"p{i}|q{i}"]
    start = [spark.createDataFrame([(name(i), [float(x) for x in row]) for i, row in enumerate(f)], "label string, f array<double>") for name, f in zip(names, begun)]
    got, mine = coloc.parafac_joins(entries, 2, 0, iterations=4, start=start)
    assert mine == pytest.approx(error, rel=1e-9)
    for name, f, w in zip(names, got, want):
        assert {r["label"]: pytest.approx(r["f"], rel=1e-9) for r in f.collect()} == {name(i): list(row) for i, row in enumerate(w)}


def test_decompose_of_any_size(spark):
    tensor = spark.createDataFrame([("k", f"i{b}", f"f{c}", f"f{d}", float((b + 1) * (c + 1) * (d + 1))) for b in range(3) for c in range(2) for d in range(2)], "compartment string, cell string, gene string, neighbor string, value double")
    for most in (100, 5):
        factors, errors = coloc.decompose(tensor, "cell", "gene", [1], 1, max_entries=most)
        assert errors.first()["rmse"] < 1e-3 and {r["mode"]: r["count"] for r in factors.groupBy("mode").count().collect()} == {"compartment": 1, "instance": 3, "pair": 4}
        top = plotdata.factor_loadings(factors, 1, "pair", 5).collect()
        assert sorted(r["label"] for r in top) == ["f0|f1", "f1|f0"]
        assert plotdata.factor_loadings(factors, 1, "pair", 1, self_pairs=True).first()["label"] == "f1|f1"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flux_counts_once(ds):
    """The raster reads what was counted, its numbers are those of the joins, and a shape without grid points has its centroid."""
    small = ds.with_shapes(CELL, ds.shapes[CELL].unionByName(ds.shapes[CELL].filter("shape_id = 'c2'").select(F.lit("c3").alias("shape_id"), F.expr("transform(rings, g -> transform(g, p -> named_struct('x', 200.3 + (p.x - 200) / 50, 'y', 0.3 + p.y / 50)))").alias("rings")), allowMissingColumns=True))
    out = flux.flux(small, radius=3.0, res=0.5).points[f"{CELL}_raster"]
    assert not any(x in plan(out) for x in ("Join", "Aggregate", "InMemoryRelation"))
    raster = shape_features.raster(small.shapes[CELL], 2.0).withColumnRenamed("shape_id", CELL).withColumn("pixel_id", F.xxhash64(CELL, "x", "y"))
    assert rows(out, CELL, F.round("x", 9), F.round("y", 9), "pixel_id")[:75] == rows(raster, CELL, F.round("x", 9), F.round("y", 9), "pixel_id")[:75] and out.count() == raster.count() == 76
    points = small.points["transcripts"].filter(F.col(CELL).isNotNull())
    near = flux.pixel_counts(points, raster, CELL, GENE, 3.0)
    long = flux.flux_long(near, flux.composition(points, CELL, GENE), CELL, GENE)
    want = {(r["pixel_id"], r[GENE]): r["flux"] for r in long.collect()}
    assert {r["pixel_id"]: r["total"] for r in near.collect()} == {r["pixel_id"]: r["flux_counts"] for r in out.collect() if r["flux_counts"]}
    for r in out.collect():
        assert r["flux"] == pytest.approx([want.get((r["pixel_id"], g), 0.0) for g in ("g1", "g2")], abs=1e-9)
    knn = flux.flux(small, method="knn", n_neighbors=2, res=0.5).points[f"{CELL}_raster"]
    assert sorted(r["flux_counts"] for r in knn.collect()) == [0] * 26 + [2] * 50


def test_fluxmap_makes_domains_once(ds, monkeypatch):
    """Whether domains can meet is asked once, of the cells; the table of all domains reads the pixels once."""
    asked = []
    whole = spatial_join.overlapping
    for module in (spatial_join, flux):
        monkeypatch.setattr(module, "overlapping", lambda *a, **k: asked.append(a) or whole(*a, **k), raising=False)
    out = flux.fluxmap(flux.flux(ds, radius=3.0, res=0.5), n_clusters=3, min_count=1, num_iterations=50)
    assert len(asked) == 1
    domains = out.tables["fluxmap"]
    assert domains.count() == 9
    for i in (1, 2, 3):
        assert rows(domains.filter(F.col("label") == i), "shape_id", "rings") == rows(out.shapes[f"fluxmap{i}"], "shape_id", "rings")


def test_enrichment_of_equal_sets(ds):
    """Sets with the same weights are scored once and share the score; others have their own."""
    out = flux.flux(ds, radius=3.0, res=0.5)
    net = ds.points["transcripts"].sparkSession.createDataFrame([("s", "g1", 1.0), ("t", "g1", 1.0), ("u", "g2", -1.0)], "source string, target string, weight double")
    scored = flux.fe(out, net, times=20).points[f"{CELL}_raster"]
    assert "Join" not in plan(scored)
    orders = [np.random.Generator(np.random.PCG64(42))]
    orders = [orders[0].permutation(2) for _ in range(20)]
    for r in scored.collect():
        x = np.array(r["flux"])
        for name, w in (("s", [1.0, 0.0]), ("t", [1.0, 0.0]), ("u", [0.0, -1.0])):
            w = np.array(w)
            p = max(1, sum(abs(x @ w[o]) >= abs(x @ w) - 1e-12 for o in orders)) / 20
            assert r[f"flux_{name}"] == pytest.approx(x @ w * -np.log10(p), abs=1e-9)


def test_parafac_updates_by_entry_and_by_cell():
    """Dense blocks, entries and the plain sums over entries give the same factors."""
    rng = np.random.default_rng(3)
    for fill in (0.9, 0.2):
        full = rng.normal(0.5, 1, (2, 7, 5)) * (rng.random((2, 7, 5)) < fill)
        coords, values = np.argwhere(full != 0), full[full != 0]
        begun = [rng.random((n, 2)) + 0.1 for n in full.shape]
        tensor = coloc._Unfolded(coords, values, full.shape, block=8)
        assert tensor.dense == (fill > 0.5)
        got, error = coloc.parafac(coords, values, full.shape, 2, 0, iterations=3, start=[b.copy() for b in begun])
        scale = (np.abs(values).sum() / np.prod([f.sum(axis=0) for f in begun], axis=0).sum()) ** (1 / 3)
        want = [f * scale for f in begun]
        for _ in range(3):
            for mode, spec in enumerate(("abc,br,cr->ar", "abc,ar,cr->br", "abc,ar,br->cr")):
                u, v = (want[m] for m in range(3) if m != mode)
                want[mode] = want[mode] * np.einsum(spec, np.maximum(full, 0), u, v) / np.maximum(want[mode] @ ((u.T @ u) * (v.T @ v)), 1e-12)
        model = np.einsum("ar,br,cr->abc", *want)
        assert error == pytest.approx(np.abs(full - model)[full != 0].mean(), rel=1e-9)
        for g, w in zip(got, want):
            assert g == pytest.approx(w, rel=1e-9)


def test_decompose_does_not_collect_the_tensor(spark, monkeypatch):
    """Starts are factored in tasks; an empty tensor has no factors."""
    tensor = spark.createDataFrame([("k", f"i{b}", f"f{c}", f"f{d}", float(b + c + d + 1)) for b in range(3) for c in range(2) for d in range(2)], "compartment string, cell string, gene string, neighbor string, value double")
    collected = []
    whole = type(tensor).collect
    monkeypatch.setattr(type(tensor), "collect", lambda self: collected.append(whole(self)) or collected[-1])
    factors, _ = coloc.decompose(tensor, "cell", "gene", [1, 2], 2)
    assert max(map(len, collected)) < 12
    monkeypatch.undo()
    assert factors.groupBy("rank").count().count() == 2 and factors.count() == 8 * 3
    assert coloc.decompose(tensor.limit(0), "cell", "gene", [1], 2)[0].count() == 0


def test_neighbours_are_counted_square_by_square(spark, monkeypatch):
    """A cell over several squares, in small steps, counts as all pairs of its points do; no join makes the pairs."""
    monkeypatch.setattr(coloc, "TESTED", 50)
    rng = np.random.default_rng(5)
    xy = np.round(np.concatenate([rng.uniform(-20, 60, (120, 2)), np.repeat([[16.0, 16.0]], 30, axis=0)]) * 4) / 4
    rows = [(i, str(i % 2), float(x), float(y), None if i % 17 == 0 else "abc"[i % 3], bool(i % 5)) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "point_id long, cell string, x double, y double, gene string, inner boolean")
    out = coloc.quotients(points, {"all": F.lit(True), "inner": F.col("inner")}, "cell", "gene", 1.0, 2, 0, False)
    assert "__pi" not in plan(out)
    want = {}
    for where in ("all", "inner"):
        for cell in "01":
            mine = [p for p in rows if p[1] == cell and (where == "all" or p[5])]
            n = {g: sum(p[4] == g for p in mine) for g in "abc"}
            for f in "abc":
                for g in "abc":
                    a = sum(any(q[4] == g and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 1 for q in mine) for p in mine if p[4] == f)
                    if a:
                        want[where, cell, f, g] = pytest.approx((a / n[f]) / (n[g] / len(mine)))
    assert {(r["compartment"], r["cell"], r["gene"], r["neighbor"]): r["clq"] for r in out.collect()} == want


def test_parafac_by_blocks_is_the_same(spark, monkeypatch):
    """Written blocks give the factors of joins, all runs at once; tensors with too many labels for the driver still go by joins."""
    rng = np.random.default_rng(4)
    full = rng.normal(0.5, 1, (2, 9, 4)) * (rng.random((2, 9, 4)) < 0.7)
    tensor = spark.createDataFrame([(f"k{a}", f"i{b}", f"f{c // 2}", f"g{c % 2}", float(full[a, b, c])) for a, b, c in np.argwhere(full)], "compartment string, cell string, gene string, neighbor string, value double")
    monkeypatch.setattr(coloc, "BLOCK", 15)
    kinds = [tuple(r) for r in tensor.select("compartment", "gene", "neighbor").distinct().collect()]
    modes = sorted({k[0] for k in kinds}), sorted({k[1:] for k in kinds})
    blocks = coloc.materialize(coloc._blocks(tensor, tensor.count(), "cell", kinds, modes), "test")
    assert blocks.count() > 1
    pairs = [f"{a}|{b}" for a, b in modes[1]]
    names, done = coloc.parafac_blocks(blocks, (modes[0], pairs), [(1, 3), (2, 5)], iterations=2)
    entries = tensor.select("compartment", F.col("cell").alias("instance"), F.concat_ws("|", "gene", "neighbor").alias("pair"), "value").persist()
    want, wrong = coloc.parafac_joins(entries, 2, 5, iterations=2)
    got, error = done[1]
    assert error == pytest.approx(wrong, rel=1e-9)
    for labels, f, w in zip((modes[0], names, pairs), got, want):
        assert {r["label"]: pytest.approx(r["f"], rel=1e-9) for r in w.collect()} == dict(zip(labels, map(list, f)))
    _, [(alone, error)] = coloc.parafac_blocks(blocks, (modes[0], pairs), [(1, 3)], iterations=2)
    assert error == pytest.approx(done[0][1], rel=1e-9) and all(f == pytest.approx(g, rel=1e-9) for f, g in zip(alone, done[0][0]))
    few = coloc.parafac_blocks
    monkeypatch.setattr(coloc, "parafac_blocks", lambda *args: few(*args, iterations=2))
    by = []
    monkeypatch.setattr(coloc, "_decompose_joins", lambda *args: by.append("joins"))
    whole = coloc.decompose(tensor, "cell", "gene", [1, 2], 1, max_entries=5)
    assert not by and whole[0].count() == (2 + 9 + 4) * 3
    monkeypatch.setattr(coloc, "FACTORS", 20)
    coloc.decompose(tensor, "cell", "gene", [1, 2], 1, max_entries=5)
    assert by == ["joins"]
