"""The registered queries: each operator on the fixture dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coloc, composition, flux, neighbors, overlay, patterns, plotdata, point_features, prep, shape_features, spatial_join
from ..dataset import SpatialDataset
from ..functions import geom
from ..sources import fixture as fx
from ..sources import io
from ..sources.scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: Column | str) -> Column:
    """Six digits; -0 is 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir).points[fx.POINTS]


@query
def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = prep.unique_ids(fx.raw_shapes(spark, sf_dir)[fx.CELL])
    return spatial_join.points_in_shapes(fx.raw_points(spark, sf_dir), shapes, fx.CELL).drop("point_id")


@query
def point_in_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = prep.unique_ids(fx.raw_shapes(spark, sf_dir)[fx.NUCLEUS])
    return spatial_join.points_in_shapes(fx.raw_points(spark, sf_dir), shapes, fx.NUCLEUS).drop("point_id")


@query
def sync_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.get_points(fx.load(spark, sf_dir), fx.POINTS).select("x", "y", fx.GENE, fx.CELL, fx.NUCLEUS)


@query
def cell_gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir).tables["table"]


@query
def dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.dense_counts(fx.load(spark, sf_dir).tables["table"], fx.CELL, fx.GENE)


@query
def filter_by_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.filter_by_gene(fx.load(spark, sf_dir), 38).tables["table"]


@query
def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.bounding_box(fx.load(spark, sf_dir), 100, 50, 700, 150).points[fx.POINTS].select("x", "y", fx.GENE, fx.CELL)


@query
def shape_map_1to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.get_shape_metadata(fx.load(spark, sf_dir), fx.CELL, fx.NUCLEUS)


@query
def shape_map_1tomany(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {k: prep.unique_ids(s) for k, s in fx.raw_shapes(spark, sf_dir).items()}
    up, _ = spatial_join.map_shapes(shapes[fx.CELL], shapes[fx.NUCLEUS], "1tomany")
    return spatial_join.merge_children(shapes[fx.NUCLEUS], up).select("shape_id", F.size("rings").cast("long").alias("n_rings"))


@query
def shape_columns_on_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = fx.load(spark, sf_dir)
    wide = prep.with_shape_columns(ds.points[fx.POINTS], ds.shapes[fx.CELL], fx.CELL, ["phenotype", "acctbal"])
    return wide.groupBy(fx.GENE, "phenotype").agg(F.count("*").alias("n"), (F.round(F.sum("acctbal"), 2) + 0.0).alias("acctbal"))


def _shape_query(name: str, key: str, feature: str, columns: list[str], exact: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shapes = shape_features.analyze_shapes(fx.load(spark, sf_dir), key, feature).shapes[key]
        return shapes.select("shape_id", *(F.col(f"{key}_{c}") if exact else r(f"{key}_{c}").alias(f"{key}_{c}") for c in columns))

    run.__name__ = name
    query(run)


_shape_query("cell_area", fx.CELL, "area", ["area"])
_shape_query("cell_centroid", fx.CELL, "centroid", ["centroid_x", "centroid_y"])
_shape_query("cell_perimeter", fx.CELL, "perimeter", ["perimeter"])
_shape_query("cell_bounds", fx.CELL, "bounds", ["minx", "miny", "maxx", "maxy"], exact=True)
_shape_query("cell_radius", fx.CELL, "radius", ["radius"])
_shape_query("cell_span", fx.CELL, "span", ["span"], exact=True)
_shape_query("cell_density", fx.CELL, "density", ["density"])
_shape_query("cell_second_moment", fx.CELL, "second_moment", ["moment"])
_shape_query("cell_aspect_ratio", fx.NUCLEUS, "aspect_ratio", ["aspect_ratio"])


@query
def cell_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_features.raster(fx.load(spark, sf_dir).shapes[fx.CELL]).groupBy("shape_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query
def cell_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = shape_features.analyze_shapes(fx.load(spark, sf_dir), fx.CELL, "opening", {"opening": {"proportion": 0.5}})
    out = f"{fx.CELL}_open_0.5_shape"
    return ds.shapes[fx.CELL].select("shape_id", r(geom.area(geom.edges(F.col(f"`{out}`")))).alias("area"), r(geom.area(geom.edges(F.col("rings")))).alias("whole"))


def _overlay_query(how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = fx.load(spark, sf_dir)
        out = overlay.overlay_shapes(ds.shapes[fx.CELL], ds.shapes[fx.NUCLEUS], how)
        return out.select("shape_id", r(geom.area(geom.edges(F.col("rings")))).alias("area"))

    run.__name__ = f"overlay_{how}"
    query(run)


for _how in overlay.HOWS:
    _overlay_query(_how)


def _feature_query(name: str, feature: str, columns: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = point_features.analyze_points(fx.load(spark, sf_dir), [fx.CELL, fx.NUCLEUS], feature, fx.GENE)
        table = ds.tables[f"{fx.CELL}_{fx.GENE}_features"]
        keys = [fx.CELL, fx.GENE]
        return table.select(*keys, *(r(c).alias(c) for c in (columns or [c for c in table.columns if c not in keys])))

    run.__name__ = name
    query(run)


for _name in ("proximity", "asymmetry", "distance", "offset", "point_dispersion", "point_dispersion_norm", "shape_dispersion", "shape_dispersion_norm"):
    _feature_query(f"pf_{_name}", _name)
_feature_query("pf_enrichment", "shape_enrichment")
_feature_query("pf_ripley", "ripley")


@query
def pf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = point_features.analyze_points(fx.load(spark, sf_dir), [fx.CELL, fx.NUCLEUS], list(point_features.all_features()), fx.GENE)
    table = ds.tables[f"{fx.CELL}_{fx.GENE}_features"]
    keys = [fx.CELL, fx.GENE]
    return table.select(*keys, *(r(c).alias(c) for c in table.columns if c not in keys))


RADIUS = 5.0


@query
def neighbors_radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.neighbor_pairs(_points(spark, sf_dir), fx.CELL, fx.GENE, radius=RADIUS)
    return pairs.groupBy(fx.CELL, F.col(f"q_{fx.GENE}").alias("source"), F.col(fx.GENE).alias("neighbor")).agg(F.count("*").alias("n"))


@query
def neighbors_radius_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbors.count_neighbors(_points(spark, sf_dir), fx.CELL, fx.GENE, radius=RADIUS, agg="binary")
    return found.groupBy(fx.CELL, fx.GENE).agg(F.sum("n").alias("n"))


@query
def neighbors_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbors.count_neighbors(_points(spark, sf_dir), fx.CELL, fx.GENE, n_neighbors=3)
    return found.groupBy(fx.CELL, fx.GENE).agg(F.sum("n").alias("n"))


@query
def neighbors_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.count_neighbors(_points(spark, sf_dir), fx.CELL, fx.GENE, radius=RADIUS, agg="feature")


def _clq(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    return coloc.coloc_quotient(fx.load(spark, sf_dir), [fx.CELL, fx.NUCLEUS], radius=RADIUS, min_points=4)


@query
def clq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clq(spark, sf_dir).tables["clq"].select("compartment", fx.GENE, "neighbor", fx.CELL, r("clq").alias("clq"))


@query
def clq_log_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clq(spark, sf_dir).tables["clq"].select("compartment", fx.GENE, "neighbor", fx.CELL, *(r(c).alias(c) for c in ("ci_lower", "ci_upper", "log_clq", "log_ci_lower", "log_ci_upper")))


@query
def coloc_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tensor = coloc.colocation_tensor(_clq(spark, sf_dir).tables["clq"], fx.CELL, fx.GENE)
    return tensor.select("compartment", fx.CELL, fx.GENE, "neighbor", r("value").alias("value"))


@query
def parafac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloc.colocation(_clq(spark, sf_dir), range(1, 3), 1).tables["factors"]


@query
def comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = composition.comp(fx.load(spark, sf_dir), [fx.CELL, fx.NUCLEUS]).tables["comp_stats"]
    return out.select(fx.GENE, *(r(c).alias(c) for c in (fx.CELL, fx.NUCLEUS, "logcounts", "cell_fraction")))


@query
def comp_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = fx.load(spark, sf_dir)
    ds = ds.with_points(fx.POINTS, prep.with_shape_columns(ds.points[fx.POINTS], ds.shapes[fx.CELL], fx.CELL, ["phenotype"]))
    return composition.comp_diff(ds, [fx.CELL, fx.NUCLEUS], "phenotype", "A").tables["comp_diff"].withColumn("distance", r("distance"))


def stand_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lp, lpp) of probabilities made of counts, in place of a trained model."""
    n, nuc = F.col("__n"), F.col("__nuc")
    table = _points(spark, sf_dir).groupBy(fx.CELL, fx.GENE).agg(F.count("*").alias("__n"), F.count(fx.NUCLEUS).alias("__nuc"))
    p = {"cell_edge": n % 7 / 7.0, "cytoplasmic": 1 - nuc / n, "none": n % 5 / 5.0, "nuclear": nuc / n, "nuclear_edge": nuc % 3 / 3.0}
    return patterns.threshold(table.withColumns({f"{k}_p": v for k, v in p.items()}), [fx.CELL, fx.GENE])


@query
def lp_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir)[0].select(fx.CELL, fx.GENE, *(F.col(p).cast("int").alias(p) for p in patterns.PATTERNS))


@query
def lp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.lp_stats(*stand_in(spark, sf_dir), [fx.CELL, fx.GENE], fx.GENE)[0]


@query
def lp_top_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.lp_stats(*stand_in(spark, sf_dir), [fx.CELL, fx.GENE], fx.GENE)[1]


def _phenotypes(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return fx.load(spark, sf_dir).shapes[fx.CELL].select(F.col("shape_id").alias(fx.CELL), F.col(column).alias("phenotype"))


@query
def lp_logfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.lp_logfc(stand_in(spark, sf_dir)[0], _phenotypes(spark, sf_dir, "phenotype"), fx.CELL, fx.GENE).withColumn("log2fc", r("log2fc"))


@query
def lp_diff_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.lp_diff_discrete(stand_in(spark, sf_dir)[0], _phenotypes(spark, sf_dir, "phenotype"), fx.CELL, fx.GENE)


@query
def lp_diff_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patterns.lp_diff_continuous(stand_in(spark, sf_dir)[1], _phenotypes(spark, sf_dir, "acctbal"), fx.CELL, fx.GENE)
    return out.withColumn("pearson_correlation", r("pearson_correlation"))


@query
def lp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.lp(fx.load(spark, sf_dir), patterns.rule_model(fx.CELL, fx.NUCLEUS), fx.NUCLEUS).tables["lp"]
    return found.select(fx.CELL, fx.GENE, *(F.col(p).cast("int").alias(p) for p in patterns.PATTERNS))


@query
def upset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.upset_counts(stand_in(spark, sf_dir)[0])


@query
def lp_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plotdata.lp_genes(stand_in(spark, sf_dir)[0], fx.load(spark, sf_dir).tables["table"], fx.CELL, fx.GENE)
    return out.select(fx.GENE, *(r(c).alias(c) for c in out.columns if c != fx.GENE))


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux on a raster of step 8, a row for each pixel and feature."""
    ds = fx.load(spark, sf_dir)
    pixels = shape_features.raster(ds.shapes[fx.CELL], 8.0).withColumnRenamed("shape_id", fx.CELL).withColumn("pixel_id", F.xxhash64(fx.CELL, "x", "y"))
    near = flux.pixel_counts(ds.points[fx.POINTS], pixels, fx.CELL, fx.GENE, RADIUS)
    return flux.flux_long(near, flux.composition(ds.points[fx.POINTS], fx.CELL, fx.GENE), fx.CELL, fx.GENE)


@query
def flux_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.composition(_points(spark, sf_dir), fx.CELL, fx.GENE).select(fx.CELL, fx.GENE, "n", r("share").alias("share"))


@query
def flux_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thin(spark, sf_dir).select(fx.CELL, "x", "y", fx.GENE, r("flux").alias("flux"))


@query
def fe_wsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.weighted_sums(_thin(spark, sf_dir), fx.gene_sets(spark, sf_dir), [fx.CELL], fx.GENE).withColumn("score", r("score"))


@query
def fe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.fe_stats(fx.gene_sets(spark, sf_dir), fx.load(spark, sf_dir).tables["table"], fx.CELL, fx.GENE, 20)


@query
def fe_ngenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.fe_ngenes(fx.gene_sets(spark, sf_dir), fx.load(spark, sf_dir).tables["table"], fx.GENE)


_fluxes: dict[tuple[str, str], SpatialDataset] = {}


def _flux(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fluxes:
        _fluxes[key] = flux.flux(fx.load(spark, sf_dir), radius=RADIUS)
    return _fluxes[key]


@query
def flux_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flux(spark, sf_dir).points[f"{fx.CELL}_raster"].select(fx.CELL, "x", "y", "flux_embed", "flux_counts", "flux_color")


_maps: dict[tuple[str, str], SpatialDataset] = {}


def _fluxmap(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _maps:
        _maps[key] = flux.fluxmap(_flux(spark, sf_dir), n_clusters=3, min_count=1)
    return _maps[key]


@query
def fluxmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fluxmap(spark, sf_dir).points[f"{fx.CELL}_raster"].select(fx.CELL, "x", "y", "fluxmap")


@query
def fluxmap_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = _fluxmap(spark, sf_dir).tables["fluxmap"]
    return domains.select("shape_id", "label", F.size("rings").alias("n_rings"), r(geom.area(geom.edges(F.col("rings")))).alias("area"))


@query
def fe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _flux(spark, sf_dir)
    ds = flux.fe(base, fx.gene_sets(spark, sf_dir), min_n=5)
    key = f"{fx.CELL}_raster"
    return ds.points[key].select(fx.CELL, "x", "y", *[c for c in ds.points[key].columns if c not in base.points[key].columns])


@query
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.hist2d(_points(spark, sf_dir), 16)


@query
def kde2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.kde2d(_points(spark, sf_dir), 16, 16).withColumn("density", r(F.col("density") * 1e6))


@query
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plotdata.quantiles(fx.load(spark, sf_dir).tables["table"], [fx.GENE], "n")
    return out.select(fx.GENE, *(r(c).alias(c) for c in out.columns if c != fx.GENE))


def _gene_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.count(fx.NUCLEUS).cast("double")
    return _points(spark, sf_dir).groupBy(fx.GENE).agg(inside.alias("a"), (F.count("*") - inside).alias("b"), F.count_distinct(fx.CELL).cast("double").alias("c"))


@query
def entropy_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.entropy_topn(_gene_sums(spark, sf_dir), fx.GENE, ["a", "b"], 10).withColumn("entropy", r("entropy"))


@query
def radviz_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.radviz(_gene_sums(spark, sf_dir), fx.GENE, ["a", "b", "c"]).select(fx.GENE, r("rx").alias("rx"), r("ry").alias("ry"))


@query
def factor_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = plotdata.zscored(fx.load(spark, sf_dir).tables["table"], [fx.GENE], "n").withColumn("z", r("z"))
    return plotdata.top_n(z, [fx.GENE], "z", fx.CELL, 3).select(fx.GENE, fx.CELL, "z", "rank")


@query
def shape_stats_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = shape_features.analyze_shapes(fx.load(spark, sf_dir), fx.CELL, ["area", "perimeter"]).shapes[fx.CELL]
    return plotdata.melted(shapes, ["shape_id"], [f"{fx.CELL}_area", f"{fx.CELL}_perimeter"]).withColumn("value", r("value"))


@query
def nearest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).groupBy("x", "y").agg(F.min(fx.GENE).alias("gene"))
    return plotdata.nearest_image(points, "gene", 8)


@query
def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = shape_features.shape_stats(fx.load(spark, sf_dir))
    parts = [ds.shapes[k].select(F.lit(k).alias("shape"), "shape_id", *(r(f"{k}_{c}").alias(c) for c in ("area", "aspect_ratio")), r(F.coalesce(f"{k}_density", F.lit(0.0))).alias("density")) for k in (fx.CELL, fx.NUCLEUS)]
    return parts[0].unionByName(parts[1])


@query
def points_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns attached to points by their id, and read again."""
    ds = fx.load(spark, sf_dir)
    values = ds.points[fx.POINTS].filter(F.col(fx.NUCLEUS).isNotNull()).select("point_id", F.lit(1).alias("mark"), F.col("x").alias("value"))
    ds = prep.set_points_metadata(ds, fx.POINTS, values)
    found = prep.get_points_metadata(ds, fx.POINTS, [fx.GENE, "mark", "value"])
    return found.groupBy(fx.GENE).agg(F.count("*").alias("n"), F.count("mark").alias("marked"), r(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"))


@query
def shape_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of nuclei attached to their cells, and read again."""
    ds = shape_features.analyze_shapes(fx.load(spark, sf_dir), fx.NUCLEUS, "area")
    values = ds.shapes[fx.NUCLEUS].select(F.col(fx.CELL).alias("shape_id"), r(f"{fx.NUCLEUS}_area").alias("nucleus_area")).filter("shape_id is not null")
    return prep.get_shape_metadata(prep.set_shape_metadata(ds, fx.CELL, values), fx.CELL, "nucleus_area")


@query
def sync_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nuclei of the cells of one phenotype."""
    ds = fx.load(spark, sf_dir)
    ds = prep.sync_shapes(ds.with_shapes(fx.CELL, ds.shapes[fx.CELL].filter("phenotype = 'A'")), fx.NUCLEUS)
    return ds.shapes[fx.NUCLEUS].select("shape_id", fx.CELL)


@query
def outside_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geom.bounds(F.col("rings"))
    mask = overlay.outside_mask(fx.load(spark, sf_dir).shapes[fx.CELL], 5.0)
    ends = [f(b[k]).alias(k) for k, f in (("minx", F.min), ("maxx", F.max), ("miny", F.min), ("maxy", F.max))]
    return mask.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("rings")).cast("long").alias("rings"), *ends)


@query
def default_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = fx.load(spark, sf_dir)
    found = [round(flux.resolve_radius(ds, x), 6) for x in (None, 0.5, 7.0)]
    return spark.createDataFrame([found], "third double, half double, given double")


@query
def annotate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = patterns.lp_stats(*stand_in(spark, sf_dir), [fx.CELL, fx.GENE], fx.GENE)[1]
    points = patterns.annotate_points(_points(spark, sf_dir), top, [fx.CELL, fx.GENE])
    return points.groupBy("pattern", F.col(fx.NUCLEUS).isNotNull().alias("nuclear")).agg(F.count("*").alias("n"))


@query
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset written to the shared folder and read again."""
    path = new_path(spark, "dataset")
    io.write_dataset(fx.load(spark, sf_dir), path, buckets=8)
    ds = io.read_dataset(spark, path)
    return prep.count_table(ds.points[fx.POINTS], ds.attrs["instance_key"], ds.attrs["feature_key"])


def _thin_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = shape_features.raster(fx.load(spark, sf_dir).shapes[fx.CELL], 8.0)
    return pixels.withColumnRenamed("shape_id", fx.CELL).withColumn("pixel_id", F.xxhash64(fx.CELL, "x", "y"))


@query
def flux_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest points around each pixel of a raster of step 8, by feature."""
    near = flux.pixel_counts(_points(spark, sf_dir), _thin_pixels(spark, sf_dir), fx.CELL, fx.GENE, None, 5)
    return near.select(fx.CELL, "x", "y", F.explode("counts").alias(fx.GENE, "n"))


@query
def flux_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the truncated SVD is taken of: the features' products summed over pixels."""
    long = _thin(spark, sf_dir)
    names = [x[0] for x in long.select(fx.GENE).distinct().orderBy(fx.GENE).collect()]
    wide = long.groupBy("pixel_id").agg(F.map_from_entries(F.collect_list(F.struct(fx.GENE, "flux"))).alias("m"))
    vectors = wide.select(F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at("m", n), F.lit(0.0))).alias("v"))
    found, _, _ = flux.gram(vectors, "v")
    rows = [(a, b, round(float(found[i, j]), 6) + 0.0) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, f"{fx.GENE} string, other string, v double")


@query
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fx.load(spark, sf_dir).tables["table"]
    return prep.count_matrix(table, fx.CELL, fx.GENE, [r[0] for r in table.select(fx.GENE).distinct().orderBy(fx.GENE).collect()])


@query
def label_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' pixels as a label image, and its shapes again."""
    image = shape_features.raster(fx.load(spark, sf_dir).shapes[fx.CELL]).select(F.col("shape_id").alias("image"), "x", "y", F.lit(1).alias("label"))
    return flux.labels_to_shapes(image).select("shape_id", r(geom.area(geom.edges(F.col("rings")))).alias("area"))


@query
def gene_set_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene sets written as CSV to the shared folder and read by name."""
    path = new_path(spark, "sets")
    fx.gene_sets(spark, sf_dir).write.option("header", True).csv(path)
    return io.read_gene_sets(spark, {"types": path}, "types")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to cells, then counts, centroid and dispersion by cell and gene."""
    points = _points(spark, sf_dir)
    return points.groupBy(fx.CELL, fx.GENE).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), r(F.var_pop("x") + F.var_pop("y")).alias("dispersion"))
