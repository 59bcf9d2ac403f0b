"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from spotweave.plans.oracles import ORACLES
from spotweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "part", "supplier"]
FAST = [
    "point_in_cell", "point_in_nucleus", "sync_points", "cell_gene_counts", "dense_counts", "filter_by_gene", "shape_map_1to1", "shape_map_1tomany", "cell_area", "cell_bounds", "cell_span", "cell_radius", "cell_density",
    "cell_aspect_ratio", "cell_second_moment", "overlay_union", "pf_proximity", "pf_offset", "pf_point_dispersion_norm", "pf_ripley", "neighbors_radius_counts", "neighbors_gene", "clq_log_ci", "comp", "comp_diff",
    "lp_stats", "lp_top_pattern", "lp_logfc", "lp_diff_continuous", "flux_scaled", "fe_stats", "radviz_xy", "factor_topn", "kde2d",
    "shape_stats", "points_metadata", "shape_metadata", "sync_shapes", "outside_mask", "default_radius", "annotate_points", "dataset_round_trip", "flux_knn", "flux_gram",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)

    def value(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float, np.number)) else v

    return columns, sorted((tuple(map(value, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 250 and out.columns[:3] == ["cell_boundaries", "feature_name", "n"]


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
