"""The registered queries in SQL (DuckDB), from the base tables up, by other means than the operators: plain joins, no tiles."""

from __future__ import annotations

from ..operators.patterns import PATTERNS, THRESHOLDS, feature_columns
from ..sources.fixture import CELL_RING, NUCLEUS_RING

_TEMPLATE = ", ".join(f"('{s}', {i}, {x}, {y})" for s, ring in (("cell", CELL_RING), ("nuc", NUCLEUS_RING)) for i, (x, y) in enumerate(ring))
_SEGMENT = "least(1.0, greatest(0.0, ((p.x-e.ax)*(e.bx-e.ax)+(p.y-e.ay)*(e.by_-e.ay))/((e.bx-e.ax)*(e.bx-e.ax)+(e.by_-e.ay)*(e.by_-e.ay))))"
_PARITY = "sum(CASE WHEN ((e.ay>p.y)<>(e.by_>p.y)) AND p.x < (e.bx-e.ax)*(p.y-e.ay)/nullif(e.by_-e.ay,0)+e.ax THEN 1 ELSE 0 END) % 2 = 1"

SHAPES = f"""tmpl(shape, i, vx, vy) AS (VALUES {_TEMPLATE}),
sup AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS cell, CAST((s_suppkey % 32)*64 AS DOUBLE) AS ox, CAST((s_suppkey // 32)*64 AS DOUBLE) AS oy,
  CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS phenotype, CAST(s_acctbal AS DOUBLE) AS acctbal FROM supplier),
vert AS (SELECT shape, CASE WHEN shape='cell' THEN cell ELSE 'n'||cell END AS id, cell, i, ox+vx+1.0::DOUBLE/256 AS x, oy+vy+1.0::DOUBLE/512 AS y
  FROM sup, tmpl WHERE shape='cell' OR k % 5 <> 0),
edge AS MATERIALIZED (SELECT a.shape, a.id, a.cell, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM vert a JOIN vert b ON a.shape=b.shape AND a.id=b.id AND b.i=(a.i+1)%8),
org AS (SELECT shape, id, x AS x0, y AS y0 FROM vert WHERE i=0),
geo AS MATERIALIZED (SELECT e.shape, e.id, any_value(e.cell) AS cell, sum((ax-x0)*(by_-y0)-(bx-x0)*(ay-y0))/2 AS area,
  any_value(x0)+sum((ax+bx-2*x0)*((ax-x0)*(by_-y0)-(bx-x0)*(ay-y0)))/(3*sum((ax-x0)*(by_-y0)-(bx-x0)*(ay-y0))) AS cx,
  any_value(y0)+sum((ay+by_-2*y0)*((ax-x0)*(by_-y0)-(bx-x0)*(ay-y0)))/(3*sum((ax-x0)*(by_-y0)-(bx-x0)*(ay-y0))) AS cy,
  sum(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay))) AS perimeter FROM edge e JOIN org o ON e.shape=o.shape AND e.id=o.id GROUP BY e.shape, e.id),
bb AS MATERIALIZED (SELECT shape, id, any_value(cell) AS cell, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vert GROUP BY shape, id),
rad AS (SELECT v.shape, v.id, any_value(v.cell) AS cell, sum(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))*(CASE WHEN i=0 THEN 2 ELSE 1 END))/9 AS radius FROM vert v JOIN geo g ON v.shape=g.shape AND v.id=g.id GROUP BY v.shape, v.id)"""

RAW = """raw AS MATERIALIZED (SELECT row_number() OVER () AS pid, CAST((l_suppkey % 32)*64 AS DOUBLE)+CAST(l_quantity AS DOUBLE)+CAST(l_linenumber AS DOUBLE)/8 AS x,
  CAST((l_suppkey // 32)*64 AS DOUBLE)+CAST(CAST(round(l_extendedprice*100) AS BIGINT) % 6400 AS DOUBLE)/128 AS y, p_brand AS gene FROM lineitem JOIN part ON l_partkey=p_partkey)"""

POINTS = f"""{RAW},
hit AS MATERIALIZED (SELECT p.pid, e.shape, e.id FROM raw p JOIN bb ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 JOIN edge e ON e.shape=bb.shape AND e.id=bb.id GROUP BY p.pid, e.shape, e.id HAVING {_PARITY}),
pts AS MATERIALIZED (SELECT r.pid, r.x, r.y, r.gene, c.id AS cell, n.id AS nuc FROM raw r JOIN hit c ON c.pid=r.pid AND c.shape='cell' LEFT JOIN hit n ON n.pid=r.pid AND n.shape='nuc')"""


def _grid(step: int) -> str:
    """ras: grid points inside each shape."""
    return f"""ras AS (SELECT p.shape, p.id, p.cell, p.x, p.y FROM (SELECT shape, id, cell, trunc(x0)+xi.k*{step} AS x, trunc(y0)+yi.k*{step} AS y
  FROM bb, (SELECT unnest(generate_series(0, 63)) AS k) xi, (SELECT unnest(generate_series(0, 63)) AS k) yi
  WHERE xi.k*{step} < trunc(x1)-trunc(x0)+{step} AND yi.k*{step} < trunc(y1)-trunc(y0)+{step}) p JOIN edge e ON e.shape=p.shape AND e.id=p.id GROUP BY p.shape, p.id, p.cell, p.x, p.y HAVING {_PARITY})"""


#: The parts and the last SELECT of each statement, so that others can be put together of them.
_MADE: dict[str, tuple[tuple[str, ...], str]] = {}


def _with(*parts: str, then: str) -> str:
    out = f"WITH {', '.join(parts)} {then}"
    _MADE[out] = (parts, then)
    return out


def _joined(names: list[str], on: str) -> tuple[list[str], str]:
    """The parts of several statements, each once, and their results joined by their common columns."""
    made = [_MADE[ORACLES[n]] for n in names]
    parts = list(dict.fromkeys(p for own, _ in made for p in own))
    tables = [f"{n} AS MATERIALIZED ({then})" for n, (_, then) in zip(names, made)]
    return [*parts, *tables], names[0] + "".join(f" JOIN {n} USING ({on})" for n in names[1:])


def r(value: str) -> str:
    return f"round({value}, 6) + 0.0"


def _shape(select: str, source: str = "geo", shape: str = "cell") -> str:
    return _with(SHAPES, then=f"SELECT id AS shape_id, {select} FROM {source} WHERE shape='{shape}'")


CELL = "cell AS cell_boundaries"
GENE = "gene AS feature_name"

ASPECT = [
    "proj AS (SELECT e.shape, e.id, e.i, ((v.x-e.ax)*(e.bx-e.ax)+(v.y-e.ay)*(e.by_-e.ay))/sqrt((e.bx-e.ax)*(e.bx-e.ax)+(e.by_-e.ay)*(e.by_-e.ay)) AS u, ((v.y-e.ay)*(e.bx-e.ax)-(v.x-e.ax)*(e.by_-e.ay))/sqrt((e.bx-e.ax)*(e.bx-e.ax)+(e.by_-e.ay)*(e.by_-e.ay)) AS w FROM edge e JOIN vert v ON v.shape=e.shape AND v.id=e.id)",
    "box AS (SELECT shape, id, i, max(u)-min(u) AS l, max(w)-min(w) AS h FROM proj GROUP BY shape, id, i)",
]

ORACLES: dict[str, str] = {
    "point_in_cell": _with(SHAPES, RAW, f"hit AS (SELECT p.pid, e.id FROM raw p JOIN bb ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 JOIN edge e ON e.shape=bb.shape AND e.id=bb.id WHERE bb.shape='cell' GROUP BY p.pid, e.id HAVING {_PARITY})", then=f"SELECT x, y, {GENE}, id AS cell_boundaries FROM raw LEFT JOIN hit USING (pid)"),
    "point_in_nucleus": _with(SHAPES, RAW, f"hit AS (SELECT p.pid, e.id FROM raw p JOIN bb ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 JOIN edge e ON e.shape=bb.shape AND e.id=bb.id WHERE bb.shape='nuc' GROUP BY p.pid, e.id HAVING {_PARITY})", then=f"SELECT x, y, {GENE}, id AS nucleus_boundaries FROM raw LEFT JOIN hit USING (pid)"),
    "sync_points": _with(SHAPES, POINTS, then=f"SELECT x, y, {GENE}, {CELL}, nuc AS nucleus_boundaries FROM pts"),
    "cell_gene_counts": _with(SHAPES, POINTS, then=f"SELECT {CELL}, {GENE}, count(*) AS n FROM pts GROUP BY cell, gene"),
    "dense_counts": _with(SHAPES, POINTS, then=f"SELECT c.cell AS cell_boundaries, g.gene AS feature_name, count(p.pid) AS n FROM (SELECT DISTINCT cell FROM pts) c CROSS JOIN (SELECT DISTINCT gene FROM pts) g LEFT JOIN pts p ON p.cell=c.cell AND p.gene=g.gene GROUP BY c.cell, g.gene"),
    "filter_by_gene": _with(SHAPES, POINTS, "c AS (SELECT cell, gene, count(*) AS n FROM pts GROUP BY cell, gene)", then=f"SELECT {CELL}, {GENE}, n FROM c WHERE gene IN (SELECT gene FROM c GROUP BY gene HAVING max(n) >= 38)"),
    "bbox_crop": _with(SHAPES, POINTS, then=f"SELECT x, y, {GENE}, {CELL} FROM pts WHERE x BETWEEN 100 AND 700 AND y BETWEEN 50 AND 150"),
    "shape_map_1to1": _with(SHAPES, then="SELECT c.id AS shape_id, n.id AS nucleus_boundaries FROM bb c LEFT JOIN bb n ON n.shape='nuc' AND n.cell=c.id WHERE c.shape='cell'"),
    "shape_map_1tomany": _with(SHAPES, then="SELECT cell AS shape_id, count(*) AS n_rings FROM bb WHERE shape='nuc' GROUP BY cell"),
    "shape_columns_on_points": _with(SHAPES, POINTS, then="SELECT gene AS feature_name, phenotype, count(*) AS n, round(sum(acctbal), 2) + 0.0 AS acctbal FROM pts JOIN sup ON sup.cell=pts.cell GROUP BY gene, phenotype"),
    "cell_area": _shape(f"{r('area')} AS cell_boundaries_area"),
    "cell_centroid": _shape(f"{r('cx')} AS cell_boundaries_centroid_x, {r('cy')} AS cell_boundaries_centroid_y"),
    "cell_perimeter": _shape(f"{r('perimeter')} AS cell_boundaries_perimeter"),
    "cell_bounds": _shape("x0 AS cell_boundaries_minx, y0 AS cell_boundaries_miny, x1 AS cell_boundaries_maxx, y1 AS cell_boundaries_maxy", "bb"),
    "cell_radius": _shape(f"{r('radius')} AS cell_boundaries_radius", "rad"),
    "cell_span": _with(SHAPES, then="SELECT a.id AS shape_id, CAST(floor(max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))) AS INTEGER) AS cell_boundaries_span FROM vert a JOIN vert b ON a.shape=b.shape AND a.id=b.id WHERE a.shape='cell' GROUP BY a.id"),
    "cell_density": _with(SHAPES, POINTS, then=f"SELECT g.id AS shape_id, {r('any_value(n)/any_value(area)')} AS cell_boundaries_density FROM geo g LEFT JOIN (SELECT cell AS c, CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY cell) ON c=g.id WHERE g.shape='cell' GROUP BY g.id"),
    "cell_raster": _with(SHAPES, _grid(1), then="SELECT id AS shape_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM ras WHERE shape='cell' GROUP BY id"),
    "cell_second_moment": _with(SHAPES, _grid(1), then=f"SELECT ras.id AS shape_id, {r('avg((x-cx)*(x-cx)+(y-cy)*(y-cy))')} AS cell_boundaries_moment FROM ras JOIN geo ON geo.shape=ras.shape AND geo.id=ras.id WHERE ras.shape='cell' GROUP BY ras.id"),
    "cell_aspect_ratio": _with(
        SHAPES,
        *ASPECT,
        then=f"SELECT id AS shape_id, {r('min_by(greatest(l,h)/least(l,h), l*h)')} AS nucleus_boundaries_aspect_ratio FROM box WHERE shape='nuc' GROUP BY id",
    ),
}

# Overlay of nested shapes: a nucleus lies in its cell.
_PAIR = "SELECT c.id||'|'||n.id AS shape_id, " + r("n.area") + " AS area FROM geo c JOIN geo n ON n.shape='nuc' AND n.cell=c.id WHERE c.shape='cell'"
_REST = "SELECT c.id||'|' AS shape_id, " + r("c.area-coalesce(n.area,0)") + " AS area FROM geo c LEFT JOIN geo n ON n.shape='nuc' AND n.cell=c.id WHERE c.shape='cell'"
ORACLES |= {
    "overlay_intersection": _with(SHAPES, then=_PAIR),
    "overlay_difference": _with(SHAPES, then=_REST),
    "overlay_symmetric_difference": _with(SHAPES, then=_REST),
    "overlay_union": _with(SHAPES, then=f"{_PAIR} UNION ALL {_REST}"),
}

# Point features by cell and gene.
_KEYS = "p.cell AS cell_boundaries, p.gene AS feature_name"
DIST = f"""dist AS (SELECT p.pid, e.shape, min(sqrt((p.x-e.ax-{_SEGMENT}*(e.bx-e.ax))*(p.x-e.ax-{_SEGMENT}*(e.bx-e.ax))+(p.y-e.ay-{_SEGMENT}*(e.by_-e.ay))*(p.y-e.ay-{_SEGMENT}*(e.by_-e.ay)))) AS d FROM pts p JOIN edge e ON e.cell=p.cell GROUP BY p.pid, e.shape)"""
OFFS = "offs AS (SELECT p.pid, g.shape, sqrt((p.x-g.cx)*(p.x-g.cx)+(p.y-g.cy)*(p.y-g.cy)) AS d FROM pts p JOIN geo g ON g.cell=p.cell)"


def _sided(table: str, name: str, value: str, empty: bool) -> str:
    """Inner and outer means for cell and nucleus; empty: 0 where a side has no points and there is a shape."""

    def mean(shape: str, where: str) -> str:
        m = value.format(m=f"avg(CASE WHEN {where} THEN {shape}.d END)")
        return r(f"CASE WHEN max({shape}.d) IS NOT NULL THEN coalesce({m}, 0) END") if empty else r(m)

    rows = [("cell_boundaries_inner", mean("c", "true")), ("cell_boundaries_outer", mean("c", "false")), ("nucleus_boundaries_inner", mean("n", "p.nuc IS NOT NULL")), ("nucleus_boundaries_outer", mean("n", "p.nuc IS NULL"))]
    select = ", ".join(f"{v} AS {k}_{name}" for k, v in rows)
    return f"SELECT {_KEYS}, {select} FROM pts p JOIN {table} c ON c.pid=p.pid AND c.shape='cell' LEFT JOIN {table} n ON n.pid=p.pid AND n.shape='nuc' JOIN rad ON rad.shape='cell' AND rad.id=p.cell GROUP BY p.cell, p.gene"


RIPLEY = [
    "sp AS (SELECT a.id AS c, CAST(floor(max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))) AS INTEGER) AS span FROM vert a JOIN vert b ON a.shape=b.shape AND a.id=b.id WHERE a.shape='cell' GROUP BY a.id)",
    "grp AS (SELECT cell, gene, count(*) AS n FROM pts GROUP BY cell, gene HAVING count(*) >= 2)",
    "pair AS (SELECT a.cell, a.gene, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM pts a JOIN pts b ON a.cell=b.cell AND a.gene=b.gene AND a.pid<>b.pid)",
    "radii AS (SELECT c, span, k, 1 + (span/2.0::DOUBLE-1)*k/(span//2-1) AS rr, false AS half FROM sp, (SELECT unnest(generate_series(0, 127)) AS k) WHERE k < span//2 UNION ALL SELECT c, span, -1, span/4.0::DOUBLE, true FROM sp)",
    "kk AS (SELECT g.cell, g.gene, s.k, s.rr, s.half, g.n, count(p.d) AS m FROM grp g JOIN radii s ON s.c=g.cell LEFT JOIN pair p ON p.cell=g.cell AND p.gene=g.gene AND p.d < s.rr GROUP BY g.cell, g.gene, s.k, s.rr, s.half, g.n)",
    "hh AS MATERIALIZED (SELECT kk.cell, gene, k, half, sqrt(area*m/(n*(n-1))/pi())-rr AS h FROM kk JOIN geo ON geo.shape='cell' AND geo.id=kk.cell)",
    # Running means of five, their differences, and mean ranks.
    "hs AS (SELECT cell, gene, k, h, count(*) OVER (PARTITION BY cell, gene) AS steps, avg(h) OVER (PARTITION BY cell, gene ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s, rank() OVER (PARTITION BY cell, gene ORDER BY h) + (count(*) OVER (PARTITION BY cell, gene, h)-1)/2.0::DOUBLE AS rk FROM hh WHERE NOT half)",
    "gr AS (SELECT cell, gene, CASE WHEN k=0 THEN lead(s) OVER v-s WHEN k=steps-5 THEN s-lag(s) OVER v ELSE (lead(s) OVER v-lag(s) OVER v)/2 END AS g FROM hs WHERE k <= steps-5 WINDOW v AS (PARTITION BY cell, gene ORDER BY k))",
    "ga AS (SELECT cell, gene, max(g) AS gmax, min(g) AS gmin FROM gr GROUP BY cell, gene)",
    "ha AS (SELECT cell, gene, max(CASE WHEN NOT half THEN h END) AS l_max, max(CASE WHEN half THEN h END) AS l_half FROM hh GROUP BY cell, gene)",
    "hm AS (SELECT cell, gene, corr(rk, CAST(k AS DOUBLE)) AS mono FROM hs GROUP BY cell, gene)",
]
_RIPLEY = f"""SELECT a.cell AS cell_boundaries, a.gene AS feature_name, {r('l_max')} AS l_max, CASE WHEN l_max IS NOT NULL THEN {r('coalesce(gmax, 0)')} END AS l_max_gradient, CASE WHEN l_max IS NOT NULL THEN {r('coalesce(gmin, 0)')} END AS l_min_gradient,
  {r('mono')} AS l_monotony, {r('l_half')} AS l_half_radius FROM (SELECT DISTINCT cell, gene FROM pts) a LEFT JOIN ha ON ha.cell=a.cell AND ha.gene=a.gene LEFT JOIN ga ON ga.cell=a.cell AND ga.gene=a.gene LEFT JOIN hm ON hm.cell=a.cell AND hm.gene=a.gene"""
_LOCAL = "loc AS (SELECT p.*, p.x-b.x0 AS lx, p.y-b.y0 AS ly FROM pts p JOIN bb b ON b.shape='cell' AND b.id=p.cell)"
_RASTER_ABOUT = "(SELECT id, avg(x-x0) AS mx, avg(y-y0) AS my, avg((x-x0)*(x-x0)+(y-y0)*(y-y0)) AS ms FROM (SELECT ras.id, ras.x, ras.y, bb.x0, bb.y0 FROM ras JOIN bb ON bb.shape='cell' AND bb.id=ras.id WHERE ras.shape='cell') GROUP BY id)"
ORACLES |= {
    "pf_distance": _with(SHAPES, POINTS, DIST, then=_sided("dist", "distance", "{m}", False)),
    "pf_offset": _with(SHAPES, POINTS, OFFS, then=_sided("offs", "offset", "{m}", False)),
    "pf_proximity": _with(SHAPES, POINTS, DIST, then=_sided("dist", "proximity", "(any_value(rad.radius)-{m})/any_value(rad.radius)", True)),
    "pf_asymmetry": _with(SHAPES, POINTS, OFFS, then=_sided("offs", "asymmetry", "{m}/any_value(rad.radius)", True)),
    "pf_point_dispersion": _with(SHAPES, POINTS, _LOCAL, then=f"SELECT {_KEYS}, {r('var_pop(lx)+var_pop(ly)')} AS point_dispersion FROM loc p GROUP BY p.cell, p.gene"),
    "pf_shape_dispersion": _with(SHAPES, POINTS, then=f"SELECT {_KEYS}, {r('avg((p.x-c.cx)*(p.x-c.cx)+(p.y-c.cy)*(p.y-c.cy))')} AS cell_boundaries_dispersion, {r('avg((p.x-n.cx)*(p.x-n.cx)+(p.y-n.cy)*(p.y-n.cy))')} AS nucleus_boundaries_dispersion FROM pts p JOIN geo c ON c.shape='cell' AND c.id=p.cell LEFT JOIN geo n ON n.shape='nuc' AND n.cell=p.cell GROUP BY p.cell, p.gene"),
    "pf_point_dispersion_norm": _with(SHAPES, POINTS, _LOCAL, _grid(1), then=f"SELECT {_KEYS}, {r('(var_pop(lx)+var_pop(ly))/(any_value(ms)-2*(avg(lx)*any_value(mx)+avg(ly)*any_value(my))+avg(lx)*avg(lx)+avg(ly)*avg(ly))')} AS point_dispersion_norm FROM loc p JOIN {_RASTER_ABOUT} m ON m.id=p.cell GROUP BY p.cell, p.gene"),
    "pf_shape_dispersion_norm": _with(SHAPES, POINTS, _grid(1), "den AS (SELECT g.cell AS c, g.shape, avg((ras.x-g.cx)*(ras.x-g.cx)+(ras.y-g.cy)*(ras.y-g.cy)) AS v FROM geo g JOIN ras ON ras.shape='cell' AND ras.id=g.cell GROUP BY g.cell, g.shape)", then=f"SELECT {_KEYS}, {r('avg((p.x-c.cx)*(p.x-c.cx)+(p.y-c.cy)*(p.y-c.cy))/any_value(dc.v)')} AS cell_boundaries_dispersion_norm, {r('avg((p.x-n.cx)*(p.x-n.cx)+(p.y-n.cy)*(p.y-n.cy))/any_value(dn.v)')} AS nucleus_boundaries_dispersion_norm FROM pts p JOIN geo c ON c.shape='cell' AND c.id=p.cell JOIN den dc ON dc.c=p.cell AND dc.shape='cell' LEFT JOIN geo n ON n.shape='nuc' AND n.cell=p.cell LEFT JOIN den dn ON dn.c=p.cell AND dn.shape='nuc' GROUP BY p.cell, p.gene"),
    "pf_enrichment": _with(SHAPES, POINTS, then=f"SELECT {_KEYS}, 1.0::DOUBLE AS cell_boundaries_enrichment, {r('avg(CASE WHEN nuc IS NULL THEN 0.0 ELSE 1.0 END)')} AS nucleus_boundaries_enrichment FROM pts p GROUP BY p.cell, p.gene"),
    "pf_ripley": _with(SHAPES, POINTS, *RIPLEY, then=_RIPLEY),
}

_FEATURE_QUERIES = [f"pf_{n}" for n in ("proximity", "asymmetry", "point_dispersion_norm", "shape_dispersion_norm", "distance", "offset", "point_dispersion", "shape_dispersion", "ripley", "enrichment")]
_ALL, _FROM = _joined(_FEATURE_QUERIES, "cell_boundaries, feature_name")
ORACLES["pf_all"] = _with(*_ALL, then=f"SELECT * FROM {_FROM}")

# The rule model on its features; a row without all 13 features has no pattern.
_USED = ["pf_proximity", "pf_asymmetry", "pf_ripley", "pf_point_dispersion_norm", "pf_shape_dispersion_norm"]
_ALL, _FROM = _joined(_USED, "cell_boundaries, feature_name")
_CLIP = "least(1.0, greatest(0.0, coalesce({}, 0.0)))"
_RULES = {
    "cell_edge": _CLIP.format("cell_boundaries_inner_proximity"),
    "cytoplasmic": f"{_CLIP.format('1-nucleus_boundaries_inner_proximity')}*{_CLIP.format('nucleus_boundaries_outer_proximity')}",
    "none": _CLIP.format("point_dispersion_norm"),
    "nuclear": _CLIP.format("nucleus_boundaries_inner_proximity"),
    "nuclear_edge": f"{_CLIP.format('nucleus_boundaries_inner_proximity')}*{_CLIP.format('nucleus_boundaries_outer_proximity')}",
}
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in feature_columns("cell_boundaries", "nucleus_boundaries"))
ORACLES["lp_predict"] = _with(*_ALL, then=f"SELECT cell_boundaries, feature_name, {', '.join(f'CAST({_COMPLETE} AND {_RULES[p]} >= {t} AS INTEGER) AS {p}' for p, t in zip(PATTERNS, THRESHOLDS))} FROM {_FROM}")

# Neighbourhoods.
_PAIRS = "pr AS (SELECT a.cell, a.pid, a.gene AS src, b.gene AS nb, a.nuc AS anuc FROM pts a JOIN pts b ON a.cell=b.cell AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25)"
ORACLES |= {
    "neighbors_radius_counts": _with(SHAPES, POINTS, _PAIRS, then=f"SELECT {CELL}, src AS source, nb AS neighbor, count(*) AS n FROM pr GROUP BY cell, src, nb"),
    "neighbors_radius_binary": _with(SHAPES, POINTS, _PAIRS, then=f"SELECT {CELL}, nb AS feature_name, count(DISTINCT pid) AS n FROM pr GROUP BY cell, nb"),
    "neighbors_knn": _with(SHAPES, POINTS, "rk AS (SELECT a.cell, b.gene, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.x, b.y, b.gene) AS k FROM pts a JOIN pts b ON a.cell=b.cell)", then=f"SELECT {CELL}, {GENE}, count(*) AS n FROM rk WHERE k <= 3 GROUP BY cell, gene"),
    "neighbors_gene": _with(SHAPES, POINTS, "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, gene ORDER BY x, y) AS k FROM pts) WHERE k=1)", then=f"SELECT a.cell AS cell_boundaries, a.gene AS source, b.gene AS neighbor, count(*) AS n FROM f a JOIN pts b ON a.cell=b.cell AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25 GROUP BY a.cell, a.gene, b.gene"),
}


def _clq(where: str, compartment: str) -> str:
    return f"""SELECT '{compartment}' AS compartment, a.src, a.nb, a.cell, a.a, g1.n AS b, g2.n AS c, t.d FROM
  (SELECT a.cell, a.gene AS src, b.gene AS nb, count(DISTINCT a.pid) AS a FROM pts a JOIN pts b ON a.cell=b.cell AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25
   WHERE {where.format(t='a')} AND {where.format(t='b')} GROUP BY a.cell, a.gene, b.gene) a
  JOIN (SELECT cell, gene, count(*) AS n FROM pts WHERE {where.format(t='pts')} GROUP BY cell, gene HAVING count(*) >= 4) g1 ON g1.cell=a.cell AND g1.gene=a.src
  JOIN (SELECT cell, gene, count(*) AS n FROM pts WHERE {where.format(t='pts')} GROUP BY cell, gene HAVING count(*) >= 4) g2 ON g2.cell=a.cell AND g2.gene=a.nb
  JOIN (SELECT cell, sum(n) AS d, count(*) AS k FROM (SELECT cell, gene, count(*) AS n FROM pts WHERE {where.format(t='pts')} GROUP BY cell, gene HAVING count(*) >= 4) GROUP BY cell) t ON t.cell=a.cell AND t.k >= 2"""


_Q = "q AS (SELECT compartment, src AS feature_name, nb AS neighbor, cell AS cell_boundaries, (CAST(a AS DOUBLE)/b)/(CAST(c AS DOUBLE)/CAST(d AS DOUBLE)) AS clq, 1.96*sqrt(1.0::DOUBLE/a+1.0::DOUBLE/b+1.0::DOUBLE/c+1.0::DOUBLE/CAST(d AS DOUBLE)) AS h FROM ({}))".format(f"{_clq('true', 'cell_boundaries')} UNION ALL {_clq('{t}.nuc IS NOT NULL', 'nucleus_boundaries')}")
_LOG = "CASE WHEN {0} > 0 THEN log2({0}) END"
ORACLES |= {
    "clq": _with(SHAPES, POINTS, _Q, then=f"SELECT compartment, feature_name, neighbor, cell_boundaries, {r('clq')} AS clq FROM q"),
    "clq_log_ci": _with(SHAPES, POINTS, _Q, then=f"SELECT compartment, feature_name, neighbor, cell_boundaries, {r('clq-h')} AS ci_lower, {r('clq+h')} AS ci_upper, {r(_LOG.format('clq'))} AS log_clq, {r(_LOG.format('(clq-h)'))} AS log_ci_lower, {r(_LOG.format('(clq+h)'))} AS log_ci_upper FROM q"),
    "coloc_tensor": _with(SHAPES, POINTS, _Q, then=f"SELECT compartment, cell_boundaries, feature_name, neighbor, {r(_LOG.format('clq'))} AS value FROM q WHERE clq > 0"),
}

# Composition.
_COMP = "SELECT {g} gene, avg(s1) AS s1, avg(s2) AS s2, sum(n) AS n, count(*) AS k FROM (SELECT {g} cell, gene, 1.0::DOUBLE AS s1, CAST(count(nuc) AS DOUBLE)/count(*) AS s2, count(*) AS n FROM {src} GROUP BY {g} cell, gene) GROUP BY {g} gene"
ORACLES |= {
    "comp": _with(SHAPES, POINTS, f"c AS ({_COMP.format(g='', src='pts')})", then=f"SELECT {GENE}, s1 AS cell_boundaries, {r('s2')} AS nucleus_boundaries, {r('log2(n+1)')} AS logcounts, {r('100.0::DOUBLE*k/(SELECT count(DISTINCT cell) FROM pts)')} AS cell_fraction FROM c"),
    "comp_diff": _with(SHAPES, POINTS, "pp AS (SELECT pts.*, phenotype FROM pts JOIN sup ON sup.cell=pts.cell)", f"c AS ({_COMP.format(g='phenotype,', src='pp')})", "every AS (SELECT DISTINCT gene FROM c)", then=f"SELECT e.gene AS feature_name, 'B' AS \"group\", {r('(abs(least(coalesce(b.s1,1e-10),coalesce(b.s2,1e-10))-least(coalesce(a.s1,1e-10),coalesce(a.s2,1e-10)))+abs(greatest(coalesce(b.s1,1e-10),coalesce(b.s2,1e-10))-greatest(coalesce(a.s1,1e-10),coalesce(a.s2,1e-10))))/2')} AS distance FROM every e LEFT JOIN c a ON a.gene=e.gene AND a.phenotype='A' LEFT JOIN c b ON b.gene=e.gene AND b.phenotype='B'"),
}

# Patterns from stand-in probabilities.
PROB = """pb AS (SELECT cell, gene, CAST(count(*) % 7 AS DOUBLE)/7 AS cell_edge, 1-CAST(count(nuc) AS DOUBLE)/count(*) AS cytoplasmic, CAST(count(*) % 5 AS DOUBLE)/5 AS none, CAST(count(nuc) AS DOUBLE)/count(*) AS nuclear, CAST(count(nuc) % 3 AS DOUBLE)/3 AS nuclear_edge FROM pts GROUP BY cell, gene)"""
_IND = ", ".join(f"CASE WHEN {p} >= {t} THEN 1 ELSE 0 END AS {p}" for p, t in zip(PATTERNS, THRESHOLDS))
LP = f"lp AS (SELECT cell, gene, {_IND} FROM pb)"
_TOP = ", ".join(f"CASE WHEN l.{p}=1 THEN b.{p} ELSE -1 END" for p in PATTERNS)
_LONG = "SELECT cell, gene, unnest([{names}]) AS pattern, unnest([{values}]) AS v FROM {src}"
_NAMES = ", ".join(f"'{p}'" for p in PATTERNS)
ORACLES |= {
    "lp_threshold": _with(SHAPES, POINTS, PROB, LP, then=f"SELECT {CELL}, {GENE}, {', '.join(PATTERNS)} FROM lp"),
    "lp_stats": _with(SHAPES, POINTS, PROB, LP, then=f"SELECT {GENE}, {', '.join(f'CAST(sum({p}) AS BIGINT) AS {p}' for p in PATTERNS)} FROM lp GROUP BY gene"),
    "lp_top_pattern": _with(SHAPES, POINTS, PROB, LP, then="SELECT l.cell AS cell_boundaries, l.gene AS feature_name, CASE " + " ".join(f"WHEN l.{p}=1 AND b.{p} >= greatest({_TOP}) THEN '{p}'" for p in PATTERNS) + " END AS pattern FROM lp l JOIN pb b ON b.cell=l.cell AND b.gene=l.gene"),
    "lp_logfc": _with(SHAPES, POINTS, PROB, LP, f"lg AS ({_LONG.format(names=_NAMES, values=', '.join(PATTERNS), src='lp')})", "s AS (SELECT gene, pattern, phenotype, CAST(sum(v) AS DOUBLE) AS n FROM lg JOIN sup ON sup.cell=lg.cell GROUP BY gene, pattern, phenotype)", "full_ AS (SELECT g.gene, p.pattern, k.phenotype, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT gene FROM lp) g CROSS JOIN (SELECT DISTINCT pattern FROM lg) p CROSS JOIN (SELECT DISTINCT phenotype FROM sup) k LEFT JOIN s ON s.gene=g.gene AND s.pattern=p.pattern AND s.phenotype=k.phenotype)", then=f"SELECT a.gene AS feature_name, a.pattern, a.phenotype, {r('log2((a.n+1)/(b.n+1))')} AS log2fc FROM full_ a JOIN full_ b ON a.gene=b.gene AND a.pattern=b.pattern AND a.phenotype<>b.phenotype"),
    "lp_diff_continuous": _with(SHAPES, POINTS, PROB, f"lg AS ({_LONG.format(names=_NAMES, values=', '.join(PATTERNS), src='pb')})", "j AS (SELECT gene, pattern, v, acctbal AS w FROM lg JOIN sup ON sup.cell=lg.cell)", then=f"SELECT gene AS feature_name, pattern, {r('(avg(v*w)-avg(v)*avg(w))/(sqrt(var_pop(v))*sqrt(var_pop(w)))')} AS pearson_correlation FROM j GROUP BY gene, pattern HAVING var_pop(v) > 1e-18 AND var_pop(w) > 1e-18"),
    "upset_counts": _with(SHAPES, POINTS, PROB, LP, then=f"SELECT {', '.join(PATTERNS)}, {'+'.join(PATTERNS)} AS degree, count(*) AS n FROM lp GROUP BY {', '.join(PATTERNS)} HAVING count(*) >= 0.001*(SELECT count(*) FROM lp)"),
    "lp_genes": _with(SHAPES, POINTS, PROB, LP, "t AS (SELECT cell, gene, count(*) AS n FROM pts GROUP BY cell, gene)", then=f"SELECT l.gene AS feature_name, {', '.join(r(f'avg(CAST(l.{p} AS DOUBLE))') + f' AS {p}' for p in PATTERNS)}, {r('log2(avg(t.n)+1)')} AS logcounts, {r('100.0::DOUBLE*count(DISTINCT t.cell)/(SELECT count(DISTINCT cell) FROM t)')} AS cell_fraction FROM lp l JOIN t ON t.cell=l.cell AND t.gene=l.gene GROUP BY l.gene"),
}

# Flux on a raster of step 8 with radius 5.
FLUX = f"""{_grid(8)},
near AS (SELECT s.cell, s.x, s.y, p.gene, count(*) AS n FROM ras s JOIN pts p ON p.cell=s.cell AND (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y) <= 25 WHERE s.shape='cell' GROUP BY s.cell, s.x, s.y, p.gene),
pix AS (SELECT cell, x, y, sum(n) AS total FROM near GROUP BY cell, x, y),
cmp AS (SELECT cell, gene, CAST(count(*) AS DOUBLE)/any_value(t) AS share FROM pts JOIN (SELECT cell AS c, count(*) AS t FROM pts GROUP BY cell) ON c=cell GROUP BY cell, gene),
dense AS (SELECT pix.cell, pix.x, pix.y, cmp.gene, cmp.share, coalesce(CAST(near.n AS DOUBLE)/CAST(pix.total AS DOUBLE), 0) AS f FROM pix JOIN cmp ON cmp.cell=pix.cell LEFT JOIN near ON near.cell=pix.cell AND near.x=pix.x AND near.y=pix.y AND near.gene=cmp.gene),
sd AS (SELECT cell, gene, CASE WHEN stddev_pop(f) > 1e-9 THEN stddev_pop(f) ELSE 1 END AS s FROM dense GROUP BY cell, gene),
fx AS (SELECT d.cell, d.x, d.y, d.gene, (d.f-d.share)/sd.s AS flux FROM dense d JOIN sd ON sd.cell=d.cell AND sd.gene=d.gene)"""
NET = "net AS (SELECT DISTINCT p_type AS source, p_brand AS target FROM part)"
ORACLES |= {
    "flux_composition": _with(SHAPES, POINTS, then=f"SELECT {CELL}, {GENE}, count(*) AS n, {r('CAST(count(*) AS DOUBLE)/any_value(t)')} AS share FROM pts JOIN (SELECT cell AS c, count(*) AS t FROM pts GROUP BY cell) ON c=cell GROUP BY cell, gene"),
    "flux_scaled": _with(SHAPES, POINTS, FLUX, then=f"SELECT {CELL}, x, y, {GENE}, {r('flux')} AS flux FROM fx"),
    "fe_wsum": _with(SHAPES, POINTS, FLUX, NET, then=f"SELECT {CELL}, source, {r('sum(flux)')} AS score FROM fx JOIN net ON target=gene GROUP BY cell, source"),
    "fe_stats": _with(SHAPES, POINTS, NET, "t AS (SELECT cell, gene, count(*) AS n FROM pts GROUP BY cell, gene)", then=f"SELECT c.cell AS cell_boundaries, s.source, count(t.gene) AS n_genes FROM (SELECT DISTINCT cell FROM t) c CROSS JOIN (SELECT DISTINCT source FROM net) s LEFT JOIN net ON net.source=s.source LEFT JOIN t ON t.cell=c.cell AND t.gene=net.target AND t.n >= 20 GROUP BY c.cell, s.source"),
    "fe_ngenes": _with(SHAPES, POINTS, NET, then="SELECT source, count(DISTINCT target) AS n FROM net WHERE target IN (SELECT gene FROM pts) GROUP BY source"),
}

# Data of figures.
_T = "t AS (SELECT cell, gene, count(*) AS n FROM pts GROUP BY cell, gene)"
ORACLES |= {
    "hist2d": _with(SHAPES, POINTS, then="SELECT CAST(floor(x/16) AS BIGINT) AS bx, CAST(floor(y/16) AS BIGINT) AS by, count(*) AS n FROM pts GROUP BY 1, 2"),
    "kde2d": _with(SHAPES, POINTS, "h AS (SELECT CAST(floor(x/16) AS BIGINT) AS bx, CAST(floor(y/16) AS BIGINT) AS by_, count(*) AS n FROM pts GROUP BY 1, 2)", "k AS (SELECT unnest(generate_series(-3, 3)) AS d)", then=f"SELECT h.bx+a.d AS bx, h.by_+b.d AS by, {r('sum(n*exp(-((a.d*a.d+b.d*b.d)*256.0::DOUBLE)/512)/(2*pi()*256))/(SELECT count(*) FROM pts)*1e6')} AS density FROM h, k a, k b GROUP BY 1, 2"),
    "quantiles": _with(SHAPES, POINTS, _T, then=f"SELECT {GENE}, " + ", ".join(f"{r(f'quantile_cont(CAST(n AS DOUBLE), {q})')} AS q{int(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM t GROUP BY gene"),
    "entropy_topn": _with(SHAPES, POINTS, "w AS (SELECT gene, CAST(count(nuc) AS DOUBLE) AS a, CAST(count(*)-count(nuc) AS DOUBLE) AS b FROM pts GROUP BY gene)", then=f"SELECT {GENE}, {r('-(CASE WHEN a>0 THEN a/(a+b)*ln(a/(a+b)) ELSE 0 END+CASE WHEN b>0 THEN b/(a+b)*ln(b/(a+b)) ELSE 0 END)')} AS entropy FROM w ORDER BY 2, 1 LIMIT 10"),
    "radviz_xy": _with(SHAPES, POINTS, "w AS (SELECT gene, CAST(count(nuc) AS DOUBLE) AS a, CAST(count(*)-count(nuc) AS DOUBLE) AS b, CAST(count(DISTINCT cell) AS DOUBLE) AS c FROM pts GROUP BY gene)", "z AS (SELECT gene, coalesce((a-min(a) OVER ())/nullif(max(a) OVER ()-min(a) OVER (),0),0) AS a, coalesce((b-min(b) OVER ())/nullif(max(b) OVER ()-min(b) OVER (),0),0) AS b, coalesce((c-min(c) OVER ())/nullif(max(c) OVER ()-min(c) OVER (),0),0) AS c FROM w)", then=f"SELECT {GENE}, {r('(a+b*cos(2*pi()/3)+c*cos(4*pi()/3))/nullif(a+b+c,0)')} AS rx, {r('(b*sin(2*pi()/3)+c*sin(4*pi()/3))/nullif(a+b+c,0)')} AS ry FROM z"),
    "factor_topn": _with(SHAPES, POINTS, _T, "z AS (SELECT cell, gene, (n-avg(n) OVER (PARTITION BY gene))/nullif(stddev_pop(n) OVER (PARTITION BY gene),0) AS z FROM t)", "k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(z,6) DESC, cell) AS rank FROM z)", then=f"SELECT {GENE}, {CELL}, {r('z')} AS z, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"),
    "shape_stats_melt": _with(SHAPES, then=f"SELECT id AS shape_id, 'cell_boundaries_area' AS variable, {r('area')} AS value FROM geo WHERE shape='cell' UNION ALL SELECT id, 'cell_boundaries_perimeter', {r('perimeter')} FROM geo WHERE shape='cell'"),
    "nearest_image": _with(SHAPES, POINTS, "s AS (SELECT x, y, gene, CAST(floor(x/8) AS BIGINT)+a.d AS ix, CAST(floor(y/8) AS BIGINT)+b.d AS iy FROM pts, (SELECT unnest([-1,0,1]) AS d) a, (SELECT unnest([-1,0,1]) AS d) b)", then="SELECT ix, iy, min(gene) AS gene FROM (SELECT ix, iy, gene, rank() OVER (PARTITION BY ix, iy ORDER BY (x-(ix+0.5)*8)*(x-(ix+0.5)*8)+(y-(iy+0.5)*8)*(y-(iy+0.5)*8), x, y) AS k FROM s) WHERE k=1 GROUP BY ix, iy"),
}

# Writes, accessors and what a whole dataset is taken through.
ORACLES |= {
    "shape_stats": _with(
        SHAPES, POINTS, *ASPECT,
        "ar AS (SELECT shape, id, min_by(greatest(l,h)/least(l,h), l*h) AS ratio FROM box GROUP BY shape, id)",
        "dn AS (SELECT 'cell' AS shape, cell AS id, CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY cell UNION ALL SELECT 'nuc', nuc, CAST(count(*) AS DOUBLE) FROM pts WHERE nuc IS NOT NULL GROUP BY nuc)",
        then=f"SELECT CASE WHEN g.shape='cell' THEN 'cell_boundaries' ELSE 'nucleus_boundaries' END AS shape, g.id AS shape_id, {r('area')} AS area, {r('ratio')} AS aspect_ratio, {r('coalesce(n, 0)/area')} AS density FROM geo g JOIN ar ON ar.shape=g.shape AND ar.id=g.id LEFT JOIN dn ON dn.shape=g.shape AND dn.id=g.id",
    ),
    "points_metadata": _with(SHAPES, POINTS, then=f"SELECT {GENE}, count(*) AS n, count(CASE WHEN nuc IS NOT NULL THEN 1 END) AS marked, {r('coalesce(sum(CASE WHEN nuc IS NOT NULL THEN x END), 0)')} AS total FROM pts GROUP BY gene"),
    "shape_metadata": _with(SHAPES, then=f"SELECT c.id AS shape_id, {r('n.area')} AS nucleus_area FROM geo c LEFT JOIN geo n ON n.shape='nuc' AND n.cell=c.id WHERE c.shape='cell'"),
    "sync_shapes": _with(SHAPES, then="SELECT n.id AS shape_id, n.cell AS cell_boundaries FROM bb n JOIN sup ON sup.cell=n.cell WHERE n.shape='nuc' AND phenotype='A'"),
    "outside_mask": _with(SHAPES, then="SELECT 0 AS part, 1 AS n, 1 AS rings, min(x0)-5 AS minx, max(x1)+5 AS maxx, min(y0)-5 AS miny, max(y1)+5 AS maxy FROM bb WHERE shape='cell' UNION ALL SELECT 1, count(*), count(*), min(x0), max(x1), min(y0), max(y1) FROM bb WHERE shape='cell'"),
    "default_radius": _with(SHAPES, then=f"SELECT {r('avg(radius)/3')} AS third, {r('avg(radius)*0.5')} AS half, 7.0::DOUBLE AS given FROM rad WHERE shape='cell'"),
    "annotate_points": _with(SHAPES, POINTS, PROB, LP, f"tp AS ({_MADE[ORACLES['lp_top_pattern']][1]})", then="SELECT pattern, nuc IS NOT NULL AS nuclear, count(*) AS n FROM pts JOIN tp ON tp.cell_boundaries=pts.cell AND tp.feature_name=pts.gene GROUP BY 1, 2"),
    "dataset_round_trip": ORACLES["cell_gene_counts"],
    "flux_knn": _with(SHAPES, POINTS, _grid(8), "rk AS (SELECT s.cell, s.x, s.y, p.gene, row_number() OVER (PARTITION BY s.cell, s.x, s.y ORDER BY (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y), p.x, p.y, p.gene) AS k FROM ras s JOIN pts p ON p.cell=s.cell WHERE s.shape='cell')", then=f"SELECT {CELL}, x, y, {GENE}, count(*) AS n FROM rk WHERE k <= 5 GROUP BY cell, x, y, gene"),
    "flux_gram": _with(SHAPES, POINTS, FLUX, then=f"SELECT a.gene AS feature_name, b.gene AS other, {r('sum(a.flux*b.flux)')} AS v FROM fx a JOIN fx b ON a.cell=b.cell AND a.x=b.x AND a.y=b.y GROUP BY a.gene, b.gene"),
}

ORACLES |= {
    "count_matrix": _with(SHAPES, POINTS, "t AS (SELECT cell AS cell_boundaries, gene, count(*) AS n FROM pts GROUP BY cell, gene)", then="SELECT * FROM (PIVOT t ON gene USING coalesce(CAST(sum(n) AS BIGINT), 0) GROUP BY cell_boundaries)"),
    "label_image": _with(SHAPES, _grid(1), then="SELECT id||'_1' AS shape_id, CAST(count(*) AS DOUBLE) AS area FROM ras WHERE shape='cell' GROUP BY id"),
    "gene_set_csv": "SELECT DISTINCT p_type AS source, p_brand AS target, 1.0::DOUBLE AS weight FROM part",
}
