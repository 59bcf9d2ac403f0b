"""Flux: how the mix of features around a pixel differs from its cell, its embedding, colours and domains."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import RINGS, SpatialDataset
from ..sources.scratch import materialize
from .polygons import contours, from_rings
from .prep import prep
from .shape_features import CX, CY, EDGES, analyze_shapes, grids, raster
from .spatial_join import nearest, overlapping, points_in_shapes, radius_pairs

COMPONENTS = 10


def composition(points: DataFrame, instance: str, feature: str) -> DataFrame:
    """(instance, feature, n, total, share) of the features that occur in each instance."""
    counts = points.groupBy(instance, feature).agg(F.count("*").alias("n"))
    total = counts.groupBy(instance).agg(F.sum("n").alias("total"))
    return counts.join(total, instance).select(instance, feature, "n", "total", (F.col("n") / F.col("total")).alias("share"))


def resolve_radius(ds: SpatialDataset, radius: float | None) -> float:
    """None: a third of the mean cell radius; up to 1: that fraction of it; else as given."""
    if radius is not None and radius > 1:
        return float(radius)
    instance = ds.attrs["instance_key"]
    mean = analyze_shapes(ds, instance, "radius").shapes[instance].agg(F.avg(f"{instance}_radius")).first()[0]
    return mean / 3 if radius is None else mean * radius


def pixel_counts(points: DataFrame, pixels: DataFrame, instance: str, feature: str, radius: float | None, n_neighbors: int | None = None) -> DataFrame:
    """(instance, pixel_id, x, y, counts map<feature, n>, total): points around each pixel of the same instance; pixels without any are left out."""
    if n_neighbors is not None:
        pairs = nearest(points, instance, n_neighbors, [feature], pixels, "pixel_id")
    else:
        pairs = radius_pairs(points, instance, radius, [feature], pixels, "pixel_id")
    pixel = [instance, "pixel_id", "x", "y"]
    near = pairs.groupBy(instance, F.col("query_id").alias("pixel_id"), F.col("qx").alias("x"), F.col("qy").alias("y"), feature).agg(F.count("*").alias("n"))
    return near.groupBy(*pixel).agg(F.map_from_entries(F.collect_list(F.struct(feature, "n"))).alias("counts"), F.sum("n").alias("total"))


def feature_scales(near: DataFrame, instance: str, feature: str) -> DataFrame:
    """(instance, feature, scale): the population deviation of a feature's share over the instance's pixels that have points; 1 where it is 0."""
    pixels = near.groupBy(instance).agg(F.count("*").alias("__p"))
    share = F.col("n") / F.col("total")
    long = near.select(instance, "total", F.explode("counts").alias(feature, "n"))
    sums = long.groupBy(instance, feature).agg(F.sum(share).alias("__s"), F.sum(share * share).alias("__q")).join(pixels, instance)
    mean = F.col("__s") / F.col("__p")
    var = F.greatest(F.lit(0.0), F.col("__q") / F.col("__p") - mean * mean)
    return sums.select(instance, feature, F.when(var > 1e-18, F.sqrt(var)).otherwise(1.0).alias("scale"))


def _profile(near: DataFrame, comp: DataFrame, instance: str, feature: str) -> DataFrame:
    """(instance, feature, share, scale) of the features of each instance."""
    scales = comp.select(instance, feature, "share").join(feature_scales(near, instance, feature), [instance, feature], "left")
    return scales.withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def flux_long(near: DataFrame, comp: DataFrame, instance: str, feature: str) -> DataFrame:
    """(instance, pixel_id, x, y, feature, flux) for the features of each instance: (share around the pixel - share in the cell) / scale."""
    base = near.join(_profile(near, comp, instance, feature), instance)
    around = F.coalesce(F.element_at("counts", F.col(feature)), F.lit(0)) / F.col("total")
    return base.select(instance, "pixel_id", "x", "y", feature, ((around - F.col("share")) / F.col("scale")).alias("flux"))


def flux(ds: SpatialDataset, radius: float | None = None, n_neighbors: int | None = None, res: float = 1.0, train_size: float = 1.0, seed: int = 11, method: str = "radius") -> SpatialDataset:
    """Points '{instance}_raster' with flux (array<double> in the order of attrs['flux_features']), flux_embed, flux_counts and flux_color.

    Pixels lie 1 / res apart. A pixel without points around has zeros. The embedding is a truncated SVD, not centred, by
    the features' gram matrix, which tasks add up; the driver solves features x features. What is around the pixels is counted
    once and written, a row for each block of pixels; all that follows reads these rows.
    """
    if method not in ("radius", "knn"):
        raise ValueError(f"method {method!r}; there are 'radius' and 'knn'")
    a = ds.attrs
    instance, feature = a["instance_key"], a["feature_key"]
    points = ds.points[a["points_key"]].filter(F.col(instance).isNotNull())
    names = [x[0] for x in ds.tables["table"].select(feature).distinct().orderBy(feature).collect()]
    if method == "knn":
        pixels = raster(ds.shapes[instance], 1 / res).withColumnRenamed("shape_id", instance).withColumn("pixel_id", F.xxhash64(instance, "x", "y"))
        near = pixel_counts(points, pixels, instance, feature, None, n_neighbors or 10)
        blocks = _blocks_of(pixels, near, instance, names)
    else:
        blocks = _blocks(points, ds.shapes[instance], instance, feature, names, resolve_radius(ds, radius), 1 / res)
    blocks = materialize(blocks, "flux")
    blocks = materialize(blocks.join(_profiles(blocks, composition(points, instance, feature), instance, feature, names), instance, "left"), "flux")
    size, k = len(names), min(len(names), COMPONENTS)
    sums = gram(_pixels(blocks, instance, size).sample(False, train_size, seed), "flux") if train_size < 1 else _added(blocks, lambda part: _flux_of(part, size)[0])
    vectors, ratio = _singular(*sums, k) if size else (np.zeros((0, 0)), np.zeros(0))
    out = _pixels(blocks, instance, size, vectors)
    out = vec2color(out, "flux_embed", "flux_counts", fitted=_pixels(blocks, instance, size, vectors, False))
    out = out.select(instance, F.xxhash64(instance, "x", "y").alias("pixel_id"), "x", "y", "flux", "flux_counts", "flux_embed", "flux_color")
    return ds.with_points(f"{instance}_raster", out).with_attrs(flux_features=names, flux_variance_ratio=ratio.tolist(), flux_res=res)


#: Pixels of a block at most, and blocks of a slice that a task holds at once.
PIXELS, SLICE = 4096, 64
_COUNTED = "x array<double>, y array<double>, counts binary, totals array<bigint>"


def _lists(rows: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind, from_pandas=kind == pa.float64()))


def _table(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix, float).reshape(-1)))


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(counts.max(initial=0))
    return counts.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8").tobytes()


def _counted(rows: list[tuple], instances: list, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """rows: (x, y, counts, totals) of each block."""
    columns = [pa.array(instances, kind), *(_lists([r[i] for r in rows], pa.float64()) for i in (0, 1)), pa.array([_packed(r[2]) for r in rows], pa.binary()), _lists([r[3] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _axis(first: float, n: int, step: float, at: int, side: float) -> np.ndarray:
    """The numbers first + k * step, k < n, whose square is `at`."""
    low, high = (at * side - first) / step, ((at + 1) * side - first) / step
    v = first + np.arange(max(0, int(np.floor(low)) - 1), min(n, int(np.ceil(high)) + 2)) * step
    return v[np.floor(v / side) == at]


def _held(xs: np.ndarray, ys: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of a grid inside edges (ax, ay, bx, by), by geom.inside's rule and arithmetic."""
    ax, ay, bx, by = e
    with np.errstate(all="ignore"):
        cut = (bx - ax) * (ys[:, None] - ay) / (by - ay) + ax
    cut = np.where((ay > ys[:, None]) != (by > ys[:, None]), cut, -np.inf)
    found = np.zeros((len(xs), len(ys)), bool)
    for i, x in enumerate(xs):
        found[i] = (x < cut).sum(axis=1) % 2 == 1
    i, j = np.nonzero(found)
    return xs[i], ys[j]


def _blocks(points: DataFrame, shapes: DataFrame, instance: str, feature: str, names: Sequence, r: float, step: float) -> DataFrame:
    """(instance, x, y, counts, totals): the pixels of a shape in a square of the plane, and the points within r of each by feature.

    The raster is that of shape_features.raster. A square of width 2 r or more meets the points that it or a border of r
    around it holds, in an equi-join by instance and square; grid, distances and counts are made a square at a time.
    """
    side, size = max(2.0 * r, 16.0 * step), len(names)
    width, reach = F.lit(side), F.lit(float(r) * (1 + 1e-9))

    def squares(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))

    base = grids(shapes, step)
    for axis, centre in (("__xs", CX), ("__ys", CY)):
        own = F.array(F.floor(F.col(centre) / width).cast("bigint"))
        base = base.withColumn(f"__q{axis}", F.explode(F.when(F.col("__empty"), own).otherwise(squares(F.get(axis, 0), F.element_at(axis, -1)))))
    base = base.select(F.col("shape_id").alias(instance), F.col("__q__xs").alias("__qi"), F.col("__q__ys").alias("__qj"), EDGES, CX, CY, "__empty", F.get("__xs", 0).alias("__x0"), F.size("__xs").alias("__nx"), F.get("__ys", 0).alias("__y0"), F.size("__ys").alias("__ny"))
    kind = points.schema[feature].dataType.simpleString()
    listed = points.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"__name {kind}, __f int")
    near = points.join(F.broadcast(listed), F.col(feature) == F.col("__name"), "left").select(instance, "x", "y", F.coalesce("__f", F.lit(size)).alias("f"))
    for c, q in (("x", "__qi"), ("y", "__qj")):
        near = near.withColumn(q, F.explode(squares(F.col(c) - reach, F.col(c) + reach)))
    near = near.groupBy(instance, "__qi", "__qj").agg(F.collect_list(F.struct("x", "y", "f")).alias("__near"))
    joined = base.join(near, [instance, "__qi", "__qj"], "left")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                get = dict(zip(batch.schema.names, batch.columns))
                edges, close = get[EDGES], get["__near"]
                ends, stops = edges.offsets.to_numpy(), close.offsets.to_numpy()
                e = np.array([edges.values.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")])
                px, py, pf = (close.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "f"))
                rows, own = [], []
                plain = zip(*(get[c].to_pylist() for c in (instance, "__qi", "__qj", "__empty", CX, CY, "__x0", "__nx", "__y0", "__ny")))
                for i, (name, qi, qj, empty, cx, cy, x0, nx, y0, ny) in enumerate(plain):
                    if empty:
                        x, y = (np.array([np.nan if v is None else v]) for v in (cx, cy))
                    else:
                        x, y = _held(_axis(x0, nx, step, qi, side), _axis(y0, ny, step, qj, side), e[:, ends[i] : ends[i + 1]])
                    ox, oy, of = (v[stops[i] : stops[i + 1]] for v in (px, py, pf))
                    room = max(1, min(PIXELS, (1 << 22) // max(1, len(ox), size)))
                    for k in range(0, len(x), room):
                        ux, uy = x[k : k + room], y[k : k + room]
                        dx, dy = ox - ux[:, None], oy - uy[:, None]
                        at, hit = np.nonzero(dx * dx + dy * dy <= float(r) * float(r))
                        n = np.bincount(at * (size + 1) + of[hit], minlength=len(ux) * (size + 1)).reshape(len(ux), size + 1)
                        rows.append((ux, uy, n[:, :size], n.sum(axis=1)))
                        own.append(name)
                if rows:
                    yield _counted(rows, own, [instance, "x", "y", "counts", "totals"], get[instance].type)

    return joined.mapInArrow(count, f"{instance} {shapes.schema['shape_id'].dataType.simpleString()}, {_COUNTED}")


def _blocks_of(pixels: DataFrame, near: DataFrame, instance: str, names: Sequence) -> DataFrame:
    """_blocks from counts that are there: pixel_counts."""
    own = F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at("counts", n), F.lit(0)).cast("bigint"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), len(names))
    full = pixels.join(near.select("pixel_id", own.alias("n"), "total"), "pixel_id", "left").select(instance, "x", "y", F.coalesce("n", zeros).alias("n"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    grouped = full.groupBy(instance, F.floor(F.col("x") / 32).alias("qi"), F.floor(F.col("y") / 32).alias("qj")).agg(F.collect_list(F.struct("x", "y", "n", "total")).alias("p"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                p, rows, own = batch.column(1), [], []
                for i, name in enumerate(batch.column(0).to_pylist()):
                    block = p[i].values
                    for k in range(0, len(block), PIXELS):
                        part = block.slice(k, PIXELS)
                        x, y, n, total = (c.to_numpy(zero_copy_only=False) if c.type != p.type.value_type.field("n").type else _matrix(c) for c in part.flatten())
                        rows.append((x, y, n, total))
                        own.append(name)
                yield _counted(rows, own, [instance, "x", "y", "counts", "totals"], batch.column(0).type)

    return grouped.select(instance, "p").mapInArrow(pack, f"{instance} {pixels.schema[instance].dataType.simpleString()}, {_COUNTED}")


def _shares(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pixels of a batch of blocks: each feature's share of the points around (0 without any), their number, and each block's pixels."""
    get = dict(zip(batch.schema.names, batch.columns))
    total = get["totals"].flatten().to_numpy(zero_copy_only=False)
    each = np.diff(get["totals"].offsets.to_numpy())
    packed = [np.frombuffer(b, f"u{len(b) // (n * size)}").reshape(n, size) if size else np.zeros((n, 0)) for b, n in zip(get["counts"].to_pylist(), each)]
    counts = np.concatenate(packed).astype(float) if packed else np.zeros((0, size))
    return counts / np.maximum(total, 1)[:, None], total, each


def _profiles(blocks: DataFrame, comp: DataFrame, instance: str, feature: str, names: Sequence) -> DataFrame:
    """(instance, share, scale): arrays in the order of names of the features' shares in each instance and feature_scales; 0 and 1 of features that it has not."""
    size = len(names)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                share, total, each = _shares(batch, size)
                starts = np.cumsum(each) - each
                sums = np.concatenate([np.add.reduceat(v, starts, axis=0) for v in (share, share * share, (total > 0)[:, None].astype(float))], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(instance)), _table(sums)], names=[instance, "v"])

    kind = blocks.schema[instance].dataType.simpleString()
    sums = blocks.mapInArrow(add, f"{instance} {kind}, v array<double>").select(instance, F.posexplode("v").alias("i", "v")).groupBy(instance, "i").agg(F.sum("v").alias("v"))
    sums = sums.groupBy(instance).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("__sums"))
    own = comp.groupBy(instance).agg(F.map_from_entries(F.collect_list(F.struct(feature, "share"))).alias("__own"))
    pixels = F.element_at("__sums", 2 * size)

    def scale(name: Column, i: Column) -> Column:
        mean = F.element_at("__sums", i) / pixels
        var = F.greatest(F.lit(0.0), F.element_at("__sums", i + size) / pixels - mean * mean)
        return F.when(F.element_at("__own", name).isNotNull() & (pixels > 0) & (var > 1e-18), F.sqrt(var)).otherwise(1.0)

    listed = F.array(*map(F.lit, names))
    share = F.transform(listed, lambda n: F.coalesce(F.element_at("__own", n), F.lit(0.0)))
    return own.join(sums, instance).select(instance, share.alias("share"), F.transform(listed, scale).alias("scale"))


def _flux_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share around - share in the instance) / scale of all pixels of a batch of blocks, 0 of those without points; with _shares' numbers."""
    around, total, each = _shares(batch, size)
    get = dict(zip(batch.schema.names, batch.columns))
    there = get["share"].is_valid().to_numpy(zero_copy_only=False)
    share, scale = np.zeros((len(batch), size)), np.ones((len(batch), size))
    share[there], scale[there] = (get[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in ("share", "scale"))
    at = np.repeat(np.arange(len(batch)), each)
    return np.where((total > 0)[:, None], (around - share[at]) / scale[at], 0.0), total, each


def _pixels(blocks: DataFrame, instance: str, size: int, vectors: np.ndarray | None = None, whole: bool = True) -> DataFrame:
    """A row for each pixel of blocks with profiles: (instance, x, y, flux) if whole, flux_counts, and flux_embed if there are vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for first in range(0, len(full), SLICE):
                batch = full.slice(first, SLICE)
                get = dict(zip(batch.schema.names, batch.columns))
                x, total, each = _flux_of(batch, size)
                columns = {"flux_counts": pa.array(total, pa.int64())}
                if whole:
                    columns |= {instance: get[instance].take(pa.array(np.repeat(np.arange(len(batch)), each))), "x": get["x"].flatten(), "y": get["y"].flatten(), "flux": _table(x)}
                if vectors is not None:
                    columns["flux_embed"] = _table(x @ vectors)
                yield pa.RecordBatch.from_arrays([columns[c] for c in schema], names=list(schema))

    kind = blocks.schema[instance].dataType.simpleString()
    schema = {instance: kind, "x": "double", "y": "double", "flux": "array<double>"} if whole else {}
    schema |= {"flux_counts": "bigint"} | ({"flux_embed": "array<double>"} if vectors is not None else {})
    return blocks.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in schema.items()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gram(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, column sums and rows of an array column: features x features numbers, added in tasks."""
    return _added(df.select(column), lambda batch: _matrix(batch.column(0)))


def _added(df: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """gram of the rows that matrix makes of slices of df."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = None, None, 0
        for whole in batches:
            for first in range(0, len(whole), SLICE * 16):
                x = matrix(whole.slice(first, SLICE * 16))
                if len(x):
                    total = x.T @ x if total is None else total + x.T @ x
                    sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
                    n += len(x)
        if total is not None:
            rows = [*total.tolist(), sums.tolist(), [float(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "v"])

    parts = df.mapInArrow(add, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not found:
        return np.zeros((0, 0)), np.zeros(0), 0
    size = max(r["j"] for r in found) + 1
    out = np.zeros((size + 2, size))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return out[:size], out[size], int(out[size + 1, 0])


def truncated_svd(df: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (features x k) of the matrix that is not centred, largest entry positive, and each component's share of the variance."""
    return _singular(*gram(df, column), k)


def _singular(total: np.ndarray, sums: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """truncated_svd from gram's numbers."""
    if not n:
        return np.zeros((len(sums), k)), np.zeros(k)
    values, vectors = np.linalg.eigh(total)
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    second = np.einsum("ij,ik,kj->j", vectors, total, vectors) / n
    mean = sums @ vectors / n
    spread = np.trace(total) / n - float(((sums / n) ** 2).sum())
    return vectors, (second - mean**2) / (spread or 1.0)


def project(df: DataFrame, column: str, out: str, vectors: np.ndarray) -> DataFrame:
    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return _table(_matrix(values) @ vectors if len(values) else np.zeros((0, vectors.shape[1])))

    return df.withColumn(out, run(F.col(column)))


def vec2color(df: DataFrame, embed: str, alpha: str, out: str = "flux_color", knots: int = 256, fitted: DataFrame | None = None) -> DataFrame:
    """'#rrggbbaa' of the first three dimensions, each made uniform by its quantiles, with opacity alpha / max(alpha); both are of `fitted`, the same rows if given."""
    dims = 3
    first = (df if fitted is None else fitted).select(*(F.get(F.col(embed), i).alias(f"d{i}") for i in range(dims)), alpha)
    levels = [i / (knots - 1) for i in range(knots)]
    row = first.agg(*(F.percentile_approx(f"d{i}", levels, 10_000).alias(f"d{i}") for i in range(dims)), F.max(alpha).alias("top")).first()
    tables = [np.array(row[f"d{i}"] if row[f"d{i}"] else [0.0, 1.0]) for i in range(dims)]
    top = float(row["top"] or 1) or 1.0

    hexes = np.frombuffer("".join(f"{v:02x}" for v in range(256)).encode(), np.uint8).reshape(256, 2)

    @F.arrow_udf("string")
    def run(vectors: pa.Array, weight: pa.Array) -> pa.Array:
        n = len(vectors)
        v = _matrix(vectors) if n else np.zeros((0, dims))
        x = np.zeros((n, dims))
        x[:, : v.shape[1]] = v[:, :dims]
        rgb = [np.interp(x[:, i], t, np.linspace(0, 1, len(t))) for i, t in enumerate(tables)]
        parts = [*rgb, np.clip(weight.to_numpy(zero_copy_only=False).astype(float) / top, 0, 1)]
        codes = np.rint(np.stack(parts, axis=1) * 255).astype(int)
        text = np.concatenate([np.full((n, 1), ord("#"), np.uint8), hexes[codes].reshape(n, -1)], axis=1)
        ends = np.arange(n + 1, dtype=np.int32) * text.shape[1]
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(text.tobytes()))

    return df.withColumn(out, run(F.col(embed), F.col(alpha)))


def train_som(x: np.ndarray, k: int, iterations: int = 1000, seed: int = 11, rate: float = 0.5, sigma: float = 1.0) -> np.ndarray:
    """A line of k units fitted to samples drawn in turn."""
    rng = np.random.Generator(np.random.PCG64(seed))
    units = x[rng.choice(len(x), k, replace=len(x) < k)].astype(float)
    place = np.arange(k)
    for t in range(iterations):
        v = x[rng.integers(len(x))]
        win = int(((units - v) ** 2).sum(axis=1).argmin())
        cool = 1 + 2 * t / iterations
        pull = rate / cool * np.exp(-((place - win) ** 2) / (2 * (sigma / cool) ** 2))
        units += pull[:, None] * (v - units)
    return units


def quantization_error(x: np.ndarray, units: np.ndarray) -> float:
    return float(np.sqrt(((x[:, None, :] - units[None]) ** 2).sum(axis=2)).min(axis=1).mean()) if len(x) else 0.0


def elbow(xs: Sequence[int], ys: Sequence[float]) -> int | None:
    """The knee of a convex falling curve: the point farthest below the line from first to last, on unit axes; None if there is none."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    if len(x) < 3 or y.max() == y.min():
        return None
    u, v = (x - x.min()) / (x.max() - x.min()), (y - y.min()) / (y.max() - y.min())
    gap = (1 - u) - v
    best = int(gap.argmax())
    return int(xs[best]) if gap[best] > 1e-9 else None


def fluxmap(ds: SpatialDataset, n_clusters: int | Iterable[int] = range(2, 9), num_iterations: int = 1000, min_count: int = 50, train_rows: int = 20_000, seed: int = 11) -> SpatialDataset:
    """Domains: pixels with min_count points or more are assigned to the units of a self-organising map; label 0 is background.

    The map is fitted on the driver on a sample of about train_rows pixels; of several n_clusters the elbow of the quantization
    error is taken, and without one the dataset comes back as it is, with a warning. Shapes and point columns fluxmap1, fluxmap2 ...
    replace earlier ones; table 'fluxmap' has the shapes of all domains (shape_id, label, rings), made in one pass.
    """
    instance = ds.attrs["instance_key"]
    key = f"{instance}_raster"
    pixels = ds.points[key]
    rich = pixels.filter(F.col("flux_counts") >= min_count)
    share = min(1.0, train_rows / max(1, rich.count()))
    sample = rich if share >= 1 else rich.sample(False, share, seed)
    x = np.array([r[0] for r in sample.select("flux_embed").collect()], float)
    if not len(x):
        warnings.warn("no pixel has min_count points", UserWarning, stacklevel=2)
        return ds
    ks = [n_clusters] if isinstance(n_clusters, int) else list(n_clusters)
    maps = {k: train_som(x, k, num_iterations, seed) for k in ks}
    best = ks[0] if len(ks) == 1 else elbow(ks, [quantization_error(x, maps[k]) for k in ks])
    if best is None:
        warnings.warn("no number of clusters stands out; give n_clusters", UserWarning, stacklevel=2)
        return ds
    units = maps[best]

    @F.arrow_udf("int")
    def winner(vectors: pa.Array) -> pa.Array:
        v = _matrix(vectors) if len(vectors) else np.zeros((0, units.shape[1]))
        return pa.array(((v[:, None, :] - units[None]) ** 2).sum(axis=2).argmin(axis=1) + 1, pa.int32())

    label = F.when(F.col("flux_counts") >= min_count, winner(F.col("flux_embed"))).otherwise(0)
    pixels = pixels.drop("fluxmap").withColumn("fluxmap", label.cast("int"))
    step = 1 / ds.attrs["flux_res"]
    shapes = vectorize(pixels, instance, "fluxmap", step).withColumnRenamed(instance, "__c").withColumnRenamed("label", "__l")
    every = ds.shapes[instance].select("shape_id", F.explode(F.sequence(F.lit(1), F.lit(best))).alias("label"))
    domains = every.join(shapes, (F.col("shape_id") == F.col("__c")) & (F.col("label") == F.col("__l")), "left")
    domains = domains.select("shape_id", "label", F.coalesce("rings", F.array().cast(RINGS)).alias("rings")).persist()
    # Domains lie within a pixel of their cells' bounds, so the cells tell whether any can meet, and no domain is made for that.
    meet = overlapping(ds.shapes[instance], grown=step)
    points = ds.points[ds.attrs["points_key"]]
    points = points.drop(*(c for c in points.columns if c.startswith("fluxmap")))
    kept = {k: s for k, s in ds.shapes.items() if not k.startswith("fluxmap")}
    for i in range(1, best + 1):
        name = f"fluxmap{i}"
        full = domains.filter(F.col("label") == i).select("shape_id", "rings", F.col("shape_id").alias(instance))
        kept[name] = full
        points = points_in_shapes(points, full.filter(F.size("rings") > 0), name, overlap=meet)
    out = SpatialDataset({**ds.points, key: pixels, ds.attrs["points_key"]: points}, kept, {**ds.tables, "fluxmap": domains}, ds.attrs)
    others = [k for k in ds.attrs["shape_keys"] if not k.startswith("fluxmap")]
    return out.with_attrs(shape_keys=[*others, *(f"fluxmap{i}" for i in range(1, best + 1))], n_domains=best)


def vectorize(pixels: DataFrame, instance: str, label: str, step: float) -> DataFrame:
    """(instance, label, rings): for each instance and label above 0 the border of its pixels, squares of width step around them."""

    def trace(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low = frame[["x", "y"]].min().to_numpy()
        col, row = np.rint((frame["x"].to_numpy() - low[0]) / step).astype(int), np.rint((frame["y"].to_numpy() - low[1]) / step).astype(int)
        image = np.zeros((row.max() + 1, col.max() + 1), np.int16)
        image[row, col] = frame[label].to_numpy()
        rows = []
        for v in np.unique(image[image > 0]):
            rings = [r * step + (low - step / 2) for r in contours(image == v)]
            rows.append((group[0], int(v), from_rings(rings)))
        return pd.DataFrame(rows, columns=[instance, "label", "rings"])

    schema = f"{instance} string, label int, rings array<array<struct<x: double, y: double>>>"
    return pixels.select(instance, "x", "y", label).groupBy(instance).applyInPandas(trace, schema)


def labels_to_shapes(image: DataFrame, instance: str = "image") -> DataFrame:
    """A label image (image, x, y, label) with unit pixels to shapes (shape_id, rings): one for each label but 0."""
    out = vectorize(image.withColumnRenamed(instance, "__image") if instance != "image" else image.withColumnRenamed("image", "__image"), "__image", "label", 1.0)
    return out.select(F.concat_ws("_", "__image", "label").alias("shape_id"), "rings")


# Enrichment -------------------------------------------------------------------------------------------------------------


def _net_matrix(net: DataFrame, names: Sequence[str], min_n: int) -> tuple[list[str], np.ndarray]:
    at = {n: i for i, n in enumerate(names)}
    rows = [r for r in net.select("source", "target", "weight").distinct().collect() if r["target"] in at]
    sources = sorted({r["source"] for r in rows})
    weights = np.zeros((len(names), len(sources)))
    for r in rows:
        weights[at[r["target"]], sources.index(r["source"])] = r["weight"]
    keep = (weights != 0).sum(axis=0) >= max(1, min_n)
    return [s for s, k in zip(sources, keep) if k], weights[:, keep]


def fe(ds: SpatialDataset, net: DataFrame, min_n: int = 0, times: int = 100, seed: int = 42) -> SpatialDataset:
    """Columns flux_<source> of the raster: the weighted sum of a pixel's flux over a gene set, times -log10 of its p-value.

    The p-value is two-sided, of `times` permutations of the features that all pixels share, at least 1 / times. net (source,
    target, weight) is collected: sources x features numbers.
    """
    instance = ds.attrs["instance_key"]
    key = f"{instance}_raster"
    names = ds.attrs["flux_features"]
    sources, weights = _net_matrix(net, names, min_n)
    rng = np.random.Generator(np.random.PCG64(seed))
    orders = [rng.permutation(len(names)) for _ in range(times)]

    # Sets with the same weights have the same score.
    unique, own = np.unique(weights, axis=1, return_inverse=True) if sources else (weights, np.zeros(0, int))

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        x = _matrix(values) if len(values) else np.zeros((0, len(names)))
        estimate = x @ unique
        beyond = np.zeros_like(estimate)
        for order in orders:
            beyond += np.abs(x @ unique[order]) >= np.abs(estimate) - 1e-12
        p = np.maximum(beyond, 1) / times
        return _table(estimate * -np.log10(p))

    pixels = ds.points[key].withColumn("__fe", run(F.col("flux")))
    pixels = pixels.withColumns({f"flux_{s}": F.get("__fe", int(i)) for s, i in zip(sources, own.reshape(-1))}).drop("__fe")
    return ds.with_points(key, pixels).with_table("fe_ngenes", fe_ngenes(net, ds.tables["table"], ds.attrs["feature_key"])).with_table("fe_stats", fe_stats(net, ds.tables["table"], instance, ds.attrs["feature_key"]))


def weighted_sums(long: DataFrame, net: DataFrame, by: Sequence[str], feature: str, value: str = "flux") -> DataFrame:
    """(by..., source, score): the sum of weight x value over the targets of each source."""
    joined = long.join(net, F.col(feature) == F.col("target"))
    return joined.groupBy(*by, "source").agg(F.sum(F.col("weight") * F.col(value)).alias("score"))


def fe_stats(net: DataFrame, table: DataFrame, instance: str, feature: str, least: int = 5) -> DataFrame:
    """(instance, source, n_genes): targets of the set with a count of at least `least`; 0 where there are none."""
    rich = table.filter(F.col("n") >= least).select(instance, feature)
    sets = net.select("source", "target").distinct()
    found = rich.join(sets, F.col(feature) == F.col("target")).groupBy(instance, "source").agg(F.count("*").alias("n_genes"))
    every = table.select(instance).distinct().join(sets.select("source").distinct())
    return every.join(found, [instance, "source"], "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0)).cast("long"))


def fe_ngenes(net: DataFrame, table: DataFrame, feature: str) -> DataFrame:
    """(source, n): targets of each set that the dataset has."""
    sets = net.select("source", F.col("target").alias(feature)).distinct()
    return sets.join(table.select(feature).distinct(), feature).groupBy("source").agg(F.count("*").alias("n"))


def fe_sets(ds: SpatialDataset, spark, files: dict[str, str], name: str, **kws) -> SpatialDataset:
    """fe with a named gene set from the caller's files."""
    from ..sources.io import read_gene_sets

    return fe(ds, read_gene_sets(spark, files, name), **kws)


def reindex(ds: SpatialDataset, shape_keys: Sequence[str]) -> SpatialDataset:
    a = ds.attrs
    return prep(ds, a["points_key"], a["feature_key"], a["instance_key"], shape_keys)


def column_norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda v: v * v), F.lit(0.0), lambda t, v: t + v))
