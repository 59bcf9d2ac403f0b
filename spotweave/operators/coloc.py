"""Colocation quotients, their tensor, and its factors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import SpatialDataset
from ..sources.scratch import materialize


def clq(points: DataFrame, instance: str, feature: str, radius: float = 20.0, min_points: int = 10, min_cells: int = 0, compat: bool = False) -> DataFrame:
    """(feature, neighbor, instance, clq, ci_lower, ci_upper, log_*) for the pairs of features of each instance.

    Features with min_points points in the instance, of which there must be two, and that occur in more than min_cells
    instances (compat: have more than min_cells points). a: points of the source with a neighbour of the other feature within
    radius; b, c: points of the source and of the neighbour; d: all points counted. clq = (a / b) / (c / d), with a 95 %
    interval of 1.96 sqrt(1/a + 1/b + 1/c + 1/d). log2 is NULL for what is not above 0.
    """
    return quotients(points, {"all": F.lit(True)}, instance, feature, radius, min_points, min_cells, compat).drop("compartment")


def quotients(points: DataFrame, compartments: dict[str, Column], instance: str, feature: str, radius: float, min_points: int, min_cells: int, compat: bool) -> DataFrame:
    """clq with a column compartment: for each name the quotients among the points where its condition holds. Neighbours are joined once for all."""
    where = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in compartments.items())))
    points = points.withColumn("__in", where).filter(F.size("__in") > 0)
    counts = points.select(instance, feature, F.explode("__in").alias("compartment")).groupBy("compartment", instance, feature).agg(F.count("*").alias("n"))
    if min_cells:
        measure = F.sum("n") if compat else F.count("*")
        common = counts.groupBy("compartment", feature).agg(measure.alias("m")).filter(F.col("m") > min_cells).select("compartment", feature)
        counts = counts.join(common, ["compartment", feature], "left_semi")
    counts = counts.filter(F.col("n") >= min_points)
    totals = counts.groupBy("compartment", instance).agg(F.sum("n").alias("d"), F.count("*").alias("k")).filter("k >= 2").drop("k")
    counts = counts.join(totals, ["compartment", instance])
    points = points.filter(F.col(instance).isNotNull() & F.col(feature).isNotNull())
    names = [row[0] for row in points.select(feature).distinct().orderBy(feature).collect()]
    kind = points.schema[feature].dataType.simpleString()
    listed = points.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"__name {kind}, f int")
    around = _seen(points.join(F.broadcast(listed), F.col(feature) == F.col("__name")), instance, "__in", list(compartments), radius, len(names))
    place = F.array_position(F.array(*map(F.lit, compartments)), F.col("compartment")).cast("int") - 1
    own = counts.join(F.broadcast(listed), F.col(feature) == F.col("__name")).groupBy(instance).agg(F.collect_list(F.struct(place.alias("k"), "f", "n", "d")).alias("own"))
    found = _counted(around, own, instance, len(compartments), len(names)).select(instance, "k", "d", F.inline("pairs"))
    name = lambda values, kind, at: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col(at))
    out = found.select(name(compartments, "string", "k").alias("compartment"), name(names, kind, "f").alias(feature), name(names, kind, "g").alias("neighbor"), instance, "a", "b", "c", "d")
    value = F.try_divide(F.col("a") / F.col("b"), F.col("c") / F.col("d"))
    half = 1.96 * F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d"))
    out = out.select("compartment", feature, "neighbor", instance, value.alias("clq"), (value - half).alias("ci_lower"), (value + half).alias("ci_upper"))
    log = lambda name: F.when(F.col(name) > 0, F.log2(name))
    return out.select("*", log("clq").alias("log_clq"), log("ci_lower").alias("log_ci_lower"), log("ci_upper").alias("log_ci_upper"))


#: Pairs of points whose distances are made at once.
TESTED = 1 << 18


def _pairs(x: np.ndarray, y: np.ndarray, f: np.ndarray, held: np.ndarray, own: np.ndarray, r: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers) of a group of points: how many own points of a feature have a neighbour of the other feature, once each, within r.

    held: bits of the compartments that hold a point. A code is (compartment * size + feature) * size + neighbour. Points go by x,
    so that own points meet only what lies within r by x.
    """
    order = np.argsort(x, kind="stable")
    x, y, f, held, own = x[order], y[order], f[order].astype(np.int64), held[order], own[order]
    ask = np.nonzero(own)[0]
    low, high = (np.searchsorted(x, x[ask] + d * (1 + 1e-9), side) for d, side in ((-r, "left"), (r, "right")))
    codes, first = [], 0
    while first < len(ask):
        last = min(first + 64, len(ask))
        while last > first + 1 and (last - first) * (high[last - 1] - low[first]) > TESTED:
            last = (first + last) // 2
        q, near = ask[first:last], slice(low[first], high[last - 1])
        dx, dy = x[near] - x[q][:, None], y[near] - y[q][:, None]
        i, j = np.nonzero(dx * dx + dy * dy <= r * r)
        both, code = held[q][i] & held[near][j], i * size + f[near][j]
        for k in range(int(both.max(initial=0)).bit_length()):
            mine = code[(both >> k & 1).astype(bool)]
            if len(q) * size <= TESTED:
                seen = np.zeros(len(q) * size, bool)
                seen[mine] = True
                mine = np.nonzero(seen)[0]
            else:
                mine = np.unique(mine)
            codes.append((k * size + f[q][mine // size]) * size + mine % size)
        first = last
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _seen(points: DataFrame, instance: str, held: str, compartments: Sequence[str], r: float, size: int) -> DataFrame:
    """(instance, codes binary, numbers binary): _pairs of the points (x, y, f, held array<string>) in each square of an instance.

    A point is its square's own and goes to all squares that a circle of r around it touches. The squares are 16 r wide, so few
    points go to several, and a crowded instance is spread over tasks. The rows come sorted; a task holds a square.
    """
    if len(compartments) > 62:
        raise ValueError("at most 62 compartments")
    side, reach = F.lit(16.0 * r), F.lit(float(r) * (1 + 1e-9))
    bits = F.aggregate(held, F.lit(0).cast("bigint"), lambda t, c: t + F.element_at(F.create_map(*(F.lit(v) for k, name in enumerate(compartments) for v in (name, 1 << k))), c).cast("bigint"))
    near = points.select(instance, "x", "y", "f", bits.alias("held"))
    for c, q in (("x", "qi"), ("y", "qj")):
        near = near.withColumn(q, F.explode(F.sequence(F.floor((F.col(c) - reach) / side).cast("bigint"), F.floor((F.col(c) + reach) / side).cast("bigint"))))
    own = (F.col("qi") == F.floor(F.col("x") / side)) & (F.col("qj") == F.floor(F.col("y") / side))
    key = [instance, "qi", "qj"]
    near = near.select(*key, "x", "y", "f", "held", own.alias("own")).repartition(*key).sortWithinPartitions(*key)

    def groups(table: pa.Table) -> np.ndarray:
        """Where groups begin, and the end."""
        cut = np.zeros(max(0, len(table) - 1), bool)
        for c in key:
            v = table.column(c)
            cut |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.nonzero(cut)[0] + 1, [len(table)]])

    def rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in ("x", "y", "f", "held", "own")]
        done = [_pairs(*(v[a:b] for v in columns), float(r), size) for a, b in zip(starts[:-1], starts[1:])]
        first = table.column(instance).take(pa.array(starts[:-1])).combine_chunks()
        return pa.RecordBatch.from_arrays([first, *(pa.array([d[i].astype("<i8" if i == 0 else "<i4").tobytes() for d in done], pa.binary()) for i in (0, 1))], names=[instance, "codes", "numbers"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            starts = groups(table)
            if len(starts) > 2:
                yield rows(table, starts[:-1])
            rest = table.slice(starts[-2])
        if rest is not None and len(rest):
            yield rows(rest, groups(rest))

    return near.mapInArrow(count, f"`{instance}` {points.schema[instance].dataType.simpleString()}, codes binary, numbers binary")


def _counted(around: DataFrame, own: DataFrame, instance: str, compartments: int, size: int) -> DataFrame:
    """(instance, k, d, pairs array<struct<f, g, a, b, c>>): _seen's numbers of all squares of an instance, with the points of either feature.

    own (instance, own array<struct<k, f, n, d>>): the features counted in each compartment; pairs of others are left out.
    """
    parts = around.groupBy(instance).agg(F.collect_list(F.struct("codes", "numbers")).alias("parts"))
    kinds = pa.struct([(c, pa.int32() if c in "fg" else pa.int64()) for c in "fgabc"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 64):
                batch = whole.slice(first, 64)
                keys, places, totals, ends, pairs = [], [], [], [0], []
                for i, (parts, counts) in enumerate(zip(batch.column(1), batch.column(2))):
                    parts, counts = parts.values, counts.values
                    codes = np.frombuffer(b"".join(parts.field("codes").to_pylist()), "<i8")
                    numbers = np.frombuffer(b"".join(parts.field("numbers").to_pylist()), "<i4")
                    codes, at = np.unique(codes, return_inverse=True)
                    a = np.bincount(at, numbers, len(codes)).astype(np.int64)
                    k, f, n, d = (counts.field(c).to_numpy() for c in ("k", "f", "n", "d"))
                    points, total = np.zeros((compartments, size), np.int64), np.zeros(compartments, np.int64)
                    points[k, f], total[k] = n, d
                    ck, cf, cg = codes // (size * size), codes // size % size, codes % size
                    b, c = points[ck, cf], points[ck, cg]
                    for j in range(compartments):
                        mine = (ck == j) & (b > 0) & (c > 0)
                        if mine.any():
                            keys.append(i)
                            places.append(j)
                            totals.append(total[j])
                            pairs.append([v[mine] for v in (cf, cg, a, b, c)])
                            ends.append(ends[-1] + len(pairs[-1][0]))
                if keys:
                    flat = [pa.array(np.concatenate(v), t.type) for v, t in zip(zip(*pairs), kinds)]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kinds)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(places, pa.int32()), pa.array(totals, pa.int64()), lists], names=[instance, "k", "d", "pairs"])

    kind = own.schema[instance].dataType.simpleString()
    return parts.join(own, instance).mapInArrow(add, f"`{instance}` {kind}, k int, d bigint, pairs array<struct<f: int, g: int, a: bigint, b: bigint, c: bigint>>")


def coloc_quotient(ds: SpatialDataset, shapes: Sequence[str], radius: float = 20.0, min_points: int = 10, min_cells: int = 0, compat: bool = False) -> SpatialDataset:
    """Table 'clq' with a column compartment: for each shape key the quotients among points inside such a shape (compat: all points of the instance, for every key)."""
    a = ds.attrs
    instance, feature = a["instance_key"], a["feature_key"]
    points = ds.points[a["points_key"]].filter(F.col(instance).isNotNull())
    compartments = {shape: F.lit(True) if compat else F.col(shape).isNotNull() for shape in shapes}
    return ds.with_table("clq", quotients(points, compartments, instance, feature, radius, min_points, min_cells, compat))


def colocation_tensor(table: DataFrame, instance: str, feature: str) -> DataFrame:
    """(compartment, instance, feature, neighbor, value): log_clq where there is one; all other entries of the tensor are 0."""
    return table.filter(F.col("log_clq").isNotNull()).select("compartment", instance, feature, "neighbor", F.col("log_clq").alias("value"))


def tensor_labels(tensor: DataFrame, instance: str, feature: str) -> dict[str, list]:
    """The sorted labels of the three modes."""
    pairs = sorted(tuple(r) for r in tensor.select(feature, "neighbor").distinct().collect())
    return {"compartment": sorted(r[0] for r in tensor.select("compartment").distinct().collect()), "instance": sorted(r[0] for r in tensor.select(instance).distinct().collect()), "pair": pairs}


class _Unfolded:
    """A sparse 3-way tensor as a matrix of (first, second) by third: all cells in blocks of rows if half of them are entries, else the entries."""

    def __init__(self, coords: np.ndarray, values: np.ndarray, shape: tuple[int, int, int], block: int = 1 << 20):
        self.row, self.column, self.values = coords[:, 0].astype(np.int64) * shape[1] + coords[:, 1], coords[:, 2], values
        self.rows, self.columns = shape[0] * shape[1], shape[2]
        self.dense = 0 < self.rows * self.columns <= 2 * len(values)
        if self.dense:
            self.matrix, self.there = np.zeros((self.rows, self.columns)), np.zeros((self.rows, self.columns), bool)
            self.matrix[self.row, self.column], self.there[self.row, self.column] = values, True
            del self.row, self.column, self.values
            step = max(1, block // self.columns)
            self.blocks = [slice(i, i + step) for i in range(0, self.rows, step)]
        else:
            self.positive = np.maximum(values, 0)

    def times(self, c: np.ndarray) -> np.ndarray:
        """The positive part times c, a row for each (first, second)."""
        if self.dense:
            return np.concatenate([np.maximum(self.matrix[b], 0) @ c for b in self.blocks])
        return np.stack([np.bincount(self.row, self.positive * v[self.column], self.rows) for v in c.T], axis=1)

    def transposed(self, ab: np.ndarray) -> np.ndarray:
        """The positive part, transposed, times ab."""
        if self.dense:
            return sum(np.maximum(self.matrix[b], 0).T @ ab[b] for b in self.blocks)
        return np.stack([np.bincount(self.column, self.positive * v[self.row], self.columns) for v in ab.T], axis=1)

    def error(self, ab: np.ndarray, c: np.ndarray) -> float:
        """The mean absolute error over the entries."""
        if self.dense:
            return float(sum((np.abs(self.matrix[b] - ab[b] @ c.T) * self.there[b]).sum() for b in self.blocks) / self.there.sum())
        if not len(self.values):
            return 0.0
        return float(np.abs(self.values - sum(u[self.row] * v[self.column] for u, v in zip(ab.T, c.T))).mean())


def parafac(coords: np.ndarray, values: np.ndarray, shape: tuple[int, int, int], rank: int, seed: int, iterations: int = 200, tolerance: float = 1e-7, start: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], float]:
    """Non-negative factors of a sparse 3-way tensor by multiplicative updates, and the mean absolute error over entries that are not 0."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factors = start or [rng.random((n, rank)) + 0.1 for n in shape]
    scale = (np.abs(values).sum() / max(1e-12, np.prod([f.sum(axis=0) for f in factors], axis=0).sum())) ** (1 / 3) if len(values) else 0.0
    a, b, c = (f * scale for f in factors)
    tensor = _Unfolded(coords, values, shape)
    before = np.inf
    for _ in range(iterations):
        both = tensor.times(c).reshape(shape[0], shape[1], rank)
        a = a * np.einsum("abr,br->ar", both, b) / np.maximum(a @ ((b.T @ b) * (c.T @ c)), 1e-12)
        b = b * np.einsum("abr,ar->br", both, a) / np.maximum(b @ ((a.T @ a) * (c.T @ c)), 1e-12)
        ab = (a[:, None] * b[None]).reshape(-1, rank)
        c = c * tensor.transposed(ab) / np.maximum(c @ ((a.T @ a) * (b.T @ b)), 1e-12)
        error = tensor.error(ab, c)
        if abs(before - error) < tolerance:
            break
        before = error
    return [a, b, c], error


MODES = ("compartment", "instance", "pair")


def _products(factor: DataFrame, rank: int) -> np.ndarray:
    """F'F of a factor table: rank x rank numbers."""
    both = [(a, b) for a in range(rank) for b in range(a, rank)]
    row = factor.agg(*(F.sum(F.col("f")[a] * F.col("f")[b]).alias(f"p{a}_{b}") for a, b in both)).first()
    out = np.zeros((rank, rank))
    for (a, b), v in zip(both, row):
        out[a, b] = out[b, a] = v or 0.0
    return out


def _chance(label: Column, mode: str, rank: int, seed: int) -> list[Column]:
    """Where the factor of a label starts, whatever the order of the labels."""
    return [F.pmod(F.xxhash64(label, F.lit(mode), F.lit(k), F.lit(seed)), F.lit(1 << 20)) / (1 << 20) + 0.1 for k in range(rank)]


def parafac_joins(entries: DataFrame, rank: int, seed: int, iterations: int = 200, tolerance: float = 1e-7, start: list[DataFrame] | None = None) -> tuple[list[DataFrame], float]:
    """parafac for entries (compartment, instance, pair, value) of any number; factors are tables (label, f array<double>).

    Each update joins the entries with the other two factors and sums by label; the driver sees rank x rank numbers. A
    factor is written after each update, so no plan grows with the iterations.
    """

    def begun(mode: str) -> DataFrame:
        return entries.select(F.col(mode).alias("label")).distinct().select("label", F.array(*_chance(F.col("label"), mode, rank, seed)).alias("f"))

    def joined(modes: Sequence[str], factors: dict[str, DataFrame]) -> DataFrame:
        out = entries
        for m in modes:
            out = out.join(factors[m].select(F.col("label").alias(m), F.col("f").alias(f"f_{m}")), m)
        return out

    def error(factors: dict[str, DataFrame]) -> float:
        model = sum((F.col("f_compartment")[k] * F.col("f_instance")[k] * F.col("f_pair")[k] for k in range(rank)), F.lit(0.0))
        return joined(MODES, factors).agg(F.avg(F.abs(F.col("value") - model))).first()[0] or 0.0

    factors = dict(zip(MODES, [materialize(f, "factor") for f in (start or map(begun, MODES))]))
    sums = [factors[m].agg(*(F.sum(F.col("f")[k]) for k in range(rank))).first() for m in MODES]
    total = entries.agg(F.sum(F.abs("value"))).first()[0] or 0.0
    scale = (total / max(1e-12, float(np.prod([[v or 0.0 for v in row] for row in sums], axis=0).sum()))) ** (1 / 3)
    factors = {m: f.select("label", F.transform("f", lambda x: x * scale).alias("f")) for m, f in factors.items()}
    before, now = np.inf, 0.0
    for _ in range(iterations):
        for mode in MODES:
            a, b = (m for m in MODES if m != mode)
            weights = _products(factors[a], rank) * _products(factors[b], rank)
            positive = F.greatest("value", F.lit(0.0))
            terms = [F.sum(positive * F.col(f"f_{a}")[k] * F.col(f"f_{b}")[k]) for k in range(rank)]
            above = joined((a, b), factors).groupBy(F.col(mode).alias("label")).agg(F.array(*terms).alias("above"))
            below = [sum((F.col("f")[j] * float(weights[j, k]) for j in range(rank)), F.lit(0.0)) for k in range(rank)]
            new = [F.col("f")[k] * F.col("above")[k] / F.greatest(below[k], F.lit(1e-12)) for k in range(rank)]
            factors[mode] = materialize(factors[mode].join(above, "label").select("label", F.array(*new).alias("f")), "factor")
        now = error(factors)
        if abs(before - now) < tolerance:
            break
        before = now
    return [factors[m] for m in MODES], now


def _decompose_joins(tensor: DataFrame, instance: str, feature: str, ranks: Iterable[int], iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    entries = tensor.select("compartment", F.col(instance).alias("instance"), F.concat_ws("|", feature, "neighbor").alias("pair"), "value")
    entries = materialize(entries, "tensor")
    out, errors = None, []
    for rank in ranks:
        best, error = min((parafac_joins(entries, rank, seed + i) for i in range(iterations)), key=lambda f: f[1])
        errors.append((int(rank), error))
        for mode, factor in zip(MODES, best):
            part = factor.select(F.lit(int(rank)).alias("rank"), F.lit(mode).alias("mode"), F.col("label").cast("string").alias("label"), F.posexplode("f").alias("component", "loading"))
            out = part if out is None else out.unionByName(part)
    return out, tensor.sparkSession.createDataFrame(errors, "rank int, rmse double")


#: An entry as tasks get it, 20 bytes.
_ENTRY = np.dtype([("at", "<i4", 3), ("value", "<f8")])


def _packed(entries: DataFrame, labels: dict[str, list]) -> DataFrame:
    """(entries binary) of (compartment, instance, feature, neighbor, value): places among the labels and values, many in a row."""
    spark = entries.sparkSession
    c, i, f, n, _ = entries.columns
    for key, on in (("compartment", [c]), ("instance", [i]), ("pair", [f, n])):
        kinds = ", ".join(f"`{x}` {entries.schema[x].dataType.simpleString()}" for x in on)
        rows = [(*(v if len(on) > 1 else (v,)), k) for k, v in enumerate(labels[key])]
        entries = entries.join(spark.createDataFrame(rows, f"{kinds}, __{key} int"), on)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch), _ENTRY)
            for k in range(3):
                out["at"][:, k] = batch.column(k).to_numpy()
            out["value"] = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["entries"])

    return entries.select("__compartment", "__instance", "__pair", "value").mapInArrow(pack, "entries binary")


#: Entries of a block at most, but for one instance's, and numbers of all factors that the driver holds.
BLOCK, FACTORS = 1 << 20, 4_000_000


def _blocks(tensor: DataFrame, n: int, instance: str, kinds: list[tuple], modes: tuple[list, list]) -> DataFrame:
    """(labels array<string>, cells binary): the entries of some instances, as _ENTRY with places among these, the compartments and the pairs."""
    on = [c for c in tensor.columns if c not in (instance, "value")]
    places = [{v: k for k, v in enumerate(m)} for m in modes]
    listed = [(c, f, g, places[0][c], places[1][f, g]) for c, f, g in kinds]
    schema = ", ".join(f"`{c}` {tensor.schema[c].dataType.simpleString()}" for c in on)
    entries = tensor.join(F.broadcast(tensor.sparkSession.createDataFrame(listed, f"{schema}, __c int, __p int")), on)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        parts = []
        for batch in batches:
            out = np.empty(len(batch), _ENTRY)
            coded = batch.column(0).dictionary_encode()
            known = np.array([place.setdefault(v, len(place)) for v in coded.dictionary.to_pylist()], np.int32)
            out["at"][:, 0], out["at"][:, 1], out["at"][:, 2] = batch.column(1).to_numpy(), known[coded.indices.to_numpy()], batch.column(2).to_numpy()
            out["value"] = batch.column(3).to_numpy()
            parts.append(out)
        if place:
            names = sorted(place)
            at = np.empty(len(names), np.int32)
            at[[place[v] for v in names]] = np.arange(len(names))
            whole = np.concatenate(parts)
            whole["at"][:, 1] = at[whole["at"][:, 1]]
            # In one order, so that sums do not depend on which row was first.
            whole = whole[np.lexsort(whole["at"].T[::-1])]
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([whole.tobytes()], pa.binary())], names=["labels", "cells"])

    entries = entries.filter(F.col(instance).isNotNull()).select(F.col(instance).cast("string").alias("__label"), "__c", "__p", "value")
    return entries.repartition(-(-n // BLOCK), "__label").mapInArrow(pack, "labels array<string>, cells binary")


def parafac_blocks(blocks: DataFrame, modes: tuple[list[str], list[str]], runs: Sequence[tuple[int, int]], iterations: int = 200, tolerance: float = 1e-7) -> tuple[list[str], list[tuple[list[np.ndarray], float]]]:
    """The instances and, for each run (rank, seed), parafac_joins' factors and error, from _blocks that are written.

    Two jobs an iteration serve all runs that go on: tasks multiply their entries with the factors, which the driver holds; the
    error of an iteration comes with the next one's first job. modes: the compartments' and pairs' labels.
    """
    spark, sizes = blocks.sparkSession, tuple(map(len, modes))

    def chances(label: Column, mode: str) -> Column:
        return F.array(*(c for rank, seed in runs for c in _chance(label, mode, rank, seed)))

    def begun(names: list[str], mode: str) -> np.ndarray:
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", chances(F.col("n"), mode).alias("f")).collect()
        return np.array([r["f"] for r in sorted(rows, key=lambda r: r["k"])], float)

    rows = sorted(blocks.select("labels", F.transform("labels", lambda v: chances(v, MODES[1])).alias("f")).collect(), key=lambda r: r["labels"][0])
    names, ends = [v for r in rows for v in r["labels"]], np.cumsum([0, *(len(r["labels"]) for r in rows)])
    own = {r["labels"][0]: slice(a, b) for r, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist())}
    whole = begun(modes[0], MODES[0]), np.array([f for r in rows for f in r["f"]], float), begun(modes[1], MODES[2])
    del rows
    cut = np.cumsum([0, *(rank for rank, _ in runs)])
    factors = [[f[:, i:j] for f in whole] for i, j in zip(cut[:-1], cut[1:])]

    def passed(work) -> list[np.ndarray]:
        """work(the block's tensor, its slice of the instances) of each block, in their order."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for labels, cells in zip(batch.column(0), batch.column(1)):
                    key, entries = labels[0].as_py(), np.frombuffer(cells.as_buffer(), _ENTRY)
                    out = work(_Unfolded(entries["at"], entries["value"], (sizes[0], len(labels), sizes[1])), own[key], entries["value"])
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([np.ascontiguousarray(out, float).tobytes()], pa.binary())], names=["key", "found"])

        found = {r["key"]: np.frombuffer(r["found"]) for r in blocks.mapInArrow(run, "key string, found binary").collect()}
        return [found[k] for k in own]

    def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, None] * b[None]).reshape(-1, a.shape[1])

    total, n = np.sum(passed(lambda tensor, at, values: np.array([np.abs(values).sum(), len(values)])), axis=0)
    factors = [[f * (total / max(1e-12, np.prod([g.sum(axis=0) for g in three], axis=0).sum())) ** (1 / 3) for f in three] for three in factors]
    errors, going = [np.inf] * len(runs), list(range(len(runs)))
    for step in range(iterations + 1):
        now = [factors[k] for k in going]

        def first(tensor: _Unfolded, at: slice, values: np.ndarray) -> np.ndarray:
            wrong = [tensor.error(together(a, b[at]), c) * len(values) if step else 0.0 for a, b, c in now]
            return np.concatenate([wrong, tensor.times(np.concatenate([c for _, _, c in now], axis=1)).reshape(-1)])

        found = passed(first)
        left = []
        for i, k in enumerate(going):
            error = float(sum(f[i] for f in found) / n) if step else np.inf
            if not (step and abs(errors[k] - error) < tolerance):
                left.append(i)
            errors[k] = error
        if not left or step == iterations:
            break
        width = np.cumsum([0, *(runs[k][0] for k in going)])
        both = np.concatenate([f[len(going) :].reshape(sizes[0], -1, width[-1]) for f in found], axis=1)
        for i in left:
            a, b, c = now[i]
            mine = both[:, :, width[i] : width[i + 1]]
            a = a * np.einsum("abr,br->ar", mine, b) / np.maximum(a @ ((b.T @ b) * (c.T @ c)), 1e-12)
            b = b * np.einsum("abr,ar->br", mine, a) / np.maximum(b @ ((a.T @ a) * (c.T @ c)), 1e-12)
            factors[going[i]] = [a, b, c]
        going = [going[i] for i in left]
        now = [factors[k] for k in going]
        ab = np.sum(passed(lambda tensor, at, values: tensor.transposed(np.concatenate([together(a, b[at]) for a, b, _ in now], axis=1))), axis=0).reshape(sizes[1], -1)
        width = np.cumsum([0, *(runs[k][0] for k in going)])
        for i, k in enumerate(going):
            a, b, c = factors[k]
            factors[k] = [a, b, c * ab[:, width[i] : width[i + 1]] / np.maximum(c @ ((a.T @ a) * (b.T @ b)), 1e-12)]
    return names, list(zip(factors, errors))


def _decompose_blocks(tensor: DataFrame, n: int, instance: str, ranks: list[int], iterations: int, seed: int, kinds: list[tuple]) -> tuple[DataFrame, DataFrame]:
    spark = tensor.sparkSession
    modes = sorted({c for c, _, _ in kinds}), sorted({(f, g) for _, f, g in kinds})
    pairs = [f"{f}|{g}" for f, g in modes[1]]
    blocks = materialize(_blocks(tensor, n, instance, kinds, modes), "tensor")
    names, done = parafac_blocks(blocks, ([str(c) for c in modes[0]], pairs), [(rank, seed + i) for rank in ranks for i in range(iterations)])
    factors, errors = [], []
    for k, rank in enumerate(ranks):
        best, error = min(done[k * iterations : (k + 1) * iterations], key=lambda d: d[1])
        errors.append((int(rank), float(error)))
        for mode, labels, matrix in zip(MODES, ([str(c) for c in modes[0]], names, pairs), best):
            at = np.repeat(np.arange(len(labels)), rank)
            factors.append(pd.DataFrame({"rank": int(rank), "mode": mode, "label": np.array(labels, object)[at], "component": np.tile(np.arange(rank), len(labels)), "loading": matrix.reshape(-1)}))
    factors = pa.Table.from_pandas(pd.concat(factors), preserve_index=False)
    return spark.createDataFrame(factors, "rank int, mode string, label string, component int, loading double"), spark.createDataFrame(errors, "rank int, rmse double")


def decompose(tensor: DataFrame, instance: str, feature: str, ranks: Iterable[int], iterations: int = 3, seed: int = 11, max_entries: int = 20_000_000) -> tuple[DataFrame, DataFrame]:
    """Factors (rank, mode, label, component, loading) and errors (rank, rmse) of the colocation tensor.

    For each rank the best of `iterations` starts, each with its own seed. The tensor is written once. Up to max_entries entries
    that are not 0 (20 bytes each) go to a task for each rank and start, which factors them; larger tensors are written in blocks of
    instances, which tasks multiply with factors that the driver holds (parafac_blocks), and those whose factors are more than FACTORS
    numbers are factored by joins and aggregates (parafac_joins): the same updates. rmse is, as users of this measure know it, the mean absolute error over
    these entries.
    """
    spark, ranks = tensor.sparkSession, list(ranks)
    tensor = materialize(tensor.select("compartment", instance, feature, "neighbor", "value"), "tensor")
    n = tensor.count()
    if n > max_entries:
        room = FACTORS // max(1, iterations * sum(ranks)) - tensor.select(instance).distinct().count()
        tensor = tensor.na.drop()
        kinds = [tuple(row) for row in tensor.select("compartment", feature, "neighbor").distinct().limit(max(0, room) + 1).collect()]
        if len(kinds) <= room:
            return _decompose_blocks(tensor, n, instance, ranks, iterations, seed, kinds)
        return _decompose_joins(tensor, instance, feature, ranks, iterations, seed)
    labels = tensor_labels(tensor, instance, feature)
    shape = tuple(len(labels[m]) for m in MODES)
    names = [labels["compartment"], labels["instance"], [f"{a}|{b}" for a, b in labels["pair"]]]
    runs = [(rank, seed + i) for rank in ranks for i in range(iterations)]

    def factor(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([np.frombuffer(b, _ENTRY) for b in frame["entries"]])
        # In one order, so that sums do not depend on which task was first.
        entries = entries[np.lexsort(entries["at"].T[::-1])]
        best, error = parafac(entries["at"], entries["value"], shape, *runs[key[0]])
        return pd.DataFrame({"run": [key[0]], "error": [error], "factors": [np.concatenate([f.reshape(-1) for f in best]).tobytes()]})

    found = {}
    if n:
        every = _packed(tensor, labels).withColumn("run", F.explode(F.array(*map(F.lit, range(len(runs))))))
        # A run a task; the driver gets a run's factors only.
        done = every.repartitionByRange(len(runs), "run").groupBy("run").applyInPandas(factor, "run int, error double, factors binary")
        found = {r["run"]: (r["error"], np.frombuffer(r["factors"])) for r in done.collect()}
    factors, errors = [], []
    for k, rank in enumerate(ranks):
        error, flat = min((found.get(k * iterations + i, (0.0, np.zeros(0))) for i in range(iterations)), key=lambda f: f[0])
        errors.append((int(rank), float(error)))
        ends = np.cumsum([0, *(m * rank for m in shape)])
        for mode, name in enumerate(MODES):
            matrix = flat[ends[mode] : ends[mode + 1]].reshape(-1, rank)
            factors += [(int(rank), name, str(names[mode][i]), int(j), float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(factors, "rank int, mode string, label string, component int, loading double"), spark.createDataFrame(errors, "rank int, rmse double")


def colocation(ds: SpatialDataset, ranks: Iterable[int], iterations: int = 3) -> SpatialDataset:
    """Tables 'tensor', 'factors' and 'factors_error' from table 'clq'."""
    instance, feature = ds.attrs["instance_key"], ds.attrs["feature_key"]
    tensor = colocation_tensor(ds.tables["clq"], instance, feature)
    factors, errors = decompose(tensor, instance, feature, ranks, iterations)
    return ds.with_table("tensor", tensor).with_table("factors", factors).with_table("factors_error", errors)
