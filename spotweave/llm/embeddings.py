"""Near copies of embeddings by spherical-cap filters: random product codes, list-decoded, joined on filters, verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .families import components, family_links, groups, in_blocks, join_hot, list_column, roots, settle
from .scratch import materialize, release

THRESHOLD = 0.93
#: A cap holds about so many vectors of the largest label, but at least MIN_SHARED of a cap's vectors have a given neighbour at the threshold in it.
CAP_ROWS = 64
MIN_SHARED = 0.1
#: A pair at the threshold has an expected SHARED caps in common in a code; codes are added until it misses all caps once in exp(MISS) times.
SHARED = 4.0
MISS = 16.0
#: Pairs on which a code's misses are measured.
TRIALS = 1000
SEED = 8
BLOCK = 512
#: Rounding to 8 bits and single precision find candidates only; this much is added to the rounding's own bound.
SLACK = 1e-4


def cap_share(bound: float, width: int, cosine: float = 1.0) -> float:
    """The share of the sphere's directions within the bound of both of two unit vectors with this cosine."""
    first, last = acos(max(-1.0, min(1.0, cosine))) / 2, acos(bound)
    if first >= last:
        return 0.0
    angle = np.linspace(first, last, 4001)
    reach = np.maximum(0.0, 1 - (bound / np.cos(angle)) ** 2) ** ((width - 2) / 2)
    return float((reach[1:] + reach[:-1]).sum() / 2 * (angle[1] - angle[0]) / pi)


class ProductCode:
    """size**2 directions, each a pair of random unit vectors of the two halves of the rotated space.

    A vector belongs to all directions of which the inner product reaches the bound; the pairs are found by
    walking the sorted products of the halves, so the work follows the number of directions found. miss is the
    expected number of caps that a pair at the threshold shares.
    """

    def __init__(self, width: int, largest: int, threshold: float = THRESHOLD, cap_rows: int = CAP_ROWS, miss: float = SHARED, seed: int = SEED, turn: int = 0) -> None:
        share = min(0.25, cap_rows / max(1, largest))
        self.half = max(1, (width + 1) // 2)
        full = 2 * self.half
        low, high = 0.0, 1.0
        for _ in range(60):
            t = (low + high) / 2
            alone = cap_share(t, full)
            low, high = (t, high) if alone > share and cap_share(t, full, threshold) >= MIN_SHARED * alone else (low, t)
        self.bound = low
        # On a line there are two directions.
        self.size = max(2, ceil(sqrt(miss / cap_share(low, full, threshold)))) if self.half > 1 else 2
        rng = np.random.Generator(np.random.PCG64([seed, width, turn]))
        self.rotation = np.linalg.qr(rng.normal(size=(full, full)))[0][:width]
        codes = rng.normal(size=(2, self.size, self.half)) if self.half > 1 else np.array([[[1.0], [-1.0]]] * 2)
        self.codes = codes / np.linalg.norm(codes, axis=2, keepdims=True) / sqrt(2)

    def misses(self, threshold: float, rng: np.random.Generator) -> float:
        """The share of TRIALS random pairs at the threshold that have no direction in common."""
        x, y = random_pairs(TRIALS, len(self.rotation), threshold, rng)
        (row, at), (other, there) = self.decode(x), self.decode(y)
        common = np.intersect1d(row * self.size**2 + at, other * self.size**2 + there) // self.size**2
        return 1 - len(np.unique(common)) / TRIALS

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and directions of all pairs that reach the bound."""
        turned = unit @ self.rotation
        left = turned[:, : self.half] @ self.codes[0].T
        right = turned[:, self.half :] @ self.codes[1].T
        order = np.argsort(-right, axis=1)
        n = len(unit)
        # Rows lie 4 apart, so one search serves all of them.
        lane = 4.0 * np.arange(n)[:, None]
        ladder = (lane - np.take_along_axis(right, order, axis=1)).ravel()
        counts = np.searchsorted(ladder, (lane + left - self.bound).ravel(), side="right") - np.repeat(np.arange(n) * self.size, self.size)
        counts = np.clip(counts, 0, self.size)
        pair = np.repeat(np.arange(n * self.size), counts)
        rank = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = pair // self.size
        return row, (pair % self.size) * self.size + order[row, rank]


def random_pairs(n: int, width: int, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of unit vectors with this cosine; of width 1, n pairs of equal ones."""
    x, y = rng.normal(size=(2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if width == 1:
        return x, x
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + sqrt(1 - cosine * cosine) * y


def product_codes(width: int, largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> list[ProductCode]:
    """Codes of rotations of their own, as many as bring the product of their measured misses to exp(-miss).

    A rotation is as good as a random pair, so what two codes miss is independent for any pair; directions of one
    code share halves and are not.
    """
    rng = np.random.Generator(np.random.PCG64([SEED, width, largest]))
    codes: list[ProductCode] = []
    got = 0.0
    while got < miss:
        codes.append(ProductCode(width, largest, threshold, turn=len(codes)))
        got -= log(max(codes[-1].misses(threshold, rng), 1 / TRIALS))
    return codes


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values, lengths = list_column(pa.chunked_array([column]) if isinstance(column, pa.Array) else column)
    return values.reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 1))


def _units(vectors: np.ndarray) -> np.ndarray:
    # Divided by the largest component first: squares of tiny or huge numbers leave the range of doubles.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _decoder(codes: dict[int, list[ProductCode]]):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, group, width, embedding) to a row (bucket, node) for each direction."""
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths):
                some = batch.filter(pa.array(widths == width))
                before = 0
                for code in codes[int(width)]:
                    step = max(1, (1 << 20) // code.size)
                    for first in range(0, some.num_rows, step):
                        part = some.slice(first, step)
                        row, direction = code.decode(_units(_matrix(part.column(3))))
                        group = part.column(1).to_numpy()[row]
                        bucket = group.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (direction.astype(np.uint64) + np.uint64(before + 1))
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(group), pa.array(part.column(0).to_numpy()[row])], names=["bucket", "group", "node"])
                    before += code.size**2

    return decode


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, width, embedding) to (node, sketch): the unit vector's components in 8 bits, then how far off they are as a float."""
    for batch in batches:
        widths = batch.column(1).to_numpy()
        for width in np.unique(widths):
            some = batch.filter(pa.array(widths == width))
            unit = _units(_matrix(some.column(2)))
            small = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
            off = np.linalg.norm(unit - _units(small.astype(float)), axis=1).astype("<f4")
            packed = np.concatenate([small.view(np.uint8), off[:, None].view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["node", "sketch"])


def _unpack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of one width to unit vectors and how far off each is."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    small = packed[:, :-4].view(np.int8).astype(np.float32)
    return small / np.linalg.norm(small, axis=1, keepdims=True), np.ascontiguousarray(packed[:, -4:]).view("<f4")[:, 0]


def _linker(threshold: float):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a bucket to candidate edges (a, b): each row to the smallest that it reaches."""
        for run in groups(batches, 3):
            if run.num_rows < 2:
                continue
            nodes = run["node"].to_numpy()
            unit, off = _unpack(run["sketch"])
            # A product of two vectors is off by no more than both together.
            close = unit @ unit.T + off[:, None] + off >= threshold - SLACK
            if close.sum() > len(nodes):
                root = roots(close, nodes)
                moved = root != nodes
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["a", "b"])

    return link


def _kernel(threshold: float):
    def linked(run: pa.Table) -> np.ndarray:
        unit = _units(_matrix(run["embedding"]))
        return unit @ unit.T >= threshold

    return linked


def near_copies(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """Per row of rows (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    Two vectors link if labels and widths are equal and the cosine, in doubles, is at least threshold. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do those without a label.
    Equal vectors of a label are one class and never meet in pairs. The number of directions follows the largest
    label, so that a cap holds about CAP_ROWS vectors, and what the codes miss is measured (product_codes); a crowded cap
    is matched in blocks. Inside a family that caps
    have found, all pairs are verified, in blocks, and only counts and the smallest member leave a block. component_id
    is the smallest vec_id reached, kept is vec_id = component_id; a null vec_id alone has a null component and stays.
    Repeated rows are copies; other columns are left out; an empty table gives an empty result.
    """
    double = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), double.alias("v"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    group = F.xxhash64(F.col("label").cast("string"), F.size("v"))
    # Adding zero makes -0.0 equal 0.0. Equal vectors have equal hashes: no vector is a key of a shuffle.
    v = F.transform("v", lambda x: x + F.lit(0.0))
    keys = [F.when(good, F.xxhash64(F.lit(seed), v)).alias(name) for seed, name in ((1, "key_a"), (2, "key_b"))]
    rows = materialize(rows.select("vec_id", good.alias("good"), group.alias("group"), *keys, F.when(good, v).alias("v")), "vectors")
    own = rows.filter("good")
    classes = own.groupBy("group", "key_a", "key_b").agg(F.first("v").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")), "classes")
    by_width: dict[int, int] = {}
    for r in classes.groupBy("group", "width").count().groupBy("width").agg(F.max("count").alias("n")).collect():
        by_width[r["width"]] = r["n"]
    codes = {width: product_codes(width, n, threshold, miss) for width, n in by_width.items()}
    dealt = classes.select("node", "group", "width", "embedding").mapInArrow(_decoder(codes), "bucket bigint, group bigint, node bigint")
    dealt = materialize(dealt, "caps")
    crowded = dealt.groupBy("bucket", "group").agg(F.count("*").alias("size")).filter("size > 1")
    sketches = classes.select("node", "width", "embedding").mapInArrow(_sketch, "node bigint, sketch binary")
    meeting = join_hot(dealt, crowded, ["bucket", "group"], "size", dealt.count()).join(sketches, "node")
    keyed = in_blocks(meeting.withColumn("cap", F.xxhash64("bucket", "group")).drop("bucket", "group"), "cap", "size", block)
    edges = keyed.mapInArrow(_linker(threshold), "a bigint, b bigint")
    families = components(edges)
    members = families.join(classes.select("node", "weight", "embedding"), "node")
    links = settle(family_links(members, "component", "weight", block, _kernel(threshold)))
    release(dealt)
    found = classes.select("group", "key_a", "key_b", "weight", "least", "node").join(links, "node", "left")
    found = found.withColumn("component", F.coalesce("component", "node"))
    smallest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    found = materialize(found.join(smallest, "component").select("group", "key_a", "key_b", "weight", n_links, "component_id"), "found")
    release(classes)
    linked = join_hot(own.select("vec_id", "group", "key_a", "key_b"), found, ["group", "key_a", "key_b"], "weight", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_copies over all embeddings."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
