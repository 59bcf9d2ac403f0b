"""N-gram Jaccard join: candidates by MinHash bands, pruned by the posterior of values compared step by step, verified exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .families import components, family_links, groups, in_blocks, join_hot, list_column, roots, settle
from .idfilter import mark
from .scratch import materialize, release

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 5 values: a pair at the threshold misses all bands once in 300,000 times.
VALUES, BAND = 160, 5
STEP = 32
#: A candidate goes when its posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
BUCKET_BLOCK, FAMILY_BLOCK = 512, 512

_RNG = np.random.Generator(np.random.PCG64(20000101))
MULTIPLY = _RNG.integers(0, 1 << 31, VALUES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of SHINGLE words of each row, sorted, and the rows' offsets in them; a shorter text is one run."""
    starts, ends, firsts = tk.words(data, offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    words = tk.span_hash(data, starts, ends)
    counts = np.diff(firsts)
    take = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = tk.ragged(firsts[:-1], take)
    row = np.repeat(np.arange(n_rows), take)
    stop = firsts[1:][row]
    h = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        here = np.minimum(at + i, len(words) - 1)
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + i < stop, words[here], np.uint64(0))
    h = tk.mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n_rows + 1))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row VALUES MinHash values of 16 bits; of a row without shingles all 65535."""
    out = np.full((len(at) - 1, VALUES), 0xFFFF, np.uint16)
    rows = np.flatnonzero(np.diff(at))
    if not len(rows):
        return out
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(VALUES):
        v = x * MULTIPLY[k] + ADD[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        low = np.minimum.reduceat(v, at[rows])
        # The least of many is near 0: mixed once more before it is cut to 16 bits.
        out[rows, k] = ((low * np.uint32(0x297A2D39)) ^ (low >> np.uint32(11))) & np.uint32(0xFFFF)
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """Per row a 64-bit bucket for each band."""
    bands = VALUES // BAND
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * BAND, (b + 1) * BAND):
            h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, k].astype(np.uint64))
        out[:, b] = h
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Of n values compared, how few equal ones make P(similarity >= threshold) fall below the tolerance, plus one; the prior is uniform."""
    # The posterior is Beta(m + 1, n - m + 1); its tail beyond t is P(Binomial(n + 1, t) <= m).
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


def survivors(signature: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """The symmetric matrix of pairs that no step of STEP more values has pruned."""
    n = len(signature)
    if n == 2:
        left, right = np.array([0]), np.array([1])
    else:
        left, right = np.triu_indices(n, 1)
    matches = np.zeros(len(left), np.int32)
    for upto in range(STEP, VALUES + 1, STEP):
        new = np.empty(len(left), np.int32)
        for a in range(0, len(left), 1 << 16):
            part = slice(a, a + (1 << 16))
            new[part] = (signature[left[part], upto - STEP : upto] == signature[right[part], upto - STEP : upto]).sum(axis=1)
        matches += new
        good = matches >= least_matches(upto, threshold, tolerance)
        left, right, matches = left[good], right[good], matches[good]
    out = np.zeros((n, n), bool)
    out[left, right] = out[right, left] = True
    return out


FEATURES = "set_a bigint, set_b bigint, n_shingles bigint, signature binary"


def set_sums(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Per row two numbers that stand for its set of shingles, of any order."""
    n = np.diff(at)
    sums = []
    for seed in (1, 2):
        upto = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(hashes + np.uint64(seed)), dtype=np.uint64)])
        sums.append(tk.mix(upto[at[1:]] - upto[at[:-1]] + n.astype(np.uint64)).view(np.int64))
    return sums


def _features(data: np.ndarray, offsets: np.ndarray) -> list:
    """FEATURES of a slice."""
    hashes, at = shingle_hashes(data, offsets)
    n = np.diff(at)
    binary = [row.tobytes() if k else None for row, k in zip(signatures(hashes, at), n.tolist())]
    return [*set_sums(hashes, at), n, pa.array(binary, pa.binary())]


def _bucket_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to a row (bucket, node) for each band."""
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
            keys = buckets(signature)
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["bucket", "node"])


def _pruner(threshold: float, tolerance: float):
    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a bucket to edges (a, b): each row to the smallest row that it reaches by pairs that are not pruned."""
        for run in groups(batches, 3):
            if run.num_rows < 2:
                continue
            nodes = run["node"].to_numpy()
            signature = np.frombuffer(b"".join(run["signature"].to_pylist()), np.uint16).reshape(-1, VALUES)
            root = roots(survivors(signature, threshold, tolerance), nodes)
            moved = root != nodes
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["a", "b"])

    return prune


def jaccard_matrix(values: np.ndarray, lengths: np.ndarray, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections and unions of the rows' sets; shingles of one row alone are left out of the product."""
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    order = np.argsort(values, kind="stable")
    ordered, row = values[order], row[order]
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    which = np.cumsum(head) - 1
    shared = np.bincount(which)[which] > 1 if len(which) else head
    which, row = which[shared], row[shared]
    _, which = np.unique(which, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    bounds = np.searchsorted(which, np.arange(0, (which[-1] + 1 if len(which) else 0) + columns, columns))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            part = np.zeros((n, columns), np.float32)
            part[row[a:b], which[a:b] % columns] = 1
            common += part @ part.T
    common = np.rint(common).astype(np.int64)
    return common, lengths[:, None] + lengths[None, :] - common


def _kernel(threshold: float, tolerance: float):
    parts = int(round(threshold * 1000))

    def linked(run: pa.Table) -> np.ndarray:
        """The pairs that no step of compared values prunes and whose sets are as similar as the threshold, exactly."""
        signature = np.frombuffer(b"".join(run["signature"].to_pylist()), np.uint16).reshape(-1, VALUES)
        out = survivors(signature, threshold, tolerance)
        some = np.flatnonzero(out.any(axis=1))
        if len(some):
            common, union = jaccard_matrix(*list_column(run["shingles"].take(pa.array(some))))
            out[np.ix_(some, some)] &= 1000 * common >= parts * union
        return out

    return linked


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket_block: int = BUCKET_BLOCK, family_block: int = FAMILY_BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_links (other rows of Jaccard similarity >= threshold), class_id and kept.

    Sets are of 5-word runs (words between white space; a shorter text is one run). Texts with equal sets are one class
    and never meet in pairs. Classes that share a band of MinHash values are candidates; bucket by bucket their
    values are compared in steps and pairs pruned by their posterior, which leaves families. Inside a family, in blocks,
    pairs are pruned in the same way and those that are left are verified by their exact sets; only counts and the smallest
    class leave a block, so links between different texts count and no list of pairs is made. class_id is the
    smallest doc_id of the texts that links connect, kept is doc_id = class_id. A null or blank text links with nothing. A row
    without doc_id has a null class_id if alone; repeated rows are copies like others (of rows with one doc_id all or none
    are kept). An empty table gives an empty result; other columns are left out.
    """
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    # A row is found again by a hash of its id and text, whatever repeats or is null.
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))
    features = tk.small_batches(rows).select("doc_id", "row", tk.kernel(FEATURES, lambda: _features, F.col("text")).alias("f")).select("doc_id", "row", "f.*")
    features = materialize(features, "features")
    total = features.count()
    sets = features.filter("n_shingles > 0").groupBy("set_a", "set_b")
    classes = sets.agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.first("signature").alias("signature"))
    # Nodes are numbered so that the smallest node of a component need not be the smallest doc_id: that is taken later.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "signature").mapInArrow(_bucket_rows, "bucket bigint, node bigint")
    banded = materialize(banded, "bands")
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    meeting = join_hot(banded, crowded, ["bucket"], "size", banded.count()).join(classes.select("node", "signature"), "node")
    edges = in_blocks(meeting, "bucket", "size", bucket_block).mapInArrow(_pruner(threshold, tolerance), "a bigint, b bigint")
    families = components(edges)
    members = materialize(families.join(classes.select("node", "row", "weight", "set_a", "set_b", "signature"), "node"), "members")
    release(banded)
    # Only texts of members, and few others, go into the shuffle; of repeated rows one.
    near = mark(rows.select("row", "text"), "row", members, "row", members.count(), "__near").filter("__near").drop("__near")
    texts = members.join(near.groupBy("row").agg(F.first("text").alias("text")), "row")
    own = F.struct("node", "component", "weight", "set_a", "set_b", "signature").alias("own")
    with_sets = tk.small_batches(texts).select(own, "text").mapInArrow(_own_sets, "node bigint, component bigint, weight bigint, signature binary, shingles array<bigint>")
    with_sets = materialize(with_sets, "sets")
    release(members)
    links = settle(family_links(with_sets, "component", "weight", family_block, _kernel(threshold, tolerance)))
    found = classes.select("node", "set_a", "set_b", "weight", "least").join(links, "node", "left")
    group = F.coalesce("component", "node")
    linked = materialize(found.select("set_a", "set_b", "weight", F.coalesce("links", F.lit(0)).alias("links"), group.alias("__group"), "least"), "linked")
    smallest = linked.groupBy("__group").agg(F.min("least").alias("class_id"), F.count("*").alias("size"))
    found = join_hot(linked.drop("least"), smallest, ["__group"], "size", linked.count()).drop("__group", "size")
    found = materialize(found, "found")
    release(with_sets, classes, linked)
    own = join_hot(features.select("doc_id", "set_a", "set_b", "n_shingles"), found, ["set_a", "set_b"], "weight", total, "left")
    blank = F.col("n_shingles") == 0
    class_id = F.when(blank, F.col("doc_id")).otherwise(F.col("class_id"))
    n_links = F.when(blank, 0).otherwise(F.col("links") + F.col("weight") - 1)
    return own.select("doc_id", n_links.cast("long").alias("n_links"), class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, class_id.isNull()).alias("kept"))


def _own_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, text) to (node, component, weight, signature, shingles) of the texts whose set is the class's."""
    for batch in batches:
        own = batch.column(0)
        for first, last, data, offsets in tk.slices(batch.column(1)):
            hashes, at = shingle_hashes(data, offsets)
            here = own.slice(first, last - first)
            a, b = set_sums(hashes, at)
            same = (a == here.field(3).to_numpy()) & (b == here.field(4).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
            columns = [here.field(0), here.field(1), here.field(2), here.field(5), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "component", "weight", "signature", "shingles"]).filter(pa.array(same))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join over all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near copies the document with the smallest doc_id.

    Rows without doc_id all stay; of rows that repeat both doc_id and text one stays.
    """
    found = materialize(join(docs.select("doc_id", "text")), "joined")
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    gone = materialize(gone, "gone")
    # Rows that the filter clears stay where they are; only the others meet the ids that go.
    marked = mark(docs, "doc_id", gone, "doc_id", gone.count(), "__doubtful")
    checked = marked.filter("__doubtful").join(gone.select(F.col("doc_id").alias("__gone")), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    left = marked.filter("not __doubtful").unionByName(checked).drop("__doubtful")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
