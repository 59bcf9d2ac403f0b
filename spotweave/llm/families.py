"""Families of near copies: connected components of links, and exact links inside a family, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, release

MAX_ROUNDS = 60
#: A key with one row in so many or more is hot; there are at most so many of them.
HOT = 1000
#: So many edges (16 bytes each) or fewer are joined up in one task.
ONE_TASK = 1 << 20


def join_hot(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and say in `size` how many rows of left (total in all) they meet.

    Keys that hold a HOTth of all rows or more, at most HOT of them, are broadcast, so that no task gets all rows of one; the
    others meet by a shuffle. Both sides are read twice: written tables, or cheap.
    """
    names = [c for c in left.columns if c not in on]
    more = [c for c in right.columns if c not in on]
    hot = right.filter(F.col(size) * HOT >= total).select(*on, F.struct(*more).alias("__hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    met = marked.filter("__hot is not null").select(*on, *names, *(F.col(f"__hot.{c}").alias(c) for c in more))
    rest = marked.filter("__hot is null").select(*on, *names)
    return met.unionByName(rest.join(right.filter(F.col(size) * HOT < total), on, how).select(*on, *names, *more))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), sorted, and of each the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    # Of the trees that an edge joins the one with the larger root goes below the other; every second pass halves the trees left.
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, component)."""
    held = [b for b in batches if b.num_rows]
    if held:
        edges = pa.Table.from_batches(held)
        found = least_reachable(edges["u"].to_numpy(), edges["v"].to_numpy())
        yield from pa.table([pa.array(x) for x in found], names=["node", "component"]).to_batches(max_chunksize=1 << 16)


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable by the edges (a, b), for nodes that have an edge to another node.

    Up to one_task different edges are joined up in one task. More go through alternating large and small stars: each
    round is aggregates and equi-joins, about ten stages, written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. The driver keeps what it was told of each task and plan, so rounds are not for few
    edges. Loops, repeated edges and nulls do no harm.
    """
    clean = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = materialize(clean, "stars")
    before, n = None, pairs.count()
    if n <= one_task:
        return pairs.coalesce(1).mapInArrow(_join_up, "node bigint, component bigint")
    for _ in range(MAX_ROUNDS):
        # Large star: each neighbour beyond a node points to the node's smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = join_hot(both.filter("v > u"), least, ["u"], "size", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, pairs = pairs, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        release(old)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = now["n"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first columns, from batches sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(j)[-1].as_py() != c[0].item() for j, c in enumerate(columns))
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b and k:
                continue
            if k and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def in_blocks(rows: DataFrame, key: str, size: str, block: int, partitions: int | None = None) -> DataFrame:
    """Rows dealt so that any two of a key meet in one run of __key, __i, __j, of at most about 2 * block rows.

    A key of `size` rows is cut into size / block chunks by a hash of node; chunks i and j (i <= j) meet in one run,
    chunk i's rows first (__side 0). A key of one chunk, as nearly all are, is not repeated.
    """
    chunks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rows = rows.withColumn("__n", chunks).withColumn("__c", F.pmod(F.xxhash64("node", F.lit(77)), F.col("__n").cast("long")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    rows = rows.withColumn("__i", F.least("__c", "__other")).withColumn("__j", F.greatest("__c", "__other"))
    rows = rows.withColumn("__side", (F.col("__c") != F.col("__i")).cast("int")).withColumnRenamed(key, "__key")
    names = ["__key", "__i", "__j", "__side"]
    rest = [c for c in rows.columns if c not in {*names, "__n", "__c", "__other", size}]
    dealt = rows.select(*names, *rest)
    return dealt.repartition("__key", "__i", "__j").sortWithinPartitions("__key", "__i", "__j", "__side", "node")


def roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Of each node the smallest that it reaches, for a symmetric matrix of links."""
    label = nodes.copy()
    while True:
        best = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1) if len(nodes) else label
        new = np.minimum(label, best)
        if (new == label).all():
            return label
        label = new


Kernel = Callable[[pa.Table], np.ndarray]


def family_links(members: DataFrame, component: str, weight: str, block: int, kernel: Kernel) -> DataFrame:
    """(node, links, root) of members (node long, component, weight, ...): exact links among the rows of a component.

    kernel(table) gives the symmetric 0/1 matrix of links among a run's rows. links sums the weights of the linked
    rows; root is the smallest node reached inside the run. Rows of one node, one for each run: sum and join them.
    """
    sizes = members.groupBy(component).agg(F.count("*").alias("__size"))
    dealt = in_blocks(members.join(sizes, component), component, "__size", block)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for run in groups(batches, 3):
            node, weights = run["node"].to_numpy(), run[weight].to_numpy()
            linked = kernel(run)
            np.fill_diagonal(linked, False)
            if run["__i"][0].as_py() != run["__j"][0].as_py():
                side = run["__side"].to_numpy()
                linked &= side[:, None] != side[None, :]
            out.append((node, linked @ weights, roots(linked, node)))
            size += len(node)
            if size > 10_000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["node", "links", "root"])

    return dealt.mapInArrow(work, "node bigint, links bigint, root bigint")


def settle(parts: DataFrame) -> DataFrame:
    """(node, links, component) from family_links' rows."""
    parts = materialize(parts, "links")
    totals = parts.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return totals.join(joined, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))


def list_column(column: pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column one after the other, and the rows' lengths."""
    lengths = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy(), lengths
