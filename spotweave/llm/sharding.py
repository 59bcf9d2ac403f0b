"""Uniform shuffle into shards of exact size: a hypergeometric communication matrix, a local permutation, one exchange and another permutation."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import gapless_rank
from .scratch import materialize

BLOCK_BITS = 17
OUT = ("shard", "slot")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of the draws without replacement are good; exact up to the rounding of doubles, for any size."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    total = good + bad
    spread = math.sqrt(draws * (good / total) * (bad / total)) + 1
    ks = np.arange(max(low, int(mode - 40 * spread)), min(high, int(mode + 40 * spread)) + 1)
    ratio = np.log(good - ks[:-1].astype(float)) + np.log(draws - ks[:-1].astype(float)) - np.log(ks[1:].astype(float)) - np.log(bad - draws + ks[1:].astype(float))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(ks[min(len(ks) - 1, np.searchsorted(weights, rng.random() * weights[-1], side="right"))])


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """How many rows each block sends to each shard, drawn as a uniform permutation would: rows sum to blocks, columns to shards."""
    assert sum(blocks) == sum(shards)
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for i, size in enumerate(blocks):
        rest, need = sum(left), size
        for j, here in enumerate(left):
            rest -= here
            out[i, j] = got = hypergeometric(rng, here, rest, need)
            need -= got
        for j in range(len(left)):
            left[j] -= int(out[i, j])
    return out


def _matrix_table(spark: SparkSession, blocks: list[int], matrix: np.ndarray) -> DataFrame:
    text = json.dumps([{"b": b, "c": np.cumsum(row).tolist()} for b, row in zip(blocks, matrix)])
    rows = F.explode(F.from_json(F.lit(text), "array<struct<b: bigint, c: array<bigint>>>"))
    return spark.range(1).select(rows.alias("r")).select(F.col("r.b").alias("__block"), F.col("r.c").alias("__upto"))


def uniform_shuffle(df: DataFrame, n_shards: int, seed: int = 2024) -> DataFrame:
    """Give each row a shard (int, 0 to n_shards - 1) and a slot in it (long, 0, 1, 2 ...), uniformly at random.

    Shard sizes differ by one row at most, exactly. The rows are written once with a row number, so lost
    executors and retries see the same numbers. A block is at most 2**17 neighbouring rows of one input
    partition; the driver draws the counts block x shard (8 bytes each: 40 shards and 10**10 rows take 25 MB)
    and sees nothing else. A block is permuted in one task; a shard is permuted in buckets, so neither grows
    with the input. Nulls, repeated rows and ties need no care: only row numbers count. An empty table gives an
    empty result. Columns of df named shard or slot are replaced.
    """
    spark = df.sparkSession
    kept = df.drop(*OUT)
    rows = materialize(kept.withColumn("__rid", F.monotonically_increasing_id()), "shuffle")
    rows = rows.withColumn("__block", F.shiftright("__rid", BLOCK_BITS))
    sizes = sorted((r["__block"], r["count"]) for r in rows.groupBy("__block").count().collect())
    n = sum(c for _, c in sizes)
    # Which shards hold the odd rows is drawn, too.
    odd = set(np.random.Generator(np.random.PCG64([seed, 1])).permutation(n_shards)[: n % n_shards].tolist())
    shards = [n // n_shards + (j in odd) for j in range(n_shards)]
    matrix = communication_matrix([c for _, c in sizes], shards, seed)
    table = _matrix_table(spark, [b for b, _ in sizes], matrix)
    local = Window.partitionBy("__block").orderBy(F.xxhash64("__rid", F.lit(seed)), "__rid")
    dealt = (
        rows.withColumn("__at", F.row_number().over(local) - 1)
        .join(table, "__block")
        .withColumn("shard", F.size(F.filter("__upto", lambda c: c <= F.col("__at"))))
        .drop("__at", "__upto", "__block")
    )
    ranked = gapless_rank(dealt, "shard", "__rid", max(shards, default=0), "slot", seed + 2)
    return ranked.select(*kept.columns, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniform_shuffle of all documents into 40 shards, by the law of rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = uniform_shuffle(narrow, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
