"""Texts to learn a classifier from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, seed: int) -> DataFrame:
    """(label, text) of about `rows` labelled documents where usable holds, chosen by a hash of doc_id; one text and label of each doc_id."""
    known = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # `some` has about `rows` rows, whatever the input; a doc_id that is repeated gives one text.
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return pairs.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
