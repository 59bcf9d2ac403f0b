"""A corpus pipeline over documents: quality, language, near copies, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spotweave.llm import jaccard, langid, packing, quality
from spotweave.llm.scratch import materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality.stage),
    ("language", langid.stage),
    ("near_copies", jaccard.stage),
    ("packing", packing.stage),
]

#: Learned classifiers, MinHash and a tokenizer have no form in SQL: the stages are tested one by one and together.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept, written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        left = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            left = materialize(left, f"stage-{name}")
            release(docs)
        docs = left
    return docs
