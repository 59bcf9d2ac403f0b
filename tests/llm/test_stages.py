"""Pipeline stages on odd tables: nulls, repeated rows, long texts, clashing columns, empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spotweave.llm import jaccard, langid, packing, quality, scratch, toxicity

SF = "/root/testdata/sf0.001"
CLEAN = "The old mill stood at the edge of the river, and in spring the water rose as far as the garden wall. " * 4


@pytest.fixture(scope="module")
def table(spark, odd):
    """The odd rows, a few whole documents, one of them twice, and columns with names that stages use inside."""
    more = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40)
    more = more.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source")
    rows = odd.select("doc_id", "text", "lang", "source").unionByName(more).unionByName(more.limit(1))
    return rows.select("*", F.lit("x").alias("score"), F.lit(1).alias("predicted"), F.lit("y").alias("lang_pred"), F.lit(2).alias("row"), F.lit(3).alias("f")).cache()


def _rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "score", "predicted", "lang_pred", "row", "f").collect()))


def test_quality_stage(spark, table):
    out = quality.stage(spark, table, SF)
    assert out.columns == table.columns and not _rows(out) - _rows(table)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(table, labels, "quality", quality._remainder() != 1)
    want = {r["text"]: r["predicted"] for r in quality.score(table, model).collect()}
    assert Counter(r["text"] for r in out.collect()) == Counter(r["text"] for r in table.collect() if want[r["text"]])
    assert quality.stage(spark, table.limit(0), SF).count() == 0


def test_language_stage(spark, table):
    out = langid.stage(spark, table, SF)
    assert out.columns == table.columns and not _rows(out) - _rows(table)
    kept = {r["text"] for r in out.collect()}
    assert not kept & {None, "", " ", "\n\t", "###!!! ***"}
    assert langid.stage(spark, table.limit(0), SF).count() == 0


def test_near_copies_stage(spark, table):
    out = jaccard.stage(spark, table, SF)
    assert out.columns == table.columns and not _rows(out) - _rows(table)
    repeated = [n for k, n in Counter((r["doc_id"], r["text"]) for r in out.collect()).items() if k[0] is not None]
    assert max(repeated) == 1
    assert jaccard.stage(spark, table.limit(0), SF).count() == 0


def test_packing_stage(spark, table):
    out = packing.stage(spark, table, SF).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(r["doc_id"] for r in table.collect())
    assert packing.stage(spark, table.limit(0), SF).count() == 0


def test_repeated_ids_give_one_training_text(spark):
    """A doc_id that a million rows share sends one text to the driver."""
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit(CLEAN), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1, 0)] * 50 + [(8, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.training_texts(docs, labels, "quality", F.lit(True), 100, 1).collect()
    assert len(got) == 1 and got[0]["label"] == 1
    assert quality.score(docs.limit(3), quality.fit(docs, labels, "quality", F.lit(True))).count() == 3
    assert toxicity.grade(docs.limit(3), toxicity.fit(docs, labels, "toxic", F.lit(True))).count() == 3


def test_released_tables_are_gone(spark):
    table = scratch.materialize(spark.range(3), "gone")
    other = scratch.materialize(spark.range(3), "stays")
    assert table.count() == 3
    scratch.release(table, spark.range(1))
    assert other.count() == 3
    with pytest.raises(Exception, match="(?i)does not exist|not found|FILE_NOT_EXIST"):
        table.count()
