"""The folder that all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a local folder in local mode and the warehouse elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before
            return
