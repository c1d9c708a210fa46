"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in `spark.checkpoint.dir`; a local session without that setting takes the machine's own. It is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/sigspark-files"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"))
    return _made[-1][1]


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in such a folder: what several branches of a plan use is computed once, and the lineage ends there."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table in such a folder that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            dropped(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans it
            return
