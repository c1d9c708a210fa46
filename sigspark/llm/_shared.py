"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: ASCII white space, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows in an Arrow batch: texts may be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1000
#: Parquet settings for rows of megabytes.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4", "parquet.page.size.row.check.min": "1"}

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where that is unset, a local session takes a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/sigspark-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, name: str, free: bool = True, large: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: this cuts the lineage, and survives lost executors.

    The table is deleted by `discard`, or when the driver ends. free: shuffle files of what led to it go at once; Spark deletes them
    when the driver collects its garbage, which may be long after. large: a row may have megabytes; groups of rows are closed by their
    size after every row, not after a hundred, as whoever writes or reads them holds a group whole.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if large:
        for key, value in LARGE_ROWS.items():
            out = out.option(key, value)
    out.parquet(path)
    if free:
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # the listeners still hold the plan
        for pause in (0.3, 0.4):  # what the first collection only finds to be unused goes with the second one
            time.sleep(pause)
            spark._jvm.System.gc()
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `store` wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans it
            return


def row_schema(row: DataType, columns: str) -> StructType:
    """A column row of that type, and the columns of a DDL string: names inside of row may be anything."""
    return StructType([StructField("row", row), *StructType.fromDDL(columns).fields])


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_ROWS rows unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def n_words(text):
    """Column: the number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
