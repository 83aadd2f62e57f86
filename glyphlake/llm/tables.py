"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one, as in tests, gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/glyphlake-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file(spark: SparkSession, path: str):
    """Hadoop's path of a name, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing.

    The files go with `drop`, or else when the driver ends.
    """
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    name, system = _file(spark, path)
    system.deleteOnExit(name)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop(*frames: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read any more."""
    for df in frames:
        name, system = _file(df.sparkSession, df._written_to)
        system.delete(name, True)


def row_of(df: DataFrame) -> Column:
    """All columns of df as one column `row`, so that no name of theirs can clash with an operator's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


#: Rows of a text table that a Python worker holds at once.
BATCH_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Lowers Spark's default of rows for each Arrow batch, which is meant for short rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes of a batch, if no row alone is longer. Executor and worker each hold copies of it, outside the heap too.
BATCH_BYTES = 4 << 20


def bounded_bytes(spark: SparkSession) -> None:
    """`bounded_batches`, and no more than BATCH_BYTES a batch, however long the texts; lower settings stay."""
    bounded_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Characters of text whose shingles or anchors a bucket holds on average.
BUCKET_CHARS = 6_000_000


def buckets(docs: DataFrame, chars: int = BUCKET_CHARS, least: int = 32) -> int:
    """How many buckets the texts of docs need, so that a bucket's size doesn't follow theirs."""
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0
    return max(least, -(-int(total) // chars))


def release(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to: shuffle files of finished stages stay on disk until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
