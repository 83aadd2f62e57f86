"""Session helper and table loader."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session(name: str = "glyphlake", cores: int = 8, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one parquet table of a data folder through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one, as in tests, gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/glyphlake-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so it is computed once and outlives executors; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(name)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """df written in buckets by keys and read again: joins, groups and windows that begin with keys don't move its rows any more.

    dealt: its rows come from such tables and still lie by keys, so they are written where they are. The files go when
    the driver ends; the table's name stays in the session's catalog until `DROP TABLE`.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"glyphlake_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tables/{name}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.table(name)


#: MB of a table's files in one part of `dealt`: about 25,000 lines of lineitem.
PART_MB = 0.5


def parts_of(df: DataFrame, part_mb: float = PART_MB) -> int:
    """How many parts df is dealt into: as many as the files of a table, as Spark knows their size, call for; the session's number at least."""
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // int(part_mb * 2**20)))


def dealt(df: DataFrame, table: DataFrame, *keys: str, part_mb: float = PART_MB) -> DataFrame:
    """df dealt out by keys into parts that follow the size of table, which it comes from; Spark doesn't join them again.

    Windows and groups that begin with keys stay in their part, and a part is as large as before when the table has grown.
    """
    return df.repartition(parts_of(table, part_mb), *keys)


@contextlib.contextmanager
def kept_in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, tables that lie by their first key are also joined on further keys where they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
