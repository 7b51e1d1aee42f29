"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the context's own checkpoint folder. A session must name one: a folder of this machine can't be guessed to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the stashes that may be discarded lie, by their DataFrames' ids; an entry goes with its DataFrame.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that later stages restart from the files."""
    spark = df.sparkSession
    path = stash_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a stash that no later stage reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Lowers the session's rows and bytes of an Arrow batch to these, for jobs that send whole texts to Python: thousands of them, or some very long ones, are a large piece of memory at once.

    The settings stay, as plans are lazy; what the session's own configuration names isn't changed.
    """
    for key, most in ((BATCH_ROWS, rows), (BATCH_BYTES, size)):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
