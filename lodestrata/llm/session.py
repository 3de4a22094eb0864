"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import shutil
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


NO_ESTIMATE = 1 << 50


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared checkpoint folder; a lost executor loses none of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared checkpoint folder and read again, and the table's path.

    For loops: unlike a checkpoint, a table has a size of its own, where the estimates of a checkpoint multiply from
    round to round.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def text_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches that suit long texts: no more than ``rows`` rows and about ``size`` bytes.

    The JVM and the Python worker each hold a batch or two, so this bounds memory besides the heap.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(name)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """Give memory that freed arrays leave behind back to the system.

    Python workers live on from task to task, and share an executor's memory with the JVM.
    """
    pa.default_memory_pool().release_unused()
    _libc().malloc_trim(0)


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")


def partitions_for(df: DataFrame, partition_bytes: int = 4 << 20) -> int:
    """Partitions that hold about ``partition_bytes`` each of what ``df`` reads, by Catalyst's estimate of its size.

    At least one for each core. Where there is no estimate (rows from the driver or a checkpoint, products of joins: all
    beyond ``NO_ESTIMATE``), the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return shuffle_partitions(spark) if size > NO_ESTIMATE else max(spark.sparkContext.defaultParallelism, -(-size // partition_bytes))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
