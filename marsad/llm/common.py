"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, newline, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of one table; only Spark's reader touches the path, so any store will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``).

    The setting is read from the session. Where there is none, a folder of our own serves a session on
    one machine, as in tests; on a cluster that would be each executor's own disk, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints/marsad"
    return f"{base.rstrip('/')}/marsad-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and executors may go."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Each frees a cache that a worker process keeps from task to task, and says if there was anything in it.
KEPT: list[Callable[[], bool]] = []


def release() -> None:
    """Give back what earlier tasks left in this worker process: caches, and free memory that allocators hold."""
    if any([forget() for forget in KEPT]):
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that only some rows at a time are Python objects; empty batches go.

    Workers are used again by later stages: what such a task has no use for is freed before its first rows.
    """
    release()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing needs it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with so many rows, and a thousandth of all, is spread over so many salts.
HOT_ROWS, SALTS = 2000, 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys of ``rows`` that hold a thousandth of them or more (and ``HOT_ROWS``): a thousand keys at most."""
    least = max(HOT_ROWS, rows.count() // 1000)
    return materialise(rows.groupBy(key).count().filter(F.col("count") >= least).select(F.col(key).alias("_hot")), "hot")


def spread_join(rows: DataFrame, key: str, by: list[str], table: DataFrame, of: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined on ``key`` to ``table``, which is unique in ``of``; hot keys go over salts of ``by``."""
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)  # bounded: a thousand keys
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    salts = F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0))
    right = table.join(hot, F.col(of) == F.col("_hot"), "left").withColumn("_salt2", F.explode(salts)).drop("_hot")
    return left.join(right, (F.col(key) == F.col(of)) & (F.col("_salt") == F.col("_salt2")), how).drop("_salt", "_salt2")
