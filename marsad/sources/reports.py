"""Tables and JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def write_report(records: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out."""
    records.write.option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str, records: str = "records", key: str = "question") -> DataFrame:
    """The records of nested reports; of equal keys the last one, as in a dictionary."""
    one = spark.read.option("multiLine", "true").schema(f"{records} array<{schema}>" if isinstance(schema, str) else schema).json(path)
    rows = one.select(F.input_file_name().alias("_f"), F.posexplode(records).alias("_at", "_r")).select("_f", "_at", "_r.*")
    last = Window.partitionBy(key).orderBy(F.desc("_f"), F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_f", "_at", "_n")


def trace(answered: DataFrame) -> DataFrame:
    """One wide row per question and a JSON snapshot of it."""
    return answered.withColumn("snapshot", F.to_json(F.struct(*[F.col(c) for c in answered.columns])))


def chunk_dump(chunks: DataFrame) -> DataFrame:
    """S12."""
    return chunks.select("chunk_id", (F.col("chunk_id") - 1).alias("idx"), "text")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for what several parts of a plan need: the folder is that of
    ``spark.checkpoint.dir``, shared by all executors; one of our own on a single machine without it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints/marsad"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer tasks than there are; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
