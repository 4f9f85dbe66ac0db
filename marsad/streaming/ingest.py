"""Incremental ingest: clean and chunk arriving documents with the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marsad.functions.text import chunk_sentences, normalize_arabic, repair_fragments, terms
from marsad.operators.chunks import is_reference_noise, pack_sentences, strip_references


def chunk_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row-local stages only, so a stream and a table give the same rows: key, chunk_id, text, terms."""
    body = strip_references(repair_fragments(normalize_arabic(F.col(text)))["repaired"])
    rows = docs.select(key, F.posexplode(pack_sentences(chunk_sentences(body))).alias("_p", "chunk"))
    rows = rows.select(key, (F.col("_p") + 1).alias("chunk_id"), F.col("chunk").alias("text")).filter(~is_reference_noise(F.col("text")))
    return rows.withColumn("terms", terms(F.col("text")))


def ingest(spark: SparkSession, source: str, schema: StructType, to: str, checkpoint: str) -> StreamingQuery:
    """Parquet files as they arrive -> chunk table in append mode; each file counts once."""
    stream = chunk_stream(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n, avg_len) of a chunk table after new files have come in."""
    df = chunks.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df, chunks.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len"))
