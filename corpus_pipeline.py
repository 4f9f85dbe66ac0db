"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; ``run`` writes it as Parquet in the shared folder and rereads it as the next one's docs.
All stages but the last return the columns of ``docs``.

In every stage null text counts as empty, null ids are carried, very long texts are worked on whole, and further
columns are carried whatever their names; an empty table gives an empty one. The stages say what they do with
repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.llm import near_copies, packing, quality_forest, secret_scan, suffix_dedup
from marsad.llm.bpe import vocabulary_path
from marsad.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go: null and empty texts too. Repeated rows are judged each."""
    return quality_forest.keep(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (op7's links, or Jaccard 0.8 of 5-word shingles) one row stays: the smallest id (nulls last), then text hash."""
    rows = materialise(near_copies.groups(docs.select("doc_id", "text")), "groups")
    # One row of each component stays: the smallest id, nulls last, then the smallest text hash.
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.th").alias("_th"))
    again = rows.groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias("_id2"), F.col("th").alias("_th2"))
    best = best.join(again, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left").select("_id", "_th", F.col("_th2").isNotNull().alias("_again"))
    kept = docs.join(best, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_th")))
    once = kept.filter("_again").dropDuplicates(["_id", "_th"])  # rows alike in id and text
    return kept.filter("NOT _again").union(once).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a document with a smaller id also has are cut out; null ids are the largest. Rows with one id keep theirs."""
    return suffix_dedup.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark, spans that overlap to one; repeated rows alike. A null source is an owner of its own."""
    found = secret_scan.scan(docs, repo=F.concat_ws("/", "source", "lang"))
    return secret_scan.redact(docs, found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences. Repeated rows are packed each; ties go by place in the input."""
    return packing.retrieval_pieces(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packed", packed),
]

#: Forest, fingerprint components, byte repeats and tokenisation are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
