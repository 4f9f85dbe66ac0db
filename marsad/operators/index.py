"""Dense and sparse indexes as tables, and ranked search over them (V*, B*)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marsad.functions.lexicon import K1, B
from marsad.functions.pin import pinned
from marsad.functions.text import terms
from marsad.sources.reports import saved


#: Queries that travel together.
QUERY_BLOCK = 1024


class Embedder(Protocol):
    """Encodes batches of texts; implementations load their model once per worker."""

    def __call__(self, texts: Iterator[pd.Series]) -> Iterator[pd.Series]: ...


def hashed_embedder(dimension: int = 64) -> Embedder:
    """A deterministic stand-in: signed hashes of words, added up."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        def one(text: str | None) -> list[float]:
            v = [0.0] * dimension
            for w in (text or "").split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1.0 if h >> 16 & 1 else -1.0
            return v

        for s in texts:
            yield s.map(one)

    return run


def zero_embedder(dimension: int = 384) -> Embedder:
    """A test double: every text is the zero vector."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda _: [0.0] * dimension)

    return run


def encode(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """V1: an array<float> column from any embedder, in Arrow batches."""
    return df.withColumn(out, F.pandas_udf(embedder, "array<float>", F.PandasUDFType.SCALAR_ITER)(F.coalesce(text, F.lit(""))))


def append_vectors(df: DataFrame, path: str) -> None:
    """Add rows (idx, embedding, text and metadata columns) to a vector table."""
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("append").parquet(path)


def mean_vectors(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """V3: elementwise mean of the vectors of each group; aggregated per position before the shuffle."""
    cells = df.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias(vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", idx: str = "idx", digits: int = 6) -> DataFrame:
    """V2: exact inner products, best k per query: qid, idx, dense_score, dense_rank.

    The queries travel to the vectors in blocks of about ``QUERY_BLOCK`` as one array each. One block is
    broadcast, which its number of queries bounds; several meet the vectors by block number, so Spark
    broadcasts them only under its own threshold. The window keeps k rows per query and task before its shuffle.
    """
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    block = queries.withColumn("_b", F.pmod(F.xxhash64(qid), F.lit(n)).cast("int"))
    blocks = block.groupBy("_b").agg(F.collect_list(F.struct(F.col(qid).alias("q"), F.col("embedding").alias("v"))).alias("_q"))
    every = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = every.join(F.broadcast(blocks) if n == 1 else blocks, "_b").select(idx, "embedding", F.explode("_q").alias("_q"))
    rows = rows.select(F.col("_q.q").alias(qid), idx, F.round(dot(F.col("_q.v"), F.col("embedding")), digits).alias("dense_score"))
    order = Window.partitionBy(qid).orderBy(F.desc("dense_score"), idx)
    return rows.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def term_lists(docs: DataFrame, idx: str = "idx", text: str = "text") -> DataFrame:
    """B1 as it is stored: idx, len (distinct terms), terms. Written once, so texts are tokenised once."""
    return saved(pinned(docs.select(idx, text), terms=terms(F.col(text))).select(idx, F.size("terms").alias("len"), "terms"), "terms")


def exploded(lists: DataFrame, idx: str = "idx") -> DataFrame:
    """One row per term of ``term_lists``."""
    return lists.select(idx, "len", F.explode("terms").alias("term"))


def postings(docs: DataFrame, idx: str = "idx", text: str = "text") -> DataFrame:
    """B1: idx, len (distinct terms of the document) and one row per term (tf is 1 throughout)."""
    return docs.select(idx, terms(F.col(text)).alias("_t")).select(idx, F.size("_t").alias("len"), F.explode("_t").alias("term"))


def term_df(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lists: DataFrame) -> DataFrame:
    """One row: n and avg_len; documents without terms count."""
    return lists.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def vocabulary(index: DataFrame) -> DataFrame:
    """B4."""
    return index.select("term").distinct()


def bm25(query_terms: DataFrame, docs: DataFrame, idx: str = "idx", text: str = "text", qid: str = "qid", digits: int = 6, lists: DataFrame | None = None) -> DataFrame:
    """B2: qid, idx, sparse_score over 0, for query_terms (qid, term); ``lists``: ``term_lists`` of docs, if at hand.

    Only postings of query terms take part: they are met by term, weighed and added up per pair, with
    partial sums before the shuffle. Document frequencies and the mean length come from aggregates of
    one row per term and one row in all.
    """
    lists = term_lists(docs, idx, text) if lists is None else lists
    index = exploded(lists, idx)
    wanted = query_terms.select(qid, "term").distinct()
    stats = corpus_stats(lists)
    df = term_df(index.join(wanted.select("term").distinct(), "term", "left_semi"))
    weighed = wanted.join(df, "term").join(F.broadcast(stats), F.lit(True)).select(qid, "term", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    norm = 1.0 + K1 * (1.0 - B + B * (F.greatest(F.lit(1), F.col("len")) / F.greatest(F.lit(1e-9), F.col("avg_len"))))
    part = F.col("idf") * ((K1 + 1.0) / F.greatest(F.lit(1e-9), norm))
    return index.join(weighed, "term").groupBy(qid, idx).agg(F.round(F.sum(part), digits).alias("sparse_score")).filter("sparse_score > 0")


def top_k(scores: DataFrame, k: int, qid: str = "qid", idx: str = "idx", score: str = "sparse_score", rank: str = "sparse_rank") -> DataFrame:
    """B3."""
    order = Window.partitionBy(qid).orderBy(F.desc(score), idx)
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)
