"""Hybrid retrieval: weighted reciprocal-rank fusion with lexical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marsad.functions import lexicon as L
from marsad.functions.pin import pinned
from marsad.functions.text import WORD_AFTER, WORD_BEFORE, normalize_terms, terms
from marsad.operators.chunks import reference_penalty
from marsad.operators.index import bm25, dense_top_k, top_k
from marsad.operators.query import MOST_SUGGESTED, analyze, expanded_terms, suggested_k, variants


def rrf(rank: Column, k: int = L.RRF_K) -> Column:
    """H4."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def coverage(wanted: Column, have: Column) -> Column:
    """H5, H6."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, have)) / F.size(wanted)).otherwise(F.lit(0.0))


def intent_score(intents: Column, text: Column, section: Column | None = None) -> Column:
    """H7."""
    has = lambda name: F.array_contains(intents, name)
    word = lambda some: text.rlike(f"{WORD_BEFORE}(?:{'|'.join(some)}){WORD_AFTER}")
    part = lambda some: text.rlike("|".join(some))
    points = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = points(has("temporal") & text.rlike(r"\p{Nd}{3,4}"), 0.35)
    score = score + points(has("location") & word(L.LOCATION_WORDS), 0.30)
    score = score + points(has("list") & (text.contains("•") | text.contains(":")), 0.35)
    score = score + points(has("education") & part(L.EDUCATION_PARTS), 0.35)
    score = score + points(has("works") & part(L.WORKS_PARTS), 0.35)
    score = score + points(has("identity") & word(L.IDENTITY_WORDS), 0.30)
    if section is not None:
        inside = F.coalesce(section, F.lit("")).rlike("|".join(L.SECTION_PARTS))
        score = score + points((has("works") | has("education") | has("list")) & inside, 0.10)
    return F.least(F.lit(1.0), score)


def targets(n: Column, k: Column, multiplier: int = 4) -> tuple[Column, Column]:
    """H1: (target_k, candidates)."""
    target = F.greatest(F.lit(1), F.least(k, n))
    return target, F.least(F.greatest(target * multiplier, F.lit(8)), n)


def fuse_ranks(dense: DataFrame, sparse: DataFrame, qid: str = "qid", idx: str = "idx") -> DataFrame:
    """H2 to H4: full outer union of two rank lists."""
    both = dense.join(sparse, [qid, idx], "full")
    return both.withColumn("dense_rrf", rrf(F.col("dense_rank"))).withColumn("sparse_rrf", rrf(F.col("sparse_rank")))


def fused_score(weights: dict[str, float] | None = None) -> Column:
    """H9."""
    w = L.FUSION | (weights or {})
    c = F.col
    return (
        F.lit(w["dense_rrf"]) * c("dense_rrf")
        + F.lit(w["sparse_rrf"]) * c("sparse_rrf")
        + F.lit(w["lexical"]) * c("lexical")
        + F.lit(w["entity"]) * c("entity")
        + F.lit(w["intent"]) * c("intent")
        - F.lit(w["reference_penalty"]) * c("reference_penalty")
    )


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    query_vectors: DataFrame,
    vectors: DataFrame,
    lex: L.Lexicon = L.ARABIC,
    k: int | None = None,
    weights: dict[str, float] | None = None,
    section: str | None = None,
) -> DataFrame:
    """H1 to H10 for many questions: questions (qid, question), chunks (idx, text), query_vectors
    (qid, embedding), vectors (idx, embedding) -> qid, rank, idx, scores and features.

    Blank questions and empty corpora give no rows. Candidates of both lists are cut by windows
    before chunk texts join, so features are worked out for candidates only.
    """
    q = pinned(questions.filter(F.trim("question") != ""), info=analyze(F.col("question"), lex))
    q = pinned(q, q_terms=expanded_terms(F.col("info.key_terms"), variants(F.col("question"), F.col("info.intents"), lex)))
    n = chunks.agg(F.count("*").alias("n"))
    q = q.join(F.broadcast(n), F.lit(True))
    target, most = targets(F.col("n"), F.lit(k) if k else suggested_k(F.col("question"), F.col("info"), lex))
    q = q.select("qid", "info", "q_terms", normalize_terms(F.col("info.entities")).alias("q_entities"), target.cast("int").alias("target_k"), most.cast("int").alias("most"))
    top = max(4 * (k or MOST_SUGGESTED), 8)  # candidates at most: four times the largest target
    dense = dense_top_k(query_vectors, vectors, top)
    sparse = top_k(bm25(q.select("qid", F.explode("q_terms").alias("term")), chunks), top)
    limits = q.select("qid", "most")
    dense = dense.join(limits, "qid").filter("dense_rank <= most").drop("most")
    sparse = sparse.join(limits, "qid").filter("sparse_rank <= most").drop("most")
    rows = fuse_ranks(dense, sparse).join(chunks.select("idx", "text", *([section] if section else [])), "idx").join(q, "qid")
    rows, c = pinned(rows, c_terms=terms(F.col("text"))), F.col("c_terms")
    rows = rows.withColumns({"lexical": coverage(F.col("q_terms"), c), "entity": coverage(F.col("q_entities"), c), "intent": intent_score(F.col("info.intents"), F.col("text"), F.col(section) if section else None), "reference_penalty": reference_penalty(F.col("text")).cast("double")})
    rows = rows.withColumn("fused_score", F.round(fused_score(weights), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("fused_score"), "idx")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("target_k"))
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    return rows.select(
        "qid", "rank", "idx", "fused_score", zero("dense_score"), zero("sparse_score"), "dense_rank", "sparse_rank",
        F.bround("dense_rrf", 6).alias("dense_rrf"), F.bround("sparse_rrf", 6).alias("sparse_rrf"), F.bround("lexical", 4).alias("lexical"), F.bround("entity", 4).alias("entity"), F.bround("intent", 4).alias("intent"), "reference_penalty", "text",
    )
