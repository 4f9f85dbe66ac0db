"""Inputs that make the operators do real work on tables without Arabic, and the lexicon they use.

The same rules stand in ``oracle`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.functions.lexicon import Lexicon
from marsad.sources.reports import spread, table

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: A letter for each of the 26, with folded forms among them.
ARABIC = "ابتثيجحخأدذرزسةشصضطظإعوغىف"
LEX = Lexicon(
    stopwords=("the", "and", "of", "la", "de", "der", "et"),
    intents={
        "identity": ("is", "est", "ist"),
        "temporal": ("in", "en", "im"),
        "location": ("on", "sur", "von"),
        "list": ("for", "pour", "por"),
        "education": ("that", "que"),
        "works": ("with", "avec", "mit"),
        "verification": ("was", "at"),
    },
    entities=("this", "from", "les", "los", "und", "er"),
    variants={"temporal": "date year", "location": "place town", "list": "items points", "education": "school law", "works": "novel verse"},
    yes_no="Th",
    waw="w",
)
ALIASES = {"the": ("of", "zzz"), "de": ("la",), "und": ("der", "die", "xyzzy"), "tion": ("ation",), "nowhere": ("the",)}


def ar(c: Column) -> Column:
    return F.translate(c, LATIN + LATIN.upper(), ARABIC * 2)


def damaged(c: Column) -> Column:
    """Glyph damage: a letter turned into a syllabics code point."""
    return F.replace(c, F.lit("e"), F.lit("ᐃ"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text", "lang"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("idx"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")


def raw_payload() -> Column:
    """Model output in five states of repair, by conv_id."""
    c = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    a, q = c("answer ", F.col("conv_id")), c("quote ", F.col("turn"))
    whole = c('{"supported": true, "answer": "', a, '", "sources": ["S1", "S2"], "evidence": [{"source": "S1", "quote": "', q, '"}]}')
    m = F.col("conv_id") % 5
    return (
        F.when(m == 0, whole)
        .when(m == 1, c("```json\n", whole, "\n```"))
        .when(m == 2, c("{'supported': True, 'answer': '", a, "', 'sources': ['S1'], 'evidence': ['", q, "', '", q, "']}"))
        .when(m == 3, c('{supported: false, answer: "', a, '", sources: [], evidence: [],}'))
        .otherwise(c('supported: true, answer: "', a, '", sources S3 and S2 {broken'))
    )


def model_payload(question: str = "qid", sources: str = "sources") -> Column:
    """A parsed payload over retrieved sources: sound, fabricated, wrongly cited, ungrounded or a refusal, by question."""
    m = F.col(question) % 6
    first = F.col(sources)[0]["chunk"]
    quote = F.when(m == 1, F.lit("never written anywhere")).otherwise(F.trim(F.substring(first, 1, 60)))
    answer = F.when(m == 3, F.concat(quote, F.lit(" 987654"))).when(m == 4, F.lit("zzzz yyyy xxxx wwww")).otherwise(quote)
    return F.struct(
        F.lit(True).alias("present"),
        (m != 5).alias("supported"),
        answer.alias("answer"),
        F.array(F.when(m == 2, F.lit("S9")).otherwise(F.lit("S1"))).alias("sources"),
        F.array(F.struct(F.lit(None).cast("string").alias("source"), quote.alias("quote")), F.struct(F.lit("S1").alias("source"), F.lit("abc").alias("quote"))).alias("evidence"),
        F.lit(False).alias("recovered"),
    )
