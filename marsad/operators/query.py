"""Question analysis and expansion (Q1 to Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.functions.lexicon import ALIASES, ARABIC, Lexicon
from marsad.functions.text import normalize_terms, normalize_token, strip, terms, tokens


def words(items) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def analyze(question: Column, lex: Lexicon = ARABIC) -> Column:
    """Question, tokens, key_terms, entities, intents, is_yes_no."""
    q = strip(question)
    t = tokens(q)
    distinct = F.array_distinct(t)
    lowered = F.array_distinct(F.concat(distinct, F.transform(distinct, F.lower)))
    hit = [F.when(F.arrays_overlap(lowered, words([*hints, *{h.lower() for h in hints} - set(hints)])), F.lit(name)) for name, hints in sorted(lex.intents.items())]
    found = F.filter(F.array(*hit, F.when(q == "", F.lit("empty"))), lambda x: x.isNotNull())
    return F.struct(
        question.alias("question"),
        t.alias("tokens"),
        F.array_sort(F.filter(distinct, lambda x: (F.char_length(x) >= 2) & ~x.isin(*lex.stopwords))).alias("key_terms"),
        F.array_sort(F.filter(distinct, lambda x: x.isin(*lex.entities))).alias("entities"),
        F.when(F.size(found) == 0, words(["generic"])).otherwise(F.array_sort(found)).alias("intents"),
        q.startswith(lex.yes_no).alias("is_yes_no"),
    )


def variants(question: Column, intents: Column, lex: Lexicon = ARABIC) -> Column:
    """Q5: the question, and one with added words for each intent that has some."""
    more = [F.when(F.array_contains(intents, name), F.concat(question, F.lit(" " + text))) for name, text in lex.variants.items()]
    return F.filter(F.array(question, *more), lambda x: x.isNotNull())


def expanded_terms(key_terms: Column, variant_list: Column) -> Column:
    """Q6."""
    return F.array_union(normalize_terms(key_terms), F.array_distinct(F.flatten(F.transform(variant_list, terms))))


#: The largest of ``suggested_k``.
MOST_SUGGESTED = 5


def suggested_k(question: Column, info: Column, lex: Lexicon = ARABIC) -> Column:
    """Q7."""
    has = lambda *names: F.arrays_overlap(info["intents"], words(names))
    waws = F.char_length(question) - F.char_length(F.replace(question, F.lit(lex.waw), F.lit("")))
    long = (F.size(info["tokens"]) >= 7) | (waws >= 2 * len(lex.waw))
    return F.when(has("list", "works", "education") | (has("temporal") & has("location")) | long, MOST_SUGGESTED).when(has("location", "temporal"), 4).otherwise(3)


def alias_table(spark: SparkSession, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Term, alias, both normalised."""
    raw = spark.createDataFrame([(t, a) for t, some in aliases.items() for a in some], "term string, alias string")
    return raw.select(normalize_token(F.col("term")).alias("term"), normalize_token(F.col("alias")).alias("alias")).filter("term <> ''").distinct()


def live_aliases(aliases: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Aliases that the corpus has; without a vocabulary all, with an empty one none."""
    if vocabulary is None:
        return aliases
    return aliases.join(vocabulary.select(F.col("term").alias("alias")), "alias", "left_semi").select("term", "alias")


def bridge(query_terms: DataFrame, aliases: DataFrame, vocabulary: DataFrame | None, qid: str = "qid") -> DataFrame:
    """Q8: qid, term, aliases (sorted; null where none is live), was_bridged; originals all stay."""
    live = live_aliases(aliases, vocabulary).groupBy("term").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return query_terms.join(live, "term", "left").select(qid, "term", "aliases", F.col("aliases").isNotNull().alias("was_bridged"))


def bridged_terms(bridged: DataFrame, qid: str = "qid") -> DataFrame:
    """Original terms and live aliases."""
    both = F.explode(F.array_union(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return bridged.select(qid, both.alias("term")).distinct()


def bridge_stats(aliases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Q9: vocabulary size and number of live keys, one row."""
    size = vocabulary.agg(F.count_distinct("term").alias("vocabulary"))
    return size.join(live_aliases(aliases, vocabulary).agg(F.count_distinct("term").alias("active")), F.lit(True))


def bridge_impact(plain: DataFrame, bridged: DataFrame, questions: DataFrame, qid: str = "qid") -> DataFrame:
    """Q10: best scores with and without the bridge; improved: had none, now has one."""
    best = lambda df, name: df.groupBy(qid).agg(F.max("sparse_score").alias(name))
    both = questions.select(qid).join(best(plain, "before"), qid, "left").join(best(bridged, "after"), qid, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(qid, zero("before").alias("before"), zero("after").alias("after"), ((zero("before") == 0) & (zero("after") > 0)).alias("improved"))
