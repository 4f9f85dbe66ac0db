import math

import pytest
from pyspark.sql import functions as F

from marsad.functions.lexicon import ALIASES, INTENTS, QUESTION_STOPWORDS
from marsad.operators import index as I
from marsad.operators import query as Q
from marsad.operators import retrieve as R

CORPUS = ["ولد غازي القصيبي في الاحساء عام 1940", "درس الحقوق في جامعة القاهرة", "من روايات القصيبي شقة الحرية", "المصادر https://a.example/x"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "idx long, text string")


def test_bm25_matches_the_formula(spark):
    terms = [set(r.x) for r in docs(spark).select(R.terms(F.col("text")).alias("x")).collect()]
    avg = sum(map(len, terms)) / len(terms)
    query = ["القصيبي", "في", "nothing"]
    q = spark.createDataFrame([(7, t) for t in query], "qid int, term string")
    got = {r.idx: r.sparse_score for r in I.bm25(q, docs(spark)).collect()}
    want = {}
    for i, have in enumerate(terms):
        s = 0.0
        for t in query:
            if t in have:
                df = sum(t in x for x in terms)
                s += math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(have) / avg))
        if s:
            want[i] = round(s, 6)
    assert got == pytest.approx(want, abs=1e-6)


def test_dense_search_and_mean(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "idx long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "qid int, embedding array<double>")
    got = [(r.qid, r.idx) for r in I.dense_top_k(q, v, 2).orderBy("qid", "dense_rank").collect()]
    assert got == [(1, 4), (1, 3), (2, 0), (2, 1)]
    g = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g int, embedding array<double>")
    assert I.mean_vectors(g, "g").first().embedding == [2.0, 4.0]
    assert I.dense_top_k(q, v.limit(0), 2).count() == 0


def test_query_analysis(spark):
    qs = ["متى ولد غازي القصيبي؟", "هل درس في جامعة؟", "", "xyz", "ما ابرز اعمال القصيبي ورواياته وشعره وكتبه"]
    df = spark.createDataFrame(list(enumerate(qs)), "i int, q string").withColumn("a", Q.analyze(F.col("q")))
    rows = df.select("i", "a", Q.suggested_k(F.col("q"), F.col("a")).alias("k"), Q.variants(F.col("q"), F.col("a.intents")).alias("v")).orderBy("i").collect()
    assert rows[0].a.entities == ["غازي", "القصيبي"][::-1] or set(rows[0].a.entities) == {"غازي", "القصيبي"}
    assert rows[0].a.intents == ["location", "temporal"] and rows[0].k == 5 and len(rows[0].v) == 3
    assert rows[1].a.is_yes_no and set(rows[1].a.intents) == {"education", "verification"}
    assert rows[2].a.intents == ["empty"] and rows[3].a.intents == ["generic"] and rows[3].k == 3
    assert rows[4].k == 5
    assert len(QUESTION_STOPWORDS) == 33 and [len(v) for v in INTENTS.values()] == [5, 7, 6, 9, 4, 8, 4] and len(ALIASES) == 31


def test_bridge_keeps_originals_and_needs_the_vocabulary(spark):
    q = spark.createDataFrame([(1, "ميلاد"), (1, "غير"), (2, "وزير")], "qid int, term string")
    aliases = Q.alias_table(spark)
    some = spark.createDataFrame([("ولد",)], "term string")
    got = {(r.qid, r.term): r.aliases for r in Q.bridge(q, aliases, some).collect()}
    assert got == {(1, "ميلاد"): ["ولد"], (1, "غير"): None, (2, "وزير"): None}
    assert all(r.aliases is None for r in Q.bridge(q, aliases, some.limit(0)).collect())
    free = {r.term: r.aliases for r in Q.bridge(q, aliases, None).collect()}
    assert set(free["وزير"]) == {"وز", "مناصب"}
    wide = {(r.qid, r.term) for r in Q.bridged_terms(Q.bridge(q, aliases, some)).collect()}
    assert wide == {(1, "ميلاد"), (1, "غير"), (2, "وزير"), (1, "ولد")}
    (s,) = Q.bridge_stats(aliases, some).collect()
    assert s.vocabulary == 1 and s.active == 6


def test_retrieve_ranks_and_guards(spark):
    questions = spark.createDataFrame([(1, "متى ولد غازي القصيبي؟"), (2, "  ")], "qid long, question string")
    vectors = spark.createDataFrame([(i, [1.0 if i == j else 0.0 for j in range(4)]) for i in range(4)], "idx long, embedding array<float>")
    qv = spark.createDataFrame([(1, [1.0, 0.5, 0.2, 0.9]), (2, [1.0, 0.0, 0.0, 0.0])], "qid long, embedding array<double>")
    rows = R.retrieve(questions, docs(spark), qv, vectors).orderBy("rank").collect()
    assert {r.qid for r in rows} == {1} and len(rows) == 4
    assert rows[0].idx == 0 and rows[0].entity == 1.0 and rows[0].intent == 0.65
    assert rows[-1].idx == 3 and rows[-1].reference_penalty == 1.0
    assert R.retrieve(questions, docs(spark).limit(0), qv, vectors).count() == 0


def test_encoders(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [len(r.embedding) for r in I.encode(df, I.hashed_embedder(8)).collect()] == [8, 8]
    assert I.encode(df, I.zero_embedder(3)).first().embedding == [0.0, 0.0, 0.0]
