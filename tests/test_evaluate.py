import duckdb
import pytest
from pyspark.sql import functions as F

from marsad.functions.lexicon import REFUSAL
from marsad.operators import evaluate as M
from marsad.sources import reports

RECORD = "qid int, category string, expected_class string, behavior string, decision string, json_valid boolean, numeric_ok boolean"
ROWS = [
    (1, "x", "A", "answered", "validated_model_answer", True, True),
    (2, "x", "B", "refusal", "safe_refusal", False, True),
    (3, "y", "C", "refusal", "model_refusal", True, True),
    (4, "y", "C", "answered", "extractive_reconstructed_fallback", True, False),
]


def test_answer_metrics(spark):
    (r,) = M.answer_metrics(spark.createDataFrame(ROWS, RECORD)).collect()
    assert (r.structured_output, r.fallback_rate, r.refusal_accuracy, r.coverage, r.grounded_coverage) == (0.75, 0.5, 0.5, 0.5, 1.0)
    assert (r.unsafe_rate, r.answered_unanswerable_rate, r.numeric_accuracy, r.expectation_rate) == (0.0, 0.25, 0.75, 0.5)
    by = {r.category: (r.n, r.success, r.refusal) for r in M.by_category(spark.createDataFrame(ROWS, RECORD)).collect()}
    assert by == {"x": (2, 1, 1), "y": (2, 1, 1)}


def test_rates_round_half_to_even(spark):
    assert spark.range(32).select(M.rate(F.col("id") < 1).alias("r")).first().r == 0.0312


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 0.1, False), (1, 2, 0.2, True), (2, 1, 0.9, False)], "qid int, rank int, relevance double, reference boolean")
    (r,) = M.retrieval_metrics(hits, spark.createDataFrame([(1,), (2,), (3,)], "qid int")).collect()
    assert (r.hit_at_1, r.hit_at_3, r.mrr, r.recall, r.precision) == (0.3333, 0.6667, 0.5, 0.6667, 0.6667)
    assert (r.reference_rate, r.irrelevant_rate) == (round(1 / 15, 4), round(1 / 15, 4))


def test_behaviour_and_numbers(spark):
    df = spark.createDataFrame([(REFUSAL, "a 1940"), ("in 1940", "1940"), ("in 1941 and 12", "1940"), ("none", "")], "a string, c string")
    got = df.select(M.behavior(F.col("a")), M.hallucinated(F.col("a"), F.col("c")), M.numeric_correct(F.col("a"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("refusal", False, None), ("answered", False, True), ("answered", True, False), ("answered", False, None)]


def test_conditions(spark):
    rows = [(q, k, i, b, "d", "A", "x", True, False) for q, bs in ((1, ["refusal", "answered", "answered"]), (2, ["answered", "answered", "refusal"])) for i, (k, b) in enumerate(zip("ABC", bs, strict=True))]
    rows.append((3, "A", 9, "answered", "d", "A", "x", True, False))
    runs = spark.createDataFrame(rows, "qid int, condition string, seq int, behavior string, decision string, expected_class string, category string, json_valid boolean, hallucinated boolean")
    assert {r.qid: r.change for r in M.compare_conditions(runs).collect()} == {1: "IMPROVED", 2: "REGRESSED"}
    assert {r.condition: r.coverage for r in M.condition_stats(runs).collect()} == {"A": 0.6667, "B": 1.0, "C": 0.5}
    assert M.category_by_condition(runs).first()["A_count"] == 3


def test_attribution(spark):
    cols = "evidence_exists boolean, ascii_only boolean, has_entities boolean, n_key_terms int, relevant_retrieved boolean, sparse_signal boolean, many_parts boolean, grounding_would_pass boolean, payload_known boolean"
    t, f = True, False
    rows = [(f, f, t, 1, f, f, f, f, f), (f, t, t, 1, f, f, f, f, f), (t, f, t, 6, f, t, f, f, f), (t, f, t, 1, f, t, f, f, f), (t, f, t, 1, f, f, f, f, f), (t, f, f, 1, f, t, f, f, f), (t, f, t, 1, t, t, f, f, f), (t, f, t, 1, t, t, f, t, f), (t, f, t, 1, t, t, f, t, t)]
    df = M.attribute_failure(spark.createDataFrame(rows, cols))
    assert [r.primary_failure[0] for r in df.collect()] == list("ACHDECIJI")
    counts = {r.primary_failure[0]: (r.n, r.layer) for r in M.failure_counts(df).collect()}
    assert counts["I"] == (2, "grounding") and counts["J"] == (1, "generation") and counts["C"] == (2, "retrieval")
    assert tuple(M.ceilings(df).first()) == (9, 7, 1, 2)


def test_oracle_evidence(spark):
    chunks = spark.createDataFrame([(0, "zero"), (1, "one")], "idx int, text string")
    mapping = spark.createDataFrame([(1, [1, 0, 99]), (2, None), (3, [])], "qid int, chunk_idx array<int>")
    got = {r.qid: (r.n_found, r.evidence, r.unanswerable) for r in M.oracle_evidence(mapping, chunks).collect()}
    assert got == {1: (2, "one\n\nzero", False), 2: (0, "", True), 3: (0, "", False)}


def test_reports(spark, tmp_path):
    reports.write_report(spark.createDataFrame([("q", None)], "question string, page int"), str(tmp_path / "out"))
    (tmp_path / "r.json").write_text('{"records": [{"question": "a", "n": 1}, {"question": "b", "n": 2}, {"question": "a", "n": 3}]}')
    got = {r.question: r.n for r in reports.read_report(spark, str(tmp_path / "r.json"), "struct<question:string,n:int>").collect()}
    assert got == {"a": 3, "b": 2}
    assert '"page":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json"))
    assert '"a":1' in reports.trace(spark.createDataFrame([(1,)], "a int")).first().snapshot


def test_stream_equals_batch(spark, tmp_path):
    from marsad.streaming import ingest

    docs = spark.createDataFrame([(i, f"جملة رقم {i}. " * 30) for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = ingest.chunk_stream(docs)
    assert sorted(map(tuple, out.select("doc_id", "chunk_id", "text").collect())) == sorted(map(tuple, want.select("doc_id", "chunk_id", "text").collect()))
    df, stats = ingest.refresh_statistics(out)
    assert stats.first().n == out.count() and df.filter("term = 'جمله'").first().df == out.count()


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q04_fragment_repair", "q08_chunk_pack", "q13_bm25_topk", "q28_decisions", "q36_condition_c_clean"])
def test_queries_against_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda df: sorted(map(str, df.astype(object).values.tolist()))
    assert key(got) == key(want)


def test_every_query_has_sql_or_a_reason():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert [n for n in queries if n[0] == "q" and n not in sql] == []
