"""The query list over the driver's tables; ``oracle`` has the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from marsad.functions import text as T
from marsad.functions.pin import pinned
from marsad.operators import answer as A
from marsad.operators import chunks as C
from marsad.operators import evaluate as M
from marsad.operators import extract as X
from marsad.operators import index as I
from marsad.operators import query as Q
from marsad.operators import retrieve as R
from marsad.plans import fixtures as fx
from marsad.sources.reports import table

S = SparkSession
c = F.col


def digest(*cols) -> list:
    return [F.md5(x).alias(n) for n, x in cols]


def join_(x, sep: str = ","):
    return F.array_join(F.array_sort(x), sep)


def q01_char_quality(spark: S, d: str) -> DataFrame:
    t = F.when(c("doc_id") % 2 == 0, fx.damaged(c("text"))).otherwise(c("text"))
    return fx.documents(spark, d).select("doc_id", T.nonspace(t).alias("nonspace"), T.suspicious(t).alias("suspicious"), T.suspicious(t, False).alias("suspicious_plain"), T.syllabics(t).alias("syllabics"), T.quality(t)["neg_ratio"].alias("neg_ratio"))


def q02_source_selection(spark: S, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    of = lambda name, bad: docs.select("doc_id", F.lit(name).alias("extractor"), F.when(bad, fx.damaged(c("text"))).otherwise(c("text")).alias("text"))
    both = of("a", c("doc_id") % 3 == 0).union(of("b", c("doc_id") % 3 == 1))
    return X.select_source(both, clean=False).select("doc_id", "extractor", "quality.neg_ratio", "quality.nonspace", *digest(("text_md5", c("text"))))


def q03_arabic_normalize(spark: S, d: str) -> DataFrame:
    t = F.replace(fx.ar(c("text")), F.lit("ب"), F.lit("بـ  \t"))
    rows = pinned(fx.documents(spark, d), n=T.normalize_arabic(t))
    return rows.select("doc_id", F.char_length("n").alias("n_chars"), *digest(("text_md5", c("n"))))


def q04_fragment_repair(spark: S, d: str) -> DataFrame:
    t = F.replace(fx.ar(c("text")), F.lit(". "), F.lit(".\nاب\n"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.repair_fragments(T.normalize_arabic(t)).alias("r"))
    return rows.select("conv_id", "turn", c("r.repair_count").cast("int").alias("repairs"), *digest(("repaired_md5", c("r.repaired"))))


def q05_tokens_terms(spark: S, d: str) -> DataFrame:
    t = fx.ar(c("text"))
    rows = pinned(fx.documents(spark, d), tokens=T.token_set(t), terms=T.terms(t))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("terms").alias("n_terms"), *digest(("terms_md5", join_(c("terms")))))


def q06_numbers(spark: S, d: str) -> DataFrame:
    return fx.documents(spark, d).select("doc_id", T.numbers(c("text")).alias("n")).select("doc_id", F.size("n").alias("n_numbers"), join_(c("n")).alias("numbers"))


def q07_sentences(spark: S, d: str) -> DataFrame:
    t = F.replace(F.replace(c("text"), F.lit(" the "), F.lit("\n• ")), F.lit(" de "), F.lit("\n\n"))
    rows = pinned(fx.documents(spark, d), a=T.chunk_sentences(t), b=T.answer_sentences(t))
    return rows.select("doc_id", F.size("a").alias("n_chunker"), F.size("b").alias("n_answer"), *digest(("chunker_md5", F.array_join("a", "|")), ("answer_md5", F.array_join("b", "|"))))


def q08_chunk_pack(spark: S, d: str) -> DataFrame:
    return C.pack_documents(fx.documents(spark, d)).select("doc_id", "chunk_id", F.char_length("text").alias("n_chars"), *digest(("text_md5", c("text"))))


def _threads(spark: S, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n\n"), x["text"])), "\n\n")
    return turns.select("conv_id", F.concat(body, F.when(c("conv_id") % 3 == 0, F.lit("\n\n المصادر\nhttps://example.org/a")).otherwise(F.lit(""))).alias("text"))


def q09_sections(spark: S, d: str) -> DataFrame:
    return C.sections(_threads(spark, d), "conv_id").select("conv_id", c("section_no").cast("int").alias("section_no"), "title", F.char_length("text").alias("n_chars"), *digest(("text_md5", c("text"))))


def q10_noise_filter(spark: S, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(c("page_id").alias("conv_id"), "url")
    url = F.coalesce("url", F.lit("www.none"))
    more = F.when(c("conv_id") % 3 == 0, F.concat(F.lit(" المصادر "), url)).when(c("conv_id") % 3 == 1, F.concat(F.lit(" "), url, F.lit(" "), url)).otherwise(F.lit(""))
    rows = table(spark, d, "conversations").join(pages, "conv_id", "left").select("conv_id", "turn", F.concat(F.when(c("turn") % 2 == 0, fx.ar(c("text"))).otherwise(c("text")), more).alias("t"))
    t = c("t")
    return rows.select("conv_id", "turn", C.has_url(t).alias("has_url"), C.url_count(t).alias("n_urls"), C.arabic_count(t).alias("n_arabic"), C.is_reference_noise(t).alias("noise"), C.reference_penalty(t).alias("penalty"))


def q11_chunk_stats(spark: S, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    chunks = C.pack_documents(docs, "doc_id", "text", "lang").withColumn("section", F.when(c("doc_id") % 3 == 0, F.lit("النص")).otherwise(c("lang")))
    out = C.chunk_stats(chunks, "lang")
    return out.select("lang", "chunks", *[F.round(x, 6).alias(x) for x in ("avg_length", "titled_share", "ended_share")])


def q12_term_df(spark: S, d: str) -> DataFrame:
    return I.term_df(I.postings(fx.chunks(spark, d)))


def _question_terms(spark: S, d: str) -> DataFrame:
    return fx.questions(spark, d).select("qid", F.explode(T.terms(c("question"))).alias("term"))


def _hits(spark: S, d: str, k: int = 8) -> DataFrame:
    return I.top_k(I.bm25(_question_terms(spark, d), fx.chunks(spark, d)), k).withColumnRenamed("sparse_rank", "rank")


def _hit_texts(spark: S, d: str, k: int) -> DataFrame:
    return _hits(spark, d, k).join(fx.chunks(spark, d), "idx")


def q13_bm25_topk(spark: S, d: str) -> DataFrame:
    return _hits(spark, d).select("qid", "rank", "idx", "sparse_score")


def _centroids(spark: S, d: str) -> DataFrame:
    return I.mean_vectors(table(spark, d, "embeddings"), "label")


def _query_vectors(spark: S, d: str) -> DataFrame:
    """A question's vector: the mean of the label that its id names."""
    return fx.questions(spark, d).select("qid", (c("qid") % 10).cast("int").alias("label")).join(_centroids(spark, d), "label").select("qid", "embedding")


def q14_dense_topk(spark: S, d: str) -> DataFrame:
    return I.dense_top_k(_centroids(spark, d).withColumnRenamed("label", "qid"), fx.vectors(spark, d), 8).select("qid", "idx", "dense_rank", "dense_score")


def q15_variant_mean(spark: S, d: str) -> DataFrame:
    return _centroids(spark, d).select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def q16_rrf_fusion(spark: S, d: str) -> DataFrame:
    dense = I.dense_top_k(_query_vectors(spark, d), fx.vectors(spark, d), 8)
    sparse = I.top_k(I.bm25(_question_terms(spark, d), fx.chunks(spark, d)), 8)
    return R.fuse_ranks(dense, sparse).select("qid", "idx", "dense_rank", "sparse_rank", F.round("dense_rrf", 9).alias("dense_rrf"), F.round("sparse_rrf", 9).alias("sparse_rrf"))


def q17_hybrid_fused(spark: S, d: str) -> DataFrame:
    return R.retrieve(fx.questions(spark, d), fx.chunks(spark, d), _query_vectors(spark, d), fx.vectors(spark, d), fx.LEX).drop("text")


def q18_lexical_entity(spark: S, d: str) -> DataFrame:
    hits = _hit_texts(spark, d, 8).join(fx.questions(spark, d), "qid")
    q, e = T.terms(c("question")), T.normalize_terms(Q.analyze(c("question"), fx.LEX)["entities"])
    t = T.terms(c("text"))
    return hits.select("qid", "idx", F.bround(R.coverage(q, t), 4).alias("lexical"), F.bround(R.coverage(e, t), 4).alias("entity"))


def q19_intent_score(spark: S, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("identity", "temporal", "location", "list", "education", "works", "verification")))
    intents = F.array(F.element_at(names, (c("doc_id") % 7 + 1).cast("int")), F.element_at(names, ((c("doc_id") + 3) % 7 + 1).cast("int")))
    t = F.replace(F.replace(F.replace(fx.ar(c("text")), F.lit(" "), F.lit("  ")), F.lit(fx.ARABIC[0] + " "), F.lit("في ")), F.lit(" " + fx.ARABIC[3]), F.lit(" هو "))
    section = F.when(c("doc_id") % 2 == 0, F.lit("التعليم")).otherwise(F.lit("النص"))
    return fx.documents(spark, d).select("doc_id", F.round(R.intent_score(intents, t, section), 6).alias("score"))


def _user_turns(spark: S, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return pinned(turns.select("conv_id", "turn", "text"), i=Q.analyze(c("text"), fx.LEX))


def q20_query_analysis(spark: S, d: str) -> DataFrame:
    return _user_turns(spark, d).select("conv_id", "turn", F.size("i.tokens").alias("n_tokens"), F.size("i.key_terms").alias("n_key_terms"), *digest(("key_terms_md5", F.array_join("i.key_terms", ","))), F.array_join("i.entities", ",").alias("entities"), F.array_join("i.intents", ",").alias("intents"), c("i.is_yes_no").alias("is_yes_no"))


def q21_variants_k(spark: S, d: str) -> DataFrame:
    v = Q.variants(c("text"), c("i.intents"), fx.LEX)
    rows = pinned(_user_turns(spark, d), v=v)
    rows = pinned(rows, x=Q.expanded_terms(c("i.key_terms"), c("v"))).select("conv_id", "turn", "v", "x", Q.suggested_k(c("text"), c("i"), fx.LEX).alias("k"))
    return rows.select("conv_id", "turn", F.size("v").alias("n_variants"), F.size("x").alias("n_terms"), "k", *digest(("terms_md5", join_(c("x")))))


def q22_bridge(spark: S, d: str) -> DataFrame:
    vocabulary = I.vocabulary(I.postings(fx.chunks(spark, d)))
    out = Q.bridge(_question_terms(spark, d), Q.alias_table(spark, fx.ALIASES), vocabulary)
    return out.select("qid", "term", F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"), "was_bridged")


def q22b_bridge_impact(spark: S, d: str) -> DataFrame:
    plain = _question_terms(spark, d)
    index = fx.chunks(spark, d)
    lists = I.term_lists(index)
    bridged = Q.bridged_terms(Q.bridge(plain, Q.alias_table(spark, fx.ALIASES), None))
    return Q.bridge_impact(I.bm25(plain, index, lists=lists), I.bm25(bridged, index, lists=lists), fx.questions(spark, d))


def _sourced(spark: S, d: str) -> DataFrame:
    """Questions with three sources each; questions without a hit have none."""
    return A.source_list(_hit_texts(spark, d, 3)).join(fx.questions(spark, d), "qid")


def q23_prompt_context(spark: S, d: str) -> DataFrame:
    p = A.prompt_context(c("sources"))
    m = A.messages(c("question"), p)
    return _sourced(spark, d).select("qid", F.size("sources").alias("n_sources"), *digest(("context_md5", p), ("system_md5", m[0]["content"]), ("user_md5", m[1]["content"])))


def q24_payload_parse(spark: S, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", fx.raw_payload().alias("raw"))
    p = turns.select("conv_id", "turn", A.payload(c("raw")).alias("p"))
    e = A.normalize_evidence(c("p.evidence"), F.lit("S0"))
    return p.select("conv_id", "turn", "p.present", "p.supported", "p.answer", F.array_join("p.sources", ",").alias("sources"), F.array_join(F.transform(e, lambda x: F.concat_ws("=", x["source"], x["quote"])), ",").alias("evidence"), "p.recovered")


def _judged(spark: S, d: str) -> DataFrame:
    rows = pinned(_sourced(spark, d), payload=fx.model_payload(), info=Q.analyze(c("question"), fx.LEX))
    return A.decide(A.with_verdict(rows))


def q25_validate(spark: S, d: str) -> DataFrame:
    return A.with_verdict(pinned(_sourced(spark, d), payload=fx.model_payload())).select("qid", "verdict", "ok", "supported", F.array_join("cited", ",").alias("cited"), F.size("quotes").alias("n_quotes"))


def q26_support_sentences(spark: S, d: str) -> DataFrame:
    s = A.support_sentences(Q.analyze(c("question"), fx.LEX)["key_terms"], c("sources"))
    rows = _sourced(spark, d).select("qid", s.alias("s"))
    return rows.select("qid", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"), *digest(("quotes_md5", F.array_join(F.transform("s", lambda x: x["quote"]), "|"))))


def q27_partial_answer(spark: S, d: str) -> DataFrame:
    rows = pinned(_sourced(spark, d), info=Q.analyze(c("question"), fx.LEX))
    rows = pinned(rows, s=A.support_sentences(c("info.key_terms"), c("sources")))
    return rows.select("qid", A.can_answer(c("info"), c("s")).alias("can_answer"), *digest(("partial_md5", A.partial_answer(c("info"), c("s")))))


def q28_decisions(spark: S, d: str) -> DataFrame:
    return _judged(spark, d).select("qid", "decision", F.char_length("final_answer").alias("n_chars"), *digest(("answer_md5", c("final_answer"))))


def q29_retrieval_metrics(spark: S, d: str) -> DataFrame:
    hits = _hit_texts(spark, d, 5).join(fx.questions(spark, d), "qid")
    hits = hits.select("qid", "rank", M.relevance(c("question"), c("text")).alias("relevance"), C.reference_penalty(c("text")).alias("reference"))
    return M.retrieval_metrics(hits, fx.questions(spark, d))


def _records(spark: S, d: str) -> DataFrame:
    """Answered questions with an expected class by their id."""
    rows = _judged(spark, d)
    context = F.array_join(F.transform("sources", lambda s: s["chunk"]), "\n\n")
    expected = F.when(c("qid") % 3 == 2, "C").when(c("qid") % 3 == 1, "B").otherwise("A")
    return rows.select("qid", expected.alias("expected_class"), F.concat(F.lit("cat"), c("qid") % 4).alias("category"), "decision", M.behavior(c("final_answer")).alias("behavior"), (c("qid") % 5 != 0).alias("json_valid"), (F.size(F.array_except(T.numbers(c("final_answer")), T.numbers(context))) == 0).alias("numeric_ok"), M.hallucinated(c("final_answer"), context).alias("hallucinated"))


def q30_answer_metrics(spark: S, d: str) -> DataFrame:
    return M.answer_metrics(_records(spark, d))


def q31_by_category(spark: S, d: str) -> DataFrame:
    return M.by_category(_records(spark, d))


def _runs(spark: S, d: str) -> DataFrame:
    """Three conditions of labelled documents as runs of one question each."""
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(*map(F.lit, "ABC"))).alias("condition"))
    n = c("doc_id") + F.ascii("condition") - 65
    behavior = F.when(n % 3 == 0, "refusal").when(c("quality") == 0, "partial").otherwise("answered")
    return rows.select(c("doc_id").alias("qid"), "condition", n.alias("seq"), behavior.alias("behavior"), F.when(c("toxic") == 1, "C").otherwise(F.when(c("doc_id") % 2 == 0, "A").otherwise("B")).alias("expected_class"), F.concat(F.lit("cat"), c("doc_id") % 4).alias("category"), F.when(n % 2 == 0, "validated_model_answer").otherwise("safe_refusal").alias("decision"), (n % 5 != 0).alias("json_valid"), (n % 7 == 0).alias("hallucinated"))


def q32_condition_stats(spark: S, d: str) -> DataFrame:
    return M.condition_stats(_runs(spark, d))


def q32b_category_pivot(spark: S, d: str) -> DataFrame:
    return M.category_by_condition(_runs(spark, d))


def q32c_condition_changes(spark: S, d: str) -> DataFrame:
    return M.compare_conditions(_runs(spark, d))


def q33_oracle_join(spark: S, d: str) -> DataFrame:
    """Each item names three documents, of which the last may be out of range; every fifth names none."""
    i = c("qid")
    mapping = fx.questions(spark, d).select("qid", F.when(i % 5 != 4, F.array(i, i * 3 + 1, i * 1000)).alias("chunk_idx"))
    out = M.oracle_evidence(mapping, fx.chunks(spark, d)).join(fx.questions(spark, d), "qid")
    return out.select("qid", "n_found", "unanswerable", *digest(("evidence_md5", c("evidence"))), M.hallucinated(c("question"), c("evidence")).alias("hallucinated"), M.numeric_correct(c("question"), c("evidence")).alias("numeric_correct"))


def _failures(spark: S, d: str) -> DataFrame:
    """Failing questions with the flags that attribution reads."""
    rows = _judged(spark, d)
    hits = _hit_texts(spark, d, 5).join(fx.questions(spark, d), "qid").groupBy("qid").agg(F.bool_or(M.relevance(c("question"), c("text")) >= M.RELEVANT).alias("relevant_retrieved"))
    rows = rows.join(hits, "qid").filter((c("qid") % 3 != 2) & (M.behavior(c("final_answer")) == "refusal"))
    waws = F.char_length("question") - F.char_length(F.replace("question", F.lit("w"), F.lit("")))
    return rows.select("qid", (c("qid") % 4 != 0).alias("evidence_exists"), (c("qid") % 8 == 0).alias("ascii_only"), (F.size("info.entities") > 0).alias("has_entities"), F.size("info.key_terms").alias("n_key_terms"), "relevant_retrieved", (c("qid") % 5 < 3).alias("sparse_signal"), (waws >= 20).alias("many_parts"), A.can_answer(c("info"), c("support")).alias("grounding_would_pass"), (c("qid") % 2 == 0).alias("payload_known"))


def q34_attribution(spark: S, d: str) -> DataFrame:
    return M.failure_counts(M.attribute_failure(_failures(spark, d)))


def q35_evidence_in_corpus(spark: S, d: str) -> DataFrame:
    """All terms of a question; every fourth question is a word that the corpus can't know."""
    t = F.when(c("qid") % 4 == 3, F.concat(F.lit("qqzzxx"), c("qid"))).otherwise(c("question"))
    q = fx.questions(spark, d).select("qid", T.terms(t).alias("terms"))
    return M.evidence_exists(q, I.postings(fx.chunks(spark, d)))


def q36_condition_c_clean(spark: S, d: str) -> DataFrame:
    t = F.replace(F.replace(F.replace(fx.ar(c("text")), F.lit(". "), F.lit(" ي\n.")), F.lit("ا "), F.lit(" ي ")), F.lit("بت"), F.lit("الممل"))
    rows = pinned(fx.documents(spark, d), n=T.clean_condition_c(t))
    return rows.select("doc_id", F.char_length("n").alias("n_chars"), *digest(("text_md5", c("n"))))


def q37_histograms(spark: S, d: str) -> DataFrame:
    return M.histogram(_records(spark, d), "decision", "behavior")


def q38_extractor_comparison(spark: S, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    both = docs.select(F.lit("a").alias("extractor"), "text").union(docs.select(F.lit("b"), fx.damaged(c("text"))))
    out = X.compare_extractors(both)
    return out.select("extractor", "length", "nonspace", "suspicious", "syllabics", "replacements", F.array_join("sample", "").alias("sample"), F.round("ratio", 9).alias("ratio"))


def q39_bridge_stats(spark: S, d: str) -> DataFrame:
    return Q.bridge_stats(Q.alias_table(spark, fx.ALIASES), I.vocabulary(I.postings(fx.chunks(spark, d))))


def q40_text_shapes(spark: S, d: str) -> DataFrame:
    fenced = F.concat(F.lit(" ```JSON\n"), c("text"), F.lit("\n``` "))
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", *digest(("line_md5", T.one_line(c("text"))), ("body_md5", T.strip_fences(fenced))))


def q41_artifacts(spark: S, d: str) -> DataFrame:
    t = F.when(c("doc_id") % 4 == 0, fx.damaged(c("text"))).when(c("doc_id") % 4 == 1, F.replace(c("text"), F.lit("the"), F.lit("�"))).when(c("doc_id") % 4 == 2, F.concat(c("text"), F.lit(" 0491"))).otherwise(c("text"))
    return fx.documents(spark, d).select("doc_id", T.artifacts(t).alias("a")).select("doc_id", "a.*")


def q42_record_slices(spark: S, d: str) -> DataFrame:
    records = fx.questions(spark, d).withColumn("ordinal", F.row_number().over(W.orderBy("qid")) - 1)
    return M.slice_records(records, "ordinal", 5, 25).select("qid", c("ordinal").cast("int").alias("ordinal"))


def q43_mirrored_lines(spark: S, d: str) -> DataFrame:
    t = F.replace(F.when(c("turn") % 2 == 0, fx.ar(c("text"))).otherwise(c("text")), F.lit(". "), F.lit("\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", *digest(("text_md5", X.mirrored_lines(t))))


def q44_build_chunks(spark: S, d: str) -> DataFrame:
    """Every third thread begins with a chunk of links: it goes as noise, and its id stays unused."""
    links = F.when(c("conv_id") % 3 == 1, F.lit("https://a.example/x https://b.example/y.\n\n")).otherwise(F.lit(""))
    chunks = C.build_chunks(_threads(spark, d).withColumn("text", F.concat(links, "text")), "conv_id")
    return chunks.select("conv_id", c("chunk_id").cast("int").alias("chunk_id"), "section", F.char_length("text").alias("n_chars"), *digest(("text_md5", c("text"))))


QUERIES = {n: f for n, f in list(globals().items()) if n[0] == "q" and n[1:3].isdigit() and callable(f)}
