"""The query list as DuckDB SQL, written from the operators' semantics.

DuckDB's regexes have neither lookbehind nor back-references: sentence ends get a mark that is split
on, and runs of one character collapse by comparing neighbours in a list.
"""

from __future__ import annotations

from marsad.functions import lexicon as L
from marsad.functions.text import EVALUATION_TOKEN, MARKS, SUSPICIOUS, SUSPICIOUS_WITHOUT_BULLET, SYLLABICS, TOKEN, WS
from marsad.operators.evaluate import FAILURES, GROUNDED
from marsad.plans.fixtures import ALIASES, ARABIC, LATIN, LEX

UPPER = LATIN.upper()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return rx(x, rf"^[{WS}]+|[{WS}]+\z")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def nonspace(x: str) -> str:
    return f"length({rx(x, f'[{WS}]')})"


def odd(x: str, pattern: str = SUSPICIOUS) -> str:
    return f"(length({x}) - length({rx(x, pattern)}))"


def ar(x: str) -> str:
    return f"translate({x}, '{LATIN}{UPPER}', '{ARABIC}{ARABIC}')"


def damaged(x: str) -> str:
    return f"replace({x}, 'e', 'ᐃ')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({rx(x, MARKS)}, {q(TOKEN)})"


def squash(t: str) -> str:
    """Runs of one character once, in a string of characters outside surrogate pairs."""
    return f"array_to_string(list_filter(string_split({t}, ''), lambda ch, i: i = 1 OR ch <> substr({t}, i - 1, 1)), '')"


def terms(x: str) -> str:
    folded = f"translate({rx(x, MARKS)}, 'أإآىة{UPPER}', 'ااايه{LATIN}')"
    found = f"regexp_extract_all({folded}, {q('[' + chr(92) + 'x{621}-' + chr(92) + 'x{64A}a-z0-9]+')})"
    return f"list_distinct(list_transform({found}, lambda tk: {squash('tk')}))"


def evaluation_terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({x}, {q(EVALUATION_TOKEN)})), lambda e: length(e) >= 2)"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\p{{Nd}}+'))"


def joined(x: str, sep: str = ",") -> str:
    return f"array_to_string(list_sort({x}), {q(sep)})"


def clean_list(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda s: {strip('s')}), lambda s: s <> '')"


def chunk_sentences(x: str) -> str:
    m = "\x01"
    y = rx(rx(rx(f"replace({x}, '\n•', '\n• ')", rf"([.!؟?])[{WS}]+", rf"\1{m}"), "\n•", f"{m}•"), r"\n{2,}", m)
    return clean_list(f"string_split({y}, '{m}')")


def answer_sentences(x: str) -> str:
    m = "\x01"
    marked = rx(x, rf"([.!?؟\n])[{WS}]+", rf"\1{m}")
    return clean_list(f"string_split({marked}, '{m}')")


def normalize_arabic(x: str) -> str:
    y = f"replace(translate({x}, 'إأآى', 'اااي'), 'ـ', '')"
    for a, b in (("\r\n", "\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        y = rx(y, a, b)
    return strip(y)


def has_url(x: str) -> str:
    return f"(contains(lower({x}), 'http://') OR contains(lower({x}), 'https://') OR contains(lower({x}), 'www.'))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def share(n: str, d: str, digits: int = 4) -> str:
    return f"round_even({n}::DOUBLE / greatest(1, {d}), {digits})"


AR_, TXT = ar("text"), "text"
SQL: dict[str, str] = {}

_t = f"CASE WHEN doc_id % 2 = 0 THEN {damaged(TXT)} ELSE text END"
SQL["q01_char_quality"] = f"""
SELECT doc_id, {nonspace("t")} AS nonspace, {odd("t")} AS suspicious, {odd("t", SUSPICIOUS_WITHOUT_BULLET)} AS suspicious_plain, {odd("t", SYLLABICS)} AS syllabics,
       CASE WHEN {nonspace("t")} = 0 THEN 0.0::DOUBLE ELSE -({odd("t")}::DOUBLE / {nonspace("t")}) END AS neg_ratio
FROM (SELECT doc_id, {_t} AS t FROM documents)"""

SQL["q02_source_selection"] = f"""
WITH c AS (
  SELECT doc_id, 'a' AS extractor, CASE WHEN doc_id % 3 = 0 THEN {damaged(TXT)} ELSE text END AS t FROM documents
  UNION ALL SELECT doc_id, 'b', CASE WHEN doc_id % 3 = 1 THEN {damaged(TXT)} ELSE text END FROM documents
), s AS (SELECT *, {nonspace("t")} AS nonspace, {odd("t")} AS bad FROM c),
r AS (SELECT *, CASE WHEN nonspace = 0 THEN 0.0::DOUBLE ELSE -(bad::DOUBLE / nonspace) END AS neg_ratio FROM s)
SELECT doc_id, extractor, neg_ratio, nonspace, md5(t) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY neg_ratio DESC, nonspace DESC, -bad DESC, extractor DESC) AS n FROM r) WHERE n = 1"""

SQL["q03_arabic_normalize"] = f"""
SELECT doc_id, length(n) AS n_chars, md5(n) AS text_md5 FROM (
  SELECT doc_id, {normalize_arabic(f"replace({AR_}, 'ب', 'بـ  ' || chr(9))")} AS n FROM documents)"""

SQL["q04_fragment_repair"] = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, list_transform(string_split({normalize_arabic(f"replace({AR_}, '. ', '.' || chr(10) || 'اب' || chr(10))")}, chr(10)), lambda s: {strip("s")}) AS l FROM conversations
), r AS (
  SELECT conv_id, turn, l, 1::BIGINT AS i, []::VARCHAR[] AS o, 0 AS n FROM src
  UNION ALL
  SELECT conv_id, turn, l, CASE WHEN f THEN i + 2 ELSE i + 1 END,
         CASE WHEN NOT f THEN list_append(o, l[i])
              WHEN len(o) > 0 AND {strip("o[len(o)]")} <> '' THEN list_append(o[1:len(o) - 1], {rx("o[len(o)]", rf"[{WS}]+$")} || ' ' || l[i] || ' ' || l[i + 1])
              ELSE list_append(o, l[i] || ' ' || l[i + 1]) END,
         n + f::INT
  FROM (SELECT *, regexp_full_match(l[i], '[\\x{{621}}-\\x{{64A}}]{{1,2}}') AND i < len(l) AND coalesce(l[i + 1], '') <> '' AS f FROM r WHERE i <= len(l))
)
SELECT conv_id, turn, n AS repairs, md5(array_to_string(o, chr(10))) AS repaired_md5 FROM r WHERE i > len(l)"""

SQL["q05_tokens_terms"] = f"""
SELECT doc_id, len(list_distinct({tokens("t")})) AS n_tokens, len(x) AS n_terms, md5({joined("x")}) AS terms_md5
FROM (SELECT doc_id, t, {terms("t")} AS x FROM (SELECT doc_id, {AR_} AS t FROM documents))"""

SQL["q06_numbers"] = f"SELECT doc_id, len(n) AS n_numbers, {joined('n')} AS numbers FROM (SELECT doc_id, {numbers(TXT)} AS n FROM documents)"

SQL["q07_sentences"] = f"""
SELECT doc_id, len(a) AS n_chunker, len(b) AS n_answer, md5(array_to_string(a, '|')) AS chunker_md5, md5(array_to_string(b, '|')) AS answer_md5 FROM (
  SELECT doc_id, {chunk_sentences("t")} AS a, {answer_sentences("t")} AS b FROM (
    SELECT doc_id, replace(replace(text, ' the ', chr(10) || '• '), ' de ', chr(10) || chr(10)) AS t FROM documents))"""

PACK = f"""
WITH RECURSIVE src AS (SELECT doc_id, lang, {chunk_sentences(TXT)} AS l FROM documents),
s AS (SELECT doc_id, lang, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM src),
last AS (SELECT doc_id, max(i) AS m FROM s GROUP BY doc_id),
r AS (
  SELECT doc_id, lang, 1::BIGINT AS i, s AS now, s AS last, NULL::VARCHAR AS done FROM s WHERE i = 1
  UNION ALL
  SELECT r.doc_id, r.lang, s.i, CASE WHEN length(r.now || ' ' || s.s) > 240 THEN r.last || ' ' || s.s ELSE r.now || ' ' || s.s END, s.s,
         CASE WHEN length(r.now || ' ' || s.s) > 240 THEN r.now END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1
), e AS (
  SELECT doc_id, lang, i, done AS text FROM r WHERE done IS NOT NULL
  UNION ALL SELECT r.doc_id, lang, i + 1, now FROM r JOIN last ON last.doc_id = r.doc_id AND i = m
), chunk AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_id, text FROM e)"""
SQL["q08_chunk_pack"] = PACK + "\nSELECT doc_id, chunk_id, length(text) AS n_chars, md5(text) AS text_md5 FROM chunk"

_lines = clean_list(r"string_split_regex(b, '\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]')")
_head = rf"(length(b) <= 55 AND (ends_with(b, ':') OR (NOT regexp_matches(b, '[.!؟?،]') AND {count('b', EVALUATION_TOKEN)} BETWEEN 1 AND 8)))"
_mark = rf"(?:\A|\n)[{WS}]*{L.SOURCES_HEADING}"
_before = f"regexp_extract(t, {q(r'(?s)' + chr(92) + 'A(.*?)' + _mark)}, 1)"
_THREADS = """
  SELECT conv_id, string_agg(role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)
         || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || ' المصادر' || chr(10) || 'https://example.org/a' ELSE '' END AS t
  FROM conversations GROUP BY conv_id
"""
#: From t0 (conv_id, t) to b4: blocks with their section.
_BLOCKS = f"""t1 AS (
  SELECT conv_id, CASE WHEN regexp_matches(t, {q(_mark)}) AND length({strip(_before)}) >= 20 THEN {strip(_before)} ELSE t END AS t FROM t0
), b0 AS (SELECT conv_id, unnest(string_split_regex(t, '\\n[{WS}]*\\n')) AS b, generate_subscripts(string_split_regex(t, '\\n[{WS}]*\\n'), 1) AS p FROM t1),
b1 AS (SELECT conv_id, p, {_lines} AS l FROM b0),
b2 AS (SELECT conv_id, p, CASE WHEN len(list_filter(l, lambda z: starts_with(z, '•') OR starts_with(z, '-'))) > 0 THEN array_to_string(l, chr(10)) ELSE array_to_string(l, ' ') END AS b FROM b1 WHERE len(l) > 0),
b3 AS (SELECT *, {_head} AS head FROM b2),
b4 AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY p) AS section_no FROM b3)"""
_body = strip("string_agg(b, chr(10) ORDER BY p) FILTER (WHERE NOT head)")
SQL["q09_sections"] = f"""
WITH t0 AS ({_THREADS}), {_BLOCKS}
SELECT conv_id, section_no::INT AS section_no, coalesce(max(CASE WHEN head THEN b END), 'النص') AS title, length({_body}) AS n_chars, md5({_body}) AS text_md5
FROM b4 GROUP BY conv_id, section_no HAVING count(*) FILTER (WHERE NOT head) > 0"""

SQL["q10_noise_filter"] = f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {AR_} ELSE text END
    || CASE conv_id % 3 WHEN 0 THEN ' المصادر ' || coalesce(url, 'www.none') WHEN 1 THEN ' ' || coalesce(url, 'www.none') || ' ' || coalesce(url, 'www.none') ELSE '' END AS t
  FROM conversations LEFT JOIN pages ON page_id = conv_id
), f AS (SELECT *, {has_url("t")} AS has_url, {count("lower(t)", rf"https?://[^{WS}]+")} AS n_urls, {count("t", "[" + chr(92) + "x{600}-" + chr(92) + "x{6FF}]+")} AS n_arabic, contains(t, 'المصادر') AS h FROM t)
SELECT conv_id, turn, has_url, n_urls, n_arabic, (h AND has_url) OR (n_urls >= 2 AND n_arabic < 25) AS noise, h OR has_url AS penalty FROM f"""

SQL["q44_build_chunks"] = f"""
WITH RECURSIVE th AS ({_THREADS}),
t0 AS (SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 'https://a.example/x https://b.example/y.' || chr(10) || chr(10) ELSE '' END || t AS t FROM th), {_BLOCKS},
sec AS (
  SELECT conv_id, section_no, coalesce(max(CASE WHEN head THEN b END), 'النص') AS title, {_body} AS text
  FROM b4 GROUP BY conv_id, section_no HAVING count(*) FILTER (WHERE NOT head) > 0
), src AS (SELECT conv_id, section_no, title, {chunk_sentences("text")} AS l FROM sec),
s AS (SELECT conv_id, section_no, title, len(l) AS m, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM src),
r AS (
  SELECT conv_id, section_no, title, m, 1::BIGINT AS i, s AS now, s AS last, NULL::VARCHAR AS done FROM s WHERE i = 1
  UNION ALL
  SELECT r.conv_id, r.section_no, r.title, r.m, s.i, CASE WHEN length(r.now || ' ' || s.s) > 240 THEN r.last || ' ' || s.s ELSE r.now || ' ' || s.s END, s.s,
         CASE WHEN length(r.now || ' ' || s.s) > 240 THEN r.now END
  FROM r JOIN s ON s.conv_id = r.conv_id AND s.section_no = r.section_no AND s.i = r.i + 1
), e AS (
  SELECT conv_id, section_no, title, i, done AS t FROM r WHERE done IS NOT NULL
  UNION ALL SELECT conv_id, section_no, title, i + 1, now FROM r WHERE i = m
), chunk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY section_no, i) AS chunk_id FROM e),
f AS (SELECT *, {has_url("t")} AS url, {count("lower(t)", rf"https?://[^{WS}]+")} AS n_urls, {count("t", "[" + chr(92) + "x{600}-" + chr(92) + "x{6FF}]+")} AS n_arabic FROM chunk)
SELECT conv_id, chunk_id::INT AS chunk_id, title AS section, length(t) AS n_chars, md5(t) AS text_md5
FROM f WHERE NOT ((contains(t, 'المصادر') AND url) OR (n_urls >= 2 AND n_arabic < 25))"""

SQL["q11_chunk_stats"] = PACK + f"""
SELECT lang, count(*) AS chunks, round(avg(length(text)), 6) AS avg_length, round(avg((doc_id % 3 <> 0)::INT::DOUBLE), 6) AS titled_share,
       round(avg(regexp_matches({strip("text")}, '[.؟!]$')::INT), 6) AS ended_share FROM chunk GROUP BY lang"""

POSTINGS = f"""docs AS (SELECT doc_id AS idx, {terms(TXT)} AS x FROM documents),
post AS (SELECT idx, len(x) AS len, unnest(x) AS term FROM docs),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(x)) AS avg_len FROM docs),
qterms AS (SELECT DISTINCT item_id AS qid, unnest({terms(TXT)}) AS term FROM benchmark)"""


def bm25(name: str, terms_of: str) -> str:
    return f"""{name} AS (
  SELECT qid, idx, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (2.2::DOUBLE / greatest(1e-9, 1.0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (greatest(1, len) / greatest(1e-9, avg_len)))))), 6) AS score
  FROM {terms_of} JOIN post USING (term) JOIN df USING (term), stats GROUP BY qid, idx)"""


SPARSE = POSTINGS + ",\n" + bm25("sparse", "qterms") + """,
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM sparse WHERE score > 0)"""

SQL["q12_term_df"] = f"WITH {POSTINGS} SELECT term, df FROM df"
SQL["q13_bm25_topk"] = f"WITH {SPARSE} SELECT qid, rank, idx, score AS sparse_score FROM hits WHERE rank <= 8"

CENTROIDS = """cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
means AS (SELECT label, p, avg(x) AS x FROM cells GROUP BY label, p),
centroid AS (SELECT label, list(x ORDER BY p) AS v FROM means GROUP BY label)"""
_dot = "round(list_sum(list_transform(list_zip(v, embedding::DOUBLE[]), lambda z: z[1] * z[2])), 6)"
SQL["q14_dense_topk"] = f"""WITH {CENTROIDS}, s AS (SELECT c.label AS qid, vec_id AS idx, {_dot} AS dense_score FROM embeddings e, centroid c)
SELECT qid, idx, dense_rank, dense_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, idx) AS dense_rank FROM s) WHERE dense_rank <= 8"""
SQL["q15_variant_mean"] = f"WITH {CENTROIDS} SELECT label, p - 1 AS pos, round(x, 6) AS x FROM means"

DENSE = CENTROIDS + f""",
bylabel AS (SELECT c.label, vec_id AS idx, {_dot} AS dense_score FROM embeddings e, centroid c),
dense AS (SELECT item_id AS qid, idx, dense_score, row_number() OVER (PARTITION BY item_id ORDER BY dense_score DESC, idx) AS dense_rank
  FROM benchmark JOIN bylabel ON label = item_id % 10)"""
SQL["q16_rrf_fusion"] = f"""WITH {SPARSE}, {DENSE}
SELECT qid, idx, dense_rank, sparse_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 9) AS dense_rrf, round(coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS sparse_rrf
FROM (SELECT qid, idx, dense_rank FROM dense WHERE dense_rank <= 8) FULL JOIN (SELECT qid, idx, rank AS sparse_rank FROM hits WHERE rank <= 8) USING (qid, idx)"""

_intents = [f"CASE WHEN len(list_intersect(tl, {lst([*h, *{x.lower() for x in h} - set(h)])})) > 0 THEN '{n}' END" for n, h in sorted(LEX.intents.items())]


def analysis(source: str, question: str) -> str:
    """CTE bodies a0..info: tokens, distinct tokens, key terms, entities, intents of a question."""
    return f"""a0 AS (SELECT *, {tokens(strip(question))} AS tokens FROM {source}),
a1 AS (SELECT *, list_distinct(tokens) AS td, list_distinct(list_concat(tokens, list_transform(tokens, lambda w: lower(w)))) AS tl FROM a0),
a2 AS (SELECT *, list_sort(list_filter(td, lambda w: length(w) >= 2 AND NOT list_contains({lst(LEX.stopwords)}, w))) AS key_terms,
  list_sort(list_filter(td, lambda w: list_contains({lst(LEX.entities)}, w))) AS entities,
  list_filter([{", ".join(_intents)}, CASE WHEN {strip(question)} = '' THEN 'empty' END], lambda w: w IS NOT NULL) AS i0 FROM a1),
info AS (SELECT *, CASE WHEN len(i0) = 0 THEN ['generic'] ELSE list_sort(i0) END AS intents, starts_with({strip(question)}, {q(LEX.yes_no)}) AS is_yes_no FROM a2)"""


def variants(question: str) -> str:
    more = ", ".join(f"CASE WHEN list_contains(intents, '{n}') THEN {question} || {q(' ' + t)} END" for n, t in LEX.variants.items())
    return f"list_filter([{question}, {more}], lambda w: w IS NOT NULL)"


def normalized(x: str) -> str:
    return f"list_distinct(list_transform({x}, lambda nt: {squash('translate(nt, ' + q('أإآىة' + UPPER) + ', ' + q('ااايه' + LATIN) + ')')}))"


def expanded(question: str) -> str:
    v = f"array_to_string({variants(question)}, ' ')"
    return f"list_distinct(list_concat({normalized('key_terms')}, {terms(v)}))"


def suggested(question: str) -> str:
    has = lambda *n: f"len(list_intersect(intents, {lst(n)})) > 0"
    return f"CASE WHEN {has('list', 'works', 'education')} OR ({has('temporal')} AND {has('location')}) OR len(tokens) >= 7 OR length({question}) - length(replace({question}, 'w', '')) >= 2 THEN 5 WHEN {has('location', 'temporal')} THEN 4 ELSE 3 END"


def intent_score(intents: str, t: str, section: str = "''") -> str:
    has = lambda n: f"list_contains({intents}, '{n}')"
    word = lambda some: f"regexp_matches({t}, {q('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:' + '|'.join(some) + ')(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')})"
    part = lambda some, x=t: f"regexp_matches({x}, {q('|'.join(some))})"
    pt = lambda c, x: f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 0 END"
    return "least(1.0::DOUBLE, " + " + ".join([
        pt(has("temporal") + f" AND regexp_matches({t}, '\\p{{Nd}}{{3,4}}')", 0.35),
        pt(has("location") + " AND " + word(L.LOCATION_WORDS), 0.30),
        pt(has("list") + f" AND (contains({t}, '•') OR contains({t}, ':'))", 0.35),
        pt(has("education") + " AND " + part(L.EDUCATION_PARTS), 0.35),
        pt(has("works") + " AND " + part(L.WORKS_PARTS), 0.35),
        pt(has("identity") + " AND " + word(L.IDENTITY_WORDS), 0.30),
        pt(f"({has('works')} OR {has('education')} OR {has('list')}) AND " + part(L.SECTION_PARTS, section), 0.10),
    ]) + ")"


SQL["q17_hybrid_fused"] = f"""
WITH {POSTINGS}, {DENSE}, {analysis("benchmark", "text")},
ask AS (SELECT item_id AS qid, intents, {expanded("text")} AS qt, {normalized("entities")} AS qe, greatest(1, least({suggested("text")}, n)) AS target, n FROM info, stats),
asked AS (SELECT qid, unnest(qt) AS term FROM ask), {bm25("sparse", "asked")},
sp AS (SELECT qid, idx, score AS sparse_score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS sparse_rank FROM sparse WHERE score > 0),
lim AS (SELECT qid, least(greatest(4 * target, 8), n) AS most FROM ask),
both_ AS (SELECT * FROM (SELECT d.* FROM dense d JOIN lim USING (qid) WHERE dense_rank <= most) FULL JOIN (SELECT s.* FROM sp s JOIN lim USING (qid) WHERE sparse_rank <= most) USING (qid, idx)),
feat AS (
  SELECT b.qid, b.idx, dense_rank, sparse_rank, coalesce(dense_score, 0) AS dense_score, coalesce(sparse_score, 0) AS sparse_score,
    coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS dr, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS sr,
    CASE WHEN len(qt) > 0 THEN {overlap("qt", "x")} / len(qt)::DOUBLE ELSE 0 END AS lexical, CASE WHEN len(qe) > 0 THEN {overlap("qe", "x")} / len(qe)::DOUBLE ELSE 0 END AS entity,
    {intent_score("intents", "d.text")} AS intent, (contains(d.text, 'المصادر') OR {has_url("d.text")})::INT::DOUBLE AS penalty, target
  FROM both_ b JOIN ask USING (qid) JOIN documents d ON d.doc_id = b.idx JOIN docs USING (idx)
), fused AS (SELECT *, round(0.5::DOUBLE * dr + 0.5::DOUBLE * sr + 0.2::DOUBLE * lexical + 0.15::DOUBLE * entity + 0.15::DOUBLE * intent - 0.35::DOUBLE * penalty, 6) AS fused_score FROM feat)
SELECT qid, rank, idx, fused_score, dense_score, sparse_score, dense_rank, sparse_rank, round_even(dr, 6) AS dense_rrf, round_even(sr, 6) AS sparse_rrf,
  round_even(lexical, 4) AS lexical, round_even(entity, 4) AS entity, round_even(intent, 4) AS intent, penalty AS reference_penalty
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, idx) AS rank FROM fused) WHERE rank <= target"""

SQL["q18_lexical_entity"] = f"""
WITH {SPARSE}, {analysis("benchmark", "text")}, ask AS (SELECT item_id AS qid, {terms("text")} AS qt, {normalized("entities")} AS qe FROM info)
SELECT qid, idx, round_even(CASE WHEN len(qt) > 0 THEN {overlap("qt", "x")} / len(qt)::DOUBLE ELSE 0 END, 4) AS lexical,
  round_even(CASE WHEN len(qe) > 0 THEN {overlap("qe", "x")} / len(qe)::DOUBLE ELSE 0 END, 4) AS entity
FROM hits JOIN ask USING (qid) JOIN docs USING (idx) WHERE rank <= 8"""

_names = lst(("identity", "temporal", "location", "list", "education", "works", "verification"))
SQL["q19_intent_score"] = f"""
SELECT doc_id, round({intent_score("i", "t", "sec")}, 6) AS score FROM (
  SELECT doc_id, [{_names}[doc_id % 7 + 1], {_names}[(doc_id + 3) % 7 + 1]] AS i, CASE WHEN doc_id % 2 = 0 THEN 'التعليم' ELSE 'النص' END AS sec,
    replace(replace(replace({AR_}, ' ', '  '), '{ARABIC[0]} ', 'في '), ' {ARABIC[3]}', ' هو ') AS t FROM documents)"""

_users = "(SELECT * FROM conversations WHERE role = 'user')"
SQL["q20_query_analysis"] = f"""
WITH {analysis(_users, "text")}
SELECT conv_id, turn, len(tokens) AS n_tokens, len(key_terms) AS n_key_terms, md5(array_to_string(key_terms, ',')) AS key_terms_md5,
  array_to_string(entities, ',') AS entities, array_to_string(intents, ',') AS intents, is_yes_no FROM info"""
SQL["q21_variants_k"] = f"""
WITH {analysis(_users, "text")}
SELECT conv_id, turn, len({variants("text")}) AS n_variants, len(x) AS n_terms, {suggested("text")} AS k, md5({joined("x")}) AS terms_md5
FROM (SELECT *, {expanded("text")} AS x FROM info)"""

_pairs = ", ".join(f"({q(t)}, {q(a)})" for t, some in ALIASES.items() for a in some)
ALIAS = f"alias AS (SELECT DISTINCT {squash('t')} AS term, {squash('a')} AS alias FROM (VALUES {_pairs}) v(t, a))"
SQL["q22_bridge"] = f"""
WITH {POSTINGS}, {ALIAS}, live AS (SELECT term, list_sort(list(alias)) AS aliases FROM alias WHERE alias IN (SELECT term FROM df) GROUP BY term)
SELECT qid, term, coalesce(array_to_string(aliases, ','), '') AS aliases, aliases IS NOT NULL AS was_bridged FROM qterms LEFT JOIN live USING (term)"""
SQL["q22b_bridge_impact"] = f"""
WITH {POSTINGS}, {ALIAS}, wide AS (SELECT qid, term FROM qterms UNION SELECT qid, alias FROM qterms JOIN alias USING (term)),
{bm25("p", "qterms")}, {bm25("b", "wide")},
x AS (SELECT item_id AS qid, coalesce((SELECT max(score) FROM p WHERE p.qid = item_id), 0) AS before, coalesce((SELECT max(score) FROM b WHERE b.qid = item_id), 0) AS after FROM benchmark)
SELECT qid, before, after, before = 0 AND after > 0 AS improved FROM x"""

SOURCED = SPARSE + """,
src AS (SELECT qid, list('S' || rank ORDER BY rank) AS ids, list(d.text ORDER BY rank) AS texts, any_value(b.text) AS question
  FROM hits JOIN documents d ON d.doc_id = idx JOIN benchmark b ON b.item_id = qid WHERE rank <= 3 GROUP BY qid)"""
_context = "array_to_string(list_transform(list_zip(ids, texts), lambda z: '[' || z[1] || '] ' || z[2]), chr(10) || chr(10))"
SQL["q23_prompt_context"] = f"""
WITH {SOURCED}
SELECT qid, len(ids) AS n_sources, md5({_context}) AS context_md5, md5({q(L.SYSTEM_PROMPT)}) AS system_md5,
  md5({q(L.USER_PROMPT[0])} || {_context} || {q(L.USER_PROMPT[1])} || question || {q(L.USER_PROMPT[2])}) AS user_md5 FROM src"""

SQL["q24_payload_parse"] = """
SELECT conv_id, turn, true AS present, conv_id % 5 <> 3 AS supported, 'answer ' || conv_id AS answer,
  CASE conv_id % 5 WHEN 2 THEN 'S1' WHEN 3 THEN '' WHEN 4 THEN 'S2,S3' ELSE 'S1,S2' END AS sources,
  CASE conv_id % 5 WHEN 0 THEN 'S1=quote ' || turn WHEN 1 THEN 'S1=quote ' || turn WHEN 2 THEN 'S0=quote ' || turn ELSE '' END AS evidence,
  conv_id % 5 = 4 AS recovered
FROM conversations"""

_stop = lst(L.ANSWER_STOPWORDS)
_long = lambda x, stop: f"list_filter(list_distinct({tokens(x)}), lambda w: length(w) >= 3{f' AND NOT list_contains({_stop}, w)' if stop else ''})"
JUDGED = f"""{SOURCED},
pay AS (SELECT *, qid % 6 AS m, CASE WHEN qid % 6 = 1 THEN 'never written anywhere' ELSE trim(substr(texts[1], 1, 60)) END AS quote FROM src),
pay1 AS (SELECT *, CASE m WHEN 3 THEN quote || ' 987654' WHEN 4 THEN 'zzzz yyyy xxxx wwww' ELSE quote END AS ans FROM pay),
ver AS (SELECT *, CASE WHEN m = 5 THEN 'unsupported' WHEN m = 2 THEN 'no_valid_source' WHEN length(quote) < 4 OR NOT contains(texts[1], quote) THEN
      CASE WHEN contains(texts[1], 'abc') AND false THEN 'x' ELSE 'no_valid_quote' END
    WHEN NOT list_has_all({numbers("texts[1]")}, {numbers("ans")}) THEN 'ungrounded_number'
    WHEN ans <> '' AND len({_long("ans", True)}) > 0 AND {overlap(_long("ans", True), _long("quote", False))}::DOUBLE / len({_long("ans", True)}) < 0.5 THEN 'low_overlap' ELSE 'valid' END AS verdict FROM pay1)"""
SQL["q25_validate"] = f"""
WITH {JUDGED}
SELECT qid, verdict, verdict IN ('valid', 'unsupported') AS ok, m <> 5 AS supported, CASE WHEN verdict IN ('unsupported', 'no_valid_source') THEN '' ELSE 'S1' END AS cited,
  CASE WHEN verdict IN ('unsupported', 'no_valid_quote') THEN 0 WHEN verdict = 'no_valid_source' THEN (length(quote) >= 4)::INT ELSE 1 END AS n_quotes FROM ver"""

SUPPORT = f"""{analysis("benchmark", "text")},
sent AS (SELECT qid, key_terms, unnest(ids) AS id, generate_subscripts(ids, 1) AS r, unnest(texts) AS chunk FROM src JOIN info ON item_id = qid),
sent1 AS (SELECT qid, key_terms, id, r, unnest(list_filter({answer_sentences("chunk")}, lambda w: length(w) >= 8)) AS quote, generate_subscripts(list_filter({answer_sentences("chunk")}, lambda w: length(w) >= 8), 1) AS p FROM sent),
sent2 AS (SELECT *, {overlap("key_terms", f"list_distinct({tokens('quote')})")} AS o FROM sent1),
sent3 AS (SELECT *, row_number() OVER (PARTITION BY qid, quote ORDER BY o + CASE WHEN regexp_matches(quote, '\\p{{Nd}}{{3,4}}') THEN 0.4::DOUBLE ELSE 0 END DESC, r, p) AS n, o + CASE WHEN regexp_matches(quote, '\\p{{Nd}}{{3,4}}') THEN 0.4::DOUBLE ELSE 0 END AS sc FROM sent2 WHERE o > 0),
sent4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, r, p) AS k FROM sent3 WHERE n = 1),
sup AS (SELECT qid, list(id ORDER BY k) AS sids, list(quote ORDER BY k) AS quotes FROM sent4 WHERE k <= 3 GROUP BY qid)"""
SQL["q26_support_sentences"] = f"""
WITH {SOURCED}, {SUPPORT}
SELECT src.qid, coalesce(len(quotes), 0) AS n, coalesce(array_to_string(sids, ','), '') AS sources, md5(coalesce(array_to_string(quotes, '|'), '')) AS quotes_md5 FROM src LEFT JOIN sup USING (qid)"""

PARTIAL = f"""{SUPPORT},
part0 AS (SELECT src.qid, coalesce(quotes, []) AS quotes, coalesce(sids, []) AS sids, entities, is_yes_no,
   list_filter({normalized(f"list_filter(key_terms, lambda w: NOT list_contains({_stop}, w))")}, lambda w: NOT list_contains({normalized("entities")}, w)) AS others,
   {terms("array_to_string(coalesce(quotes, []), ' ')")} AS have, {normalized("entities")} AS ent
  FROM src JOIN info ON item_id = src.qid LEFT JOIN sup ON sup.qid = src.qid),
part AS (SELECT *, len(quotes) > 0 AND CASE WHEN len(others) = 0 THEN len(list_intersect(ent, have)) > 0 OR len(have) > 0
     ELSE {overlap("others", "have")}::DOUBLE / len(others) >= CASE WHEN is_yes_no THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END END AS can_answer,
   list_sort(list_filter(others, lambda w: NOT list_contains(have, w))) AS missing, array_to_string(quotes[1:2], ' ') AS core FROM part0),
parts AS (SELECT *, CASE WHEN len(quotes) = 0 THEN {q(L.REFUSAL)} WHEN len(missing) BETWEEN 1 AND 3 THEN core || {q(" " + L.PARTIAL_TEXT)} || array_to_string(missing, '، ') || '.' ELSE core END AS partial FROM part)"""
SQL["q27_partial_answer"] = f"WITH {SOURCED}, {PARTIAL} SELECT qid, can_answer, md5(partial) AS partial_md5 FROM parts"


def clean_answer(x: str) -> str:
    stripped = f"regexp_replace({strip(x)}, {q('^#+[' + WS + ']*')}, '')"
    return strip(rx(stripped, rf"[{WS}]+", " "))


DECIDED = f"""{JUDGED}, {PARTIAL},
dec AS (SELECT v.qid, v.question, v.texts, CASE WHEN verdict = 'valid' THEN 'validated_model_answer' WHEN verdict = 'unsupported' THEN 'model_refusal'
    WHEN can_answer AND partial <> {q(L.REFUSAL)} THEN 'extractive_reconstructed_fallback' ELSE 'safe_refusal' END AS decision, quote, partial, sids, can_answer FROM ver v JOIN parts USING (qid)),
fin AS (SELECT *, CASE decision WHEN 'validated_model_answer' THEN {clean_answer("quote")} || chr(10) || {q(L.SOURCE_PREFIX)} || 'S1'
    WHEN 'extractive_reconstructed_fallback' THEN {clean_answer("partial")} || chr(10) || {q(L.SOURCE_PREFIX)} || array_to_string(list_sort(list_distinct(sids)), ', ')
    ELSE {q(L.REFUSAL)} END AS answer FROM dec)"""
SQL["q28_decisions"] = f"WITH {DECIDED} SELECT qid, decision, length(answer) AS n_chars, md5(answer) AS answer_md5 FROM fin"

_rel = f"CASE WHEN len({evaluation_terms('b.text')}) = 0 THEN 0 ELSE {overlap(evaluation_terms('b.text'), evaluation_terms('d.text'))}::DOUBLE / len({evaluation_terms('b.text')}) END"
SQL["q29_retrieval_metrics"] = f"""
WITH {SPARSE}, h AS (SELECT qid, rank, {_rel} >= 0.2 AS rel, contains(d.text, 'المصادر') OR {has_url("d.text")} AS ref FROM hits JOIN documents d ON d.doc_id = idx JOIN benchmark b ON b.item_id = qid WHERE rank <= 5),
p AS (SELECT item_id AS qid, min(rank) FILTER (WHERE rel) AS first, count(rank) AS n, count(*) FILTER (WHERE rel) AS good, count(*) FILTER (WHERE ref) AS refs FROM benchmark LEFT JOIN h ON qid = item_id GROUP BY item_id)
SELECT count(*) AS questions, {share("count(*) FILTER (WHERE first <= 1)", "count(*)")} AS hit_at_1, {share("count(*) FILTER (WHERE first <= 3)", "count(*)")} AS hit_at_3, {share("count(*) FILTER (WHERE first <= 5)", "count(*)")} AS hit_at_5,
  {share("coalesce(sum(1.0::DOUBLE / first), 0)", "count(*)")} AS mrr, {share("count(first)", "count(*)")} AS recall, {share("sum(good)", "sum(n)")} AS precision,
  {share("sum(refs)", "count(*) * 5")} AS reference_rate, {share("(sum(n) - sum(good))", "count(*) * 5")} AS irrelevant_rate FROM p"""

_ctx = "array_to_string(texts, chr(10) || chr(10))"
RECORDS = f"""{DECIDED},
rec AS (SELECT qid, CASE qid % 3 WHEN 2 THEN 'C' WHEN 1 THEN 'B' ELSE 'A' END AS expected_class, 'cat' || (qid % 4) AS category, decision,
  CASE WHEN trim(answer) = {q(L.REFUSAL)} THEN 'refusal' WHEN contains(answer, {q(L.PARTIAL_MARK)}) THEN 'partial' ELSE 'answered' END AS behavior, qid % 5 <> 0 AS json_valid,
  list_has_all({numbers(_ctx)}, {numbers("answer")}) AS numeric_ok FROM fin)"""


def rate(c: str) -> str:
    return share(f"count(*) FILTER (WHERE {c})", "count(*)")


_ab, _cov, _gr = "expected_class IN ('A', 'B')", "behavior IN ('answered', 'partial')", f"decision IN ({', '.join(map(q, GROUNDED))})"
_meets = f"CASE WHEN expected_class = 'C' THEN behavior = 'refusal' ELSE {_cov} END"
SQL["q30_answer_metrics"] = f"""
WITH {RECORDS}
SELECT count(*) AS questions, {rate("json_valid")} AS structured_output, {rate("decision NOT IN ('validated_model_answer', 'model_refusal')")} AS fallback_rate,
  {rate("behavior = 'refusal'")} AS refusal_rate, {rate("behavior = 'partial'")} AS partial_rate, {rate(_gr)} AS grounded_rate,
  {share("count(*) FILTER (WHERE expected_class = 'C' AND behavior = 'refusal')", "count(*) FILTER (WHERE expected_class = 'C')")} AS refusal_accuracy,
  {share(f"count(*) FILTER (WHERE {_ab} AND {_cov})", f"count(*) FILTER (WHERE {_ab})")} AS coverage, {share(f"count(*) FILTER (WHERE {_gr})", f"count(*) FILTER (WHERE {_ab})")} AS grounded_coverage,
  0.0::DOUBLE AS unsafe_rate, {rate("expected_class = 'C' AND behavior = 'answered'")} AS answered_unanswerable_rate, {rate("numeric_ok")} AS numeric_accuracy, {rate(_meets)} AS expectation_rate FROM rec"""
SQL["q31_by_category"] = f"""
WITH {RECORDS} SELECT category, count(*) AS n, count(*) FILTER (WHERE {_meets}) AS success, count(*) FILTER (WHERE behavior = 'refusal') AS refusal,
  {rate(_meets)} AS success_rate, {rate("behavior = 'refusal'")} AS refusal_rate FROM rec GROUP BY category"""
SQL["q37_histograms"] = f"WITH {RECORDS} SELECT decision, behavior, count(*) AS n FROM rec GROUP BY decision, behavior"

RUNS = """runs AS (SELECT doc_id AS qid, condition, n AS seq, CASE WHEN n % 3 = 0 THEN 'refusal' WHEN quality = 0 THEN 'partial' ELSE 'answered' END AS behavior,
  CASE WHEN toxic = 1 THEN 'C' WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS expected_class, 'cat' || (doc_id % 4) AS category,
  CASE WHEN n % 2 = 0 THEN 'validated_model_answer' ELSE 'safe_refusal' END AS decision, n % 5 <> 0 AS json_valid, n % 7 = 0 AS hallucinated
  FROM (SELECT *, doc_id + ascii(condition) - 65 AS n FROM labels, (VALUES ('A'), ('B'), ('C')) c(condition)))"""
SQL["q32_condition_stats"] = f"""
WITH {RUNS} SELECT condition, count(*) AS runs, count(*) FILTER (WHERE {_ab}) AS answerable, {share(f"count(*) FILTER (WHERE {_ab} AND {_cov})", f"count(*) FILTER (WHERE {_ab})")} AS coverage,
  {rate("behavior = 'answered' AND expected_class = 'C'")} AS unsafe_rate, {share(f"count(*) FILTER (WHERE {_ab} AND behavior = 'refusal')", f"count(*) FILTER (WHERE {_ab})")} AS refusal_rate,
  {rate("json_valid")} AS json_valid_rate, {rate("hallucinated")} AS hallucination_rate FROM runs GROUP BY condition"""
_cell = lambda x: ", ".join([f'nullif(count(*) FILTER (WHERE condition = {q(x)}), 0) AS "{x}_count"', f'CASE WHEN count(*) FILTER (WHERE condition = {q(x)}) > 0 THEN count(*) FILTER (WHERE condition = {q(x)} AND {_cov}) END AS "{x}_answered"', f'round_even(count(*) FILTER (WHERE condition = {q(x)} AND {_cov})::DOUBLE / nullif(count(*) FILTER (WHERE condition = {q(x)}), 0), 4) AS "{x}_coverage"'])
SQL["q32b_category_pivot"] = f"WITH {RUNS} SELECT category, {', '.join(map(_cell, 'ABC'))} FROM runs GROUP BY category"
_pick = lambda x, f: f"arg_min({f}, seq) FILTER (WHERE condition = '{x}') AS \"{x}_{f}\""
SQL["q32c_condition_changes"] = f"""
WITH {RUNS}, w AS (SELECT qid, {", ".join(_pick(x, f) for x in "ABC" for f in ("behavior", "decision"))} FROM runs GROUP BY qid)
SELECT *, "A_behavior" <> "B_behavior" AS a_to_b_change, "B_behavior" <> "C_behavior" AS b_to_c_change,
  CASE WHEN "A_behavior" = 'refusal' AND "C_behavior" <> 'refusal' THEN 'IMPROVED' WHEN "A_behavior" <> 'refusal' AND "C_behavior" = 'refusal' THEN 'REGRESSED' ELSE 'same' END AS change
FROM w WHERE "A_behavior" IS NOT NULL AND "B_behavior" IS NOT NULL AND "C_behavior" IS NOT NULL"""

SQL["q33_oracle_join"] = f"""
WITH m AS (SELECT item_id AS qid, text AS question, CASE WHEN item_id % 5 <> 4 THEN [item_id, item_id * 3 + 1, item_id * 1000] END AS l FROM benchmark),
u AS (SELECT qid, unnest(l) AS want, generate_subscripts(l, 1) AS p FROM m),
e AS (SELECT qid, count(text) AS n_found, string_agg(text, chr(10) || chr(10) ORDER BY p) AS evidence FROM u JOIN documents ON doc_id = want GROUP BY qid),
j AS (SELECT m.qid, coalesce(n_found, 0) AS n_found, l IS NULL AS unanswerable, coalesce(evidence, '') AS evidence, question FROM m LEFT JOIN e USING (qid))
SELECT qid, n_found, unanswerable, md5(evidence) AS evidence_md5, NOT list_has_all({numbers("evidence")}, list_filter({numbers("question")}, lambda w: length(w) >= 3)) AS hallucinated,
  CASE WHEN len({numbers("question")}) > 0 THEN list_has_all({numbers("evidence")}, {numbers("question")}) END AS numeric_correct FROM j"""

_f = FAILURES
SQL["q34_attribution"] = f"""
WITH {DECIDED}, rel AS (SELECT qid, bool_or({_rel} >= 0.2) AS near FROM hits JOIN documents d ON d.doc_id = idx JOIN benchmark b ON b.item_id = qid WHERE rank <= 5 GROUP BY qid),
f AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN CASE WHEN qid % 8 = 0 OR len(entities) = 0 AND len(key_terms) = 0 THEN {q(_f["C"])} ELSE {q(_f["A"])} END
   WHEN NOT near THEN CASE WHEN length(question) - length(replace(question, 'w', '')) >= 20 OR len(key_terms) > 5 THEN {q(_f["H"])} WHEN len(entities) = 0 THEN {q(_f["C"])} WHEN qid % 5 >= 3 THEN {q(_f["E"])} ELSE {q(_f["D"])} END
   WHEN can_answer AND qid % 2 <> 0 THEN {q(_f["J"])} ELSE {q(_f["I"])} END AS primary_failure
  FROM fin JOIN rel USING (qid) JOIN info ON item_id = qid WHERE qid % 3 <> 2 AND answer = {q(L.REFUSAL)})
SELECT primary_failure, count(*) AS n, round_even(100.0::DOUBLE * count(*) / nullif(sum(count(*)) OVER (), 0), 1) AS percent,
  CASE WHEN primary_failure[1] IN ('A', 'C', 'D', 'E', 'H') THEN 'retrieval' WHEN primary_failure[1] = 'I' THEN 'grounding' WHEN primary_failure[1] = 'J' THEN 'generation' ELSE 'other' END AS layer
FROM f GROUP BY primary_failure"""

SQL["q35_evidence_in_corpus"] = f"""
WITH {POSTINGS}, own AS (SELECT item_id AS qid, unnest({terms("CASE WHEN item_id % 4 = 3 THEN 'qqzzxx' || item_id ELSE text END")}) AS term FROM benchmark)
SELECT item_id AS qid, EXISTS (SELECT 1 FROM own JOIN df USING (term) WHERE own.qid = item_id) AS evidence_exists FROM benchmark"""

_c = f"replace(replace(replace({AR_}, '. ', ' ي' || chr(10) || '.'), 'ا ', ' ي '), 'بت', 'الممل')"
# A blank on either side of a lone ya may belong to two of them: blanks are doubled, then halved.
_y = rx("t", r"([\p{L}\p{N}_]) ي\n([^" + WS + "])", r"\1 في \2")
_y = rx(rx(rx(_y, rf"([{WS}])", r"\1\1"), rf"([{WS}])ي([{WS}])", r"\1في\2"), rf"([{WS}])[{WS}]", r"\1")
_y = rx(_y, rf"(?m)^ي[{WS}]", "في ")
for _a, _b in ((r"\n\.", " ."), (r"\n+", " "), ("الممل", "المملكة"), (r" {2,}", " ")):
    _y = rx(_y, _a, _b)
SQL["q36_condition_c_clean"] = f"SELECT doc_id, length(n) AS n_chars, md5(n) AS text_md5 FROM (SELECT doc_id, {strip(_y)} AS n FROM (SELECT doc_id, {_c} AS t FROM documents))"

SQL["q38_extractor_comparison"] = f"""
WITH c AS (SELECT 'a' AS extractor, text AS t FROM documents UNION ALL SELECT 'b', {damaged(TXT)} FROM documents),
o AS (SELECT DISTINCT extractor, unnest(regexp_extract_all(t, {q(SUSPICIOUS)})) AS ch FROM c),
k AS (SELECT extractor, string_agg(ch, '' ORDER BY ch) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY extractor ORDER BY ch) AS n FROM o) WHERE n <= 20 GROUP BY extractor),
s AS (SELECT extractor, sum(length(t))::BIGINT AS length, sum({nonspace("t")})::BIGINT AS nonspace, sum({odd("t", SUSPICIOUS_WITHOUT_BULLET)})::BIGINT AS suspicious, sum({odd("t", SYLLABICS)})::BIGINT AS syllabics, sum({odd("t", "�")})::BIGINT AS replacements FROM c GROUP BY extractor)
SELECT extractor, length, nonspace, suspicious, syllabics, replacements, coalesce(sample, '') AS sample, round(suspicious::DOUBLE / greatest(1, nonspace), 9) AS ratio FROM s LEFT JOIN k USING (extractor)"""

SQL["q39_bridge_stats"] = f"""
WITH {POSTINGS}, {ALIAS} SELECT (SELECT count(DISTINCT term) FROM post) AS vocabulary, (SELECT count(DISTINCT term) FROM alias WHERE alias IN (SELECT term FROM df)) AS active"""

_line = strip(rx("text", f"[{WS}]+", " "))
_body = strip(rx(rx(strip("' ```JSON' || chr(10) || text || chr(10) || '``` '"), r"\A(?i:```(?:json)?)"), r"```\z"))
SQL["q40_text_shapes"] = f"SELECT conv_id, turn, md5(CASE WHEN length({_line}) > 160 THEN left({_line}, 160) || '...' ELSE {_line} END) AS line_md5, md5({_body}) AS body_md5 FROM conversations"

SQL["q41_artifacts"] = f"""
SELECT doc_id, regexp_matches(t, '[\\x{{1400}}-\\x{{167F}}\\x{{18B0}}-\\x{{18FF}}]') AS syllabics, contains(t, '�') AS replacement, contains(t, 'اغ يز ا يصقلبي') AS corrupted_phrase, contains(t, '0491') AS reversed_year
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {damaged(TXT)} WHEN 1 THEN replace(text, 'the', '�') WHEN 2 THEN text || ' 0491' ELSE text END AS t FROM documents)"""

SQL["q42_record_slices"] = "SELECT qid, ordinal::INT AS ordinal FROM (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark) WHERE ordinal >= 5 AND ordinal < 25"

_arabic3 = r"[\x{600}-\x{6FF}]"
SQL["q43_mirrored_lines"] = f"""
SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(replace(CASE WHEN turn % 2 = 0 THEN {AR_} ELSE text END, '. ', chr(10)), chr(10)),
  lambda z: CASE WHEN {count("z", _arabic3)} >= 3 THEN reverse(z) ELSE z END), chr(10))) AS text_md5 FROM conversations"""
