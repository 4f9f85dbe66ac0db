import re

from pyspark.sql import functions as F

from marsad.functions.lexicon import DEFAULT_SECTION
from marsad.operators import chunks as C
from marsad.operators import extract as X
from tests.test_text import samples


def py_heading(s):
    s = s.strip()
    if not s or len(s) > 55:
        return False
    return s.endswith(":") or (not re.search("[.!؟?،]", s) and 1 <= len(re.findall("[؀-ۿA-Za-z0-9]+", s)) <= 8)


def py_sections(text):
    out, title, parts = [], DEFAULT_SECTION, []
    for b in re.split(r"\n\s*\n", text):
        lines = [s.strip() for s in b.splitlines() if s.strip()]
        b = ("\n" if any(s[0] in "•-" for s in lines) else " ").join(lines)
        if not b:
            continue
        if py_heading(b):
            if parts:
                out.append((title, "\n".join(parts).strip()))
            title, parts = b, []
        else:
            parts.append(b)
    if parts:
        out.append((title, "\n".join(parts).strip()))
    return out or ([(DEFAULT_SECTION, text.strip())] if text.strip() else [])


def test_sections_match_a_plain_loop(spark):
    xs = [x.replace("ي", "كلمة طويلة جدا في جملة من كلمات كثيرة جدا هنا ") for x in samples(200, 3)]
    df = spark.createDataFrame(list(enumerate(xs)), "doc_id int, text string")
    got = {}
    for r in C.sections(df, "doc_id").orderBy("doc_id", "section_no").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.text))
    assert {i: s for i, x in enumerate(xs) if (s := py_sections(x))} == got


def py_pack(sentences, size=240):
    out, now = [], []
    for s in sentences:
        if now and len(" ".join([*now, s])) > size:
            out.append(" ".join(now))
            now = [now[-1]]
        now.append(s)
    return out + ([" ".join(now)] if now else [])


def test_packing_seeds_the_next_chunk_with_the_last_sentence(spark):
    cases = [["a" * n for n in ns] for ns in ([100, 100, 100, 50], [300, 10, 10], [], [240], [120, 119, 1, 1], [239, 239])]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s array<string>")
    got = [r.p for r in df.select("i", C.pack_sentences(F.col("s")).alias("p")).orderBy("i").collect()]
    assert got == [py_pack(c) for c in cases]


def test_references_are_cut_and_noise_takes_an_id(spark):
    body = "هذا نص اساسي طويل بما يكفي ليبقى في الوثيقة."
    text = f"{body}\n\nالمصادر\nhttps://a.example/x\nhttps://b.example/y"
    df = spark.createDataFrame([(1, text), (2, "قصير\nالمصادر\nhttps://a.example")], "doc_id int, text string")
    rows = C.build_chunks(df).collect()
    one = " ".join(r.text for r in rows if r.doc_id == 1)
    assert body in one and "https" not in one
    assert not [r for r in rows if r.doc_id == 2]  # too short a body to cut, and noise as it is
    assert all(r.page is None for r in rows)


def test_noise_in_front_leaves_its_id_unused(spark):
    text = "https://a.example/x https://b.example/y.\n\nعنوان اول\n\nهذا نص اساسي طويل بما يكفي."
    rows = C.build_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.chunk_id, r.section) for r in rows] == [(2, "عنوان اول")]


def test_corpus_loader_chooses_repairs_and_cuts(spark):
    good = "هذا نص اساسي طويل بما يكفي ليبقى في الوثيقة."
    rows = [(1, "a", good), (1, "b", good.replace("نص", "ن᐀ص")), (2, "a", None), (2, "b", " "), (3, "b", "أَهلًا  بكم في المكتبة.")]
    got = C.load_corpus(spark.createDataFrame(rows, "doc_id int, extractor string, text string"), source=F.concat("extractor", F.lit(".pdf"))).collect()
    want = {r.doc_id: r.t for r in spark.createDataFrame([(1, good), (3, "أَهلًا بكم في المكتبة.")], "doc_id int, t string").select("doc_id", C.process(F.col("t"))["repaired"].alias("t")).collect()}
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.source_document for r in got} == {1: "a.pdf", 3: "b.pdf"}
    assert all(r.chunk_id == 1 and r.section == DEFAULT_SECTION and r.page is None for r in got)


def test_chunk_stats(spark):
    df = spark.createDataFrame([("a", "عنوان", "نص."), ("a", DEFAULT_SECTION, "نص طويل")], "k string, section string, text string")
    (r,) = C.chunk_stats(df, "k").collect()
    assert (r.chunks, r.avg_length, r.titled_share, r.ended_share) == (2, 5.0, 0.5, 0.5)


def test_better_extraction_wins_and_ties_go_to_the_preferred(spark):
    rows = [(1, "a", "good"), (1, "b", "g᐀od"), (2, "a", "same"), (2, "b", "same"), (3, "a", "long text"), (3, "b", "long"), (4, "a", "x᐀"), (4, "b", "")]
    got = X.select_source(spark.createDataFrame(rows, "doc_id int, extractor string, text string")).collect()
    assert {r.doc_id: r.extractor for r in got} == {1: "a", 2: "b", 3: "a", 4: "b"}


def test_pages_through_an_extractor(spark, tmp_path):
    class Lines:
        name = "lines"

        def __call__(self, content):
            yield from enumerate(content.decode().split("\f"), 1)

    (tmp_path / "a.bin").write_bytes("eins\f\fdrei".encode())
    pages = X.scan_pages(spark, str(tmp_path), Lines())
    assert [r.text for r in X.join_pages(pages, "path").collect()] == ["eins\n\ndrei"]
    assert X.glyph_probe(spark.createDataFrame([("aᦀᦀ",)], "page_text string")).first().n == 2
    (r,) = X.compare_extractors(spark.createDataFrame([("a", "é x�")], "extractor string, text string")).collect()
    assert (r.suspicious, r.replacements, r.sample) == (2, 1, ["é", "�"])
    assert spark.createDataFrame([(["a"],)], "c array<string>").select(X.character_names("c")).first()[0] == ["LATIN SMALL LETTER A"]
    assert spark.createDataFrame([("ابج\nab",)], "t string").select(X.mirrored_lines(F.col("t"))).first()[0] == "جبا\nab"


def test_extractors_are_counted_by_code_point(spark):
    """Counts made an array of all characters counted; a text of some MB took minutes."""
    rows = [("a", "é\u2003x • ᐁ�\U0001F600 أ"), ("a", None), ("a", "é" * 3_000_000), ("b", None), (None, "ñ")]
    got = {r.extractor: r for r in X.compare_extractors(spark.createDataFrame(rows, "extractor string, text string").repartition(3)).collect()}
    r = got["a"]
    assert (r.length, r.nonspace, r.suspicious, r.syllabics, r.replacements, r.sample) == (3_000_011, 3_000_007, 3_000_005, 1, 1, ["é", "ᐁ", "�", "\U0001F600"])
    assert got["b"].length is None and not got["b"].sample
    assert (got[None].suspicious, got[None].sample) == (1, None)
