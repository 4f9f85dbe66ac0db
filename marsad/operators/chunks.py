"""Sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marsad.functions.lexicon import DEFAULT_SECTION, SOURCES_HEADING
from marsad.functions.text import EVALUATION_TOKEN, WS, chunk_sentences, process, strip
from marsad.operators.extract import select_source

BUDGET, HEADING_CHARS, HEADING_WORDS, LEAST_BODY = 240, 55, 8, 20


def strip_references(c: Column) -> Column:
    """Cut at the sources heading if a body of some length stands before it."""
    cut = F.regexp_extract(c, rf"(?s)\A(.*?)(?:\A|\n)[{WS}]*{SOURCES_HEADING}", 1)
    found = c.rlike(rf"(?:\A|\n)[{WS}]*{SOURCES_HEADING}")
    return F.when(found & (F.char_length(strip(cut)) >= LEAST_BODY), strip(cut)).otherwise(c)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")


def normalize_block(c: Column) -> Column:
    """A block with bullets keeps its lines, any other becomes one line."""
    lines = _lines(c)
    bullets = F.exists(lines, lambda x: x.rlike(r"\A[•-]"))
    return F.when(bullets, F.array_join(lines, "\n")).otherwise(F.array_join(lines, " "))


def blocks(c: Column) -> Column:
    """Normalised blocks between empty lines, blank ones dropped."""
    return F.filter(F.transform(F.split(c, rf"\n[{WS}]*\n"), normalize_block), lambda b: b != "")


def is_heading(c: Column) -> Column:
    """C4."""
    s = strip(c)
    words = F.regexp_count(s, F.lit(EVALUATION_TOKEN))
    return (s != "") & (F.char_length(s) <= HEADING_CHARS) & (s.endswith(":") | (~s.rlike(r"[.!؟?،]") & words.between(1, HEADING_WORDS)))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Key, section_no, title, text; a window over one document's blocks numbers the sections."""
    body = strip_references(F.col(text))
    rows = docs.select(key, body.alias("_body")).select(key, "_body", F.posexplode_outer(blocks(F.col("_body"))).alias("_pos", "_block"))
    order = Window.partitionBy(key).orderBy("_pos")
    head = F.coalesce(is_heading(F.col("_block")), F.lit(False))
    rows = rows.withColumn("_head", head).withColumn("section_no", F.sum(head.cast("int")).over(order))
    title = F.max(F.when(F.col("_head"), F.col("_block")))
    parts = F.array_sort(F.collect_list(F.when(~F.col("_head") & F.col("_block").isNotNull(), F.struct("_pos", "_block"))))
    built = rows.groupBy(key, "section_no").agg(F.coalesce(title, F.lit(DEFAULT_SECTION)).alias("title"), parts.alias("_p"), F.first("_body").alias("_body"))
    # A document of headings alone is one section of its whole text.
    bodies = F.sum(F.size("_p")).over(Window.partitionBy(key))
    built = built.withColumn("_n", bodies).filter((F.size("_p") > 0) | ((F.col("_n") == 0) & (F.col("section_no") <= 1) & (strip(F.col("_body")) != "")))
    whole = F.col("_n") == 0
    text_ = F.when(whole, strip(F.col("_body"))).otherwise(strip(F.array_join(F.transform("_p", lambda p: p["_block"]), "\n")))
    out = built.select(key, "section_no", F.when(whole, F.lit(DEFAULT_SECTION)).otherwise(F.col("title")).alias("title"), text_.alias("text"), whole.alias("_whole"))
    first = Window.partitionBy(key).orderBy("section_no")
    return out.withColumn("_r", F.row_number().over(first)).filter(~F.col("_whole") | (F.col("_r") == 1)).drop("_whole", "_r")


def pack_sentences(sentences: Column, budget: int = BUDGET) -> Column:
    """Greedy packing; a full chunk's last sentence also begins the next one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit("").alias("last"))

    def step(s: Column, x: Column) -> Column:
        longer = F.concat(s["now"], F.lit(" "), x)
        return (
            F.when(s["now"] == "", F.struct(s["out"].alias("out"), x.alias("now"), x.alias("last")))
            .when(F.char_length(longer) > budget, F.struct(F.array_append(s["out"], s["now"]).alias("out"), F.concat(s["last"], F.lit(" "), x).alias("now"), x.alias("last")))
            .otherwise(F.struct(s["out"].alias("out"), longer.alias("now"), x.alias("last")))
        )

    return F.aggregate(sentences, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.array_append(s["out"], s["now"])))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """C6 and C8 without sections: key, chunk_id (from 1), text; row by row, no shuffle."""
    packed = pack_sentences(chunk_sentences(F.col(text)))
    return docs.select(key, *more, F.posexplode(packed).alias("_p", "chunk")).select(key, *more, (F.col("_p") + 1).alias("chunk_id"), F.col("chunk").alias("text"))


def has_url(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("http://") | low.contains("https://") | low.contains("www.")


def url_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(rf"https?://[^{WS}]+"))


def arabic_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{600}-\x{6FF}]+"))


def is_reference_noise(c: Column) -> Column:
    """C7."""
    return (c.contains(SOURCES_HEADING) & has_url(c)) | ((url_count(c) >= 2) & (arabic_count(c) < 25))


def reference_penalty(c: Column) -> Column:
    """H8."""
    return c.contains(SOURCES_HEADING) | has_url(c)


def build_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: Column | None = None) -> DataFrame:
    """Key, chunk_id, section, page, source_document, text; noise takes an id but no row."""
    rows = sections(docs.select(key, text), key, text)
    rows = rows.select(key, "section_no", "title", F.posexplode(pack_sentences(chunk_sentences(F.col("text")))).alias("_p", "chunk"))
    order = Window.partitionBy(key).orderBy("section_no", "_p")
    rows = rows.withColumn("chunk_id", F.row_number().over(order)).filter(~is_reference_noise(F.col("chunk")))
    return rows.select(key, "chunk_id", F.col("title").alias("section"), F.lit(None).cast("int").alias("page"), (source if source is not None else F.lit("")).alias("source_document"), F.col("chunk").alias("text"))


def load_corpus(candidates: DataFrame, key: str = "doc_id", source: Column | None = None) -> DataFrame:
    """Chunks of (key, extractor, text): the better text of each key (S3), repaired (N7), cut.

    A key whose text is null or blank has no chunk. ``source`` may name ``key``, ``extractor`` and ``text``."""
    docs = select_source(candidates, key).withColumn("text", process(F.col("text"))["repaired"])
    # The source goes along inside the key, so the texts are chosen and repaired once and nothing is joined back.
    docs = docs.select(F.struct(key, (source if source is not None else F.lit("")).alias("source_document")).alias("_k"), "text")
    return build_chunks(docs, "_k").select(f"_k.{key}", "chunk_id", "section", "page", "_k.source_document", "text")


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """C10."""
    share = lambda c: F.avg(c.cast("double"))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.avg(F.char_length("text")).alias("avg_length"),
        share(F.col("section") != DEFAULT_SECTION).alias("titled_share"),
        share(strip(F.col("text")).rlike(r"[.؟!]\z")).alias("ended_share"),
    )
