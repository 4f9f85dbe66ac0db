"""Page extraction, choice between extractors, and their comparison."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marsad.functions.text import SUSPICIOUS_WITHOUT_BULLET, SYLLABICS, WS, clean_extracted, quality
from marsad.sources.reports import saved


class PageExtractor(Protocol):
    """bytes of one file -> (page_no, text), in order."""

    name: str

    def __call__(self, content: bytes) -> Iterator[tuple[int, str]]: ...


def scan_pages(spark: SparkSession, path: str, extractor: PageExtractor) -> DataFrame:
    """Path, extractor, page_no, page_text of every file; decoding stays behind the protocol."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                pages = list(extractor(content))
                yield pd.DataFrame({"path": p, "extractor": extractor.name, "page_no": [n for n, _ in pages], "page_text": [t for _, t in pages]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, extractor string, page_no int, page_text string")


def join_pages(pages: DataFrame, *key: str) -> DataFrame:
    """Texts of non-empty pages in order, an empty line between them."""
    some = F.array_sort(F.collect_list(F.when(F.coalesce("page_text", F.lit("")) != "", F.struct("page_no", "page_text"))))
    return pages.groupBy(*key).agg(F.array_join(F.transform(some, lambda p: p["page_text"]), "\n\n").alias("text"))


def select_source(candidates: DataFrame, key: str = "doc_id", preferred: str = "b", clean: bool = True) -> DataFrame:
    """S3: of (key, extractor, text) the text with the best quality; ties go to ``preferred``."""
    rows = candidates.withColumn("text", clean_extracted(F.col("text"))) if clean else candidates
    rows = rows.withColumn("quality", quality(F.col("text")))
    order = F.struct(F.col("quality"), (F.col("extractor") == preferred).cast("int"))
    return rows.groupBy(key).agg(F.max_by(F.struct("extractor", "text", "quality"), order).alias("s")).select(key, "s.*")


def mirrored_lines(c: Column) -> Column:
    """Lines with three Arabic characters or more reversed, as the older extraction needed."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(F.regexp_count(x, F.lit(r"[\x{600}-\x{6FF}]")) >= 3, F.reverse(x)).otherwise(x)), "\n")


@F.pandas_udf(ArrayType(StringType()))
def character_names(chars: pd.Series) -> pd.Series:
    return chars.map(lambda some: [unicodedata.name(c, "UNKNOWN") for c in some] if some is not None else None)


@cache
def kinds() -> np.ndarray:
    """For every code point: 0 usual, 1 white space, 2 bullet, 3 syllabics, 4 replacement character, 5 any other suspicious one."""
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000])
    every = "".join(map(chr, points.tolist()))
    out = np.zeros(0x110000, np.uint8)
    for kind, chars in ((5, SUSPICIOUS_WITHOUT_BULLET), (2, "\u2022"), (3, SYLLABICS), (4, "\ufffd"), (1, f"[{WS}]")):
        found = re.finditer(re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08x}", chars), every)
        out[points[[m.start() for m in found]]] = kind
    return out


def count_characters(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(extractor, text) -> one row per extractor and task: sums over its texts (null if it has none), distinct suspicious characters."""
    counts: dict[str | None, np.ndarray | None] = {}
    seen: dict[str | None, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part, texts = batch.slice(at, rows), {}
            for name, text in zip(part.column("extractor").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                counts.setdefault(name, None)
                if text is not None:
                    texts.setdefault(name, []).append(text.decode("utf-8", "replace"))
            for name, some in texts.items():
                whole = "".join(some)
                if counts[name] is None:
                    counts[name], seen[name] = np.zeros(6, np.int64), np.zeros(0x110000, bool)
                for i in range(0, len(whole), chars):
                    points = np.frombuffer(whole[i : i + chars].encode("utf-32-le"), "<u4")
                    kind = kinds()[points]
                    counts[name] += np.bincount(kind, minlength=6)
                    seen[name][points[kind > 2]] = True
    for name, n in counts.items():
        odd = list(map(chr, np.flatnonzero(seen[name]).tolist())) if n is not None else []
        sums = [None] * 5 if n is None else [n.sum(), n.sum() - n[1], n[2:].sum(), n[3], n[4]]
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *[pa.array([x], pa.int64()) for x in sums], pa.array([odd], pa.list_(pa.string()))], ["extractor", *COUNTED, "odd"])


COUNTED = ("length", "nonspace", "suspicious", "syllabics", "replacements")


def compare_extractors(candidates: DataFrame, first: int = 20) -> DataFrame:
    """Metrics of every extractor over all its texts; ``first`` smallest suspicious characters."""
    per = candidates.select("extractor", "text").mapInArrow(count_characters, "extractor string, " + ", ".join(f"{c} long" for c in COUNTED) + ", odd array<string>")
    per = saved(per, "extracted")  # a row per extractor and task, read twice
    total = per.groupBy("extractor").agg(*[F.sum(c).alias(c) for c in COUNTED])
    odd = per.select("extractor", F.explode("odd").alias("char")).distinct()
    few = odd.withColumn("r", F.row_number().over(Window.partitionBy("extractor").orderBy("char"))).filter(F.col("r") <= first)
    sample = few.groupBy("extractor").agg(F.array_sort(F.collect_list("char")).alias("sample"))
    return total.join(sample, "extractor", "left").withColumn("ratio", F.col("suspicious") / F.greatest(F.lit(1), F.col("nonspace")))


def glyph_probe(pages: DataFrame, low: int = 0x1980, high: int = 0x19FF) -> DataFrame:
    """Characters of one block with their counts."""
    chars = pages.select(F.explode(F.regexp_extract_all("page_text", F.lit(rf"[\x{{{low:X}}}-\x{{{high:X}}}]"), F.lit(0))).alias("char"))
    return chars.groupBy("char").agg(F.count("*").alias("n"))
