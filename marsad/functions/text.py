"""Cleaning, normalising and splitting text as column expressions.

Classes are written out where engines differ over them: \\d and \\s are ASCII in Java's regexes, \\w
has no Arabic marks, and trim only strips spaces.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it.
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ALLOWED = r"\x{20}-\x{7E}\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{200C}-\x{200F}"
SUSPICIOUS = rf"[^{WS}{ALLOWED}\x{{2022}}]"
SUSPICIOUS_WITHOUT_BULLET = rf"[^{WS}{ALLOWED}]"
SYLLABICS = r"[\x{1400}-\x{167F}\x{18B0}-\x{18FF}]"
MARKS = r"[\x{64B}-\x{652}\x{670}\x{640}]"
TOKEN = r"[\x{621}-\x{64A}A-Za-z0-9]+"
EVALUATION_TOKEN = r"[\x{600}-\x{6FF}A-Za-z0-9]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = r"\p{Nd}+"
WORD_BEFORE, WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def sub(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """No built-in function has this form."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_extracted(c: Column) -> Column:
    """NFKC, no replacement characters, single blanks, at most one empty line."""
    return strip(sub(F.replace(nfkc(c), F.lit("�"), F.lit("")), (r"[ \t]+", " "), (rf"\n[{WS}]*\n+", "\n\n")))


def nonspace(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{WS}]")).cast("long")


def suspicious(c: Column, bullet: bool = True) -> Column:
    """Characters outside the expected blocks."""
    return F.regexp_count(c, F.lit(SUSPICIOUS if bullet else SUSPICIOUS_WITHOUT_BULLET)).cast("long")


def syllabics(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SYLLABICS)).cast("long")


def quality(c: Column) -> Column:
    """A struct that compares as candidates do; an empty text has zeros."""
    n, s = nonspace(c), suspicious(c)
    ratio = F.when(n == 0, F.lit(0.0)).otherwise(-(s.cast("double") / n))
    return F.struct(ratio.alias("neg_ratio"), n.alias("nonspace"), (-s).alias("neg_count"))


def normalize_arabic(c: Column) -> Column:
    """Bare alef, ya for alef-maqsura, no tatweel, LF, single blanks, at most one empty line."""
    c = F.translate(c, "إأآىـ", "اااي")
    return strip(sub(c, (r"\r\n", "\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))


def repair_fragments(c: Column) -> Column:
    """One or two Arabic letters alone on a line join the lines around them.

    Fold over lines with the output, the repairs and whether the line was consumed already.
    """
    lines = F.transform(F.split(c, "\n"), strip)
    pairs = F.zip_with(lines, F.concat(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("line"), b.alias("following")))
    repair = "struct<reason:string,confidence:string,left:string,right:string,merged:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast(f"array<{repair}>").alias("repairs"), F.lit(False).alias("skip"))

    def step(s: Column, x: Column) -> Column:
        short = x["line"].rlike(r"\A[\x{621}-\x{64A}]{1,2}\z") & (F.coalesce(x["following"], F.lit("")) != "")
        last = F.when(F.size(s["out"]) > 0, F.element_at(s["out"], -1)).otherwise(F.lit(""))
        left = F.regexp_replace(last, rf"[{WS}]+\z", "")
        joins = strip(last) != ""
        right = F.concat(x["line"], F.lit(" "), x["following"])
        merged = F.when(joins, F.concat(left, F.lit(" "), right)).otherwise(right)
        note = F.struct(F.lit("short_fragment_wrap").alias("reason"), F.lit("high").alias("confidence"), F.when(joins, left).otherwise(F.lit("")).alias("left"), right.alias("right"), merged.alias("merged"))
        head = F.when(joins, F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))).otherwise(s["out"])
        return (
            F.when(s["skip"], F.struct(s["out"].alias("out"), s["repairs"].alias("repairs"), F.lit(False).alias("skip")))
            .when(short, F.struct(F.array_append(head, merged).alias("out"), F.array_append(s["repairs"], note).alias("repairs"), F.lit(True).alias("skip")))
            .otherwise(F.struct(F.array_append(s["out"], x["line"]).alias("out"), s["repairs"].alias("repairs"), F.lit(False).alias("skip")))
        )

    return F.aggregate(pairs, start, step, lambda s: F.struct(F.array_join(s["out"], "\n").alias("repaired"), F.size(s["repairs"]).alias("repair_count"), s["repairs"].alias("repairs")))


def process(c: Column) -> Column:
    """All stages of cleaning with diagnostics."""
    n = normalize_arabic(c)
    r = repair_fragments(n)
    return F.struct(c.alias("original"), n.alias("normalized"), r["repaired"].alias("repaired"), r["repair_count"].alias("repair_count"), r["repairs"].alias("repairs"))


def clean_condition_c(c: Column) -> Column:
    """Seven ordered rewrites of line-break damage."""
    w = r"[\p{L}\p{N}_]"
    return strip(
        sub(
            c,
            (rf"({w}) ي\n([^{WS}])", "$1 في $2"),
            (rf"(?<=[{WS}])ي(?=[{WS}])", "في"),
            (rf"(?m)(?<![^\n])ي[{WS}]", "في "),
            (r"\n\.", " ."),
            (r"\n+", " "),
            ("الممل", "المملكة"),
            (r" {2,}", " "),
        )
    )


def artifacts(c: Column) -> Column:
    """Four signs of a damaged extraction."""
    return F.struct(
        c.rlike(r"[\x{1400}-\x{167F}\x{18B0}-\x{18FF}]").alias("syllabics"),
        c.contains("�").alias("replacement"),
        c.contains("اغ يز ا يصقلبي").alias("corrupted_phrase"),
        c.contains("0491").alias("reversed_year"),
    )


def one_line(c: Column, limit: int = 160) -> Column:
    """N11."""
    s = strip(F.regexp_replace(c, rf"[{WS}]+", " "))
    return F.when(F.char_length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit("..."))).otherwise(s)


def clean_answer(c: Column) -> Column:
    """N10."""
    return strip(sub(strip(c), (rf"\A#+[{WS}]*", ""), (rf"[{WS}]+", " ")))


def strip_fences(c: Column) -> Column:
    """N12."""
    return strip(sub(strip(c), (r"\A(?i:```(?:json)?)", ""), (r"```\z", "")))


def tokens(c: Column) -> Column:
    """Tokens in order, repeats kept."""
    return F.regexp_extract_all(F.regexp_replace(c, MARKS, ""), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    """T1."""
    return F.array_distinct(tokens(c))


def normalize_token(c: Column) -> Column:
    """Lower case, folded letters, each run of one character once."""
    c = F.regexp_replace(F.lower(strip(c)), r"[^\x{621}-\x{64A}a-z0-9]", "")
    c = F.regexp_replace(F.translate(c, "أإآىة", "ااايه"), MARKS, "")
    return F.regexp_replace(c, r"(.)\1+", "$1")


def normalize_terms(terms: Column) -> Column:
    """T4."""
    return F.array_distinct(F.transform(F.filter(terms, lambda t: strip(t) != ""), normalize_token))


def terms(c: Column) -> Column:
    """Normalised term set of a text. The text is folded as a whole, which is much cheaper than
    token by token and the same, as tokens hold none of the characters between them."""
    c = F.translate(F.regexp_replace(c, MARKS, ""), "أإآىة" + UPPER, "ااايه" + UPPER.lower())
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"([\x{621}-\x{64A}a-z0-9])\1+", "$1"), F.lit(r"[\x{621}-\x{64A}a-z0-9]+"), F.lit(0)))


def evaluation_terms(c: Column) -> Column:
    """T5."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(EVALUATION_TOKEN), F.lit(0)))


def numbers(c: Column) -> Column:
    """T6."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(DIGITS), F.lit(0)))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != "")


def chunk_sentences(c: Column) -> Column:
    """After . ! ? and the Arabic question mark, before bullets, at empty lines."""
    parts = _parts(F.replace(c, F.lit("\n•"), F.lit("\n• ")), rf"(?<=[.!؟?])[{WS}]+|\n(?=•)|\n{{2,}}")
    whole = strip(c)
    return F.when(F.size(parts) > 0, parts).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def answer_sentences(c: Column) -> Column:
    """T8."""
    return _parts(c, rf"(?<=[.!?؟\n])[{WS}]+")
