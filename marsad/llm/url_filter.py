"""URL filtering: host/path rules, then a blocked Bloom filter before an exact join. Spark functions only.

The list is a table of canonical URLs. Its Bloom filter has 512-bit blocks, ``BITS_EACH`` bits for each
listed URL, up to ``MOST_BLOCKS`` blocks: what is broadcast is at most that many rows of eight longs (32 MB),
whatever the list; a list beyond some 20 million URLs passes more false hits and never gives a wrong
answer. Possible hits alone are shuffled, to a hash join on the exact canonical URL that removes the
false ones; that join is salted, as one URL may be on very many pages.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule, is in no
list and is allowed; of rules that fit the longest (host and path together) wins, and of equally long
ones the later in the list; repeated rows are judged each; very long URLs are judged whole; other columns, whatever
their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.llm.common import materialise, table

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BITS_EACH, LEAST_BLOCKS, MOST_BLOCKS, SALTS = 12, 64, 1 << 19, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change the page.
NOISE = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and query of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without ``www.`` and default port, path without final slash, query without noise."""
    h = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    p = F.regexp_replace(path, r"/+$", "")
    q = F.regexp_replace(F.regexp_replace(query, NOISE, ""), "^&", "")
    return F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    """Block number, then a bit for each of its eight words."""
    a, b = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))
    return [F.pmod(a, F.lit(blocks)).cast("int"), *[F.shiftrightunsigned(b, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]]


def blocks_for(listed: DataFrame) -> int:
    """Blocks of the filter by the length of the list, within bounds."""
    n = listed.count()
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (BITS_EACH * n // 512).bit_length()))


def bloom(listed: DataFrame, col: str, blocks: int) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows; partial aggregation makes it one small shuffle."""
    block, *bits = _bits(F.col(col), blocks)
    rows = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, maybe (the Bloom filter's word) and listed.

    ``listed``: one column canon, any number of copies. A listed page is blocked unless a rule fits.
    """
    blocks = blocks or blocks_for(listed)
    rows = pages.select("page_id", *[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path", "query"), strict=True)])
    rows = rows.withColumn("canon", canonical(F.col("host"), F.col("path"), F.col("query"))).drop("query")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    block, *bits = _bits(F.col("canon"), blocks)
    rows = rows.withColumn("block", block).withColumns({f"b{i}": b for i, b in enumerate(bits)})
    rows = rows.join(F.broadcast(bloom(listed, "canon", blocks)), "block", "left")
    hit = F.col("rule").isNull() & (F.col("host") != "")
    for i in range(8):
        hit = hit & (F.expr(f"bit_get(w{i}, b{i})") == 1)
    rows = rows.select("page_id", "host", "path", "rule", "said", "canon", F.coalesce(hit, F.lit(False)).alias("maybe"))
    out = [*(F.col(c) for c in ("page_id", "host", "path", "rule")), F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("maybe"), F.col("listed")]
    sure = rows.filter(~F.col("maybe")).withColumn("listed", F.lit(False)).select(*out)
    exact = listed.select(F.col("canon").alias("c")).distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    perhaps = rows.filter("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    perhaps = perhaps.join(exact, (F.col("canon") == F.col("c")) & (F.col("salt") == F.col("s")), "left")
    return sure.unionByName(perhaps.withColumn("listed", F.col("c").isNotNull()).select(*out))


def listed_urls(pages: DataFrame, under: str = "ads-track.example.com") -> DataFrame:
    """The query's list, as the tables hold none: canonical URLs of all pages on advertising hosts, and of
    all that were linked with a campaign's parameter (whoever links to them without it, too)."""
    host, path, query = parts(F.col("url"))
    chosen = (host == under) | host.endswith(f".{under}") | query.rlike("(^|&)utm_")
    return pages.filter(chosen).select(canonical(host, path, query).alias("canon")).distinct()


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, materialise(listed_urls(pages), "listed")).drop("maybe")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM cut
), canon AS (
  SELECT page_id, host, path, query,
         regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canon
  FROM (SELECT *, regexp_replace(regexp_replace(query, '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q FROM part)
), listed AS (
  SELECT DISTINCT canon AS c FROM canon WHERE host = 'ads-track.example.com' OR ends_with(host, '.ads-track.example.com')
     OR regexp_matches(query, '(^|&)utm_')
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM canon
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host <> '' AND c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND host <> '' AND c IS NOT NULL AS listed
FROM ruled LEFT JOIN listed ON canon = c
"""
