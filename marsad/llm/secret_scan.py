"""Secret scans with corpus-wide ownership frequency. Spark functions only.

Findings of three base kinds come from fixed patterns. A fourth, broader kind (long credential-like
runs) is only believed when its hash belongs to few owners and few repositories: strings that
``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories share are copied examples, the others look
live. Hashes are counted over the whole corpus by distinct owner and distinct repository.

Offsets: Spark has no position-returning regex function, so a text is split by the pattern; the
lengths of pieces and matches, summed in order by a window over one text's findings, give code
point offsets. Texts are scanned once; only findings (hashes and lengths, no secret) leave that pass, to the
shared folder, from where both spans and ownership are taken.

Defined cases: null text is the empty text; null ids are kept and carried; repeated rows each get
the same findings; null owner or repository counts as one owner or repository of its own; ties in start go
by kind; very long texts are scanned whole, as one row (their pieces become lengths before they are taken
apart); empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marsad.llm.common import materialise, table

KINDS = ("assign", "access", "hex", "live")
PATTERNS = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]{16,}",
    r"[0-9a-f]{24,}",
    r"[A-Za-z0-9+/_=-]{20,}",
)
#: Cheaper tests that a text with a match always passes: a run of 20 with a digit in it, and an
#: assigned value of six.
BROAD_TEST = r"[0-9][A-Za-z0-9+/_=-]*+(?<=[A-Za-z0-9+/_=-]{20})"
ASSIGN_TEST = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
MIN_ASSIGNED = 6
#: A broad run counts only with as many digits and letters.
MIN_DIGITS, MIN_LETTERS = 4, 4
#: From so many owners on, a string is a copied example.
EXAMPLE_OWNERS = 3
#: So many repositories of fewer owners make one, too.
EXAMPLE_REPOS = 6
SALTS = 16


def _found(docs: DataFrame, text: Column, owner: Column, repo: Column) -> DataFrame:
    """One row per match: doc_id, h, owner, repo, kind, n, gap, len, vh (hash of the value), good."""
    d = docs.select("doc_id", text.alias("t"), owner.alias("owner"), repo.alias("repo"))
    tests = [F.col("t").rlike(p) for p in PATTERNS[1:3]] + [F.col("t").rlike(BROAD_TEST), F.col("t").rlike(ASSIGN_TEST) & F.col("t").rlike(PATTERNS[0])]
    d = d.filter(reduce(Column.__or__, tests))
    count = lambda v, others: F.char_length(F.regexp_replace(v, others, ""))
    judged = (lambda v: F.char_length(v) >= MIN_ASSIGNED, lambda v: F.lit(True), lambda v: F.lit(True), lambda v: (count(v, "[^0-9]") >= MIN_DIGITS) & (count(v, "[^A-Za-z]") >= MIN_LETTERS))
    value = lambda good: lambda v: F.struct(F.xxhash64(v).alias("vh"), good(v).alias("good"))
    kinds = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.arrays_zip(
                    F.transform(F.split("t", p, -1), F.char_length).alias("gap"),
                    F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.char_length).alias("len"),
                    F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(2 if k == 0 else 0)), value(judged[k])).alias("value"),
                ).alias("m"),
            )
            for k, p in enumerate(PATTERNS)
        ]
    )
    d = d.select("doc_id", F.xxhash64("t").alias("h"), "owner", "repo", F.explode(kinds).alias("k"))
    d = d.select("doc_id", "h", "owner", "repo", "k.kind", F.posexplode("k.m").alias("n", "m"))
    return d.filter(F.col("m.len").isNotNull()).select("doc_id", "h", "owner", "repo", "kind", "n", "m.gap", "m.len", "m.value.vh", "m.value.good")


def findings(docs: DataFrame, text: str = "text", owner: str = "source", repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Spans of all kinds: doc_id, h (hash of the text), kind, start, end, owners, repos, live."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = _found(docs, t, F.coalesce(F.col(owner).cast("string"), F.lit("\0")), F.coalesce(repo if repo is not None else F.col(owner), F.lit("\0")))
    rows = materialise(rows, "findings")
    one = rows.groupBy("doc_id", "h", "kind", "n").agg(*[F.first(x).alias(x) for x in ("gap", "len", "vh", "good")])
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("n")
    spans = one.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    spans = spans.filter("good")
    base = F.col("kind") < 3
    up = Window.partitionBy("doc_id", "h").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("after", F.min(F.when(base, F.col("start"))).over(down))
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    spans = spans.filter(base | clear).select("doc_id", "h", "kind", "start", "end", "vh")

    # Ownership: distinct (hash, owner, repository) first, so that a hash copied a million times
    # reaches the counting task as one row per owner and repository.
    held = rows.select("vh", "owner", "repo").distinct()
    owned = held.groupBy("vh").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    owned = owned.select("vh", "owners", "repos", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spans = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")).join(owned, ["vh", "salt"]).drop("salt", "vh")
    spans = spans.withColumn("live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos))
    return spans.filter((F.col("kind") < 3) | F.col("live"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, n_* per kind, base (array), spans (array), n_live, n_example."""
    found = findings(docs, text, owner, repo, example_owners, example_repos)
    n = lambda c: F.count(F.when(c, 1))
    per = found.groupBy("doc_id", "h").agg(
        *[n(F.col("kind") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        n(F.col("live")).alias("n_owner_specific"),
        n(~F.col("live")).alias("n_copied"),
        F.max("repos").alias("max_repos"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
    )
    mine = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"))
    per = per.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    out = mine.join(per, mine.doc_id.eqNullSafe(per._id) & (mine.h == per._h), "left").drop("_id", "_h")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in [*(f"n_{k}" for k in KINDS), "n_owner_specific", "n_copied", "max_repos"]}
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return out.withColumns(counts | {"spans": F.coalesce(F.col("spans").cast("array<struct<start:bigint,kind:int,end:bigint>>"), empty)})


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span (overlaps merged) replaced by ``mark``; n_chars follows."""
    found = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_s")).dropDuplicates(["_id", "_h"])
    t = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(found, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(t) == F.col("_h")), "left")
    cut = F.aggregate(
        "_s",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"))),
    )
    out = joined.withColumn("text", F.when(F.col("_s").isNotNull(), cut).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("_s").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``; owner: source, repository: source and language."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    out = scan(docs, repo=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "n_live", "n_owner_specific", "n_copied", "max_repos"
    )
