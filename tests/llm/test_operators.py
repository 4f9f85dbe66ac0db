import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marsad.llm import ann_forest, bpe, catalog, packing, quality_forest, repeats, retrieval, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter
from tests.llm.conftest import PASSAGE, ROWS

SMALL = "/root/testdata/sf0.001"
TEXTS = [(i, t or "") for i, t in ROWS]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0


# --- 1 secrets


def py_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def secret_rows(spark, texts):
    df = spark.createDataFrame([(i, t, s, "en") for i, t, s in texts], "doc_id long, text string, source string, lang string")
    return secret_scan.scan(df).orderBy("doc_id").collect()


def test_secrets_match_brute_force(spark, corpus):
    got = catalog.QUERIES["op1_secret_scan"](spark, corpus).collect()
    assert len(got) == len(ROWS)
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abc", "abcdefg", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "中", "\n", "+/_.=-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    for r, t in zip(secret_rows(spark, [(i, t, f"s{i}") for i, t in enumerate(texts)]), texts, strict=True):
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]
        assert base == py_base(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
    one = {r.doc_id: r for r in got}[11]
    names = secret_scan.KINDS
    text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in py_base(dict(TEXTS)[11]))
    assert one.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and one.spans == text


def test_owner_specific_strings_are_added_and_copied_ones_are_not(spark):
    mine, shared = "Zx81-QwErTy_7731-PoIuZ", "DeMo-KeY_0000-ExAmPlE1234"
    texts = [(1, f"see {mine} here", "a"), (2, f"see {shared} here", "a"), (3, f"see {shared}", "b"), (4, f"see {shared}", "c"), (5, f"secret={mine}", "a")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secret_rows(spark, texts)}
    assert got == {1: [(4, 4 + len(mine))], 2: [], 3: [], 4: [], 5: []}


def test_repositories_decide_too(spark):
    wide, narrow = "Zx81-QwErTy_7731-PoIuZ", "Ab12-QwErTy_7731-PoIuZ"
    texts = [(i, f"see {wide} here", "one", f"repo{i}") for i in range(6)] + [(10 + i, f"see {narrow} here", "one", f"repo{i}") for i in range(5)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: (r.n_live, r.max_repos) for r in secret_scan.scan(df, repo=F.col("repo")).collect()}
    assert got == {i: (0, 0) for i in range(6)} | {10 + i: (1, 5) for i in range(5)}


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([(1, 'x token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" y', "s", 5), (2, None, "s", 0), (3, "clean", "s", 5)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(df, secret_scan.scan(df)).collect()}
    assert got == {1: ('x [secret]" y', 13), 2: (None, 0), 3: ("clean", 5)}


# --- 2 urls


def test_urls(spark, tmp_path):
    urls = [
        ("http://A.Example.ORG/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12?q#f", "example.org/en/1", "block"),
        ("https://example.org/fr/", "org/", "allow"),
        ("http://example.org", None, "allow"),
        ("http://shop.com/de/a", "com/de/", "block"),
        ("http://shopcom/de/a", None, "allow"),
        ("http://x.ads-track.example.com/en/7?utm_source=a", None, "block"),
        ("http://www.x.ads-track.example.com:80/en/7/#top", None, "block"),
        ("http://x.ads-track.example.com/fr/7", "com/fr/", "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
    ]
    spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in catalog.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: (r, v) for i, (_, r, v) in enumerate(urls)}


def test_a_crowded_bloom_filter_is_never_wrong(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.net/p",) for i in range(0, 400, 3)] * 2, "canon string")
    got = url_filter.judge(pages, listed, blocks=4).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 400, 3))
    assert len(got) == 400 and all(r.maybe for r in got if r.listed)
    assert sum(r.maybe for r in url_filter.judge(pages, listed).collect()) < 200
    assert url_filter.blocks_for(listed) == url_filter.LEAST_BLOCKS


def test_the_exact_join_decides(spark, tmp_path):
    """A campaign's link lists the page itself; others on its host are free; names inside do not clash."""
    urls = ["http://h.net/p?utm_source=a", "http://www.h.net/p/", "http://h.net/q", "http://h.net/p?x=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    df.select("*", *[F.lit("x").alias(n) for n in ("host", "path", "rule", "canon", "block", "w0", "b0", "s", "c", "salt")]).write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.verdict) for r in catalog.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([(0, "block"), (1, "block"), (2, "allow"), (3, "allow")] * 2)


def test_urls_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    got = catalog.QUERIES["op2_url_filter"](spark, SMALL).toPandas()
    want = con.execute(catalog.SQL["op2_url_filter"]).df()[list(got.columns)]
    assert sorted(map(str, got.fillna("").values.tolist())) == sorted(map(str, want.fillna("").values.tolist()))


# --- 3 and 4 repeats


def py_bytes(texts, n=50):
    first = defaultdict(set)
    for i, t in texts:
        b = t.encode()
        for a in range(len(b) - n + 1):
            first[b[a : a + n]].add(2**63 if i is None else i)
    out = []
    for i, t in texts:
        b, mine = t.encode(), 2**63 if i is None else i
        gone = [False] * len(b)
        for a in range(len(b) - n + 1):
            if min(first[b[a : a + n]]) < mine:
                gone[a : a + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def py_words(texts, n=35):
    split = [(i, WORDS.findall(t)) for i, t in texts]
    seen = Counter(tuple(w[a : a + n]) for _, w in split for a in range(len(w) - n + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if seen[tuple(w[a : a + n])] > 1:
                gone[a : a + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark, corpus):
    assert rows(catalog.QUERIES["op3_suffix_dedup"](spark, corpus)) == py_bytes(TEXTS)
    assert rows(catalog.QUERIES["op4_substring_dedup"](spark, corpus)) == py_words(TEXTS)


@pytest.fixture
def tiny_packs(monkeypatch):
    monkeypatch.setattr(repeats, "PACK_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 5)


def test_repeats_across_many_packs(spark, tmp_path, tiny_packs):
    rng = random.Random(8)
    passages = [" ".join(rng.choice(["ab", "cd", "e", "fgé", "hi"]) for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(120):
        t = " ".join(rng.choice([*passages, f"own {i} " * 5, "x x x x x " * 12]) for _ in range(rng.randrange(1, 5)))
        cut = rng.randrange(1 + len(t) // 2)
        texts.append((i, t[cut:]))
    spark.createDataFrame(texts, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(catalog.QUERIES["op3_suffix_dedup"](spark, str(tmp_path))) == py_bytes(texts)
    assert rows(catalog.QUERIES["op4_substring_dedup"](spark, str(tmp_path))) == py_words(texts)


def test_collections_hold_the_transform_and_common_prefixes():
    rng = random.Random(2)
    for strings in ([bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(0, 40))) for _ in range(60)], [b"aaaa", b"aaa", b"aaaa"], [b"", b"x"], []):
        c = suffix_dedup.Collection(strings, 9)
        rows = c.suffixes()
        of = {int(rows[i, k]): (s[k:], i) for i, s in enumerate(strings) for k in range(len(s))}
        got = [of[r][0] for r in sorted(of)]
        assert got == sorted(got) and sorted(of) == list(range(len(strings), len(c.key)))
        prefix = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        want = [0, *(min(9, prefix(x, y)) for x, y in zip(got, got[1:]))][: len(got)]
        assert c.common[len(strings) :].tolist() == want


def test_one_line_in_every_document(spark, tmp_path, tiny_packs):
    line = "this very common line of more than fifty bytes stands in every document of the corpus without any exception, " * 3
    texts = [(i, f"own words of document {i} {i * i} " * (i % 3) + line + f" end {i}") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(catalog.QUERIES["op3_suffix_dedup"](spark, str(tmp_path))) == py_bytes(texts)
    assert rows(catalog.QUERIES["op4_substring_dedup"](spark, str(tmp_path))) == py_words(texts)


def test_copies_in_a_pack_are_told_once():
    text = ("a passage of some length that stands in many documents of one and the same pack of texts " * 2).encode()
    pack = repeats.Pack(np.arange(50), np.full(50, len(text)), text * 50, [])
    symbols, sizes = suffix_dedup._symbols(pack)
    runs = repeats.find_runs(symbols, sizes, 50, 20)
    f = suffix_dedup._tell(pack, runs, np.arange(len(runs.first)))
    assert len(f.told.strings) < len(runs.first) / 40 and f.told.doc.max() == 0
    again = repeats.Told.unpack(f.told.pack())
    assert again.strings == f.told.strings and all((getattr(again, n) == getattr(f.told, n)).all() for n in ("doc", "anchor", "count", "place", "first", "which"))


@pytest.mark.parametrize("hashes", ["real", "all alike"])
def test_words_decide_and_not_their_hashes(monkeypatch, hashes):
    if hashes == "all alike":
        monkeypatch.setattr(substring_dedup, "window_hash", lambda words: np.zeros(max(0, len(words) - 34), np.uint64))
    rng = random.Random(6)
    anchor = [f"anchor{k}" for k in range(8)]
    sides = [([rng.choice("ab") for _ in range(27)], [rng.choice("ab") for _ in range(27)]) for _ in range(4)]
    strings, place, count = [], [], []
    for _ in range(40):
        left, right = rng.choice(sides)[0][rng.randrange(20) :], rng.choice(sides)[1]
        right = right[: rng.randrange(27 - len(left), 28)]
        strings.append(" ".join(left + anchor + right).encode())
        place.append(len(left))
        count.append(len(left) + 8 + len(right) - 34)
    got = substring_dedup.repeated_windows(strings, np.array(place), np.array(count))
    words = [s.split() for s in strings]
    seen = Counter(tuple(w[k : k + 35]) for w, n in zip(words, count) for k in range(n))
    want = [sum((seen[tuple(w[k : k + 35])] > 1) << k for k in range(n)) for w, n in zip(words, count)]
    assert got.tolist() == want and 0 in want and any(want)


# --- 5 tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_codec_matches_the_library(spark, corpus, library):
    got = rows(catalog.QUERIES["op5_bpe_codec"](spark, corpus))
    want = []
    for i, t in TEXTS:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    plain = bpe.codec(spark.createDataFrame(TEXTS, "doc_id long, text string"), bpe.vocabulary_path()).collect()
    assert all(r.ids == library.encode(dict(TEXTS)[r.doc_id], add_special_tokens=False).ids for r in plain if r.doc_id != 6)


def test_encoding_matches_the_library(library):
    rng = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aab", "theinr", "aeio '", "!#$%&*'-.,;:<>|ab1", "àéñüßöÉÑ .", "abcé中Ω١²́\x1c\xa0 İΣṩ<|endoftext|>", "a\0b×÷ĮįAZ09 "]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([1, 4, 9, 30, 70]))) for a in alphabets for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    e = bpe.Encoder(bpe.vocabulary_path())
    assert [x.tolist() for x in e.many(texts)] == want
    assert [x.tolist() for x in e.many(texts[::-1])] == want[::-1]


def test_words_abreast_and_alone_take_the_same_path(library):
    rng = random.Random(8)
    a = bpe.encoder(bpe.vocabulary_path()).automaton
    words = ["".join(rng.choice("aabeéinstß") for _ in range(rng.randrange(1, 47))).encode() for _ in range(500)]
    ids, count = a.words(words)
    cut = np.cumsum(count)[:-1]
    assert [x.tolist() for x in np.split(ids, cut)] == [a.word(w) for w in words]


def test_an_unbroken_word_takes_linear_time(library):
    rng = random.Random(9)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    began = time.perf_counter()
    got = bpe.Encoder(bpe.vocabulary_path()).ids(word)
    assert time.perf_counter() - began < 30
    assert got.tolist() == library.encode(word, add_special_tokens=False).ids


def test_forgetting_and_cutting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    e = bpe.Encoder(bpe.vocabulary_path())
    texts = [f"some words{i} more, Words again. " * (1 + 7 * (i % 3)) for i in range(40)] + [None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.many(texts)] == want


# --- 6 quality


def py_counts(t):
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_match_brute_force(spark, corpus):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in catalog.QUERIES["op6_quality_forest"](spark, corpus).collect()), key=str)
    want = []
    for i, t in TEXTS:
        n = py_counts(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        want.append((i, *n, failed, not failed))  # too few labels for a forest
    assert got == sorted(want, key=str)


def test_forest_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    train = labels.filter(F.col("doc_id") % 2 == 0)
    got = quality_forest.judge(docs.join(labels.select("doc_id"), "doc_id"), train).join(labels, "doc_id").filter(F.col("doc_id") % 2 == 1)
    n = {(r.quality, r.kept): r["count"] for r in got.filter(~F.col("base_failed")).groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] >= 0.85 * (n[0, False] + n.get((0, True), 0))


def test_all_labelled_rows_decide(spark):
    """Forest and thresholds came from 4000 labelled rows at most."""
    rng = np.random.default_rng(3)
    n = 9000
    x, good, words = rng.normal(size=(n, 4)), rng.random(n) < 0.9, rng.choice([30, 100, 900], n, p=[0.6, 0.395, 0.005])
    x[~good] += 2
    rows = [(i, bool(g), int(w), *map(float, v)) for i, (g, w, v) in enumerate(zip(good, words, x))]
    df = spark.createDataFrame(rows, "doc_id long, good boolean, n_words long, " + ", ".join(f"{f} double" for f in quality_forest.FEATURES))
    measured = df.withColumn("base_failed", F.lit(False))
    labels = df.select("doc_id", F.col("good").cast("int").alias("quality"))
    forest, limit = quality_forest.fit(measured.repartition(3), labels)
    again, same = quality_forest.fit(measured.repartition(7), labels.repartition(2))
    assert np.array_equal(forest.split, again.split) and np.array_equal(limit, same)
    # A tree's splits lie between its rows, drawn from all: the ids of its smallest hashes.
    ids = np.array([r.id for r in df.select(F.xxhash64("doc_id").alias("id")).collect()])
    drawn = [np.argsort(quality_forest._mixed(ids, t))[: quality_forest.SAMPLE] for t in range(quality_forest.TREES)]
    f, at = forest.feature[:, 1], forest.split[:, 1]
    assert all(x[d, k].min() <= y <= x[d, k].max() for d, k, y in zip(drawn, f, at, strict=True))
    assert len(set(np.concatenate(drawn).tolist())) > 4000
    score, band = forest.score(x), np.searchsorted(quality_forest.BANDS, words)
    assert (np.bincount(band[good]) < quality_forest.LEAST_IN_BAND).tolist() == [False, False, True]
    for b in range(3):  # the last band has too few good ones and takes the threshold of all
        mine = band == b if b < 2 else np.ones(n, bool)
        edge = np.sort(score[mine & good])[::-1][int(quality_forest.CLEAN_LOSS * (mine & good).sum())]
        bad = score[mine & ~good & (score > edge)]
        assert limit[b] == ((edge + bad.min()) / 2 if len(bad) else edge + 1e-6)


# --- 7 simhash


def py_print(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORDS.findall(t)]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def py_components(prints):
    """Smallest reachable id for a list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(prints):
        k = find(i)
        best[k] = min((x for x in (best.get(k), d) if x is not None), default=None)
    return [best[find(i)] for i in range(len(prints))]


def test_simhash_matches_brute_force(spark, corpus):
    prints = [(i, py_print(t)) for i, t in TEXTS]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, py_components(prints), strict=True)), key=str)
    assert rows(catalog.QUERIES["op7_simhash"](spark, corpus)) == want


@pytest.mark.parametrize("hot", [4096, 4])
def test_components_of_chains_and_clusters(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(6)
    prints = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.append(x)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << rng.randrange(64)
    prints += [rng.getrandbits(64) for _ in range(100)]
    nodes = sorted(set(prints))
    want = py_components([(n, n) for n in nodes])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(n),) for n in nodes], "fp long")
    label = {r.fp: r.comp for r in simhash.components(simhash.links(df)).collect()}
    groups = lambda of: sorted(sorted(v) for v in of.values())
    a, b = defaultdict(list), defaultdict(list)
    for n, w in zip(nodes, want, strict=True):
        a[w].append(n)
        b[label.get(signed(n), signed(n))].append(n)
    assert groups(a) == groups(b)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x[1:100] = x[0] ^ (np.uint64(1) << rng.integers(0, 64, 99).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 99).astype(np.uint64))
    got = simhash._members(simhash._within(simhash._planes(x), len(x), int(x[5]))[0], len(x))
    assert got.tolist() == [i for i in range(300) if (int(x[i]) ^ int(x[5])).bit_count() <= 3]


@pytest.mark.parametrize("n", [64, 100, 1000, 5000])
def test_far_blocks_are_abandoned(n):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, n, dtype=np.uint64)
    near, read = simhash._within(simhash._planes(x), n, 0)
    assert not simhash._members(near, n).size and read <= 32 * simhash._planes(x).shape[1]
    x[-1] = 1  # one near node keeps its own block alone
    near, more = simhash._within(simhash._planes(x), n, 0)
    blocks = simhash._planes(x).shape[1]
    assert simhash._members(near, n).tolist() == [n - 1] and more <= 64 + 32 * (blocks - 1)


def test_finer_buckets_lose_no_pair():
    rng = random.Random(3)
    levels = simhash.masks()
    for _ in range(200):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        paths = [p for p, m in enumerate(levels[0]) if not d & m]
        for level in levels[1:]:
            paths = [4 * p + k for p in paths for k in range(4) if not d & level[4 * p + k]]
        assert paths
    assert all(m.bit_count() >= 46 for m in levels[-1])


def test_hot_fingerprint_and_star(spark, tmp_path, monkeypatch):
    from marsad.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    texts = [(i, None if i % 2 else "the same words in every one of these copies") for i in range(400)] + [(None, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op7_simhash"](spark, str(tmp_path)).collect()
    assert Counter((r.fingerprint == "0" * 16, r.component_id) for r in got) == {(True, 1): 201, (False, 0): 200}
    star = spark.createDataFrame([(i, 7) for i in range(100, 400)] + [(7, 3), (399, 1000)], "a long, b long")
    assert {r.fp: r.comp for r in simhash.components(star).collect()} == dict.fromkeys([*range(100, 400), 7, 3, 1000], 3)


# --- 8 and 10 packing


@pytest.mark.parametrize("name", ["op8_retrieval_packing", "op10_token_output"])
def test_packing_keeps_every_id_once(spark, corpus, library, name):
    pieces = catalog.QUERIES[name](spark, corpus).collect()
    tokens = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in TEXTS}
    assert sum(p.length for p in pieces) == sum(len(tokens[i]) for i, _ in TEXTS)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
        x = tokens[p.doc_id]
        assert p.doc_tokens == len(x) and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for some in by.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert 0 < at <= 2048
    cover = Counter((p.doc_id, k) for p in pieces for k in range(p.start, p.start + p.length))
    assert set(cover.values()) <= {1, 2} and all((v == 2) == (i == 6) for (i, _), v in cover.items())  # document 6 is there twice


def test_index_scores_match_brute_force():
    rng = np.random.default_rng(2)
    held = [rng.integers(0, 30, rng.integers(1, 40)).astype("<u4") for _ in range(50)]
    sets = [Counter(x.tolist()) for x in held]
    df = np.array([sum(t in s for s in sets) for t in range(30)])
    mean = sum(map(len, held)) / 50
    index = retrieval.Index(held, retrieval.Corpus(df, 50, mean))
    for q in (0, 7):
        want = [sum(math.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) * s[t] * 2.2 / (s[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in sets[q] if t in s) for s, x in zip(sets, held)]
        assert np.allclose(index.scores(held[q]), want)


def test_neighbours_fill_a_seeds_window():
    ids = lambda *x: np.array(x, "<u4")
    held = list(enumerate([ids(*[5, 6, 7, 8] * 4), ids(*[50, 60] * 8), ids(*[5, 6, 9] * 5), ids(*[70, 80] * 8)]))
    corpus = retrieval.Corpus(np.where(np.isin(np.arange(100), (5, 6)), 2, 1), 4, 16.0)
    w = retrieval.Windows(32)
    found = [*w.shard(held, corpus), *w.finish()]
    assert [p[0] for p in found if p[5] == 0][:2] == [0, 2]
    room = Counter()
    for p in found:
        room[p[5]] += p[2]
    assert sum(room.values()) == 63 and all(n == 32 or n & (n - 1) == 0 for n in room.values())  # full, or a power of two


def test_padding_of_retrieval_is_none(spark, corpus):
    room = Counter()
    for p in catalog.QUERIES["op8_retrieval_packing"](spark, corpus).collect():
        room[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in room.values())


def test_segment_tree_finds_the_least_room():
    rng = random.Random(5)
    rooms, plain = packing.Rooms(64), []
    for n in range(2000):
        if rng.random() < 0.5:
            room = rng.randrange(1, 64)
            rooms.put(room, n)
            plain.append(room)
        else:
            need = rng.randrange(1, 64)
            want = min((r for r in plain if r >= need), default=None)
            got = rooms.take(need)
            assert (got and got[0]) == want
            if want is not None:
                plain.remove(want)


def test_best_fit_is_tight_and_matrices_hold_the_ids(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.choice([3, 500, 1000, 1500, 2048, 5000]) for _ in range(200)]
    found = packing.best_fit_pack([np.zeros(n, "<u4") for n in sizes])
    used = len({p[3] for p in found})
    assert used <= 1.05 * sum(sizes) / 2048 + 1
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    packing.write_matrices(df.coalesce(1), bpe.vocabulary_path(), str(tmp_path / "m"), 16)
    (r,) = spark.read.parquet(str(tmp_path / "m")).collect()
    assert r.cu_seqlens == [0, 4, 7] and r.doc_ids == [1, 2] and r.n_ids == 7
    assert np.frombuffer(r.positions, "<u2").tolist() == [0, 1, 2, 3, 0, 1, 2, *[0] * 9] and len(r.ids) == 32


# --- 9 neighbours


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[:400] = x[0]
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (5400, [1.0, 2.0]), (None, x[1].tolist()), (7, x[7].tolist())]
    spark.createDataFrame(table + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["op9_ann_forest"](spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 3000, 100))  # a vector of another length has nobody to meet
    hits = 0
    y = x.astype(np.float64)
    for q, some in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        assert [r.rank for r in some] == list(range(1, 11)) or sorted(r.rank for r in some) == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in some)
        hits += len(set(want.tolist()) & {r.vec_id for r in some})
    assert hits >= 0.9 * 10 * len(by)


def test_recall_over_several_shards_and_blocks(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = ann_forest.search(df, F.col("vec_id") % 20 == 0, shard=500, block=30).collect()
    rows_ = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows_]), np.array([r.embedding for r in rows_], np.float64)
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found) and len(found) == 100


def test_all_candidates_if_there_are_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_forest.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    noise = " ".join(f"w{i}" for i in range(40))
    clean = lambda i: " ".join(f"plain{i}word{k}" for k in range(50))
    texts = [(1, clean(1) + " " + PASSAGE), (2, clean(2) + " " + PASSAGE), (3, clean(1) + " " + PASSAGE), (4, "too short"), (5, clean(5) + " password=abcdefgh123 " + noise), (None, clean(6)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "secrets", "packed"]
    out, kept = docs, {}
    for name, f in P.STAGES[:-1]:
        out = spark.createDataFrame(f(spark, out, str(tmp_path)).select(docs.columns).collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns
    assert set(kept["quality_rules"]) == {1, 2, 3, 5, None}
    assert set(kept["near_duplicates"]) == {1, 2, 5, None}
    assert PASSAGE[:100] in kept["repeated_passages"][1].text and PASSAGE[:100] not in kept["repeated_passages"][2].text
    assert "[secret]" in kept["secrets"][5].text and "abcdefgh123" not in kept["secrets"][5].text
    assert all(r.n_chars == len(r.text) for r in kept["secrets"].values())
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 5, None}
