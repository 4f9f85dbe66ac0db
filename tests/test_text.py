import random
import re
import unicodedata

from pyspark.sql import functions as F

from marsad.functions import text as T


def run(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


MARKS = "[ً-ْٰـ]"
TOKEN = "[ء-يA-Za-z0-9]+"


def samples(n=300, seed=5):
    rng = random.Random(seed)
    pieces = ["كان", "في", "ي", "و", "أدب", "إلى", "مدرسة", "مُدَرِّس", "على", "aab", "Hello", "1940", "12", " ", " ", "\n", "\n\n", "\n \n", ". ", "! ", "؟ ", "•", "\n•", "-", ",", "ـ", "\t", "\r\n", "."]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(n)]


def py_token(t):
    t = re.sub("[^ء-يa-z0-9]", "", t.strip().lower())
    t = t.translate(str.maketrans("أإآىة", "ااايه"))
    return re.sub(r"(.)\1+", r"\1", re.sub(MARKS, "", t))


def test_tokens_and_terms(spark):
    xs = samples()
    t = F.col("t")
    got = run(spark, xs, T.tokens(t), F.array_sort(T.terms(t)), F.array_sort(T.normalize_terms(T.token_set(t))))
    for x, (toks, folded, one_by_one) in zip(xs, got, strict=True):
        want = re.findall(TOKEN, re.sub(MARKS, "", x))
        assert toks == want
        assert folded == one_by_one == sorted({py_token(w) for w in want}, key=lambda s: s.encode())


def test_repeated_characters_collapse_in_numbers_too(spark):
    assert run(spark, ["1900", "http", "مميز"], T.normalize_token(F.col("t"))) == [("190",), ("htp",), ("ميز",)]


def py_normalize(x):
    x = re.sub("[إأآا]", "ا", x).replace("ى", "ي").replace("ـ", "").replace("\r\n", "\n")
    for a, b in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        x = re.sub(a, b, x)
    return x.strip()


def py_repair(x):
    lines, out, n, i = [s.strip() for s in x.split("\n")], [], 0, 0
    while i < len(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if re.fullmatch("[ء-ي]{1,2}", lines[i]) and nxt:
            head = out.pop().rstrip() + " " if out and out[-1].strip() else ""
            out.append(f"{head}{lines[i]} {nxt}")
            n, i = n + 1, i + 2
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out), n


def test_normalize_and_repair_match_a_plain_loop(spark):
    xs = samples(400, 9)
    got = run(spark, xs, T.process(F.col("t")))
    joins = 0
    for x, (r,) in zip(xs, got, strict=True):
        n = py_normalize(x)
        assert r.normalized == n
        assert (r.repaired, r.repair_count) == py_repair(n)
        assert len(r.repairs) == r.repair_count
        joins += r.repair_count
    assert joins >= 10


def test_repair_leaves_clean_text_alone(spark):
    for x in ("ولد في\n1940\nفي المدينة", "انظر\nhttps://example.org/a\nهنا", "عنوان\n• بند اول\n• بند ثان", "First line\nSecond line", "فقرة اول كاملة.\n\nفقرة ثانية كاملة."):
        ((r,),) = run(spark, [x], T.process(F.col("t")))
        assert r.repair_count == 0 and r.repaired == x
    ((r,),) = run(spark, ["كان يعمل\nفي\nالرياض"], T.process(F.col("t")))
    assert r.repaired == "كان يعمل في الرياض" and r.repairs[0].left == "كان يعمل"


def test_quality_counts(spark):
    (row,) = run(spark, ["ab é᐀•"], T.nonspace(F.col("t")), T.suspicious(F.col("t")), T.suspicious(F.col("t"), False), T.syllabics(F.col("t")), T.quality(F.col("t")))
    assert row[:4] == (5, 2, 3, 1) and row[4].neg_ratio == -0.4
    ((q,),) = run(spark, ["  \n"], T.quality(F.col("t")))
    assert (q.neg_ratio, q.nonspace, q.neg_count) == (0.0, 0, 0)


def test_clean_extracted(spark):
    x = " ﷲ\t a\n \n\n b� "
    want = re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", unicodedata.normalize("NFKC", x).replace("�", ""))).strip()
    assert run(spark, [x], T.clean_extracted(F.col("t"))) == [(want,)]


def test_sentences(spark):
    xs = samples(300, 21)
    got = run(spark, xs, T.chunk_sentences(F.col("t")), T.answer_sentences(F.col("t")))
    for x, (a, b) in zip(xs, got, strict=True):
        parts = [p.strip() for p in re.split(r"(?<=[.!؟?])\s+|\n(?=•)|\n{2,}", x.replace("\n•", "\n• ")) if p.strip()]
        assert a == (parts or ([x.strip()] if x.strip() else []))
        assert b == [p.strip() for p in re.split(r"(?<=[.!?؟\n])\s+", x) if p.strip()]


def test_condition_c(spark):
    def py(x):
        x = re.sub(r"(\w) ي\n(\S)", r"\1 في \2", x)
        x = re.sub(r"(?<=\s)ي(?=\s)", "في", x)
        x = re.sub(r"(?m)^ي\s", "في ", x)
        x = re.sub(r"\n+", " ", re.sub(r"\n\.", " .", x)).replace("الممل", "المملكة")
        return re.sub(r" {2,}", " ", x).strip()

    xs = [x.replace("\r", "").replace("مُدَرِّس", "الممل") for x in samples(300, 33)]
    assert [r[0] for r in run(spark, xs, T.clean_condition_c(F.col("t")))] == list(map(py, xs))


def test_small_cleaners(spark):
    xs = ["## عنوان  طويل\nهنا", "```json\n{}\n```", "a" * 200]
    got = run(spark, xs, T.clean_answer(F.col("t")), T.strip_fences(F.col("t")), T.one_line(F.col("t")), T.numbers(F.col("t")))
    assert got[0][0] == "عنوان طويل هنا" and got[1][1] == "{}" and got[2][2] == "a" * 160 + "..."
    assert run(spark, ["عام 1940 و ١٩٥٠ 1940"], T.numbers(F.col("t"))) == [(["1940", "١٩٥٠"],)]
    ((f,),) = run(spark, ["x� 0491"], T.artifacts(F.col("t")))
    assert (f.syllabics, f.replacement, f.reversed_year) == (False, True, True)
