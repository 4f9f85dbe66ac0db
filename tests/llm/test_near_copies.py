import random
import weakref

import numpy as np

import corpus_pipeline as P
from marsad.llm import bpe, near_copies
from marsad.llm.common import small


def jaccard(x, y):
    of = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = of(x), of(y)
    return len(x & y) / len(x | y)


def texts():
    rng = random.Random(5)
    out = []
    for k in range(30):
        words = [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(120)]
        out.append(" ".join(words))
        for edits in range(1, 7):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return [*out, "short", "SHORT", "two words", ""]


def test_every_pair_at_the_limit_is_linked(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cache: dict = {}
    least = near_copies.prints(df).selectExpr("node", "node AS least").distinct()
    ids = {i: near_copies.node(near_copies.shingles(t, cache)) for i, t in rows}
    want = {frozenset((ids[i], ids[j])) for i, x in rows for j, y in rows if i < j and ids[i] != ids[j] and jaccard(x, y) >= 0.8}
    assert len(want) > 50
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in near_copies.similar(df, least).collect()}
    assert got == want


def test_stage_drops_near_copies_that_fingerprints_miss(spark):
    """The stage linked by at most three differing bits only: such pairs at 0.8 both stayed."""
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    kept = {r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert not [(i, j) for i in kept for j in kept if i < j and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert {7 * k for k in range(30)} <= kept


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    """Removal by doc_id kept rows without id and repeated rows, and took a clean row with the id of a copy."""
    clean = lambda i: " ".join(f"plain{i}word{k}" for k in range(50))
    rows = [(1, clean(1)), (2, clean(1)), (2, clean(2)), (None, clean(1)), (None, clean(3)), (None, clean(3)), (4, clean(4)), (4, clean(4)), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(1, clean(1)), (2, clean(2)), (None, clean(3)), (4, clean(4)), (5, None)], key=str)


def test_large_groups_are_linked_in_rounds(spark):
    """All pairs of a group were candidates, as many as its square."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for _ in range(300):  # many near copies, some of which are linked through others only
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    rows += texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    cache: dict = {}
    least = near_copies.prints(df).selectExpr("node", "node AS least").distinct()
    sets = {near_copies.node(x): set(x.tolist()) for x in (near_copies.shingles(t, cache) for t in rows)}
    edges = [(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and 5 * len(x & y) >= 4 * len(x | y)]

    def parts(edges):
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in edges:
            root[find(i)] = find(j)
        out: dict = {}
        for i in sets:
            out.setdefault(find(i), set()).add(i)
        return sorted(map(sorted, out.values()))

    for big in (2, 20):
        got = {(r.a % 2**64, r.b % 2**64) for r in near_copies.similar(df, least, big).collect()}
        assert {frozenset(e) for e in got} <= {frozenset(e) for e in edges}
        assert parts(got) == parts(edges)


def test_marks_hold_every_node_and_no_other_slot(spark):
    nodes = [0, 5, 5, -1, -(2**63), 2**63 - 1, near_copies.MARKS, near_copies.MARKS - 1]
    df = spark.createDataFrame([(n,) for n in nodes], "node long").repartition(3)
    assert set(np.flatnonzero(np.unpackbits(near_copies.marked(df))).tolist()) == {n % near_copies.MARKS for n in nodes}
    assert not near_copies.marked(df.limit(0)).any()


def test_a_round_takes_each_node_once(spark):
    """A round took a node as often as it had large groups, 18 times and more for near copies of 100 words."""
    nodes, groups = 200, 30
    rows = [(n, 100, [(h, 0, n) for h in range(groups)]) for n in range(nodes)]
    packed = spark.createDataFrame(rows, "node long, size long, at array<struct<h: long, pos: long, ord: long>>")
    of = spark.createDataFrame([(n, n) for n in range(nodes)], "node long, g long")
    met = []
    for turn in range(3):
        got = [(r.a, r.b) for r in near_copies._near(packed, of, turn).collect()]
        assert nodes - 1 <= len(got) <= near_copies.NEAR * nodes  # all in one group: nodes alike go to the same
        met += got
    assert len(set(met)) > near_copies.NEAR * nodes  # each round others


def parts_of(nodes, edges):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    out: dict = {}
    for i in nodes:
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def test_what_the_rounds_leave_is_compared_in_its_task(spark, monkeypatch):
    """Copies that are hardly alike left their task as pairs, as many as the square of their group."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(250):  # mostly three edits: like few others, but with the same first shingles
        words = list(base)
        for _ in range(1 if k < 10 else 3):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    cache: dict = {}
    least = near_copies.prints(df).selectExpr("node", "node AS least").distinct()
    sets = {near_copies.node(x): set(x.tolist()) for x in (near_copies.shingles(t, cache) for t in rows)}
    edges = [(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and 5 * len(x & y) >= 4 * len(x | y)]
    want, made, left = parts_of(sets, edges), [], near_copies._left

    def counted(*of):
        out = left(*of)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "_left", counted)
    for little in (1 << 17, 2000):  # one block a group, and many
        monkeypatch.setattr(near_copies, "LITTLE", little, raising=False)
        monkeypatch.setattr(near_copies, "ROUNDS", 1)
        got = {(r.a % 2**64, r.b % 2**64) for r in near_copies.similar(df, least).collect()}
        assert {frozenset(e) for e in got} <= {frozenset(e) for e in edges}
        assert parts_of(sets, got) == want
    assert len(want) > 50 and max(made) < 4 * len(sets)


def test_products_of_sets_are_exact():
    rng = random.Random(4)
    for columns, dense in ((40, 30), (2048, 10**6), (2048, 1)):  # both ways, and a mixture
        near_copies._COLUMNS, kept = columns, (near_copies._COLUMNS, near_copies._DENSE)
        near_copies._DENSE = dense
        x, y = ([np.array(sorted(rng.sample(range(300), rng.randrange(1, 120))), np.uint64) for _ in range(n)] for n in (13, 7))
        assert near_copies._shared(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
        near_copies._COLUMNS, near_copies._DENSE = kept
    assert near_copies._shared([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_a_task_frees_what_others_left_in_its_worker():
    """Workers kept the encoder of the stage before, some 200 MB each, while near_duplicates ran in them."""
    path = bpe.vocabulary_path()
    ids = bpe.encoder(path).ids("some words").tolist()
    left = weakref.ref(bpe.encoder(path))
    assert not list(small(iter([])))
    assert left() is None and not bpe.encoder.cache_info().currsize
    assert bpe.encoder(path).ids("some words").tolist() == ids  # made anew when wanted
