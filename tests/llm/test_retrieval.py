from collections import Counter, defaultdict

import numpy as np

from marsad.llm import bpe, packing, retrieval
from marsad.llm.common import materialise


def test_neighbours_come_from_other_tasks(spark):
    """Documents with the same leading terms share a shard, whatever task read them."""
    names = "river castle engine garden winter silver monkey planet doctor bridge cotton letter".split()
    topic = lambda k: f"{names[k]} " * 300
    rows = [(k + 12 * half, topic(k)) for half in (0, 1) for k in range(12)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = packing.retrieval_pieces(df, bpe.vocabulary_path()).collect()
    total = {p.doc_id: p.doc_tokens for p in got}
    cover = Counter()
    by = defaultdict(list)
    for p in got:
        cover[p.doc_id] += p.length
        by[p.sequence_id].append((p.offset, p.doc_id))
    assert cover == total and len(total) == 24
    pairs = [{d for _, d in some} for some in by.values()]
    assert all(any({k, k + 12} <= p for p in pairs) for k in range(12))


def test_used_documents_leave_the_index():
    """Every seed went through the postings of all documents, used or not."""
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 60, rng.integers(1, 50)).astype("<u2") for _ in range(80)]
    corpus = retrieval.Corpus(rng.integers(1, 80, 60), 80, 25.0)
    whole, index = retrieval.Index(held, corpus), retrieval.Index(held, corpus)
    free, sizes = np.arange(80), [len(index.doc)]
    while len(free):
        index.keep(free)
        sizes.append(len(index.doc))
        assert 3 * index.left <= 4 * len(free) and set(free) <= set(index.doc)
        for seed in (0, 41):
            assert index.scores(held[seed])[free].tolist() == index.scores(held[seed], seed)[free].tolist() == whole.scores(held[seed])[free].tolist()
        free = np.sort(rng.permutation(free)[: len(free) - 7])
    assert sizes[-1] < sizes[0] / 5


def test_statistics_come_with_the_ids(spark):
    """Ids were read and sorted once more for document frequencies alone."""
    texts = ["river castle river", "castle", None, "", "engine garden", "river"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = bpe.vocabulary_path()
    rows = materialise(retrieval.encoded(df, path), "ids")
    n = len(bpe.encoder(path).automaton.labels)
    got = retrieval.statistics(rows, n)
    ids = [[*bpe.encoder(path).ids(t).tolist(), retrieval.END] for t in texts]
    want = Counter(t for x in ids for t in set(x))
    assert {t: int(k) for t, k in enumerate(got.df) if k} == dict(want)
    assert got.mean == sum(map(len, ids)) / len(ids)
    assert rows.filter("counts IS NULL").count() == len(texts)
    none = retrieval.statistics(materialise(retrieval.encoded(df.limit(0), path), "ids"), n)
    assert not none.df.any() and not retrieval.pieces(df.limit(0), path, 2048, packing.PIECES).count()


def test_rows_are_routed_once_and_in_order(spark):
    """Spark's own range partitions looked for the terms of all rows twice."""
    rng = np.random.default_rng(5)
    held = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u2") for _ in range(400)] + [np.array([1], "<u2")] * 100
    df = np.zeros(40, np.int64)
    for x in held:
        df[np.unique(x)] += 1
    corpus = retrieval.Corpus(df, len(held), sum(map(len, held)) / len(held))
    corpus.ids = 1 << 30  # else one partition
    rows = [(7 * k, k, x.tobytes()) for k, x in enumerate(held)]
    got = retrieval.routed(spark.createDataFrame(rows, "at long, doc_id long, ids binary").repartition(4), corpus, "<u2")
    want = []
    for at, k, _ in rows:
        doc, term, count = retrieval.terms_of([held[k]])
        weight = np.where(df[term] > 1, corpus.weight(term, count, np.array([len(held[k])])), 0)
        first = [int(term[i]) if weight[i] > 0 else -1 for i in np.lexsort((term, -weight))[: retrieval.LEADING]]
        want.append(([*first, *[-1] * (retrieval.LEADING - len(first))], at, k))
    assert [r.doc_id for r in got.collect()] == [k for _, _, k in sorted(want)]
    assert sum(n > 0 for n in got.rdd.glom().map(len).collect()) > 1


def test_driver_sizes_ids_without_the_automaton(monkeypatch):
    """The driver built the whole automaton to learn the number of ids."""
    path = bpe.vocabulary_path()
    n = len(bpe.encoder(path).automaton.labels)

    def none(path):
        raise AssertionError

    monkeypatch.setattr(retrieval, "encoder", none)
    assert retrieval.width(path) == ("<u2" if n <= 1 << 16 else "<u4") and bpe.vocabulary_size(path) == n
