"""Retrieval packing: a BM25 inverted index in shards, whose unused neighbours fill a seed's window.

1. Texts are encoded once; ids are written to the shared folder, and with them, in a row of its own, what
   each task counted.
2. Document frequencies of terms (token ids) and the mean length are the whole corpus's. The driver
   holds a number for each token of the vocabulary, however long the corpus.
3. A document is routed by its leading terms, those of the greatest BM25 weight: all documents are
   range partitioned and sorted by them, so documents with the same leading terms lie in one shard of
   the index wherever they stood in the table. Rows with the same terms are told apart by their place
   in the input, so a hot group is spread over tasks.
4. In a shard (``SHARD_DOCS`` documents or ``SHARD_IDS`` ids) an inverted index answers for each
   seed with all unused documents in order of BM25 score, and they fill its window greedily. A
   document that does not fit whole goes on in the next window and seeds it. A window that has used up
   a shard goes on in the next one; a task's last window is cut at powers of two, without padding. Used
   documents leave the index whenever they are a quarter of it, which changes no score.

Each document is used exactly once. A seed's list is its shard's: what lies in others is not asked
for, which keeps the work linear (README has the loss against asking all of them).

Defined cases: null text is empty (its final id alone); null ids are carried; repeated rows are packed
each; ties in score go to the earlier place in the shard; very long texts fill windows of their own and
are never cut short; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marsad.llm.bpe import encoder, vocabulary_size
from marsad.llm.common import materialise, small

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_IDS = 1024, 4_000_000
#: Terms that route a document, and documents a partition whose terms set the bounds.
LEADING, BOUND = 4, 128
END = 1

#: (doc_id, ids with the final one)
Doc = tuple[int | None, np.ndarray]
#: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
Piece = tuple[int | None, int, int, int, int, int, int]


def width(path: str) -> str:
    """Type of a stored id: 16 bits if the vocabulary fits, else 32."""
    return "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """at (place in the input), doc_id, ids (of ``width``, with the final one); then a row for each task without ids: counts.

    counts: documents with each term, then all documents and ids (little-endian, 64 bits).
    """
    kind, vocabulary = width(path), vocabulary_size(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, place = encoder(path), TaskContext.get().partitionId() << 36
        total = np.zeros(vocabulary + 2, "<i8")
        names_of = ["at", "doc_id", "ids", "counts"]
        for batch in batches:
            names, at = batch.column("doc_id").cast(pa.int64()), 0
            for ids, offsets in e.batch(batch.column("text")):
                n = len(offsets) - 1
                ids = np.insert(ids.astype(kind), offsets[1:], END)
                ends = offsets + np.arange(n + 1)
                for i in range(0, n, 1024):
                    some = [ids[a:b] for a, b in zip(ends[i : min(n, i + 1024)].tolist(), ends[i + 1 : i + 1025].tolist(), strict=True)]
                    total[:-2] += np.bincount(terms_of(some)[1], minlength=vocabulary)
                total[-2:] += n, len(ids)
                data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(place, place + n)), names.slice(at, n), data.cast(pa.binary()), pa.nulls(n, pa.binary())], names_of)
                at, place = at + n, place + n
        if total[-2]:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array([total.tobytes()], pa.binary())], names_of)

    return docs.select("doc_id", "text").mapInArrow(run, "at long, doc_id long, ids binary, counts binary")


def terms_of(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of all documents, in order."""
    size, ids = [len(x) for x in held], np.concatenate(held)
    if ids.itemsize == 2 and len(held) <= 1 << 16:  # half as wide sorts in half the time
        key, count = np.unique(np.repeat(np.arange(len(held), dtype=np.uint32) << np.uint32(16), size) | ids, return_counts=True)
        return (key >> np.uint32(16)).astype(np.int64), (key & np.uint32(0xFFFF)).astype(np.int64), count
    key, count = np.unique(np.repeat(np.arange(len(held), dtype=np.int64) << 32, size) | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def _arrays(batch: pa.RecordBatch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]


class Corpus:
    """What BM25 needs of the whole corpus: idf of each term, mean length."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean, self.ids = df, n, mean, n * mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weight(self, term: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / self.mean))


def statistics(held: DataFrame, vocabulary: int) -> Corpus:
    """Over all documents, from the tasks' counts (``encoded``); those are added up by term."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary + 2, np.int64)
        for batch in small(batches):
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    total = np.zeros(vocabulary + 2, np.int64)
    for r in held.select("counts").filter("counts IS NOT NULL").mapInArrow(add, "term long, n long").groupBy("term").sum("n").collect():
        total[r[0]] = r[1]
    return Corpus(total[:-2], int(total[-2]), float(total[-1]) / max(1, int(total[-2])))


def routed(held: DataFrame, corpus: Corpus, kind: str) -> DataFrame:
    """``held`` in range partitions by leading terms, sorted. Every row goes to one; a sample sets no more than their bounds."""
    names = [f"t{r}" for r in range(LEADING)]

    def lead(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = _arrays(batch, kind)
            doc, term, count = terms_of(ids)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            weight = np.where(corpus.df[term] > 1, corpus.weight(term, count, size[doc]), 0)  # a term of one document finds nobody
            leads, first = [], np.searchsorted(doc, np.arange(len(ids)))
            for _ in range(LEADING):  # the greatest weight, of equal ones the smaller term; then without it
                most = np.maximum.reduceat(weight, first)
                at = np.flatnonzero(weight == most[doc])
                at = at[np.diff(doc[at], prepend=-1) > 0]
                leads.append(np.where(most > 0, term[at], -1).astype(np.int32))
                weight[at] = 0
            part = np.searchsorted(bounds, _keys(leads, batch.column("at").to_numpy()), "right") if len(bounds) else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, leads), pa.array(part.astype(np.int32))], [*batch.schema.names, *names, "part"])

    def with_leads(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
        return rows.mapInArrow(lambda batches: lead(batches, bounds), "at long, doc_id long, ids binary, " + ", ".join(f"{t} int" for t in names) + ", part int")

    parts = max(1, min(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(corpus.ids) * np.dtype(kind).itemsize >> 20))
    bounds = np.empty(0, "S24")
    if parts > 1:  # as Spark's own range partitions do, but the terms of all rows are not looked for twice
        some = held.filter(F.pmod(F.xxhash64("at"), F.lit(max(1, corpus.n // (BOUND * parts)))) == 0)
        some = np.array(with_leads(some, bounds).select(*names, "at").collect(), np.int64).reshape(-1, LEADING + 1)
        some = np.sort(_keys(list(some[:, :LEADING].T), some[:, LEADING]))
        bounds = np.unique(some[[len(some) * p // parts for p in range(1, parts)]]) if len(some) else bounds
    rows = with_leads(held, bounds).repartitionById(parts, F.col("part"))
    return rows.sortWithinPartitions(*names, "at").select("doc_id", "ids")


def _keys(leads: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Leading terms and place as bytes of the same order."""
    out = np.empty((len(at), 3), ">u8")
    out[:, 0], out[:, 1] = ((leads[r].astype(np.int64) + 1) << 32 | leads[r + 1].astype(np.int64) + 1 for r in (0, 2))
    out[:, 2] = at
    return out.view("S24").ravel()


class Index:
    """Inverted index of one shard, with the corpus's statistics."""

    def __init__(self, held: list[np.ndarray], corpus: Corpus):
        doc, term, count = terms_of(held)
        size, n = np.fromiter(map(len, held), np.int64, len(held)), np.bincount(doc, minlength=len(held))
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.weight = corpus.weight(term[order], count[order], size[self.doc])
        self.terms, self.slot, many = np.unique(term, return_inverse=True, return_counts=True)
        self.at, self.upto = np.append(0, np.cumsum(many)), np.append(0, np.cumsum(n))
        self.n = self.left = len(held)

    def keep(self, free: np.ndarray) -> None:
        """Postings of documents that are not among ``free`` may go, now that they are used: a quarter of those left at least."""
        if 4 * len(free) > 3 * self.left:
            return
        good = np.zeros(self.n, bool)
        good[free] = True
        good = good[self.doc]
        self.at = np.append(0, np.cumsum(good))[self.at]
        self.doc, self.weight, self.left = self.doc[good], self.weight[good], len(free)

    def terms_in(self, ids: np.ndarray) -> np.ndarray:
        """Places of the distinct terms of any ``ids``."""
        found = np.unique(ids)
        where = np.searchsorted(self.terms, found)
        return where[(where < len(self.terms)) & (self.terms[np.minimum(where, len(self.terms) - 1)] == found)]

    def scores(self, ids: np.ndarray, which: int | None = None) -> np.ndarray:
        """BM25 of every document kept for the distinct terms of ``ids``, those of document ``which`` if they are."""
        where = self.terms_in(ids) if which is None else self.slot[self.upto[which] : self.upto[which + 1]]
        first, size = self.at[where], self.at[where + 1] - self.at[where]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Windows:
    """Windows of one task, filled from one shard after another."""

    def __init__(self, length: int, number: int = 0):
        self.length, self.number = length, number
        self.window: list[tuple[Doc, int, int]] = []
        self.room, self.seed = length, None

    def _close(self, pieces: list[tuple[Doc, int, int]]) -> Iterator[Piece]:
        offset = 0
        for (name, ids), start, take in pieces:
            yield name, start, take, zlib.crc32(ids[start : start + take].astype("<u4")), len(ids), self.number, offset
            offset += take
        self.number += 1

    def add(self, doc: Doc) -> Iterator[Piece]:
        start, size = 0, len(doc[1])
        while start < size:
            if self.seed is None:
                self.seed = doc
            take = min(self.room, size - start)
            self.window.append((doc, start, take))
            start, self.room = start + take, self.room - take
            if not self.room:
                yield from self._close(self.window)
                self.window, self.room, self.seed = [], self.length, None

    def shard(self, held: list[Doc], corpus: Corpus) -> Iterator[Piece]:
        index, unused, at = Index([x for _, x in held], corpus), np.ones(len(held), bool), 0
        place = {id(doc): d for d, doc in enumerate(held)}  # a seed may be of another shard
        while True:
            if self.seed is None:
                while at < len(held) and not unused[at]:
                    at += 1
                if at == len(held):
                    return
                unused[at] = False
                yield from self.add(held[at])
                continue
            free = np.flatnonzero(unused)
            if not len(free):
                return
            index.keep(free)
            score, seed = index.scores(self.seed[1], place.get(id(self.seed)))[free], self.seed
            for d in free[np.argsort(-score, kind="stable")].tolist():
                unused[d], number = False, self.number
                yield from self.add(held[d])
                if self.number != number or self.seed is not seed:
                    break

    def finish(self) -> Iterator[Piece]:
        """The last window, cut at powers of two."""
        total, part = self.length - self.room, []
        room = 1 << (total.bit_length() - 1) if total else 0
        for doc, start, size in self.window:
            while size:
                take = min(room, size)
                part.append((doc, start, take))
                start, size, room, total = start + take, size - take, room - take, total - take
                if not room:
                    yield from self._close(part)
                    part, room = [], 1 << (total.bit_length() - 1) if total else 0
        self.window, self.room, self.seed = [], self.length, None


def piece_batch(found: list[Piece]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pieces(docs: DataFrame, path: str, length: int, schema: str) -> DataFrame:
    """One row per piece."""
    kind = width(path)
    rows = materialise(encoded(docs, path), "ids", compression="zstd")
    corpus = statistics(rows, vocabulary_size(path))
    held = rows.filter("counts IS NULL").drop("counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, some, size = Windows(length, TaskContext.get().partitionId() << 36), [], 0
        for batch in small(batches, 256):
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                some.append((name, np.frombuffer(ids, kind)))
                size += len(some[-1][1])
                if len(some) >= SHARD_DOCS or size >= SHARD_IDS:
                    yield piece_batch(list(windows.shard(some, corpus)))
                    some, size = [], 0
        if some:
            yield piece_batch(list(windows.shard(some, corpus)))
        yield piece_batch(list(windows.finish()))

    return routed(held, corpus, kind).mapInArrow(run, schema)
