"""Packing token ids into sequences by best-fit decreasing, and the queries of both packings.

Best fit works on shards: the documents that one task reads, up to ``BFD_DOCS`` documents or
``SHARD_IDS`` ids. Nothing is shuffled and a shard's memory is bounded, so its cost is linear in the
input. Its sequence numbers are the task's number and a counter in it. A document longer than a sequence
gives full sequences and a rest, so nothing is lost; pieces go, longest first, to the sequence with the
least room that is enough, which a segment tree over room finds.

Packing by lexical retrieval is in ``retrieval``.

Defined cases: null text is empty (its final id alone), null ids are carried, repeated rows are packed
each, ties (pieces of one size) go in order of arrival, very long texts are cut into whole sequences, an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from marsad.llm import retrieval
from marsad.llm.bpe import encoder, vocabulary_path
from marsad.llm.common import scratch, small, table

LENGTH, END = 2048, 1
SHARD_IDS, BFD_DOCS = 4_000_000, 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: doc, start, length, sequence, offset
Piece = tuple[int, int, int, int, int]


def shards(batches: Iterator[pa.RecordBatch], path: str, docs: int, most: int = SHARD_IDS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc ids, their token ids with the final one) of one shard after another."""
    e, names, held, size = encoder(path), [], [], 0
    for batch in batches:
        every, at = batch.column("doc_id").to_pylist(), 0
        for ids, offsets in e.batch(batch.column("text")):
            ids = np.insert(ids, offsets[1:], END).astype("<u4")
            edges = (offsets + np.arange(len(offsets))).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                names.append(every[at])
                held.append(ids[a:b])
                at, size = at + 1, size + b - a
                if len(held) >= docs or size >= most:
                    yield names, held
                    names, held, size = [], [], 0
    if held:
        yield names, held


class Rooms:
    """Segment tree over room 0..length: which sequence has the least room that is enough."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.some = bytearray(2 * self.base)
        self.held: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        node = self.base + room
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``need``."""
        some, node = self.some, self.base + need
        if not some[node]:
            while node > 1 and (node & 1 or not some[node + 1]):  # up, until there is a right neighbour
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.base
        sequence = self.held[room].pop()
        if not self.held[room]:
            some[node] = 0
            while node > 1 and not (some[node] or some[node ^ 1]):
                node >>= 1
                some[node] = 0
        return room, sequence


def best_fit_pack(held: list[np.ndarray], length: int = LENGTH) -> list[Piece]:
    """Pieces of one shard by best-fit decreasing."""
    pieces, out, n = [], [], 0
    for d, x in enumerate(held):
        size = len(x)
        for start in range(0, size - length + 1, length):
            out.append((d, start, length, n, 0))
            n += 1
        if size % length:
            pieces.append((size % length, d, size - size % length))
    rooms = Rooms(length)
    for size, d, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        got = rooms.take(size)
        if got is None:
            got, n = (length, n), n + 1
        room, sequence = got
        out.append((d, start, size, sequence, length - room))
        if room > size:
            rooms.put(room - size, sequence)
    return sorted(out, key=lambda p: p[3:])


def retrieval_pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of retrieval packing, with neighbours from the whole table."""
    return retrieval.pieces(docs, path, LENGTH, PIECES)


MATRIX = "sequence_id long, n_ids int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>, doc_tokens array<long>"


def matrices(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per best-fit sequence.

    ids: ``length`` little-endian unsigned ids of ``retrieval.width(path)``, zero after the first n_ids; cu_seqlens:
    0 and the end of each piece; positions: as many 16-bit positions (32-bit if ``length`` needs them), from
    0 again in each piece; doc_ids, starts, doc_tokens: document, first id and size of the document for
    each piece.
    """
    kind, place = retrieval.width(path), "<u2" if length <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for names, held in shards(batches, path, BFD_DOCS):
            found = best_fit_pack(held, length)
            cuts = [i for i, p in enumerate(found) if p[4] == 0]  # where sequences begin
            for i in range(0, len(cuts), 512):  # some MB at a time
                end = cuts[i + 512] if i + 512 < len(cuts) else len(found)
                yield _matrix(names, held, found[cuts[i] : end], length, base, kind, place)
            base += len(cuts)

    return docs.select("doc_id", "text").mapInArrow(run, MATRIX)


def _matrix(names: list, held: list[np.ndarray], found: list[Piece], length: int, base: int, kind: str, place: str) -> pa.RecordBatch:
    doc, start, size, sequence, offset = (np.array(c) for c in zip(*found, strict=True))
    first = np.flatnonzero(offset == 0)
    row = np.cumsum(offset == 0) - 1
    ids = np.zeros((len(first), length), kind)
    places = np.zeros((len(first), length), place)
    count = np.arange(length, dtype=place)
    for r, d, a, n, o in zip(row.tolist(), doc.tolist(), start.tolist(), size.tolist(), offset.tolist(), strict=True):
        ids[r, o : o + n] = held[d][a : a + n]
        places[r, o : o + n] = count[:n]
    edges = np.append(first, len(doc))
    total = np.add.reduceat(size, first)
    lists = pa.array(edges, pa.int32())
    ends = [[0, *(offset[a:b] + size[a:b]).tolist()] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    of = lambda x: pa.ListArray.from_arrays(lists, pa.array(x, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(base + sequence[first]), pa.array(total, pa.int32()), pa.array([x.tobytes() for x in ids]), pa.array(ends, pa.list_(pa.int32())), pa.array([x.tobytes() for x in places]), of([names[d] for d in doc]), of(start), of([len(held[d]) for d in doc])],
        ["sequence_id", "n_ids", "ids", "cu_seqlens", "positions", "doc_ids", "starts", "doc_tokens"],
    )


def write_matrices(docs: DataFrame, path: str, to: str, length: int = LENGTH) -> None:
    """Write the packed matrices as Parquet; each row is one fixed-size record of the matrix."""
    matrices(docs, path, length).write.option("compression", "zstd").parquet(to)


def matrix_pieces(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per piece of ``matrices``, with checksums taken from the packed ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            out: list[list] = [[] for _ in range(9)]
            for row in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "n_ids", "ids", "cu_seqlens", "positions", "doc_ids", "starts", "doc_tokens")), strict=True):
                sequence, n, ids, ends, places, names, starts, sizes = row
                x, p = np.frombuffer(ids, f"<u{len(ids) // length}").astype("<u4"), np.frombuffer(places, f"<u{len(places) // length}")
                for a, b, name, start, size in zip(ends[:-1], ends[1:], names, starts, sizes, strict=True):
                    for c, v in zip(out, (name, start, b - a, zlib.crc32(x[a:b]), size, sequence, a, n, bool(p[a] == 0 and p[b - 1] == b - a - 1)), strict=True):
                        c.append(v)
            types = [pa.int64()] * 8 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_ids", "resets"])

    return packed.mapInArrow(run, f"{PIECES}, sequence_ids long, resets boolean")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path())


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed matrices are written to the shared folder; the query's rows are read back from them."""
    to = scratch(spark, "matrices")
    write_matrices(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(), to)
    return matrix_pieces(spark.read.schema(MATRIX).parquet(to))
