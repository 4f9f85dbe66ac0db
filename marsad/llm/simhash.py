"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside buckets, connected components.

1. Fingerprints: a pass without shuffle; bit i is set if over half of the shingle hashes have it.
2. Exact copies of a fingerprint collapse to one node before anything is compared.
3. 64 bits are cut into 5 blocks. Two fingerprints at distance 3 or less agree on 2 of the 5 blocks
   at least, so each goes to 10 buckets keyed by a pair of blocks (25 or 26 bits). A bucket with
   more than ``HOT`` nodes is split by the bits left, in 4 parts of which one agrees, and again, until
   18 bits are left. Distances are thus only taken within buckets, and no link is lost.
4. In a bucket, bit planes are stored vertically (bit b of all nodes in one bit set). A node is
   compared with all at once: carry-save counters (ones, twos, four or more) take the differing
   planes one after another, and a block of 512 nodes is abandoned once all of it exceeds the radius.
   A search from node to node within a bucket gives its connected groups; only (node, smallest node of
   its group) leaves the task, so output is linear however many pairs a group has.
5. Components: smallest label among neighbours, with pointer jumping, each round written to the
   shared folder. Joins on a fingerprint, a neighbour or a component that holds a thousandth of all
   rows or more are spread over salts.

Defined cases: null or blank text has fingerprint zero, linked like any other; null ids are carried
and never are a component's id unless all are null; repeated rows are one node; a bit set in exactly half
of the hashes (a tie) is 0; very long texts are hashed whole, their bits counted a part at a time; other
columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.llm.common import discard, hot_keys, materialise, small, spread_join, table

RADIUS, SEED, SHINGLE = 3, 42, 3
#: (shift, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HOT = 4096
#: Groups up to so many nodes are compared as lists of pairs, larger ones node by node.
FEW = 24
#: Words of 64 nodes in a block that is abandoned as a whole, and levels of ever finer buckets.
WORDS, LEVELS = 8, 4
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        part = np.ascontiguousarray(h[i : i + _CHUNK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fp = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of ``x``: 64 x blocks x words of packed bits, 64 nodes to a word."""
    bits = np.unpackbits(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    pad = -packed.shape[1] % (8 * WORDS)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64).reshape(64, -1, WORDS)


def _within(planes: np.ndarray, n: int, want: int = 0) -> tuple[np.ndarray, int]:
    """Bit set of those of ``n`` nodes at distance 3 or less from ``want``, and how many planes of blocks were read.

    Carry-save counters hold each node's distance (ones, twos, and over: four or more). A block is
    abandoned as soon as all of its nodes are over; places beyond ``n`` count as over from the start.
    """
    blocks = planes.shape[1]
    out = np.packbits(np.arange(blocks * WORDS * 64) >= n, bitorder="little").view(np.uint64).reshape(blocks, WORDS)
    over, live, read = out.copy(), np.arange(blocks), 0
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for b in range(64):
        plane = planes[b] if len(live) == blocks else planes[b, live]
        d = plane ^ _FULL if want >> b & 1 else plane
        read += len(live)
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if b % 4 == 3 and b > 6:
            going = (over != _FULL).any(1)
            if not going.all():
                out[live[~going]] = _FULL
                live, ones, twos, over = live[going], ones[going], twos[going], over[going]
                if not len(live):
                    break
    out[live] = over
    return ~out.ravel(), read


def _members(bitset: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitset.view(np.uint8), bitorder="little")[:n])


def pair_links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are within the radius; all pairs at once, bit-sliced."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 17):
        x = a[i : i + (1 << 17)] ^ b[i : i + (1 << 17)]
        out[i + _members(_within(_planes(x), len(x))[0], len(x))] = True
    return out


def group_links(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """(members, smallest member) of each connected group of two or more in one bucket."""
    left = np.sort(x)
    while len(left) > 1:
        planes, alive = _planes(left), np.ones(len(left), bool)
        rest = np.packbits(alive, bitorder="little")
        rest = np.pad(rest, (0, -len(rest) % (8 * WORDS))).view(np.uint64)
        gone = 0
        for root in range(len(left)):
            if not alive[root]:
                continue
            front, group = [root], [root]
            alive[root] = False
            rest[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
            while front:
                near = _members(_within(planes, len(left), int(left[front.pop()]))[0] & rest, len(left))
                if len(near):
                    alive[near] = False
                    np.bitwise_and.at(rest, near >> 6, ~(np.uint64(1) << (near & 63).astype(np.uint64)))
                    front += near.tolist()
                    group += near.tolist()
            gone += len(group)
            if len(group) > 1:
                yield left[group], left[root]
            if gone > 64 and 2 * gone > len(left):  # pack what is left
                break
        left = left[alive]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> (a, b) links, b the smallest node of a's group in the bucket."""
    carry_k, carry_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        x = f.view(np.uint64)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        size = np.diff(cut)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for m in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
            first = cut[:-1][size == m]
            i, j = np.triu_indices(m, 1)
            left, right = x[first[:, None] + i].ravel(), x[first[:, None] + j].ravel()
            good = pair_links(left, right)
            lo, hi = np.minimum(left, right)[good], np.maximum(left, right)[good]
            a.append(hi)
            b.append(lo)
        for g in np.flatnonzero(size > FEW).tolist():
            for members, root in group_links(np.unique(x[cut[g] : cut[g + 1]])):
                a.append(members[members != root])
                b.append(np.full(len(members) - 1, root))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        k = np.concatenate((carry_k, batch.column("key").to_numpy()))
        f = np.concatenate((carry_f, batch.column("fp").to_numpy()))
        if not len(k):
            continue
        end = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
        if end:
            yield links(k[:end], f[:end])
        carry_k, carry_f = k[end:], f[end:]
    if len(carry_k):
        yield links(carry_k, carry_f)


def masks() -> list[list[int]]:
    """Bits that a bucket's nodes share at each level; entry p of a level has entries 4p to 4p + 3 of the next.

    At distance 3 or less, two of five blocks agree, so a node goes to ten buckets. In each, the bits left
    fall into four parts of which one agrees, so a hot bucket gives way to four finer ones, and so on.
    """
    out = [[sum(((1 << w) - 1) << s for s, w in pair) for pair in combinations(BLOCKS, 2)]]
    while len(out) < LEVELS:
        finer = []
        for mask in out[-1]:
            left = [1 << b for b in range(64) if not mask >> b & 1]
            cut = [len(left) * q // 4 for q in range(5)]
            finer += [mask | sum(left[x:y]) for x, y in zip(cut, cut[1:])]
        out.append(finer)
    return out


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, fp: ten keys for each node; four finer ones in place of a hot key, again and again.

    On the last level a bucket's nodes share all but 18 bits, so it has a bound.
    """
    signed = [[m - (1 << 64) if m >> 63 else m for m in level] for level in masks()]
    rows, out = nodes.select("fp", F.lit(0).alias("path")), []
    for level, shared in enumerate(signed):
        some, first = (10, F.lit(0)) if not level else (4, F.col("path") * 4)
        rows = rows.select("fp", F.explode(F.sequence(first, first + some - 1)).alias("path"))
        mask = F.element_at(F.array(*map(F.lit, shared)).cast("array<long>"), F.col("path") + 1)
        rows = rows.select("fp", "path", F.xxhash64(F.lit(level), "path", F.col("fp").bitwiseAND(mask)).alias("key"))
        if level == LEVELS - 1:
            out.append(rows)
            break
        hot = materialise(rows.groupBy("key").count().filter(F.col("count") > HOT).select(F.col("key").alias("hot")), "hot")
        if hot.isEmpty():
            out.append(rows)
            break
        out.append(rows.join(hot, rows.key == hot.hot, "left_anti"))
        rows = rows.join(hot, rows.key == hot.hot, "left_semi")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("key", "fp")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes (column fp) as all pairs within the radius do."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _buckets(nodes).repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(_compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, comp (smallest connected fp) for every fp in a link.

    Links are stars, so a node may have very many neighbours, and many nodes one target: joins on
    either are spread over salts.
    """
    both = materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "links")
    hot = hot_keys(both, "y")
    label = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).select(F.col("x").alias("fp"), "comp"), "label")
    while True:
        near = spread_join(both, "y", ["x"], label, "fp", hot=hot).groupBy("x").agg(F.min("comp").alias("near"))
        step = materialise(label.join(near, label.fp == near.x, "left").select("fp", "comp", F.least("comp", "near").alias("next")), "step")
        up = step.select(F.col("fp").alias("up"), F.col("next").alias("far"))  # pointer jumping
        jumped = spread_join(step, "next", ["fp"], up, "up", "left").select("fp", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved"))
        last, label = label, materialise(jumped, "label")
        discard(last)
        discard(step)
        still = label.filter("moved").isEmpty()
        label = label.select("fp", "comp")
        if still:
            return label


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    prints = materialise(fingerprints(docs), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(links(nodes.select("fp"))).withColumnRenamed("fp", "of")
    named = materialise(nodes.join(label, nodes.fp == label.of, "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp")), "named")
    best = named.groupBy("comp").agg(F.min("first").alias("component_id")).withColumnRenamed("comp", "root")
    ids = spread_join(named, "comp", ["fp"], best, "root").select(F.col("fp").alias("node"), "component_id")
    return spread_join(prints, "fp", ["doc_id"], ids, "node").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
