"""Near copies by exact Jaccard similarity of word shingles, joined to the SimHash links.

1. A document is its set of distinct 5-word shingles (lower case; a shorter text is one shingle).
   Equal sets are one node.
2. All sets are ordered alike, rare shingles first by a sketch of shingle counts. Two sets of
   similarity ``LEAST`` or more share a shingle among the first size - ceil(LEAST * size) + 1 of
   each, so a group by those shingles meets every such pair; sizes and positions rule out most
   others. Pairs that SimHash links join already are left out, since only components count. No
   other pair is lost, whatever its SimHash distance.
3. Candidates are compared as whole sets; those at ``LEAST`` or more are links.
4. A group over ``BIG`` rows isn't paired: its rows leave their task as they come, in blocks. A round sends each
   node to one of its groups, where it meets a few neighbours, while rounds make components one. Then groups with
   several components left are compared as whole sets, block by block, in the task that holds both blocks: an exact
   product of their shingles. Only links that make two components one leave it, so no link between components is lost,
   and neither rows moved nor rows made grow with the square of a group (its comparisons do, inside the task).
5. SimHash components that hold rows of one node, or linked nodes, become one.

Null or blank text is the empty set, equal to itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marsad.llm import simhash
from marsad.llm.common import discard, materialise, small, spread_join

LEAST, WORDS = 0.8, 5
SLOTS, PARTS = 1 << 18, 16
MARKS = 1 << 22
_CACHE = 1 << 18
_PAIRS = 1 << 20
#: Groups over so many rows are not paired at once: rounds of ``NEAR`` neighbours in blocks of so many rows.
BIG, NEAR, BLOCK, ROUNDS = 64, 3, 512, 6
#: After the rounds a group is cut into ``CUTS`` blocks, but none under or over so many shingles (1 and 32 MB).
CUTS, LITTLE, MUCH = 16, 1 << 17, 1 << 22
#: A product of sets: so many columns at once; a shingle of fewer pairs is counted pair by pair.
_COLUMNS, _DENSE = 2048, 1536
#: So many nodes are broadcast (2 MB) to pick their sets.
FEW = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > _CACHE:
        cache.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    width = min(WORDS, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return np.unique(_mix(out))


def node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp, node of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            fp = np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts))
            nodes = np.fromiter((node(shingles(t, cache)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), _long(fp), _long(nodes)], ["doc_id", "th", "fp", "node"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long, node long")


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Documents per slot of shingle hashes; only an order is taken from it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cache = np.zeros(SLOTS, np.int64), {}
        for batch in small(batches):
            for t in batch.column("text").to_pylist():
                np.add.at(total, (shingles(t, cache) >> np.uint64(46)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in total.reshape(PARTS, -1)])], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])], ["part", "counts"])

    kind = "part int, counts binary"
    out = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for r in docs.select("text").mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect():
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def marked(nodes: DataFrame) -> np.ndarray:
    """``MARKS`` bits, that of every row's node set: 512 KB whatever the input, put together on the executors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[batch.column("node").to_numpy() % MARKS] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([np.packbits(p).tobytes() for p in bits.reshape(PARTS, -1)])], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                total[part] = total.get(part, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])], ["part", "bits"])

    kind = "part int, bits binary"
    out = np.zeros((PARTS, MARKS // 8 // PARTS), np.uint8)
    for r in nodes.mapInArrow(mark, kind).repartition(PARTS, "part").mapInArrow(merge, kind).collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, counts: np.ndarray, least: DataFrame) -> DataFrame:
    """h, node, size, pos, g: the first shingles of each set, in the common order; g from ``least`` (node, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in small(batches, 256):
            h, nodes, size = [], [], []
            for t in batch.column("text").to_pylist():
                x = shingles(t, cache)
                if len(x):
                    n = len(x) - -int(-(4 * len(x)) // 5) + 1
                    first = x[np.argsort(counts[(x >> np.uint64(46)).astype(np.int64)], kind="stable")[:n]]
                    h.append(first.view(np.int64))
                    nodes.append(node(x))
                    size.append(len(x))
            if h:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, h)]), pa.int32()), pa.array(np.concatenate(h)))
                yield pa.RecordBatch.from_arrays([_long(np.array(nodes, np.uint64)), pa.array(size, pa.int32()), lists], ["node", "size", "hs"])

    rows = docs.select("text").mapInArrow(run, "node long, size int, hs array<long>").join(least.withColumnRenamed("least", "g"), "node").dropDuplicates(["node"])
    return rows.select("node", "size", "g", F.posexplode("hs").alias("pos", "h"))


def _pairs(h: np.ndarray, nodes: np.ndarray, size: np.ndarray, pos: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by h and size; a row meets the later ones of its group that are not too long."""
    n = len(h)
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    end = np.repeat(cut[1:], np.diff(cut))
    group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    # Rows are sorted by (group, size): those up to 5/4 of the own size end here.
    top = int(size.max()) * 2 + 2
    end = np.minimum(end, np.searchsorted(group * top + size, group * top + size * 5 // 4, "right"))
    many = end - np.arange(n) - 1
    i, total = 0, np.concatenate(([0], np.cumsum(many)))
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
        m = many[i:j]
        a = np.repeat(np.arange(i, j), m)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], m)
        rest = np.minimum(size[a] - pos[a], size[b] - pos[b])
        good = (9 * rest >= 4 * (size[a] + size[b])) & (g[a] != g[b])
        x, y = nodes[a[good]], nodes[b[good]]
        if len(x):
            found = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        i = j


def _meet(batches: Iterator[pa.RecordBatch], big: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h and size -> pairs of small groups (h null); rows of groups over ``big`` as they come, numbered in their group, with the shingles up to them."""
    names = ("h", "node", "size", "pos", "g")
    held, hot, seen, upto = None, None, 0, 0

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found in _pairs(*rows):
            none = pa.nulls(found.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*found.columns, *[none] * 5], ["a", "b", "h", "size", "pos", "ord", "upto"])

    def rows_of(x: list[np.ndarray], first: int, before: int) -> pa.RecordBatch:
        h, nodes, size, pos, g = map(pa.array, x)
        return pa.RecordBatch.from_arrays([nodes, g, h, size, pos, pa.array(np.arange(first, first + len(x[0]))), pa.array(before + np.cumsum(x[2]))], ["a", "b", "h", "size", "pos", "ord", "upto"])

    for batch in batches:
        now = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        h = held[0]
        if not len(h):
            continue
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        small_, last = np.ones(len(h), bool), int(cut[-2])
        for i in np.flatnonzero((np.diff(cut) > big) | (h[cut[:-1]] == hot if hot is not None else False)).tolist():
            x, y = int(cut[i]), int(cut[i + 1])
            seen, upto = (seen, upto) if h[x] == hot else (0, 0)
            yield rows_of([c[x:y] for c in held], seen, upto)
            hot, seen, upto = h[x], seen + y - x, upto + int(held[2][x:y].sum())
            small_[x:y] = False
        done = small_.copy()
        done[last:] = False  # the last group may go on
        if done.any():
            yield from pairs([c[done] for c in held])
        rest = small_ & ~done
        held = [c[rest] for c in held]
    if held is not None and len(held[0]):
        yield from pairs(held)


def _grouped(rows: DataFrame, keys: list[str], order: list[str], run) -> DataFrame:
    """a, b: what ``run`` makes of rows (h, node, size, pos, g, side), h a key of each group, whole groups at a time."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ("h", "node", "size", "pos", "g", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
            x = held[0]
            end = int(np.flatnonzero(x != x[-1])[-1]) + 1 if len(x) and (x != x[-1]).any() else 0
            if end:
                yield from run(*(c[:end] for c in held))
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield from run(*held)

    rows = rows.withColumn("h", F.xxhash64(*keys)).repartition(parts, "h").sortWithinPartitions("h", *order)
    return rows.select(*names).mapInArrow(meet, "a long, b long").distinct()


def _neighbours(h: np.ndarray, nodes: np.ndarray, size: np.ndarray, pos: np.ndarray, g: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row with the next ``NEAR`` of its group: linear in the rows."""
    for d in range(1, min(NEAR, len(h) - 1) + 1):
        a, b = np.arange(len(h) - d), np.arange(d, len(h))
        rest = np.minimum(size[a] - pos[a], size[b] - pos[b])
        good = (h[a] == h[b]) & (g[a] != g[b]) & (9 * rest >= 4 * (size[a] + size[b]))
        x, y = nodes[a[good]], nodes[b[good]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _near(packed: DataFrame, of: DataFrame, turn: int) -> DataFrame:
    """Candidates of one round: each node goes to one of its groups, alike nodes mostly to the same, and meets a few of like size there."""
    one = F.array_min(F.transform("at", lambda x: F.struct(F.xxhash64(x["h"], F.lit(turn)).alias("k"), x["h"].alias("h"), x["pos"].alias("pos"), x["ord"].alias("ord"))))
    rows = packed.select("node", "size", one.alias("p")).join(of, "node").select("node", "g", "size", "p.h", "p.pos", "p.ord")
    rows = rows.withColumn("side", F.floor((F.col("ord") + turn * BLOCK // 2) / BLOCK)).withColumn("turn", F.xxhash64("node", F.lit(turn)))
    return _grouped(rows, ["h", "side"], ["turn"], _neighbours)


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` has in common with each of ``y``: a product of sets, exact."""
    hx, hy = np.concatenate(x), np.concatenate(y)
    some = np.intersect1d(hx, hy)
    total = np.zeros((len(x), len(y)), np.int64)
    if not len(some):
        return total

    def entries(h: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin and number of each column's) of entries by column."""
        row, col = np.repeat(np.arange(len(sets)), [len(v) for v in sets]), np.minimum(np.searchsorted(some, h), len(some) - 1)
        good = some[col] == h
        row, col = row[good], col[good]
        count = np.bincount(col, minlength=len(some))
        return row[np.argsort(col, kind="stable")], np.cumsum(count) - count, count

    (rx, ax, cx), (ry, ay, cy) = entries(hx, x), entries(hy, y)
    many = cx * cy
    dense = np.flatnonzero(many >= _DENSE)
    for i in range(0, len(dense), _COLUMNS):
        c = dense[i : i + _COLUMNS]
        left, right = np.zeros((len(x), len(c)), np.float32), np.zeros((len(y), len(c)), np.float32)
        for of, r, begin, count in ((left, rx, ax, cx), (right, ry, ay, cy)):
            n = count[c]
            of[r[np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], np.repeat(np.arange(len(c)), n)] = 1
        total += (left @ right.T).astype(np.int64)  # exact: sums of _COLUMNS at most
    rest = np.flatnonzero(many < _DENSE)
    upto, i = np.concatenate(([0], np.cumsum(many[rest]))), 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + _PAIRS, "right")) - 1)
        c, m = rest[i:j], many[rest[i:j]]
        k, col = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m), np.repeat(c, m)
        total += np.bincount(rx[ax[col] + k // cy[col]] * len(y) + ry[ay[col] + k % cy[col]], minlength=total.size).reshape(total.shape)
        i = j
    return total


def _joined(nodes: np.ndarray, g: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of two blocks (or within the only one) that make what all their links make one: fewer than there are components."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.lexsort((size, block))
    two = block[order[0]] != block[order[-1]]
    slices = [some[i : i + BLOCK] for b in np.unique(block) for some in [order[block[order] == b]] for i in range(0, len(some), BLOCK)]
    g, out = g.copy(), []
    for i, x in enumerate(slices):
        for y in slices[i:]:
            if two and block[x[0]] == block[y[0]] or 4 * max(size[x[0]], size[y[0]]) > 5 * min(size[x[-1]], size[y[-1]]):
                continue
            if (g[x] == g[x[0]]).all() and (g[y] == g[x[0]]).all():
                continue
            good = (9 * _shared([sets[k] for k in x], [sets[k] for k in y]) >= 4 * (size[x][:, None] + size[y])) & (g[x][:, None] != g[y])
            for a, b in np.argwhere(good).tolist():
                p, q = x[a], y[b]
                if g[p] != g[q]:
                    out.append((min(nodes[p], nodes[q]), max(nodes[p], nodes[q])))
                    g[g == g[q]] = g[p]
    return out


def _left(hot: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links that make what all links of ``hot`` make one, block by block; blocks within one component go. ``sets`` has those of nodes."""
    several = hot.groupBy("h").agg(F.min("g").alias("least"), F.max("g").alias("most"), F.max("upto").alias("total")).filter("least != most")
    several = several.select("h", F.least(F.greatest(F.col("total") / CUTS, F.lit(LITTLE)), F.lit(MUCH)).alias("per"))
    hot = materialise(hot.join(several, "h").select("h", "node", "g", "size", F.floor((F.col("upto") - 1) / F.col("per")).alias("block")), "blocks")
    blocks = hot.groupBy("h", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    blocks = materialise(blocks, "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = ~((F.col("x.g0") == F.col("x.g1")) & (F.col("y.g0") == F.col("y.g1")) & (F.col("x.g0") == F.col("y.g0")))
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") <= F.col("y.block")) & (4 * F.col("y.lo") <= 5 * F.col("x.hi")) & apart)
    both = materialise(both.select(F.col("x.h").alias("h"), F.col("x.block").alias("b1"), F.col("y.block").alias("b2")), "blocks")
    one = hot.join(both.withColumn("block", F.col("b1")), ["h", "block"])
    two = hot.join(both.filter("b1 < b2").withColumn("block", F.col("b2")), ["h", "block"])
    rows = one.unionByName(two).select(F.xxhash64("h", "b1", "b2").alias("key"), "h", "b1", "b2", "block", "node", "g")
    rows = rows.join(sets(hot.select("node").distinct()), "node")
    names = ("h", "b1", "b2", "node", "g", "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            links = _joined(*(np.array([r[i] for r in held], np.int64) for i in range(3)), found) if held else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([int(v[i]) for v in links], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in small(batches):
            columns = [batch.column(c).to_pylist() for c in names]
            for i, key in enumerate(zip(*columns[:3], strict=True)):
                if key != last:
                    yield from done()
                    last, held, found = key, [], []
                held.append((columns[3][i], columns[4][i], columns[5][i]))
                found.append(np.frombuffer(batch.column("held")[i].as_buffer(), np.uint64))
        yield from done()

    parts = max(1, int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "key").sortWithinPartitions("h", "b1", "b2")
    return rows.select(*names, "held").mapInArrow(meet, "a long, b long").distinct()


def _relabel(of: DataFrame, links: DataFrame) -> DataFrame:
    """``of`` (node, g) with components that ``links`` (a, b: nodes) connect made one."""
    edges = links.join(of.select(F.col("node").alias("a"), F.col("g").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("g").alias("y")), "b")
    label = simhash.components(edges.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).withColumnRenamed("fp", "to")
    now = materialise(spread_join(of, "g", ["node"], label, "to", "left").select("node", F.coalesce("comp", "g").alias("g")), "of")
    discard(of)
    return now


def similar(docs: DataFrame, least: DataFrame, big: int = BIG) -> DataFrame:
    """a, b: links of nodes at ``LEAST`` or more that connect what all such pairs do, with the names of ``least``."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = prefixes(docs, shingle_counts(docs), least).repartition(parts, "h").sortWithinPartitions("h", "size")
    met = materialise(rows.mapInArrow(lambda batches: _meet(batches, big), "a long, b long, h long, size long, pos long, ord long, upto long"), "met")
    pairs = materialise(met.filter("h IS NULL").select("a", "b").distinct(), "candidates")
    hot = met.filter("h IS NOT NULL").select("h", F.col("a").alias("node"), F.col("b").alias("g"), "size", "pos", "ord", "upto")
    marks = marked(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        wanted = np.unpackbits(marks)
        for batch in small(batches, 256):
            found = [shingles(t, cache) for t in batch.column("text").to_pylist()]
            nodes = np.fromiter(map(node, found), np.uint64, len(found)).view(np.int64)
            good = np.flatnonzero(wanted[nodes % MARKS])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[good]), pa.array([found[i].tobytes() for i in good.tolist()], pa.binary())], ["node", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 5 * both >= 4 * (len(x) + len(y) - both)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    held = materialise(docs.select("text").mapInArrow(sets, "node long, held binary").dropDuplicates(["node"]), "sets")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # Sets are many times as large as all else here: those that no pair names needn't move.
        return held.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= FEW else held

    def linked(pairs: DataFrame) -> DataFrame:
        nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
        some = sets_of(nodes)
        rows = pairs.join(some.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
        out = materialise(rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")
        discard(nodes)
        return out

    found = linked(pairs)
    if not hot.isEmpty():
        packed = materialise(hot.groupBy("node").agg(F.min("g").alias("g"), F.min("size").alias("size"), F.collect_list(F.struct("h", "pos", "ord")).alias("at")), "packed")
        of = _relabel(materialise(packed.select("node", "g"), "of"), found)
        for turn in range(ROUNDS):
            near = materialise(_near(packed, of, turn), "near")
            more = linked(near)
            discard(near)
            if more.isEmpty():
                break
            found, of = found.union(more), _relabel(of, more)
        found = found.union(materialise(_left(hot.drop("g").join(of, "node"), sets_of), "left"))
        discard(packed)
    discard(met)
    discard(held)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, comp for every row of ``docs`` (doc_id, text): rows of one comp are near copies."""
    rows = materialise(prints(docs), "prints")
    label = simhash.components(simhash.links(rows.select("fp").distinct())).withColumnRenamed("fp", "of")
    rows = spread_join(rows, "fp", ["doc_id", "th"], label, "of", "left").select("doc_id", "th", "node", F.coalesce("comp", "fp").alias("g"))
    rows = materialise(rows, "rows")
    least = materialise(rows.groupBy("node").agg(F.min("g").alias("least")), "least")
    within = rows.select("node", "g").distinct().join(least, "node").filter(F.col("g") != F.col("least")).select(F.col("g").alias("a"), F.col("least").alias("b"))
    across = similar(docs, least).join(least.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
    across = across.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = simhash.components(within.union(across).distinct()).withColumnRenamed("fp", "of")
    return spread_join(rows, "g", ["doc_id", "th"], label, "of", "left").select("doc_id", "th", F.coalesce("comp", "g").alias("comp"))
