"""Approximate nearest neighbours: a hash-prefix forest in shards.

Vectors are dealt over shards by a hash of their id, so a shard's size is bounded and no cluster or
copy group lands in one task. A shard keeps, for each of ``TREES`` trees, its vectors' hash strings
(``BITS`` random projections, each cut at its median over the shard) as one sorted array. A query descends
every tree to its longest matching prefix by binary search, then all trees ascend together, one bit
at a time, and the ranges under the shorter prefixes are united until a share ``CANDIDATES`` of the shard
(and ``LEAST`` vectors) have been met. Candidates are ranked by exact distance, a shard returns its k best, and a window
merges them.

Queries meet shards in a grid: a block of ``QUERY_BLOCK`` queries and a shard make one group. The
number of groups is shards times blocks; a group's memory is constant.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do null ids; repeated rows (same id and vector) count once; vectors only meet vectors of their own
length, of any length; ties in distance go to the smaller vec_id; with fewer candidates than k all are returned;
other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marsad.llm.common import table

TREES, BITS, SEED = 64, 32, 11
SHARD, QUERY_BLOCK = 8192, 4096
#: Share of a shard, and least number, that a query ascends to.
K = 10
CANDIDATES, LEAST = 0.5, 25 * K
_OUT = "query_id long, vec_id long, score double"


class Forest:
    """Sorted arrays of hash strings over one shard."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * bits))
        self.middle = np.median(x @ self.planes, axis=0)
        h = self.strings(x)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, 1)
        self.n = len(x)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings, the first bit highest: an array of unsigned integers for each tree."""
        signs = (x @ self.planes > self.middle).reshape(len(x), self.trees, self.bits)
        return (signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T.copy()

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix length, tree and query: begin and end in the tree's sorted array."""
        h = self.strings(q)
        lo = np.empty((self.bits + 1, self.trees, len(q)), np.int32)
        hi = lo.copy()
        for length in range(self.bits + 1):
            tail = (1 << (self.bits - length)) - 1
            for t in range(self.trees):
                lo[length, t] = np.searchsorted(self.sorted[t], h[t] & ~tail, "left")
                hi[length, t] = np.searchsorted(self.sorted[t], h[t] | tail, "right")
        return lo, hi

    def candidates(self, q: np.ndarray, least: int) -> list[np.ndarray]:
        """For each query, what the trees meet when they ascend together to ``least`` vectors."""
        lo, hi = self.ranges(q)
        met = (hi - lo).sum(1, dtype=np.int64)
        out = []
        for i in range(len(q)):
            seen = np.zeros(self.n, bool)
            start = int(np.flatnonzero(met[:, i] >= min(least, self.n))[-1])  # shorter prefixes meet more
            for length in range(start, -1, -1):
                for t in range(self.trees):
                    seen[self.order[t, lo[length, t, i] : hi[length, t, i]]] = True
                found = np.flatnonzero(seen)
                if len(found) >= least:
                    break
            out.append(found)
        return out


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(t.num_rows, -1)


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            x, ids = _matrix(vectors), vectors.column("id").to_numpy()
            q, qids = _matrix(queries), queries.column("id").to_numpy()
            forest = Forest(x)
            least = max(LEAST, int(CANDIDATES * len(x)))
            for at in range(0, len(q), 256):
                for i, found in enumerate(forest.candidates(q[at : at + 256], least)):
                    found = found[ids[found] != qids[at + i]]
                    score = np.sqrt(((x[found] - q[at + i]) ** 2).sum(1))
                    best = np.lexsort((ids[found], score))[:k]
                    out[0].append(np.full(len(best), qids[at + i]))
                    out[1].append(ids[found][best])
                    out[2].append(score[best])
        parts = [np.concatenate([np.empty(0, t), *o]) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table([pa.array(p) for p in parts], ["query_id", "vec_id", "score"])

    return run


def usable(v: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, chosen: Column, k: int = K, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows (vec_id, embedding) that ``chosen`` names."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").alias("id"), v.alias("v"), F.size(v).alias("dim"), chosen.alias("chosen")).distinct()
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("chosen"), 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // block))
    spread = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    dealt = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    left = rows.select("id", "v", "dim", dealt(shards, "shard").alias("shard"), spread(blocks, "block"))
    right = rows.filter("chosen").select("id", "v", "dim", dealt(blocks, "block").alias("block"), spread(shards, "shard"))
    keys = ["dim", "shard", "block"]
    take = ["id", "v", *keys]
    found = left.select(*take).groupBy(*keys).cogroup(right.select(*take).groupBy(*keys)).applyInArrow(_search(k), _OUT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
