"""Quality rules: counts over whole texts, base rules, and an isolation forest over rule statistics.

All labelled documents that pass the base rules take part. Each tree draws its ``SAMPLE`` rows from all of them, as the
method has it (Liu, Ting and Zhou 2008): those with the smallest hash of id and tree. A tree makes random splits over statistics of the
rules (word length, symbols, and marks with repeated words and repeated lines, by word) and the share of capitals; path
lengths are the score. Thresholds, one per length band, come from all labels, exactly: the lowest score that rejects no more
than ``CLEAN_LOSS`` of the good documents in that band, half way to the next bad one of the band. Texts are
not shuffled, only their statistics; the driver gets the trees (655 KB, whatever the input) and counts by 16 bits of scores.

Defined cases: null text has no words (and fails the base rule); null ids are carried, and a doc_id with several
texts or labels is fitted by the smallest of each; repeated rows are judged each; equal scores are judged alike; very
long texts are counted whole; with fewer than ``LEAST_LABELLED`` labelled documents that pass the base rules there is nothing
to calibrate with and the forest rejects nothing; a band with fewer than ``LEAST_IN_BAND`` good ones takes the
threshold of all bands; other columns are ignored (``keep`` carries them), whatever their names; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marsad.llm.common import discard, materialise, small, table

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
TREES, SAMPLE, SEED = 256, 64, 7
#: Upper ends of the length bands, in words.
BANDS = (60, 250)
CLEAN_LOSS = 0.001
LEAST_LABELLED, LEAST_IN_BAND = 50, 100
#: Words of usual text that every share is smoothed with.
PRIOR = 30
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
FEATURES = ("mean_word", "symbols", "upper", "noise")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MUL = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose id sequence occurs twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    x = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        h = x[:n].copy()
        for j in range(1, window):
            h *= _MUL
            h += x[j : n + j]
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the statistics of FEATURES for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeats = repeated_words(ids) if len(seen) < n else 0
    size = len(raw)
    less = lambda x: size - len(raw.translate(None, x))
    upper, lower, marks = map(less, (_UPPER, _LOWER, _MARKS))
    # Shares are drawn towards usual values with the weight of PRIOR words, or short texts would
    # be anomalies for their small counts alone.
    weight = n + PRIOR
    stats = (
        (chars + 5 * PRIOR) / weight,
        symbols / weight,
        upper / max(1, upper + lower) * n / weight,
        # Repeated words and lines count with the marks: by themselves, nearly always zero, a random
        # split on them would part any text that repeats a little from all others.
        (marks + repeats + dup + 0.15 * PRIOR) / weight,
    )
    return (n, chars, symbols, dup, repeats), stats


class Forest:
    """Isolation forest (Liu, Ting and Zhou 2008) in flat arrays: one row per node and tree; ``n`` rows to fit it with."""

    def __init__(self, n: int, trees: int = TREES, sample: int = SAMPLE):
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, n))))))
        size = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, size), np.int32)
        self.split = np.full((trees, size), np.inf)
        self.length = np.zeros((trees, size))
        self.usual = self.expected(min(sample, n))

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, rng) -> None:
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
        if depth == self.depth or len(rows) < 2 or len(spread) == 0:
            self._leaf(t, node, depth, depth + self.expected(len(rows)))
            return
        f = int(rng.choice(spread))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[t, node], self.split[t, node] = f, at
        left = rows[:, f] <= at
        self._grow(t, 2 * node, rows[left], depth + 1, rng)
        self._grow(t, 2 * node + 1, rows[~left], depth + 1, rng)

    def _leaf(self, t: int, node: int, depth: int, length: float) -> None:
        """A leaf above the last level is carried down its left edge (split is infinite there)."""
        while depth < self.depth:
            node, depth = 2 * node, depth + 1
        self.length[t, node] = length

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(len(self.split)):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (rows[every, self.feature[t, node]] > self.split[t, node])
            total += self.length[t, node]
        return np.exp2(-total / len(self.split) / max(self.usual, 1e-9))


def _mixed(ids: np.ndarray, tree: int) -> np.ndarray:
    """A hash of id hashes and a tree; one to one for each tree."""
    x = ids.view(np.uint64) ^ np.uint64((tree + 1) * int(_MUL) % 2**64)
    with np.errstate(over="ignore"):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def grow(labelled: DataFrame, n: int) -> Forest:
    """The forest over all ``n`` rows (id, x): a tree's rows are those with the smallest hashes, whatever the partitions."""
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def least(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)[:SAMPLE] if len(h) <= 4 * SAMPLE else (near := np.argpartition(h, SAMPLE)[:SAMPLE])[np.argsort(h[near])]
        return h[order], x[order]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64), np.empty((0, len(FEATURES)))
        best = [none] * TREES
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)
            for t in range(TREES):
                h, mine = least(_mixed(ids, t), x)
                best[t] = least(np.concatenate((best[t][0], h)), np.concatenate((best[t][1], mine)))
        for t, (h, x) in enumerate(best):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["tree", "h", "x"])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for t, h, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, x = np.frombuffer(h, np.uint64), np.frombuffer(x).reshape(-1, len(FEATURES))
                if t in best:
                    h, x = np.concatenate((best[t][0], h)), np.concatenate((best[t][1], x))
                best[t] = least(h, x)
        for t, (_, x) in best.items():
            one = Forest(n, 1)
            one._grow(0, 1, x, 0, np.random.default_rng((SEED, t)))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (one.feature, one.split, one.length)]], ["tree", "feature", "split", "length"])

    forest = Forest(n)
    drawn = labelled.select("id", *FEATURES).mapInArrow(draw, "tree int, h binary, x binary").repartition(min(parts, TREES), "tree")
    for r in drawn.mapInArrow(tree, "tree int, feature binary, split binary, length binary").collect():
        forest.feature[r.tree], forest.split[r.tree], forest.length[r.tree] = np.frombuffer(r.feature, np.int32), np.frombuffer(r.split), np.frombuffer(r.length)
    return forest


def thresholds(scored: DataFrame) -> np.ndarray:
    """Per length band, the score above which documents go; from all rows (band, good, bits: those of the score), exactly.

    The good score that stays at the edge is found by 16 bits a round, as scores are positive and order as their bits do.
    """
    good = {r.band: r["count"] for r in scored.filter("good").groupBy("band").count().collect()}
    bands = range(len(BANDS) + 1)
    of = {b: b if good.get(b, 0) >= LEAST_IN_BAND else -1 for b in bands}  # -1: all bands
    own = [b for b in bands if of[b] == b]
    groups = F.array(*[F.lit(b) for b in own], F.lit(-1)) if len(own) < len(of) else F.array(*map(F.lit, own))
    rows = scored.select(F.explode(groups).alias("grp"), "band", "good", "bits").filter("grp = -1 OR grp = band")
    size = {g: good.get(g, 0) if g >= 0 else sum(good.values()) for g in set(of.values())}
    left = {g: int(CLEAN_LOSS * n) for g, n in size.items() if n}  # good ones above the edge
    edge = dict.fromkeys(left, 0)
    for shift in (48, 32, 16, 0):
        here = F.lit(False)
        for g, bits in edge.items():
            here = here | ((F.col("grp") == g) & (F.shiftright("bits", shift + 16) == bits if shift < 48 else F.lit(True)))
        counts = rows.filter(F.col("good") & here).groupBy("grp", F.shiftright("bits", shift).alias("top")).count().collect()
        for g in edge:
            for top, n in sorted(((r.top, r["count"]) for r in counts if r.grp == g), reverse=True):
                if left[g] < n:
                    edge[g] = top
                    break
                left[g] -= n
    over = F.lit(False)
    for g, bits in edge.items():
        over = over | ((F.col("grp") == g) & (F.col("bits") > bits))
    bad = {r.grp: r.least for r in rows.filter(~F.col("good") & over).groupBy("grp").agg(F.min("bits").alias("least")).collect()}
    score = lambda bits: float(np.array(bits, np.int64).view(np.float64))
    ends = {g: (score(e) + score(bad[g])) / 2 if g in bad else score(e) + 1e-6 for g, e in edge.items()}  # half way to the next bad one
    return np.array([ends.get(of[b], np.inf) for b in bands])


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, statistics, and whether the base rules fail, for the texts of a batch."""
    found = [measure(t) for t in batch.column("text").to_pylist()]
    counts, stats = np.array([c for c, _ in found], np.int64), np.array([s for _, s in found])
    return counts, stats, (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])


def _verdict(n_words: np.ndarray, stats: np.ndarray, failed: np.ndarray, forest: Forest | None, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is kept, and its score."""
    if forest is None:
        return ~failed, np.zeros(len(failed))
    score = forest.score(stats)
    return ~failed & (score <= limit[np.searchsorted(BANDS, n_words)]), score


MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)
SCHEMA = MEASURED.replace("base_failed boolean", "base_failed boolean, kept boolean, score double")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and statistics of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, stats, failed = _measured(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, counts.T), pa.array(failed), *map(pa.array, stats.T)], ["doc_id", *COUNTS, "base_failed", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, MEASURED)


def fit(rows: DataFrame, labels: DataFrame) -> tuple[Forest | None, np.ndarray | None]:
    """Forest and thresholds from all labelled rows (of ``measured``) that pass the base rules."""
    quality = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_l")).agg((F.min("quality") > 0).alias("good"))
    one = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n_words", "base_failed", *FEATURES)).alias("s"))
    one = one.join(quality, F.col("doc_id") == F.col("_l")).filter("NOT s.base_failed").select(F.xxhash64("doc_id").alias("id"), "good", "s.n_words", *[f"s.{f}" for f in FEATURES])
    labelled = materialise(one, "labelled")
    n = labelled.count()
    if n < LEAST_LABELLED:
        return None, None
    forest = grow(labelled, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.score(np.stack([batch.column(f).to_numpy() for f in FEATURES], 1))
            band = np.searchsorted(BANDS, batch.column("n_words").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), batch.column("good"), pa.array(found.view(np.int64))], ["band", "good", "bits"])

    scored = materialise(labelled.mapInArrow(score, "band int, good boolean, bits long"), "scored")
    limit = thresholds(scored)
    discard(labelled)
    discard(scored)
    return forest, limit


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, statistics, score and verdict for every row of ``docs`` (doc_id, text)."""
    rows = materialise(measured(docs), "measured")
    forest, limit = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            stats = np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)
            kept, score = _verdict(batch.column("n_words").to_numpy(), stats, batch.column("base_failed").to_numpy(zero_copy_only=False), forest, limit)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")], pa.array(kept), pa.array(score), *[batch.column(f) for f in FEATURES]], ["doc_id", *COUNTS, "base_failed", "kept", "score", *FEATURES])

    return rows.mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is kept; judged row by row, so no join is needed. Texts are measured again instead of carried."""
    forest, limit = fit(measured(docs), labels)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, stats, failed = _measured(batch)
            yield batch.filter(pa.array(_verdict(counts[:, 0], stats, failed, forest, limit)[0]))

    return docs.mapInArrow(chosen, docs.schema)


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
