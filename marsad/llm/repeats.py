"""What both repeat finders share: packs of documents, anchors, and messages between packs and shards.

A pack holds the texts of some documents, up to ``PACK_BYTES``, compressed; packs are written once to
the shared folder. A window of ``length`` symbols is represented by its anchor: of the k-grams in it,
the one with the smallest hash. Equal windows have equal anchors, so all of them meet in the shard
that the anchor's hash names. Consecutive windows with one anchor make a run.

Round 1 sends only anchor hashes (each once per pack, however often a pack repeats it) and gets a bit
back: repeated or not. Round 2 sends the strings under runs of repeated anchors, each distinct string
once per pack, however many documents of the pack hold it; what comes back are bit masks of windows.
What a pack's own copies decide (``Folded.first``) needs no answer and goes straight to the last round.
A message is one row for a pack and a shard with arrays inside; shards grow in number with the input,
so a task's share stays bounded. Only packs' texts and these messages are shuffled, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marsad.llm.common import materialise, small

PACK_BYTES, SHARD_BYTES, LEAST_SHARDS = 1 << 20, 8 << 20, 24
LAST = np.int64(2**63 - 1)
_M = 0x9E3779B97F4A7C15


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


@dataclass
class Pack:
    """Documents of one pack; ids: LAST for null."""

    ids: np.ndarray
    sizes: np.ndarray
    raw: bytes
    extra: list[bytes]

    @property
    def texts(self) -> Iterator[bytes]:
        at = 0
        for n in self.sizes.tolist():
            yield self.raw[at : at + n]
            at += n


PACK = "pack long, n_bytes long, ids binary, sizes binary, raw binary, extra binary"


def make_packs(docs: DataFrame, label: str) -> DataFrame:
    """Packs of ``docs`` (doc_id, text and more); further columns travel as one Arrow stream per pack."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 36, [], 0

        def row() -> pa.RecordBatch:
            ids = np.array([LAST if i is None else i for i, _, _ in held], "<i8")
            raw = [t for _, t, _ in held]
            sizes = np.fromiter(map(len, raw), "<i8", len(raw))
            more = b""
            if rest:
                whole = pa.concat_tables([pa.Table.from_batches([x]) for _, _, x in held]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema) as w:
                    w.write_table(whole)
                more = squeeze(sink.getvalue().to_pybytes())
            values = [number, int(sizes.sum()), ids.tobytes(), sizes.tobytes(), squeeze(b"".join(raw)), more]
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["pack", "n_bytes", "ids", "sizes", "raw", "extra"])

        for batch in small(batches):
            others = batch.select(rest) if rest else None
            for n, (i, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                held.append((i, raw, others.slice(n, 1) if rest else None))
                size += len(raw)
                if size >= PACK_BYTES or len(held) >= 4096:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return materialise(docs.select("doc_id", "text", *rest).mapInArrow(run, PACK), label, compression="uncompressed")


def load(row: dict) -> Pack:
    return Pack(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"), expand(row["raw"]), [row["extra"]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def gram_hash(symbols: np.ndarray, k: int, seed: int = _M) -> np.ndarray:
    """Hash of the k symbols from each position on (len - k + 1 of them); doubling, so log k passes."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, width, out, done = symbols.astype(np.uint64), 1, None, 0
    power = lambda e: np.uint64(pow(seed | 1, e, 1 << 64))
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                part = have[done : done + n]
                out = part.copy() if out is None else out * power(width) + part
                done += width
            if 2 * width > k:
                return _mix(out)
            have = have[:-width] * power(width) + have[width:]
            width *= 2


@dataclass
class Runs:
    """Runs of windows with one anchor: anchor hash, first window, number of windows, document, anchor's place."""

    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def find_runs(symbols: np.ndarray, sizes: np.ndarray, length: int, k: int) -> Runs:
    """Runs in the documents of one pack, whose symbols follow one another; no window leaves its document."""
    n, w = len(symbols) - length + 1, length - k + 1
    assert w <= 64
    if n <= 0:
        none = np.empty(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none, none)
    h = gram_hash(symbols, k)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[w - width : w - width + n])
    # The low half is the anchor's place; of equal ones the first stands, so equal windows have it
    # at equal distances and two of them never share a run.
    place = (least & low).astype(np.int64)
    ends = np.cumsum(sizes)
    valid = np.zeros(n, bool)
    for a, b in zip((ends - sizes).tolist(), (ends - length + 1).tolist(), strict=True):
        if b > a:
            valid[a:b] = True
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    good = valid[first]
    first, count = first[good], count[good]
    doc = np.searchsorted(ends, first, side="right")
    # A run never crosses documents: the windows before a border are not valid.
    return Runs(h[place[first]] >> np.uint64(6), first, count, doc, place[first])


def _split(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, positions) for each shard that occurs; positions in order."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else []
    return [(int(s[a]), order[a:b]) for a, b in zip(cut, [*cut[1:], len(s)], strict=True)]


@dataclass
class Told:
    """Strings of a message, and the runs (first window) that stand for them."""

    doc: np.ndarray  # smallest document of each string
    anchor: np.ndarray  # 32 bits of its hash
    count: np.ndarray  # windows
    place: np.ndarray  # of the anchor in the string
    strings: list[bytes]
    first: np.ndarray
    which: np.ndarray

    _TYPES = (("doc", "<i8"), ("anchor", "<u4"), ("count", "u1"), ("place", "u1"))

    def pack(self) -> bytes:
        # Sizes go by what they exceed the windows, and numbers by their differences: most are alike.
        sizes = np.fromiter(map(len, self.strings), "<i8", len(self.strings)) - self.count
        head = np.array([len(self.strings), len(self.first)], "<u4")
        parts = [head, *(getattr(self, n).astype(t) for n, t in self._TYPES), sizes.astype("<u4"), self.first.astype("<u4"), np.diff(self.which, prepend=0).astype("<i4")]
        return squeeze(b"".join([x.tobytes() for x in parts] + self.strings))

    @classmethod
    def unpack(cls, body: bytes) -> Told:
        raw = expand(body)
        n, m = np.frombuffer(raw, "<u4", 2).tolist()
        at, out = 8, []
        for t, k in (*((t, n) for _, t in cls._TYPES), ("<u4", n), ("<u4", m), ("<i4", m)):
            out.append(np.frombuffer(raw, t, k, at).astype(np.int64))
            at += k * np.dtype(t).itemsize
        ends = (at + np.cumsum(out[4] + out[2])).tolist()
        return cls(*out[:4], [raw[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)], out[5], np.cumsum(out[6]))


@dataclass
class Folded:
    """Distinct strings to tell, and the runs (first, mask) that the pack's own copies decide."""

    told: Told
    first: np.ndarray
    mask: np.ndarray


def fold(pack: Pack, runs: Runs, chosen: np.ndarray, strings: list[bytes], apart: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Folded:
    """``strings`` of the chosen runs, each once. ``apart(doc, least, copies)`` says of each run, by its
    document, the smallest document with its string and the number of copies, whether they decide it."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(x, len(known)) for x in strings), np.int64, len(strings))
    doc = pack.ids[runs.doc[chosen]]
    order = np.lexsort((doc, which))
    _, at = np.unique(which[order], return_index=True)
    head = order[at]  # of each string, a run in its smallest document
    own = apart(doc, doc[head][which], np.bincount(which)[which]) if len(chosen) else np.empty(0, bool)
    every, lead = runs.count[chosen], chosen[head]
    told = Told(doc[head], (runs.anchor[lead] & np.uint64(0xFFFFFFFF)).astype(np.int64), runs.count[lead], runs.place[lead] - runs.first[lead], list(known), runs.first[chosen][~own], which[~own])
    return Folded(told, runs.first[chosen][own], (np.uint64(1) << every[own].astype(np.uint64)) - np.uint64(1))


def masks_body(first: np.ndarray, mask: np.ndarray) -> bytes:
    on = mask != 0
    return squeeze(first[on].astype("<u4").tobytes() + mask[on].astype("<u8").tobytes())


MESSAGE = "shard long, pack long, body binary"
REPLY = "pack long, shard long, body binary"


def _batch(names: list[str], a: list[int], b: list[int], body: list[bytes]) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], names)


def _anchor_message(runs: Runs, shards: int, several: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, distinct hashes in order, which of them the pack itself repeats)."""
    owner = several(runs.doc, runs.first)
    order = np.argsort(runs.anchor, kind="stable")
    a, d = runs.anchor[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    start = np.flatnonzero(new)
    many = np.maximum.reduceat(d, start) != np.minimum.reduceat(d, start) if len(a) else np.empty(0, bool)
    anchors = a[start]
    for shard, at in _split((anchors % np.uint64(shards)).astype(np.int64)):
        yield shard, anchors[at], many[at]


def short(anchors: np.ndarray, shards: int) -> np.ndarray:
    """32 bits of an anchor's hash besides its shard; a chance repeat costs work, not results."""
    return ((anchors // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def repeated_anchors(packs: DataFrame, shards: int, symbols: Callable[[Pack], tuple[np.ndarray, np.ndarray]], length: int, k: int, several: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Round 1: for each pack and shard, a bit for each distinct anchor hash (in order): repeated?

    ``several(doc, first)`` numbers a run's owner: an anchor with two owners in a pack is repeated.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            for row in batch.to_pylist():
                p = load(row)
                runs = find_runs(*symbols(p), length, k)
                out = [(s, row["pack"], short(a, shards).tobytes() + np.packbits(m).tobytes() + len(a).to_bytes(4, "little")) for s, a, m in _anchor_message(runs, shards, several)]
                if out:
                    yield from _batch(["shard", "pack", "body"], *map(list, zip(*out, strict=True))).to_batches()

    def answer(group: pa.Table) -> pa.Table:
        bodies = group.column("body").to_pylist()
        sizes = [int.from_bytes(b[-4:], "little") for b in bodies]
        h = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(bodies, sizes, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), 4 * n))[:n] for b, n in zip(bodies, sizes, strict=True)]).astype(bool)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        again = many.copy()
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at, out, packs_, shards_ = 0, [], group.column("pack").to_pylist(), group.column("shard").to_pylist()
        for n in sizes:
            out.append(np.packbits(again[at : at + n]).tobytes())
            at += n
        keep = [i for i, b in enumerate(out) if any(b)]
        return _batch(["pack", "shard", "body"], [packs_[i] for i in keep], [shards_[i] for i in keep], [out[i] for i in keep])

    return packs.mapInArrow(ask, MESSAGE).groupBy("shard").applyInArrow(answer, REPLY)


def selected(runs: Runs, shards: int, several: Callable[[np.ndarray, np.ndarray], np.ndarray], replies: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, runs whose anchor is repeated) by round 1's replies to this pack."""
    bits = dict(zip(replies.column("shard").to_pylist(), replies.column("body").to_pylist(), strict=True))
    wanted = []
    for shard, anchors, _ in _anchor_message(runs, shards, several):
        if shard in bits:
            wanted.append(anchors[np.unpackbits(np.frombuffer(bits[shard], np.uint8))[: len(anchors)].astype(bool)])
    if not wanted:
        return
    good = np.flatnonzero(np.isin(runs.anchor, np.concatenate(wanted)))
    for shard, at in _split((runs.anchor[good] % np.uint64(shards)).astype(np.int64)):
        yield shard, good[at]


def marked(n: int, first: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Symbols covered by windows whose bit is set; first and mask (up to 64 bits) are by run."""
    edge = np.zeros(n + 1, np.int32)
    for b in range(64):
        on = first[(mask >> np.uint64(b)) & np.uint64(1) == 1] + b
        if len(on):
            np.add.at(edge, on, 1)
            np.add.at(edge, on + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find(docs: DataFrame, label: str, symbols, length: int, k: int, several, tell, decide, finish, schema: str) -> DataFrame:
    """The whole exchange. ``tell(pack, runs, chosen)`` folds the strings of a round 2 message,
    ``decide(told)`` makes the masks of each message's strings, ``finish(pack, first, mask)`` rows."""
    packs = make_packs(docs, f"{label}-packs")
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    known = repeated_anchors(packs, shards, symbols, length, k, several)

    def ask(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if replies.num_rows:
            for row in mine.to_pylist():
                p = load(row)
                s, sizes = symbols(p)
                runs = find_runs(s, sizes, length, k)
                own = []
                for shard, chosen in selected(runs, shards, several, replies):
                    f = tell(p, runs, chosen)
                    own.append((f.first, f.mask))
                    out.append((shard, row["pack"], f.told.pack()))
                if any(len(first) for first, _ in own):  # a group of its own, which passes through
                    out.append((-1 - row["pack"], row["pack"], masks_body(*map(np.concatenate, zip(*own, strict=True)))))
        return _batch(["shard", "pack", "body"], *(map(list, zip(*out, strict=True)) if out else ([], [], [])))

    def answer(group: pa.Table) -> pa.Table:
        packs_, shards_, bodies = (group.column(c).to_pylist() for c in ("pack", "shard", "body"))
        if shards_[0] < 0:
            return _batch(["pack", "shard", "body"], packs_, shards_, bodies)
        told = [Told.unpack(b) for b in bodies]
        found = [(t.first, m[t.which]) for t, m in zip(told, decide(told), strict=True)]
        some = [i for i, (_, m) in enumerate(found) if m.any()]
        return _batch(["pack", "shard", "body"], [packs_[i] for i in some], [shards_[i] for i in some], [masks_body(*found[i]) for i in some])

    told = packs.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(ask, MESSAGE)
    masks = materialise(told.groupBy("shard").applyInArrow(answer, REPLY), f"{label}-masks")

    def close(mine: pa.Table, replies: pa.Table) -> pa.Table:
        got = [expand(b) for b in replies.column("body").to_pylist()]
        first = np.concatenate([np.empty(0, "<u4"), *[np.frombuffer(b, "<u4", len(b) // 12) for b in got]]).astype(np.int64)
        mask = np.concatenate([np.empty(0, "<u8"), *[np.frombuffer(b, "<u8", len(b) // 12, len(b) // 12 * 4) for b in got]])
        return pa.concat_tables([finish(load(row), first, mask) for row in mine.to_pylist()])

    return packs.groupBy("pack").cogroup(masks.groupBy("pack")).applyInArrow(close, schema)


def extras(pack: Pack) -> pa.Table | None:
    """The further columns of a pack's documents."""
    return pa.ipc.open_stream(expand(pack.extra[0])).read_all() if pack.extra[0] else None

