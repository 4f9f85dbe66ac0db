"""Suffix-array dedup: remove every byte covered by a 50-byte string that a smaller doc_id also has.

Documents are dealt out by the anchors of their windows (``repeats``): all equal 50-byte windows come to
one shard, inside strings of 80 bytes or less, so the number of rounds below does not grow with the
longest document. A shard's distinct strings are collections for column-wise construction:

* the transform starts with the empty suffix of every string; each round inserts one symbol of every
  string that still has one, from the right end on, as a new suffix. Its row is found among the rows of
  its first symbol by the row of the suffix it extends; what is there already is not sorted again, only
  moved on in one sequential pass;
* the common prefix of a new suffix with the rows above and below it is one more than the least common
  prefix between the suffixes they extend (a range minimum), so the array of common prefixes is updated
  in the same round;
* after the last round, rows whose common prefix with the row above is 50 or more hold equal windows, and the
  smallest doc_id of such a class decides for all of its members.

Copies cost one string in a pack's message and one in the collection, however many there are. A string
that is the only one with its anchor needs no row: its windows are its own.

Defined cases: null and empty texts have no bytes, and texts under 50 bytes are kept whole; a null doc_id counts as
the largest; rows with one doc_id are one document to each other (nothing is removed for their sake,
repeated rows included); the smallest doc_id of equal strings keeps them, so there are no other ties; very
long texts are whole packs of their own; other columns are ignored by ``digests`` and carried by ``dedup``,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marsad.llm.common import table
from marsad.llm.repeats import LAST, Folded, Pack, Runs, Told, extras, find, fold, marked

LENGTH, K = 50, 20
#: Strings that are inserted together: an anchor's strings are never divided.
COLLECTION = 2000
_LOW = np.int64(0xFFFFFFFF)


def _symbols(pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pack.raw, np.uint8), pack.sizes


def _tell(pack: Pack, runs: Runs, chosen: np.ndarray) -> Folded:
    first, count = runs.first[chosen], runs.count[chosen]
    raw = pack.raw
    strings = [raw[a : a + n] for a, n in zip(first.tolist(), (count + LENGTH - 1).tolist(), strict=True)]
    return fold(pack, runs, chosen, strings, lambda doc, least, _: doc > least)


class Collection:
    """Burrows-Wheeler transform and common prefixes of some strings, a symbol of each per round.

    Row r stands for a suffix: ``key[r]`` is its first symbol (0: the empty suffix; bytes are 1 up) and
    the row of the rest; ``common[r]`` its common prefix with row r - 1, up to ``cap``.
    """

    def __init__(self, strings: list[bytes], cap: int = LENGTH):
        self.cap, m = cap, len(strings)
        self.size = np.fromiter(map(len, strings), np.int64, m)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.end = np.cumsum(self.size)
        self.key, self.common = np.arange(m, dtype=np.int64), np.zeros(m, np.uint8)
        self.row = np.arange(m)  # of each string's longest suffix so far
        for length in range(1, int(self.size.max(initial=0)) + 1):
            self._insert(length)

    def _least(self, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Least common prefix of rows a + 1 to b, for arrays of (a, b)."""
        n = len(self.common)
        top = max((int((b - a).max(initial=1)) for a, b in ranges), default=1).bit_length()
        least = np.empty((top, n), np.uint8)
        least[0] = self.common
        for k in range(1, top):
            half, span = 1 << (k - 1), n - (1 << k) + 1
            np.minimum(least[k - 1, :span], least[k - 1, half : half + span], out=least[k, :span])
        out = []
        for a, b in ranges:
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            out.append(np.minimum(least[level, a + 1], least[level, b + 1 - (1 << level)]))
        return out

    def _insert(self, length: int) -> None:
        key, n = self.key, len(self.key)
        some = np.flatnonzero(self.size >= length)
        symbol = self.text[self.end[some] - length].astype(np.int64) + 1
        new = symbol << 32 | self.row[some]
        order = np.argsort(new)
        some, new = some[order], new[order]
        at = np.searchsorted(key, new)  # rows of one first symbol stand in the order of their rests
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] == at[:-1]
        above = np.where(follows, np.concatenate(([0], new[:-1])), key[at - 1])
        last = np.flatnonzero(np.append(~follows[1:], True) & (at < n))
        below = key[at[last]]
        up, down = above >> 32 == new >> 32, below >> 32 == new[last] >> 32
        a, b = self._least([(above[up] & _LOW, new[up] & _LOW), (new[last][down] & _LOW, below[down] & _LOW)])
        common = np.zeros(len(new), np.uint8)
        common[up] = np.minimum(a + 1, self.cap)
        after = np.zeros(len(last), np.uint8)
        after[down] = np.minimum(b + 1, self.cap)
        # One sequential pass: old rows move on, new ones go between them.
        moved = np.arange(n) + np.cumsum(np.bincount(at, minlength=n + 1)[:n])
        put = at + np.arange(len(at))
        old = self.common.copy()
        old[at[last]] = after
        self.key, self.common = np.empty(n + len(new), np.int64), np.empty(n + len(new), np.uint8)
        self.key[moved], self.common[moved] = (key & ~_LOW) | moved[key & _LOW], old
        self.key[put], self.common[put] = (new & ~_LOW) | moved[new & _LOW], common
        self.row = moved[self.row]
        self.row[some] = put

    def suffixes(self) -> np.ndarray:
        """Row of the suffix at each place of each string; -1 beyond its end."""
        out = np.full((len(self.size), int(self.size.max(initial=0))), -1, np.int64)
        row = self.row.copy()
        for i in range(out.shape[1]):
            some = np.flatnonzero(self.size > i)
            out[some, i] = row[some]
            row[some] = self.key[row[some]] & _LOW
        return out


def window_owner(strings: list[bytes], owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Smallest owner of each window, as a row of windows for each string (LAST beyond its end)."""
    c = Collection(strings, length)
    n = max(1, int(c.size.max(initial=length)) - length + 1)
    out = np.full((len(strings), n), LAST, np.int64)
    if c.size.max(initial=0) < length:
        return out
    rows = c.suffixes()[:, :n]
    who, at = np.nonzero(np.arange(n) + length <= c.size[:, None])
    group = np.cumsum(c.common < length)[rows[who, at]]  # equal windows: nothing between them is shorter
    least = np.full(int(group.max()) + 1, LAST, np.int64)
    np.minimum.at(least, group, owner[who])
    out[who, at] = least[group]
    return out


def _decide(told: list[Told]) -> list[np.ndarray]:
    doc, anchor, count = (np.concatenate([getattr(t, n) for t in told]) for n in ("doc", "anchor", "count"))
    known: dict[bytes, int] = {}
    strings = [s for t in told for s in t.strings]
    which = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
    distinct = list(known)
    owner = np.full(len(distinct), LAST, np.int64)
    np.minimum.at(owner, which, doc)
    of = np.zeros(len(distinct), np.int64)
    of[which] = anchor
    _, group, members = np.unique(of, return_inverse=True, return_counts=True)
    mask = np.where(doc > owner[which], (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1), np.uint64(0))
    shared = np.flatnonzero(members[group] > 1)
    shared = shared[np.argsort(group[shared], kind="stable")]
    row_of = np.full(len(distinct), -1)
    at = 0
    while at < len(shared):
        end = min(len(shared), at + COLLECTION)
        while end < len(shared) and group[shared[end]] == group[shared[end - 1]]:
            end += 1
        mine = shared[at:end]
        least = window_owner([distinct[i] for i in mine], owner[mine])
        row_of[mine] = np.arange(len(mine))
        rows = np.flatnonzero(row_of[which] >= 0)
        flags = least[row_of[which[rows]]] < doc[rows, None]
        bits = np.zeros(len(rows), np.uint64)
        for b in range(flags.shape[1]):
            bits |= (flags[:, b] & (b < count[rows])).astype(np.uint64) << np.uint64(b)
        mask[rows] = bits
        row_of[mine] = -1
        at = end
    return np.split(mask, np.cumsum([len(t.strings) for t in told])[:-1])


def _several(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return doc


def _kept(pack: Pack, first: np.ndarray, mask: np.ndarray):
    """(n_bytes, n_removed, n_spans, kept bytes) of each document of the pack."""
    gone = marked(len(pack.raw), first, mask, LENGTH) if len(first) else None
    at = 0
    for raw in pack.texts:
        n = len(raw)
        if gone is None or not (mine := gone[at : at + n]).any():
            yield n, 0, 0, raw
        else:
            begins = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
            yield n, int(mine.sum()), begins, np.frombuffer(raw, np.uint8)[~mine].tobytes()
        at += n


def _digest(pack: Pack, first: np.ndarray, mask: np.ndarray) -> pa.Table:
    rows = [(n, r, s, hashlib.sha256(k).hexdigest()) for n, r, s, k in _kept(pack, first, mask)]
    n, r, s, h = map(list, zip(*rows, strict=True))
    ids = [None if i == LAST else i for i in pack.ids.tolist()]
    return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return find(docs.select("doc_id", "text"), "suffix", _symbols, LENGTH, K, _several, _tell, _decide, _digest, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the bytes left as text; characters that a cut divides go too, n_chars follows."""
    schema, rest = docs.schema, [c for c in docs.columns if c not in ("doc_id", "text")]

    def rows(pack: Pack, first: np.ndarray, mask: np.ndarray) -> pa.Table:
        text = [k.decode("utf-8", "ignore") for _, _, _, k in _kept(pack, first, mask)]
        more = extras(pack)
        columns = {"doc_id": pa.array([None if i == LAST else i for i in pack.ids.tolist()], pa.int64()), "text": pa.array(text, pa.string())}
        columns |= {c: more.column(c) for c in rest}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array(list(map(len, text)), pa.int64())
        return pa.table({c: columns[c] for c in schema.names})

    return find(docs, "suffix", _symbols, LENGTH, K, _several, _tell, _decide, rows, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
