"""Substring dedup, seed and extend over words: remove words of 35-word windows that occur again.

Seeds are winnowed anchors: of the 8-word grams in a window the one with the smallest hash
(``repeats``). Occurrences of an anchor meet in a shard with the words around it, as numbers of a
dictionary of the shard's words, so no two words look alike. An occurrence is set beside one
representative for each of its windows: the first that a sort by window hash puts next to it. The match is
extended from the anchor to the left and to the right, word by word, and a maximal repeat of 35 words
or more marks the windows inside it on both sides. Windows that a hash put together though their words
differ look for another representative among themselves, until none is left: hashes save work and
decide nothing. An anchor with a million occurrences costs a sort and a million extensions, never pairs.

Defined cases: null and empty texts have no words; null ids are carried; repeated rows repeat each other, so
their windows go (there is no first one that stays, hence no ties); texts under 35 words are kept whole; very
long texts are whole packs of their own; other columns, whatever their names, are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from marsad.llm.common import table
from marsad.llm.repeats import LAST, Folded, Pack, Runs, Told, find, fold, gram_hash, marked

LENGTH, K = 35, 8
_EXTENSION = 0xD6E8FEB86659FD93


def _words(pack: Pack) -> list[bytes]:
    found = getattr(pack, "_words", None)
    if found is None:
        found = pack._words = [w for t in pack.texts for w in t.split()]
    return found


def _symbols(pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t.split()) for t in pack.texts), np.int64, len(pack.sizes))
    words = _words(pack)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), sizes


def _tell(pack: Pack, runs: Runs, chosen: np.ndarray) -> Folded:
    """A string that the pack holds twice is repeated already."""
    words = _words(pack)
    strings = [b" ".join(words[a : a + n + LENGTH - 1]) for a, n in zip(runs.first[chosen].tolist(), runs.count[chosen].tolist(), strict=True)]
    return fold(pack, runs, chosen, strings, lambda _, __, copies: copies > 1)


def window_hash(words: np.ndarray) -> np.ndarray:
    return gram_hash(words, LENGTH, _EXTENSION)


def extend(words: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words strings ``a`` and ``b`` share to the left of their anchors, and from them on."""
    out = []
    for room, step in ((np.minimum(anchor[a] - begin[a], anchor[b] - begin[b]), -1), (np.minimum(end[a] - anchor[a], end[b] - anchor[b]), 1)):
        shared, going = np.zeros(len(a), np.int64), np.arange(len(a))
        for n in range(int(room.max(initial=0))):
            going = going[room[going] > n]
            at = step * n - (step < 0)
            going = going[words[anchor[a[going]] + at] == words[anchor[b[going]] + at]]
            shared[going] += 1
        out.append(shared)
    return out[0], out[1]


def repeated_windows(strings: list[bytes], place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each string a mask of its windows that another string (or place) has too.

    ``place``: its anchor's word; ``count``: its windows.
    """
    lists = pc.split_pattern(pa.array(strings, pa.large_binary()), " ")
    words = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    edge = lists.offsets.to_numpy().astype(np.int64)
    begin, end, anchor = edge[:-1], edge[1:], edge[:-1] + place
    marks = np.zeros((len(strings), 64), bool)
    if not len(words):
        return np.zeros(len(strings), np.uint64)
    owner = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = window_hash(words)[begin[owner] + offset]
    order = np.lexsort((owner, h))
    owner, offset, h = owner[order], offset[order], h[order]
    while len(h):
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rest = np.flatnonzero(~new)
        pairs, back = np.unique(owner[rest] << 32 | owner[head[rest]], return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        left, right = extend(words, begin, end, anchor, a, b)
        good = (left + right >= LENGTH) & (a != b)  # maximal repeats
        for x in (a[good], b[good]):
            first = (anchor[x] - left[good]) - begin[x]
            last = first + (left + right)[good] - LENGTH
            for n in range(int(count.max(initial=0))):
                marks[x[(first <= n) & (n <= last)], n] = True
        # A window is settled if its own maximal repeat covers it; the others looked alike only.
        inside = offset[rest] + begin[owner[rest]] - anchor[owner[rest]]
        settled = good[back] & (inside >= -left[back]) & (inside + LENGTH <= right[back])
        left_over = rest[~settled]
        owner, offset, h = owner[left_over], offset[left_over], h[left_over]
    bits = np.zeros(len(strings), np.uint64)
    for n in range(int(count.max(initial=0))):
        bits |= (marks[:, n] & (n < count)).astype(np.uint64) << np.uint64(n)
    return bits


def _decide(told: list[Told]) -> list[np.ndarray]:
    place, count = (np.concatenate([getattr(t, n) for t in told]) for n in ("place", "count"))
    mask = repeated_windows([s for t in told for s in t.strings], place, count)
    return np.split(mask, np.cumsum([len(t.strings) for t in told])[:-1])


def _several(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return first


def _kept(pack: Pack, first: np.ndarray, mask: np.ndarray):
    """(n_words, n_removed, kept words) of each document."""
    words = [t.split() for t in pack.texts]
    gone = marked(sum(map(len, words)), first, mask, LENGTH) if len(first) else None
    at = 0
    for w in words:
        mine = None if gone is None else gone[at : at + len(w)]
        at += len(w)
        if mine is None or not mine.any():
            yield len(w), 0, w
        else:
            yield len(w), int(mine.sum()), [x for x, g in zip(w, mine.tolist(), strict=True) if not g]


def _digest(pack: Pack, first: np.ndarray, mask: np.ndarray) -> pa.Table:
    rows = [(n, r, hashlib.sha256(b" ".join(k)).hexdigest()) for n, r, k in _kept(pack, first, mask)]
    n, r, h = map(list, zip(*rows, strict=True))
    ids = [None if i == LAST else i for i in pack.ids.tolist()]
    return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"), "substring", _symbols, LENGTH, K, _several, _tell, _decide, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
