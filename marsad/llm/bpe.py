"""BPE as a deterministic automaton over tokens: compiled by merge gadgets, walked by tables.

A state is the last token; an arc (x, y) says that token y may follow token x inside a word. At
first all tokens are single bytes and every arc is there. The merges add a gadget each, in order of
rank: (u, v) of rank r takes away the arc from u to v, and the new token uv goes on as v does and is
entered as u is. So an arc (x, y) is gone if x ends in some u and y begins with some v whose merge came
before anything hid either of them. Tokens that begin with v form a tree; in its preorder, with later
merges first, one gadget takes from a state one interval of arcs. The compiled automaton is, for each state,
its intervals in order (``begins``, ``ends``), beside a trie of labels.

A word is read left to right without going back: each of its prefixes has exactly one path, so the
state after a prefix is one token, and a label that starts there leads on if its arc is there. That
is linear in the word's length (times the longest label). Words of a slice are walked together, a
column of places at a time; words of ``LONG`` bytes or more one by one. Decoding emits the arcs' labels.

Texts are cut at ASCII white space, and only distinct pieces and distinct words of a slice are looked
at (Arrow's dictionaries); ids are gathered by index. Words already walked are kept, within a bound.
Special strings in a text become their ids, as the library does it.

Defined cases: null text is empty; the empty text has no ids; a text of any length is cut into parts
of about ``TOGETHER`` bytes at white space, and a single word without any is walked in linear time;
repeated rows are encoded each; null ids are carried; other columns, whatever their names, are ignored;
an empty table gives no rows. There are no ties: a text has one encoding.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from marsad.llm.common import KEPT, table

#: Bytes of text whose pieces are encoded together.
TOGETHER = 4 << 20
#: Words walked together, and the size from which one goes alone.
ABREAST, LONG = 1 << 13, 48
#: Words kept per worker, and bytes of them.
REMEMBERED, REMEMBERED_BYTES = 300_000, 8 << 20
_FOREVER = 1 << 60


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Integers to integers for whole arrays; -1 where there is none. Open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[at[left]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero(found != keys)
        out[left] = -1
        left = left[found[left] >= 0]
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Automaton:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        model, of = spec["model"], _byte_of()
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab = model["vocab"]
        self.labels = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = s
        #: Arcs out of the start are all there: it is a state without gadgets.
        self.start = len(self.labels)
        self.parts: dict[int, tuple[int, int, int]] = {}
        tokens = [vocab[s] for c in of for s in (c, c + end) if s in vocab]
        gadgets = []
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            gadgets.append((u, v, r))
            self.rank.setdefault(u << 20 | v, r)
            # A merge whose arc is gone already makes no token.
            if uv not in self.parts and not self._taken(u, v, r):
                self.parts[uv] = (u, v, r)
                tokens.append(uv)
        self._intervals(np.array(gadgets, np.int64), tokens)
        self._trie(tokens, of, end)
        self.joints: dict[int, bool] = {}

    # -- compilation -----------------------------------------------------------------------------

    def _edge(self, x: int, side: int) -> list[tuple[int, int]]:
        """(token exposed on one side of x, rank of the merge that hides it)."""
        out = [(x, _FOREVER)]
        while x in self.parts:
            hides, x = self.parts[x][2], self.parts[x][side]
            out.append((x, hides))
        return out

    def _taken(self, x: int, y: int, before: int) -> bool:
        """Whether a gadget of a rank under ``before`` took the arc (x, y)."""
        for u, hidden in self._edge(x, 1):
            for v, covered in self._edge(y, 0):
                r = self.rank.get(u << 20 | v)
                if r is not None and r < before and r < hidden and r <= covered:  # of equal merges the left one goes first
                    return True
        return False

    def _intervals(self, gadgets: np.ndarray, tokens: list[int]) -> None:
        """Places of tokens in the preorder, and each state's taken intervals in order."""
        children: dict[int, list[tuple[int, int]]] = {}
        for t, (u, _, r) in self.parts.items():
            children.setdefault(u, []).append((r, t))
        place = np.zeros(self.start + 1, np.int64)
        last: dict[int, list[tuple[int, int]]] = {}  # token -> (rank of child, last place under it), later merges first
        own = {}
        n = 0
        for root in tokens:
            if root in self.parts:
                continue
            stack = [(root, -1, -1)]
            while stack:
                t, parent, r = stack.pop()
                if t < 0:  # leaving
                    last.setdefault(parent, []).append((r, n - 1))
                    continue
                place[t] = own[t] = n
                n += 1
                if parent >= 0:
                    stack.append((-1, parent, r))
                for rank, child in sorted(children.get(t, ())):
                    stack.append((child, t, rank))
        first = np.unique(gadgets[:, 0] << 20 | gadgets[:, 1], return_index=True)[1]  # the earliest of equal merges
        u, v, r = gadgets[np.sort(first)].T
        begin = place[v]
        end = begin.copy()
        for i, (b, rank) in enumerate(zip(v.tolist(), r.tolist(), strict=True)):
            for rank_of, until in last.get(b, ()):  # children merged at that rank or later are entered as b is
                if rank_of < rank:
                    break
                end[i] = until
        order = np.argsort(u, kind="stable")
        u, r, begin, end = u[order], r[order], begin[order], end[order]
        lo, hi = np.searchsorted(u, np.arange(self.start)), np.searchsorted(u, np.arange(self.start), "right")
        right, made = np.full(self.start, -1, np.int64), np.full(self.start, _FOREVER, np.int64)
        for t, (_, b, rank) in self.parts.items():
            right[t], made[t] = b, rank
        x = np.array(tokens, np.int64)
        at, hidden = x.copy(), np.full(len(x), _FOREVER, np.int64)
        found = []
        while len(x):  # along the right edges of all states at once
            many = hi[at] - lo[at]
            which = np.repeat(np.arange(len(x)), many)
            g = np.repeat(lo[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            ok = r[g] < hidden[which]
            found.append((x[which[ok]] << 17 | begin[g[ok]], x[which[ok]] << 17 | end[g[ok]]))
            go = right[at] >= 0
            x, hidden, at = x[go], made[at[go]], right[at[go]]
        begins, ends = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(begins, kind="stable")
        self.place = place
        self.begins = np.concatenate(([-1], begins[order]))
        self.ends = np.maximum.accumulate(np.concatenate(([-1], ends[order])))

    def _trie(self, tokens: list[int], of: dict[str, int], end: str) -> None:
        """Labels as a trie over bytes; a word's last byte is a symbol of its own (256 up)."""
        self.step: dict[int, int] = {}
        at_node = [-1]
        for t in tokens:
            s = self.labels[t]
            ends = bool(end) and s.endswith(end)
            symbols = [of[c] for c in (s[: -len(end)] if ends else s)]
            if ends:
                symbols[-1] += 256
            node = 0
            for c in symbols:
                node = self.step.setdefault(node << 10 | c, len(at_node))
                if node == len(at_node):
                    at_node.append(-1)
            at_node[node] = t
        self.token = np.array(at_node, np.int32)
        self.tokens = at_node
        self.steps = Table(np.fromiter(self.step, np.int64, len(self.step)), np.fromiter(self.step.values(), np.int32, len(self.step)))

    # -- walking ---------------------------------------------------------------------------------

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which arcs (x, y) are there."""
        q = x.astype(np.int64) << 17 | self.place[y]
        return self.ends[np.searchsorted(self.begins, q, "right") - 1] < q

    def joint(self, x: int, y: int) -> bool:
        """``allowed`` of one arc, remembered."""
        key = x << 20 | y
        ok = self.joints.get(key)
        if ok is None:
            if len(self.joints) > 500_000:
                self.joints.clear()
            ok = self.joints[key] = bool(self.allowed(np.array([x]), np.array([y]))[0])
        return ok

    def word(self, w: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n, step, tokens, joint = len(w), self.step.get, self.tokens, self.joint
        state, back = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        state[0] = self.start
        for i in range(n):
            x, node = state[i], 0
            for j in range(i, n):
                node = step(node << 10 | (w[j] if j < n - 1 else w[j] + 256))
                if node is None:
                    break
                t = tokens[node]
                if t >= 0 and state[j + 1] < 0 and joint(x, t):
                    state[j + 1], back[j + 1] = t, i
        out, at = [], n
        while at:
            out.append(state[at])
            at = back[at]
        return out[::-1]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        flat, count = [np.empty(0, np.int32)], np.zeros(len(words), np.int64)
        short = int(np.searchsorted(size[order], LONG))
        for a in range(0, short, ABREAST):
            some = order[a : min(short, a + ABREAST)]
            ids, count[some] = self._abreast([words[i] for i in some.tolist()], size[some])
            flat.append(ids)
        for i in order[short:].tolist():
            ids = np.array(self.word(words[i]), np.int32)
            count[i] = len(ids)
            flat.append(ids)
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return gather(np.concatenate(flat), begin, count, np.arange(len(words))), count

    def _abreast(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``words`` in order of size, all of them a place at a time."""
        m, n = len(words), int(size[-1]) if len(words) else 0
        row, at = np.repeat(np.arange(m), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        symbol = np.full((n, m), 512, np.int64)  # 512: beyond the end
        symbol[at, row] = np.frombuffer(b"".join(words), np.uint8)
        some = size > 0
        symbol[size[some] - 1, np.flatnonzero(some)] += 256
        state, back = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)
        state[0] = self.start
        for i in range(n):
            rows = np.arange(np.searchsorted(size, i, "right"), m)
            node = np.zeros(len(rows), np.int64)
            for j in range(i, n):
                node = self.steps.get(node << 10 | symbol[j, rows])
                good = np.flatnonzero(node >= 0)
                if not len(good):
                    break
                rows, node = rows[good], node[good].astype(np.int64)
                t = self.token[node]
                c = np.flatnonzero((t >= 0) & (state[j + 1, rows] < 0))
                r, t = rows[c], t[c]
                ok = self.allowed(state[i, r], t)
                state[j + 1, r[ok]], back[j + 1, r[ok]] = t[ok], i
        out, count, at = np.zeros((m, n), np.int32), np.zeros(m, np.int64), size.copy()
        rows = np.flatnonzero(at > 0)
        while len(rows):
            count[rows] += 1
            out[rows, n - count[rows]] = state[at[rows], rows]
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out[np.arange(n) >= n - count[:, None]], count

    def pieces(self, raw: bytes) -> list[bytes]:
        """Words of a piece of text without ASCII white space; a special string is 255 and its id."""
        text, out, at = raw.decode("utf-8", "replace"), [], 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            out += [w.encode() for w in self.split(self.normal(text[at : m.start()]))]
            out.append(b"\xff%d" % self.special[m[0]])
            at = m.end()
        return out + [w.encode() for w in self.split(self.normal(text[at:]))]

    def decode(self, ids) -> str:
        """Labels of the arcs, as the library joins them when a file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``flat`` one after another."""
    many = count[which]
    total = int(many.sum())
    return flat[np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(total)]


def _binary(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _content(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large binary array."""
    if not len(values):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


#: Kinds of bytes: 0 marks, 1 letters, 2 digits; 3 has to be looked at by the library's own rules.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[ord("'"), ord("<"), 0]] = 3
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def kinds(raw: np.ndarray) -> np.ndarray:
    """Kind of each byte; the composed Latin letters from U+00C0 to U+012F are letters."""
    kind = _KIND[raw]
    for head, last, odd in ((0xC3, 0xBF, (0x97, 0xB7)), (0xC4, 0xAF, ())):
        at = np.flatnonzero(raw[:-1] == head)
        tail = raw[at + 1]
        at = at[(tail >= 0x80) & (tail <= last) & ~np.isin(tail, odd)]
        kind[at] = kind[at + 1] = 1
    return kind


class Encoder:
    """Texts to ids; holds the automaton and the words walked so far."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.bytes = 0
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _resolve(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in ``begin`` and ``count``."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = words.filter(pa.array(at < 0))
        if len(self.known) + len(fresh) > REMEMBERED or self.bytes + len(_content(fresh)[1]) > REMEMBERED_BYTES:
            self._forget()
            at[:], fresh = -1, words
        new = np.flatnonzero(at < 0)
        if len(new):
            found = fresh.to_pylist()
            marked = [i for i, w in enumerate(found) if w[:1] == b"\xff"]
            ids, count = self.automaton.words([b"" if w[:1] == b"\xff" else w for w in found])
            begin = len(self.flat) + np.cumsum(count) - count
            if marked:
                begin[marked], count[marked] = len(self.flat) + len(ids) + np.arange(len(marked)), 1
                ids = np.concatenate((ids, np.array([int(found[i][1:]) for i in marked], np.int32)))
            at[new] = len(self.begin) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat, self.begin, self.count = (np.concatenate(p) for p in ((self.flat, ids), (self.begin, begin), (self.count, count)))
            self.bytes += len(_content(fresh)[1])
        return at

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: (flat, begin, count)."""
        offsets, raw = _content(pieces)
        n = len(pieces)
        kind = kinds(raw)
        odd = np.diff(np.concatenate(([0], np.cumsum(kind == 3)))[offsets]) > 0
        strange = np.flatnonzero(odd)
        plain = np.flatnonzero(~odd)
        size = np.diff(offsets)
        where = gather(np.arange(len(raw)), offsets[:-1], size, plain)
        raw_plain, kind = raw[where], kind[where]
        edge = np.cumsum(size[plain]) - size[plain]
        start = np.ones(len(raw_plain), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[edge[size[plain] > 0]] = True
        first = np.flatnonzero(start)
        lowered = bytes(raw_plain).decode().lower().encode()
        words = _binary(lowered, np.append(first, len(raw_plain)))
        n_words = np.diff(np.append(np.searchsorted(first, edge), len(first)))
        more = [self.automaton.pieces(p) for p in pieces.take(pa.array(strange)).to_pylist()]
        if more:
            words = pa.concat_arrays([words, pa.array([w for some in more for w in some], pa.large_binary())])
            n_words = np.concatenate((n_words, [len(some) for some in more])).astype(np.int64)
        coded = words.dictionary_encode()
        at = self._resolve(coded.dictionary)[coded.indices.to_numpy()]
        flat = gather(self.flat, self.begin, self.count, at)
        ends = np.concatenate(([0], np.cumsum(self.count[at])))
        upto = np.cumsum(n_words)
        begin, end = ends[upto - n_words], ends[upto]
        order = np.concatenate((plain, strange))
        out = np.empty((2, n), np.int64)
        out[0, order], out[1, order] = begin, end - begin
        return flat, out[0], out[1]

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        flat, begin, count = self._distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        upto = np.concatenate(([0], np.cumsum(count[which])))
        edges = lists.offsets.to_numpy()
        return gather(flat, begin, count, which), upto[edges - edges[0]]

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids one after another, n + 1 offsets) for some texts at a time, in order."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy()
        begin = held = 0
        for i, s in enumerate(size.tolist()):
            if s > TOGETHER:
                if begin < i:
                    yield self._together(texts.slice(begin, i - begin))
                yield self._very_long(texts[i].as_py().encode())
                begin, held = i + 1, 0
                continue
            held += s
            if held >= TOGETHER:
                yield self._together(texts.slice(begin, i + 1 - begin))
                begin, held = i + 1, 0
        if begin < len(size):
            yield self._together(texts.slice(begin))

    def _very_long(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, at = [np.empty(0, np.int32)], 0
        while at < len(raw):
            m = _WHITE.search(raw, at + TOGETHER)
            end = m.end() if m else len(raw)
            out.append(self._together(pa.array([raw[at:end].decode()], pa.large_string()))[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([0, len(ids)])

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for ids, at in self.batch(pa.array(texts, pa.large_string())):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[a:b]

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


@lru_cache(2)
def vocabulary_size(path: str) -> int:
    """Greatest id and one; the driver needs no automaton for that."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process, until a task of another kind begins there."""
    return Encoder(path)


def _forget() -> bool:
    held = encoder.cache_info().currsize > 0
    encoder.cache_clear()
    return held


KEPT.append(_forget)


def codec(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            names, at = batch.column("doc_id").cast(pa.int64()), 0
            for ids, offsets in e.batch(batch.column("text")):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                decoded = [e.automaton.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(at, n), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``codec``, but counts and hashes leave the worker instead of ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        labels, sha = e.automaton.labels, hashlib.sha256
        label_of, name_of = [x.encode() for x in labels], [b"%d" % i for i in range(len(labels))]
        for batch in batches:
            names, at = batch.column("doc_id").cast(pa.int64()), 0
            for ids, offsets in e.batch(batch.column("text")):
                edges, a, b = offsets.tolist(), [], []
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    mine = ids[x:y].tolist()
                    a.append(sha(b" ".join(map(name_of.__getitem__, mine))).hexdigest())
                    b.append(sha(b" ".join(map(label_of.__getitem__, mine))).hexdigest())
                n = len(a)
                yield pa.RecordBatch.from_arrays([names.slice(at, n), pa.array(np.diff(offsets)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path())
