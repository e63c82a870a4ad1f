"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokenisation uses no regular expression.  Every code point gets a class
from an array; each class is a transition function on eight states, function
composition is associative, and so block-wise composition followed by a scan
over the blocks gives the state before each code point, hence the token starts.
Slices between starts are merged by rank; slices seen before come from a cache,
new ones are merged together in numpy, one merge round for all of them at a time.

Null texts count as empty, empty texts give no tokens, texts of any length are
encoded whole; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provena.llm.textarrays import chunks, hash_spans, ragged, ship, tidy, utf8

# Classes of code points.
L, N, O, A2, A3, SPL, WSL, WSM = range(8)
# States: nothing open, runs of letters, numbers, others, an open blank, white space, contraction with 1 or 2 to come.
FRESH, IN_L, IN_N, IN_O, BLANK, IN_W, LEFT1, LEFT2 = range(8)
BLOCK = 32
CACHE = 150_000
WIDE = 48
NONE = 1 << 40

#: The characters of Unicode's White_Space property.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _machine():
    nxt = np.zeros((16, 8), np.uint8)
    start = np.ones((16, 8), bool)
    for s in range(8):
        joined = s == BLANK
        nxt[L, s] = {LEFT2: LEFT1, LEFT1: FRESH}.get(s, IN_L)
        start[L, s] = not (joined or s in (IN_L, LEFT1, LEFT2))
        nxt[N, s], start[N, s] = IN_N, not (joined or s == IN_N)
        nxt[O, s], start[O, s] = IN_O, not (joined or s == IN_O)
        for c, left in ((A2, LEFT1), (A3, LEFT2)):
            inside = joined or s == IN_O
            nxt[c, s], start[c, s] = (IN_O, False) if inside else (left, True)
        nxt[SPL, s], nxt[WSL, s], nxt[WSM, s] = BLANK, FRESH, IN_W
        start[WSM, s] = s != IN_W
    for c in range(8):  # classes 8 to 15: the same at the first code point of a text
        nxt[8 + c, :], start[8 + c, :] = nxt[c, FRESH], True
    return nxt, start


NEXT, START = _machine()


@lru_cache(1)
def _class_table() -> np.ndarray:
    kind = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = L
        elif c == "N":
            kind[cp] = N
    kind[WHITE] = WSM
    return kind


def classes(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point; `first` holds the positions where a text begins."""
    kind = _class_table().take(cp.astype(np.intp))
    n = len(cp)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    white = kind == WSM
    after = np.zeros(n, bool)  # the next code point, of the same text, is not white space
    after[:-1] = ~white[1:] & ~head[1:n]
    last = white & after
    kind[last] = np.where(cp[last] == 0x20, SPL, WSL)
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        pad = np.concatenate([cp, [0, 0]])
        ends = np.concatenate([head, [True]])
        one, two = pad[quote + 1], pad[quote + 2]
        one = np.where(ends[quote + 1], 0, one)
        two = np.where(ends[quote + 1] | ends[quote + 2], 0, two)
        kind[quote[np.isin(one, [ord(x) for x in "stmd"])]] = A2
        three = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[quote[three]] = A3
    kind[first[first < n]] += 8
    return kind


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    c = np.full(rows * BLOCK, O, np.uint8)
    c[:n] = classes(cp, first)
    c = np.left_shift(c.reshape(rows, BLOCK).T, 3, dtype=np.intp)
    flat = NEXT.ravel().astype(np.intp)
    f = np.tile(np.arange(8), (rows, 1))
    for k in range(BLOCK):
        f = flat.take(c[k][:, None] + f)
    step = 1  # inclusive scan: f[i] becomes the composition of blocks 0 to i
    while step < rows:
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.full(rows, FRESH)
    state[1:] = f[:-1, FRESH]
    begins = np.empty((BLOCK, rows), bool)
    emit = START.ravel()
    for k in range(BLOCK):
        at = c[k] + state
        begins[k] = emit.take(at)
        state = flat.take(at)
    return np.flatnonzero(begins.T.ravel()[:n])


class Encoder:
    """Merges by the ranks of a vocabulary file; ids are the ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, r in self.ranks.items():
            words[r] = w
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word_at = np.cumsum(self.word_len) - self.word_len
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        order = np.argsort(h := hash_spans(self.word_bytes, self.word_at, self.word_at + self.word_len))
        self.vocab_hash, self.vocab_rank = h[order], order
        said = [f"{i},".encode() for i in range(size)]
        self.dec_len = np.array([len(x) for x in said])
        self.dec_at = np.cumsum(self.dec_len) - self.dec_len
        self.dec_bytes = np.frombuffer(b"".join(said), np.uint8)
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        pairs = {}
        for w, r in self.ranks.items():
            for k in range(1, len(w)):
                a, b = self.ranks.get(w[:k]), self.ranks.get(w[k:])
                if a is not None and b is not None:
                    pairs[a << 17 | b] = r
        self.bits = max(10, (4 * len(pairs)).bit_length())
        key = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.key[slot] < 0
            put = left[free]
            self.key[slot[free]] = key[put]
            won = self.key[slot] == key[left]
            self.rank[slot[won]] = rank[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 17 | b
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.rank[slot], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.key[slot]
            hit = found == key[left]
            out[left[hit]] = self.rank[slot[hit]]
            go = ~hit & (found >= 0)
            left, slot = left[go], slot[go]
        return out

    def _forget(self) -> None:
        """The cache: hashes of slices in order, and where their ids are."""
        self.seen, self.at, self.len, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _long(self, piece: bytes) -> list[int]:
        """Merges of one long slice, with a heap of pairs."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        words = [piece[i:i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if words[i] is not None else n
            if j >= n or words[i] is None or len(words[i]) + len(words[j]) != size or self.ranks.get(words[i] + words[j]) != r:
                continue
            words[i], ids[i], words[j] = words[i] + words[j], r, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    w = words[x] + words[after[x]]
                    if (q := self.ranks.get(w)) is not None:
                        heapq.heappush(heap, (q, x, len(w)))
        return [ids[i] for i in range(n) if words[i] is not None]

    def _merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray):
        """Ids of slices, as (flat ids, lengths): whole words of the vocabulary at once, the others by merge rounds."""
        at = np.minimum(np.searchsorted(self.vocab_hash, hashes), len(self.vocab_hash) - 1)
        known = self.vocab_hash[at] == hashes
        got = np.where(known, 1, 0)
        parts, where = [self.vocab_rank[at[known]]], [np.flatnonzero(known)]
        for i in np.flatnonzero(~known & (lens > WIDE)).tolist():
            ids = self._long(data[starts[i]:starts[i] + lens[i]].tobytes())
            got[i] = len(ids)
            parts.append(np.array(ids, np.int64))
            where.append(np.full(len(ids), i))
        rest = np.flatnonzero(~known & (lens <= WIDE))
        rest = rest[np.argsort(lens[rest], kind="stable")]
        for k in range(0, len(rest), 8192):
            group = rest[k:k + 8192]
            ln = lens[group]
            w = int(ln.max())
            m = np.full((len(group), w + 1), -1, np.int64)
            m[:, :w][np.arange(w) < ln[:, None]] = self.byte_id[data[ragged(starts[group], ln)]]
            live = np.arange(len(group))
            a = m
            r = np.full((len(group), w), NONE, np.int64)
            ok = a[:, 1:] >= 0
            r[ok] = self.pair_ranks(a[:, :-1][ok], a[:, 1:][ok])
            while True:
                j = r.argmin(1)
                best = r[np.arange(len(live)), j]
                on = best < NONE
                if not on.all():
                    m[live[~on]] = a[~on]
                    live, a, r, j, best = live[on], a[on], r[on], j[on], best[on]
                if not len(live):
                    break
                each, cols = np.arange(len(live)), np.arange(w + 1)
                src = np.minimum(cols + (cols > j[:, None]), w)
                a = np.take_along_axis(a, src, 1)
                a[:, w] = -1
                a[each, j] = best
                r = np.take_along_axis(r, src[:, :w].clip(max=w - 1), 1)
                r[:, w - 1] = NONE
                for col, has in ((j - 1, j > 0), (j, a[each, np.minimum(j + 1, w)] >= 0)):
                    q = np.full(len(live), NONE, np.int64)
                    x = each[has]
                    q[has] = self.pair_ranks(a[x, col[has]], a[x, col[has] + 1])
                    inside = (col >= 0) & (col < w)
                    r[each[inside], col[inside]] = q[inside]
            there = m >= 0
            size = there.sum(1)
            got[group] = size
            parts.append(m[there])
            where.append(np.repeat(group, size))
        where = np.concatenate(where)
        return np.concatenate(parts)[np.argsort(where, kind="stable")], got

    def slices(self, data: np.ndarray, offsets: np.ndarray):
        """Starts and lengths, in bytes, of the slices of concatenated texts."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        starts = lead[token_starts(cp, np.searchsorted(lead, first))]
        return starts, np.diff(np.append(starts, len(data)))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, offsets of each text's ids) of concatenated UTF-8 texts."""
        starts, lens = self.slices(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        h, index, back = np.unique(hash_spans(data, starts, starts + lens), return_index=True, return_inverse=True)
        pos = np.searchsorted(self.seen, h)
        hit = np.zeros(len(h), bool)
        if len(self.seen):
            hit = self.seen[np.minimum(pos, len(self.seen) - 1)] == h
        new = index[~hit]
        ids, count = self._merge(data, starts[new], lens[new], h[~hit])
        at = np.empty(len(h), np.int64)
        size = np.empty(len(h), np.int64)
        at[hit], size[hit] = self.at[pos[hit]], self.len[pos[hit]]
        at[~hit], size[~hit] = len(self.ids) + np.cumsum(count) - count, count
        pool = np.concatenate([self.ids, ids])
        flat = pool[ragged(at[back], size[back])]
        if len(self.seen) + len(new) > CACHE:
            self.ids = pool[ragged(at, size)]
            self.seen, self.at, self.len = h, np.cumsum(size) - size, size
        else:
            order = np.argsort(np.concatenate([self.seen, h[~hit]]), kind="stable")
            self.seen = np.concatenate([self.seen, h[~hit]])[order]
            self.at = np.concatenate([self.at, at[~hit]])[order]
            self.len = np.concatenate([self.len, count])[order]
            self.ids = pool
        upto = np.concatenate([[0], np.cumsum(size[back])])
        return flat, upto[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_bytes(data, np.array([0, len(data)]))[0].tolist()

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text as decimals joined by commas."""
        size = self.dec_len[ids]
        said = self.dec_bytes[ragged(self.dec_at[ids], size)].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [said[a:max(a, b - 1)] for a, b in zip(upto, upto[1:])]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        size = self.word_len[ids]
        raw = self.word_bytes[ragged(self.word_at[ids], size)].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [raw[a:b] for a, b in zip(upto, upto[1:])]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.word_bytes[ragged(self.word_at[ids], self.word_len[ids])].tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens and, read from the ids, their digest and that of the decoded bytes.

    Unless `digests_only`, also `ids` (array<int>) and `ends` (array<int>: the end
    of each token in the text's bytes), which decode() reads.
    """
    ship(df.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            for i, j in chunks(offsets, 1_000_000):
                ids, at = enc.encode_bytes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cols = [
                    batch.column(id_col).slice(i, j - i), pa.array(np.diff(at), pa.int64()),
                    *(pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()) for texts in (enc.decimals(ids, at), enc.decode_all(ids, at))),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    size = enc.word_len[ids]
                    upto = np.cumsum(size)
                    before = np.concatenate([[0], upto])[at]  # bytes before each text
                    ends = (upto - np.repeat(before[:-1], np.diff(at))).astype(np.int32)
                    cut = pa.array(at.astype(np.int32))
                    cols += [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids.astype(np.int32), ends)]
                    names += ["ids", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not digests_only:
        schema += ", ids array<int>, ends array<int>"
    return df.select(id_col, text_col).mapInArrow(lambda it: tidy(run(it)), schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: its id and the text of its ids (bytes that are no text are replaced); null ids give an empty text."""
    ship(df.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or []).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(lambda it: tidy(run(it)), f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")
