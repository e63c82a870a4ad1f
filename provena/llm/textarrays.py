"""Vectorised text primitives on Arrow buffers: words, word hashes, shingles.

Everything here works on one chunk of documents at a time (``chunks``), so the
memory of a Python worker is bounded by the chunk and not by the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single document is a chunk of its own.
CHUNK_BYTES = 2_000_000

#: The separators of the words `[^\x20\x09-\x0D]+`.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20240917)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
#: The low k bytes of a lane.
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one; there are at most bytes / LONG_WORD of them.
LONG_WORD = 256


#: Bytes of an Arrow batch between Spark and its Python workers; a longer single row is a batch of its own.
BATCH_BYTES = 8 << 20


def ship(spark) -> None:
    """Let Python workers import this package even where only the driver's sys.path has it, and bound the batches that they get."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9-]", "", spark.conf.get(name)) or -1) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def tidy(batches):
    """The batches; what the task has freed goes back to the system when they end, since workers live on for other tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents [i, j) of at most `limit` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE):
    """Starts, ends and document numbers of the words of concatenated documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets[:-1]] = True
    fresh = fresh[:-1]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh))
    last = np.empty_like(inside)
    last[-1] = True
    last[:-1] = ~inside[1:] | fresh[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for non-empty spans: lanes of eight bytes, each mixed into what came before."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    lanes = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))  # the eight bytes from each place on
    lens = ends - starts
    out = mix((lens.astype(np.uint64) * _STEP) ^ (lanes[starts] & _LOW_BYTES[np.minimum(lens, 8)]))
    left, k = np.flatnonzero((lens > 8) & (lens <= LONG_WORD)), 8
    while len(left):
        out[left] = mix((out[left] + _STEP) ^ (lanes[starts[left] + k] & _LOW_BYTES[np.minimum(lens[left] - k, 8)]))
        k += 8
        left = left[lens[left] > k]
    for w in np.flatnonzero(lens > LONG_WORD).tolist():
        out[w] = int.from_bytes(hashlib.blake2b(data[starts[w]:ends[w]].tobytes(), digest_size=8).digest(), "little")
    return out


#: Bytes whose words are sought at once, so that the arrays of one value a byte stay short in a long text.
WORD_BLOCK = 1 << 22


def word_blocks(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE):
    """(start, bytes, offsets of its units, number of its first unit) of blocks that end where a word does."""
    i = 0
    while i < len(data):
        j = min(i + WORD_BLOCK, len(data))
        while j < len(data) and table[data[j]]:
            gap = np.flatnonzero(~table[data[j:j + WORD_BLOCK]])
            j = j + int(gap[0]) if len(gap) else min(j + WORD_BLOCK, len(data))
        first = int(np.searchsorted(offsets, i, side="right")) - 1
        last = int(np.searchsorted(offsets, j, side="left"))
        yield i, data[i:j], np.clip(offsets[first:last + 1], i, j) - i, first
        i = j


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE):
    """(hash, unit) of every word, lower-cased A to Z, of concatenated units."""
    hashes, units = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, block, own, first in word_blocks(data, offsets, table):
        low = LOWER[block]
        s, e, unit = word_bounds(low, own, table)
        hashes.append(hash_spans(low, s, e))
        units.append(unit + first)
    return (hashes[1], units[1]) if len(hashes) == 2 else (np.concatenate(hashes), np.concatenate(units))


def order_in_units(unit: np.ndarray, key: np.ndarray, n_units: int, level: np.ndarray | None = None, level_bits: int = 0) -> np.ndarray:
    """Positions sorted by unit, then level, then key: one sort of a packed number; the rare ties of shortened keys are sorted out in full."""
    bits = max(1, int(n_units - 1).bit_length()) if n_units > 1 else 0
    packed = key >> np.uint64(bits + level_bits) if bits + level_bits else key.copy()
    if level is not None:
        packed |= level.astype(np.uint64) << np.uint64(64 - bits - level_bits)
    if bits:
        packed |= unit.astype(np.uint64) << np.uint64(64 - bits)
    order = np.argsort(packed)
    if bits + level_bits and len(order) > 1:
        p, k = packed[order], key[order]
        if ((p[1:] == p[:-1]) & (k[1:] != k[:-1])).any():
            return np.lexsort((key, level, unit) if level is not None else (key, unit))
    return order


def runs(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's stretch in an ascending document column."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n: int):
    """Hashes of the n consecutive words inside one document, and the first word's position."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    acc = h[:m] * _LANES[0]
    for k in range(1, n):
        acc = acc + h[k:k + m] * _LANES[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    return mix(acc[at]), at


def shingle_sets(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int):
    """Distinct n-word shingles by document: (hashes sorted in each, document numbers).

    A document of fewer words than n has its whole sequence as its one shingle;
    one without words has none.
    """
    g, at = ngram_hashes(h, doc, n)
    gd = doc[at]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = runs(doc, n_docs)[short]
        acc = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            acc[has] += h[first[has] + k] * _LANES[k]
        g = np.concatenate([g, mix(acc + count[short].astype(np.uint64) * _LANES[14])])
        gd = np.concatenate([gd, short])
    order = order_in_units(gd, g, n_docs)
    g, gd = g[order], gd[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
    return g[keep], gd[keep]


def crc_mod(ids: np.ndarray, m: int) -> np.ndarray:
    """crc32(id as decimal text) mod m."""
    return np.fromiter((zlib.crc32(str(x).encode()) % m for x in ids.tolist()), np.int64, len(ids))


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 bits as the long that Spark holds."""
    return h.view(np.int64)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    upto = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (upto - lens), lens)


class HashIndex:
    """Open-addressing map from 64-bit hashes to numbers, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * max(len(keys), 1)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.zeros(size, bool)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = ~self.used[slot]
            self.keys[slot[free]] = keys[left[free]]
            self.used[slot[free]] = True
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is missing."""
        slot = self._slot(keys)
        hit = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(hit, self.values[slot], -1)
        left = np.flatnonzero(~hit & self.used[slot])
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            used = self.used[slot]
            hit = used & (self.keys[slot] == keys[left])
            out[left[hit]] = self.values[slot[hit]]
            go = used & ~hit
            left, slot = left[go], slot[go]
        return out
