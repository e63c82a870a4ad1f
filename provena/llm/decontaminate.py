"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment (operator 7).

Every word n-gram of a test item is a seed of it, common or rare: an edited copy
keeps any of them.  A document that holds a seed is aligned with the item around
it, word by word; the local alignment score, as a share of the item's own, tells
edited copies from chance.  A copy that keeps no n words of an item in a row has
no seed and is not found.  An empty table of documents or of items gives no matches.

Words are runs of letters and digits, lower-cased.  Items travel in blocks of a
fixed number of n-grams, so that what a worker holds does not grow with the
benchmark.  Null and empty texts and items have no words and no matches; items
shorter than an n-gram are sought whole; repeated rows are matched each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provena.llm.tables import cut, small, unused
from provena.llm.textarrays import LOWER, HashIndex, chunks, hash_spans, ngram_hashes, ship, tidy, utf8, word_bounds

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
MATCH, OTHER, GAP = 2, -1, -1
#: N-grams of one block of items, and cells of one alignment array.
BLOCK_GRAMS = 1 << 20
CELLS = 1 << 21


def words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    s, e, doc = word_bounds(low, offsets, ALNUM)
    return hash_spans(low, s, e), doc


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of an item's words against rows of words (0: padding)."""
    n, width = windows.shape
    j = np.arange(width, dtype=np.int32) * -GAP
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    for w in item:
        hit = np.where(windows == w, MATCH, OTHER).astype(np.int32)
        x = np.maximum(row[:, :-1] + hit, row[:, 1:] + GAP)
        np.maximum(x, 0, out=x)
        row[:, 1:] = np.maximum.accumulate(x + j, axis=1) - j  # gaps within the item's row
        best = np.maximum(best, row[:, 1:].max(1))
    return best


class Items:
    """A block of items: words, and n-grams with their items and places."""

    def __init__(self, ids: list, texts: list, n: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        h, doc = words(data, offsets)
        self.ids, self.n = ids, n
        self.words = [h[doc == k] for k in range(len(ids))] if len(ids) < 64 else np.split(h, np.searchsorted(doc, np.arange(1, len(ids))))
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        grams, item, place = [], [], []
        for size in self.sizes:
            g, at = ngram_hashes(h, doc, size)
            right = np.array([min(n, len(w)) == size for w in self.words], bool)[doc[at]]
            first = np.searchsorted(doc, doc[at])
            grams.append(g[right] + np.uint64(size))
            item.append(doc[at][right])
            place.append((at - first)[right])
        empty = np.zeros(0, np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.unique, number = np.unique(gram, return_inverse=True)
        self.index = HashIndex(self.unique, np.arange(len(self.unique)))
        order = np.argsort(number, kind="stable")
        self.at = np.searchsorted(number[order], np.arange(len(self.unique) + 1))
        self.seed_item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.seed_place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    def hits(self, h: np.ndarray, doc: np.ndarray):
        """(n-gram number, document, word position) of the items' n-grams in documents."""
        out = []
        for size in self.sizes:
            g, at = ngram_hashes(h, doc, size)
            k = self.index.get(g + np.uint64(size))
            hit = np.flatnonzero(k >= 0)
            out.append((k[hit], doc[at[hit]], at[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _match_rows(batches, items: Items, least: float, id_type):
    for b in batches:
        data, offsets = utf8(b.column("t"))
        for i, j in chunks(offsets):
            part, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            h, doc = words(part, o)
            found = _matches(items, h, doc, j - i, least)
            if found:
                d, k, score, at = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column("i").slice(i, j - i).take(pa.array(d, pa.int64())), pa.array([items.ids[x] for x in k], id_type), pa.array(score, pa.float64()), pa.array(at, pa.int64())],
                    ["i", "item", "score", "at_word"],
                )


def _matches(items: Items, h: np.ndarray, doc: np.ndarray, n_docs: int, least: float):
    """(document, item, score, word position) of the documents that hold an item's passage."""
    k, d, at = items.hits(h, doc)
    many = items.at[k + 1] - items.at[k]
    if not many.sum():
        return []
    each = np.repeat(np.arange(len(k)), many)
    seed = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.at[k], many)
    order = np.argsort(items.seed_item[seed], kind="stable")
    each, item, place = each[order], items.seed_item[seed[order]], items.seed_place[seed[order]]
    groups = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for low, high in zip(groups[:-1].tolist(), groups[1:].tolist()):
        q = int(item[low])
        own = items.words[q]
        pad = len(own) // 4 + 4
        hit = each[low:high]
        diagonal = at[hit] - place[low:high]
        bucket = diagonal // pad
        where = np.unique(np.stack([d[hit], bucket], 1), axis=0)
        width = len(own) + 3 * pad
        block = max(1, CELLS // width)
        best: dict = {}
        for x in range(0, len(where), block):
            wd, start = where[x:x + block, 0], where[x:x + block, 1] * pad - pad
            cell = start[:, None] + np.arange(width)
            inside = (cell >= first[wd][:, None]) & (cell < first[wd + 1][:, None])
            window = np.where(inside, h[np.clip(cell, 0, len(h) - 1)], np.uint64(0))
            enough = np.isin(window, own).sum(1) * MATCH >= least * MATCH * len(own)  # no alignment can do better
            score = np.zeros(len(wd))
            if enough.any():
                score[enough] = align(own, window[enough]) / (MATCH * len(own))
            for dd, s, a in zip(wd.tolist(), score.tolist(), start.tolist()):
                if s >= least and s > best.get(dd, (0, 0))[0]:
                    best[dd] = (s, max(0, a + pad - int(first[dd])))
        out += [(dd, q, s, a) for dd, (s, a) in best.items()]
    return out


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            n: int = 3, least: float = 0.5) -> DataFrame:
    """(id, item, score, at_word) of every document and item whose alignment score is at least `least` of the item's own.

    Where documents and items have ids of one name, the item's is called item_<name>.
    """
    spark = df.sparkSession
    ship(spark)
    kind, item_kind = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    texts = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    out = None
    schema = f"i {kind}, item {item_kind}, score double, at_word long"
    id_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for items in _blocks(benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")), n):
        shared = spark.sparkContext.broadcast(items)
        found = texts.mapInArrow(lambda it, s=shared: tidy(_match_rows(it, s.value, least, id_type)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("i").alias(id_col), F.col("item").alias(item_col if item_col != id_col else f"item_{item_col}"), "score", "at_word")


def _blocks(items: DataFrame, n: int):
    """The benchmark as Items of at most BLOCK_GRAMS words or so, streamed to the driver block by block."""
    ids, texts, size = [], [], 0
    for r in items.where("length(t) > 0").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 4
        if size >= BLOCK_GRAMS:
            yield Items(ids, texts, n)
            ids, texts, size = [], [], 0
    if ids:
        made = Items(ids, texts, n)
        if len(made.unique):
            yield made


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the documents that hold a passage of the benchmark; rows of one id are told apart by their texts."""
    bad = unused(df, "__bad")
    row = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    held = matches(df.select(row.alias(bad), F.col(f"`{text_col}`").alias("text")), benchmark, bad, "text", **options)
    return df.join(small(cut(held.select(bad).distinct())), row == F.col(bad), "left_anti")
