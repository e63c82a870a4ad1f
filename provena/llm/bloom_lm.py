"""Language-model scoring with a log-frequency Bloom filter (operator 4).

Word counts are exact and stay distributed.  Bigram counts, of all words, are
quantised on a logarithmic scale; a count of level q is stored as q entries in a
Bloom filter, and read again by probing levels until one is missing.  The filter
is as large as the bigrams of the corpus need, and stays distributed in shards:

    P(w | v) = share * c(v, w) / c(v) + (1 - share) * P(w)

A chunk of texts asks the shards for the counts of its rare words and of its
bigrams; questions and answers travel as packed arrays, and the answers meet the
chunk's word numbers, read once more from the same rows; texts don't travel.  Counts of frequent words are known
everywhere, from a table of at most `frequent` rows.

Null and empty texts have one token, the end.  Repeated rows are counted and
scored each.  An empty table gives no rows; a corpus without training rows knows
no token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.tables import cut
from provena.llm.textarrays import LOWER, HashIndex, chunks, hash_spans, mix, runs, ship, tidy, utf8, word_bounds

#: The hash that stands for the end token; no word has it, words are hashed from bytes.
END = np.uint64(0x5EED0FE2D0FA7E37)
SEGMENTS = 64
#: Tokens of the training rows by shard, and shards at least.
SHARD_TOKENS = 2 << 20
SHARDS = 32
#: Bytes of text that ask together: few enough for 16-bit word numbers, mostly.
ASK_BYTES = 1_000_000
#: Keys that a shard answers at once.
ASK_KEYS = 1 << 18
#: What a packed row holds: a chunk's own arrays, or questions and answers about words or bigrams.
CHUNK, WORDS, PAIRS = 0, 1, 2
#: Keys as they travel.  Inside a shard 32 bits tell bigrams apart: an unseen one meets another's key in 1 of 2000 cases, the filter errs in 1 of 100.
KEY = {WORDS: np.uint64, PAIRS: np.uint32}
#: A task merges the counts it holds once so many distinct words are new.
MERGE_AT = 3_000_000


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hashes, document numbers) of words and ends, in order."""
    low = LOWER[data]
    s, e, doc = word_bounds(low, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    at = np.cumsum(count + 1) - 1
    h = np.empty(len(s) + n, np.uint64)
    is_end = np.zeros(len(h), bool)
    is_end[at] = True
    h[is_end] = END
    h[~is_end] = hash_spans(low, s, e)
    return h, np.repeat(np.arange(n), count + 1)


def _merged(parts):
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, back = np.unique(k, return_inverse=True)
    return u, np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)


def _counted(batches, keys, name: str):
    """Counts of keys(data, offsets) over a whole task, as rows (name, n)."""
    parts, held = [], 0
    for batch in batches:
        data, offsets = utf8(batch.column("t"))
        for i, j in chunks(offsets):
            parts.append(np.unique(keys(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), return_counts=True))
            held += len(parts[-1][0])
            if held > MERGE_AT:
                parts = [_merged(parts)]
                held = 0
                if len(parts[0][0]) > MERGE_AT:  # new words all along: hand on what is there
                    yield from _emit(parts.pop(), name)
    if parts:
        yield from _emit(_merged(parts), name)


def _emit(counts, name: str):
    k, c = counts
    for i in range(0, len(k), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[i:i + 200_000].view(np.int64)), pa.array(c[i:i + 200_000].astype(np.int64))], [name, "n"])


class Words:
    """The counts of the frequent words, and the size of the corpus."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.hashes, self.counts = hashes, np.append(counts, -1)
        self.index = HashIndex(hashes, np.arange(len(hashes)))

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w + np.uint64(0x2545F4914F6CDD1D)))


def word_pairs(tok: np.ndarray, doc: np.ndarray, end: int, n: int, places: bool = True):
    """(distinct codes v * n + w, the code's place for each token), or the codes alone; a text's first word follows an end."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[runs(doc, int(doc[-1]) + 1)[:-1]] = end
    return np.unique(before * n + tok, return_inverse=places)


def _pairs_of(data, offsets):
    """Keys of all bigrams of texts."""
    h, doc = tokens(data, offsets)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[runs(doc, len(offsets) - 1)[:-1]] = END
    return pair_keys(before, h)


def deal(keys: np.ndarray, shards: int):
    """(order by shard, [(shard, from, to)] in that order)."""
    s = (mix(keys ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(s[order], np.arange(shards + 1))
    return order, [(k, int(at[k]), int(at[k + 1])) for k in range(shards) if at[k] < at[k + 1]]


def _dealt(batches, name: str, kind: int, shards: int):
    """Rows (name, n) as packed rows of shards."""
    for b in batches:
        k, n = b.column(name).to_numpy().view(np.uint64), b.column("n").to_numpy()
        order, parts = deal(k, shards)
        k, n = k[order].astype(KEY[kind]), n[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([k[i:j].tobytes() for _, i, j in parts], pa.binary()),
             pa.array([n[i:j].tobytes() for _, i, j in parts], pa.binary())], ["shard", "kind", "a", "b"]
        )


def _unpacked(table: pa.Table, kind: int):
    """(keys, counts) of the packed rows of a kind."""
    rows = [(a, b) for k, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b"))) if k == kind]
    return np.frombuffer(b"".join(r[0] for r in rows), KEY[kind]), np.frombuffer(b"".join(r[1] for r in rows), np.int64)


class Bloom:
    """Bits in segments; a key's segment and bits follow from its hash."""

    def __init__(self, segments: list, probes: int, base: float):
        self.bits = np.concatenate([np.frombuffer(s, np.uint8) for s in segments])
        self.size = np.array([8 * len(s) for s in segments], np.uint64)
        self.at = np.cumsum(np.append(np.uint64(0), self.size[:-1]))
        self.probes, self.base = probes, base

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int, probes: int):
        """(segment, hashes for the probes) of (key, level)."""
        h = Bloom.spread(keys)
        g = Bloom.at_level(h, level)
        return (h >> np.uint64(58)).astype(np.int64), [Bloom.probe(g, k) for k in range(probes)]

    @staticmethod
    def spread(keys: np.ndarray) -> np.ndarray:
        return mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567))

    @staticmethod
    def at_level(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        return mix(h + np.asarray(level).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    @staticmethod
    def probe(g: np.ndarray, k: int) -> np.ndarray:
        return mix(g + np.uint64(k * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level that is there with all below it."""
        out = np.zeros(len(keys), np.int64)
        h = self.spread(keys)
        seg = (h >> np.uint64(58)).astype(np.int64)
        left = np.flatnonzero(self.size[seg] > 0)
        h, size, at, level = h[left], self.size[seg[left]], self.at[seg[left]], 1
        while len(left):
            g = self.at_level(h, level)
            for k in range(self.probes):
                bit = at + self.probe(g, k) % size
                on = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if not on.all():
                    left, h, g, size, at = left[on], h[on], g[on], size[on], at[on]
            out[left] = level
            level += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        q = self.levels(keys)
        return np.where(q > 0, self.base ** (q - 0.5), 0.0)


def level_of(n: np.ndarray, base: float) -> np.ndarray:
    """1 for a count of 1, one more for each factor of base."""
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(base) + 1e-9).astype(np.int64)


def _segment(base: float, bits_per_entry: float, probes: int):
    def build(table: pa.Table) -> pa.Table:
        """One segment of the filter from its keys and levels."""
        keys, q = table.column("k").to_numpy(), table.column("q").to_numpy()
        seg = table.column("seg")[0].as_py()
        size = max(64, int(-(-int(q.sum() * bits_per_entry) // 64) * 64))
        bits = np.zeros(size, bool)
        for i in range(0, len(keys), 1 << 18):
            kk, qq = keys[i:i + (1 << 18)], q[i:i + (1 << 18)]
            each = np.repeat(kk, qq)
            level = np.arange(len(each)) - np.repeat(np.cumsum(qq) - qq, qq) + 1
            for h in Bloom.places(each, level, probes)[1]:
                bits[(h % np.uint64(size)).astype(np.int64)] = True
        return pa.table({"seg": pa.array([seg], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return build


def _shard(base: float, bits_per_entry: float, probes: int):
    def build(table: pa.Table) -> pa.Table:
        """A shard's filter from the packed counts of its bigrams: sizes and bits of its segments."""
        keys, n = _merged([_unpacked(table, PAIRS)])
        q, seg = level_of(n, base), Bloom.places(keys, 1, 0)[0]
        order = np.argsort(seg, kind="stable")
        keys, q, at = keys[order], q[order], np.searchsorted(seg[order], np.arange(SEGMENTS + 1))
        make, parts = _segment(base, bits_per_entry, probes), []
        for s in range(SEGMENTS):
            i, j = at[s], at[s + 1]
            parts.append(make(pa.table({"k": keys[i:j], "q": q[i:j], "seg": np.full(j - i, s, np.int32)})).column("bits")[0].as_py() if i < j else bytes(8))
        return pa.table({
            "shard": table.column("shard")[:1], "kind": pa.array([PAIRS], pa.int32()), "a": pa.array([np.array([len(x) for x in parts]).tobytes()], pa.binary()),
            "b": pa.array([b"".join(parts)], pa.binary()),
        })

    return build


def fit(df: DataFrame, text_col: str = "text", frequent: int = 1 << 18, context: int | None = None, base: float = 1.5,
        bits_per_entry: float = 10.0, probes: int = 5) -> dict:
    """Counts and filter over all rows of df: {"words": Words, "parts": DataFrame of packed rare counts and filters by shard, "shards", "probes", "base"}.
    """
    ship(df.sparkSession)
    texts = df.select(F.col(text_col).alias("t"))
    counts = cut(texts.mapInArrow(lambda it: tidy(_counted(it, lambda d, o: tokens(d, o)[0], "w")), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = _least_count(counts, frequent)
    top = counts.where(F.col("n") >= least).toPandas()
    words = Words(top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total["n"], total["v"])
    shards = max(SHARDS, total["n"] // SHARD_TOKENS)
    packed = "shard int, kind int, a binary, b binary"
    rare = counts.where(F.col("n") < least).mapInArrow(lambda it: _dealt(it, "w", WORDS, shards), packed)
    pairs = texts.mapInArrow(lambda it: tidy(_dealt(_counted(it, _pairs_of, "k"), "k", PAIRS, shards)), packed)
    filters = cut(pairs.groupBy("shard").applyInArrow(_shard(base, bits_per_entry, probes), packed))
    return {"words": words, "parts": rare.unionByName(filters), "shards": shards, "probes": probes, "base": base}


def _least_count(counts: DataFrame, rows: int) -> int:
    """The count from which on at most `rows` words lie, to within 2 %: found from a histogram, so that no task sends more than its share."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    bins = sorted(((r["b"], r["m"], r["low"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("m"), F.min("n").alias("low")).collect()), reverse=True)
    least = (bins[0][2] + 1) if bins else 1
    for _, m, low in bins:
        rows -= m
        if rows < 0:
            break
        least = low
    return least


def _questions(batches, words: Words, shards: int, asks: bool):
    """What a chunk asks each shard; or else its own row of ids, word hashes, word numbers and lengths.  Chunks have the same numbers each time."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, offsets = utf8(batch.column("t"))
        for i, j in chunks(offsets, ASK_BYTES):
            h, doc = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            own, tok = np.unique(h, return_inverse=True)
            known = words.index.get(own)
            rare, ids = own[known < 0], batch.column("i").slice(i, j - i)
            if asks:
                rows, ids = [], ids.slice(0, 0)
                code = word_pairs(tok, doc, int(np.searchsorted(own, END)), len(own), False)
                for kind, keys in ((WORDS, rare), (PAIRS, pair_keys(own[code // len(own)], own[code % len(own)]))):
                    order, parts = deal(keys, shards)
                    keys = keys[order].astype(KEY[kind])
                    rows += [(s, kind, keys[x:y].tobytes(), None, None, None) for s, x, y in parts]
            else:
                narrow = tok.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
                rows = [(0, CHUNK, known[known >= 0].astype(np.uint32).tobytes(), rare.tobytes(), narrow.tobytes(), np.bincount(doc, minlength=j - i).astype(np.int32).tobytes())]
            s, kind, *packed = zip(*rows)
            ids = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in packed), ids],
                ["shard", "chunk", "kind", "a", "b", "c", "d", "ids"],
            )
            number += 1


def _answers(probes: int, base: float):
    def answer(parts: pa.Table, asked: pa.Table) -> pa.Table:
        """The rows asked with counts of words or levels of bigrams in place of keys."""
        w, n = _unpacked(parts, WORDS)
        index, bloom = HashIndex(w, n), None
        for kind, a, b in zip(*(parts.column(c).to_pylist() for c in ("kind", "a", "b"))):
            if kind == PAIRS:
                at = np.append(0, np.cumsum(np.frombuffer(a, np.int64)))
                bloom = Bloom([b[x:y] for x, y in zip(at[:-1], at[1:])], probes, base)
        kinds, packed = asked.column("kind").to_pylist(), asked.column("a").to_pylist()
        out = list(packed)
        for kind in (WORDS, PAIRS):  # all questions of a kind at once, a block of keys at a time
            rows = [k for k, x in enumerate(kinds) if x == kind]
            keys = np.frombuffer(b"".join(packed[k] for k in rows), KEY[kind])
            said = np.zeros(len(keys), np.int64 if kind == WORDS else np.uint8)
            for x in range(0, len(keys), ASK_KEYS):
                block = keys[x:x + ASK_KEYS]
                if kind == WORDS:
                    said[x:x + ASK_KEYS] = np.maximum(index.get(block), 0)  # 0 for a word that is new
                elif bloom:
                    said[x:x + ASK_KEYS] = bloom.levels(block)
            ends = np.cumsum([len(packed[k]) // KEY[kind]().itemsize for k in rows]).tolist()
            for k, x, y in zip(rows, [0, *ends], ends):
                out[k] = said[x:y].tobytes()
        at = asked.schema.get_field_index("a")
        return asked.set_column(at, "a", pa.array(out, pa.binary()))

    return answer


def _scores(words: Words, shards: int, base: float, share: float, id_col: str):
    def scores(table: pa.Table) -> pa.Table:
        """The documents of one chunk from its own arrays and the shards' answers."""
        col = {c: table.column(c).to_pylist() for c in ("shard", "kind", "a", "b", "c", "d")}
        at = col["kind"].index(CHUNK)
        own = np.sort(np.concatenate([words.hashes[np.frombuffer(col["a"][at], np.uint32)], np.frombuffer(col["b"][at], np.uint64)]))
        size = np.frombuffer(col["d"][at], np.int32).astype(np.int64)
        tok = np.frombuffer(col["c"][at], np.uint16 if len(own) <= 1 << 16 else np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)

        def replies(kind, keys, dtype):
            got = dict((s, a) for s, k, a in zip(col["shard"], col["kind"], col["a"]) if k == kind)
            out = np.zeros(len(keys), np.int64)
            order, parts = deal(keys, shards)
            out[order] = np.frombuffer(b"".join(got[s] for s, _, _ in parts), dtype)
            return out

        n = words.counts[words.index.get(own)]
        rare = np.flatnonzero(n < 0)
        n[rare] = replies(WORDS, own[rare], np.int64)
        code, back = word_pairs(tok, doc, int(np.searchsorted(own, END)), len(own))
        v, w = code // len(own), code % len(own)
        q = replies(PAIRS, pair_keys(own[v], own[w]), np.uint8)
        c = np.minimum(np.where(q > 0, base ** (q - 0.5), 0.0), np.minimum(n[v], n[w]))  # a bigram is as rare as its words
        p = (n + 0.5) / words.denominator
        factor = np.where(n[v] > 0, share * c / np.maximum(n[v], 1) / p[w] + 1 - share, 1.0)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(size))
        score = total(np.log10(p)[tok])
        return pa.table({
            id_col: table.column("ids").slice(at, 1).combine_chunks().flatten(), "n_tokens": size, "n_known": total(n[tok] > 0).astype(np.int64),
            "train_tokens": np.full(len(size), words.total, np.int64), "base_score": score, "score": score + total(np.log10(factor)[back]),
        })

    return scores


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", share: float = 0.7) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (unigram) and score (the model's log10 probability)."""
    ship(df.sparkSession)
    shards, base = model["shards"], model["base"]
    shared = df.sparkSession.sparkContext.broadcast(model["words"])
    kind = dict(df.dtypes)[id_col]
    packed = f"shard int, chunk long, kind int, a binary, b binary, c binary, d binary, ids array<{kind}>"
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # rows of a shuffle may come in another order; those of a table don't
        texts = cut(texts)
    asked, own = (texts.mapInArrow(lambda it, a=asks: tidy(_questions(it, shared.value, shards, a)), packed) for asks in (True, False))
    answered = model["parts"].groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_answers(model["probes"], base), packed)
    # Each side is dealt by itself, so that a chunk has the same number, made from its task's place in the stage, on both.
    return own.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        lambda mine, told: _scores(shared.value, shards, base, share, id_col)(pa.concat_tables([mine, told])),
        f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
