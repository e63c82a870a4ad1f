"""Exact set-similarity joins by prefixes, for documents and for lines.

A unit (a document, a line) is a set of word shingles.  Tokens have one global
order, rare first; its rarity comes from a count sketch over all rows, of a size
that does not depend on the corpus, and only steers cost: any order gives the
same result.  Two sets of the threshold share a token of their prefixes, or, with
prefixes lengthened by l, at least l of them.

Equal sets are one class.  Classes that share prefix tokens are first compared
with the first class of a token's list (a star, not all pairs); only classes that
this leaves apart are compared with the rest of the list.  Lists whose members
are all joined already cost nothing more, so that large groups of near copies
don't make pairs of all their members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.tables import cut, small
from provena.llm.textarrays import (
    chunks,
    hashed_words,
    mix,
    ngram_hashes,
    order_in_units,
    ragged,
    runs,
    shingle_sets,
    ship,
    signed,
    tidy,
    utf8,
)

SKETCH_BITS = 22
PARTS = 64
#: Rows that one step of summing counts takes, and steps: up to FAN ** LEVELS tasks.
FAN, LEVELS = 32, 4
LONGEST = 8
#: Tokens of a chunk of units that asks the shards together, entries of a shard, and shards at least.
CHUNK_TOKENS = 1 << 18
SHARD_ENTRIES = 4 << 20
LEAST_SHARDS = 32
#: Cost of verifying a candidate, in tokens read from lists.
VERIFY = 16.0


def whole(data: np.ndarray, offsets: np.ndarray):
    """Documents as units: (unit offsets, document of a unit, its number there)."""
    n = len(offsets) - 1
    return offsets, np.arange(n), np.zeros(n, np.int32)


def lines(data: np.ndarray, offsets: np.ndarray):
    """Lines as units, split at line feeds."""
    breaks = np.flatnonzero(data == 10) + 1
    doc = np.searchsorted(offsets, breaks - 1, side="right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks])
    docs = np.concatenate([np.arange(n), doc])
    order = np.lexsort((np.arange(len(starts)), starts, docs))  # a document's own start comes before its breaks
    starts, docs = starts[order], docs[order]
    number = np.arange(len(docs)) - np.searchsorted(docs, docs)
    return np.append(starts, offsets[-1]), docs, number.astype(np.int32)


def _sketch_rows(batches, split, n: int):
    """Counts of a task's shingles by bucket, as PARTS rows."""
    from pyspark import TaskContext

    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        data, offsets = utf8(b.column("t"))
        for i, j in chunks(offsets):
            part, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            h, unit = hashed_words(part, split(part, o)[0])
            at = np.sort((ngram_hashes(h, unit, n)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
            first = np.flatnonzero(np.diff(at, prepend=np.uint32(0xFFFFFFFF)))
            counts[at[first]] += np.diff(first, append=len(at)).astype(np.uint32)
    own = TaskContext.get().partitionId()
    rows = [np.minimum(x, 255).astype(np.uint8).tobytes() for x in counts.reshape(PARTS, -1)]  # a count of 255 in one task is frequent, however great
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, own, np.int32)), pa.array(rows, pa.binary())], ["p", "salt", "c"])


def _add(t: pa.Table) -> pa.Table:
    size = 1 << (SKETCH_BITS - 6)
    total = np.zeros(size, np.uint64)
    for x in t.column("c"):
        raw = x.as_buffer()
        total += np.frombuffer(raw, np.uint8 if len(raw) == size else np.uint32)
    summed = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
    return pa.table({"p": t.column("p")[:1], "salt": t.column("salt")[:1], "c": pa.array([summed], pa.binary())})


def sketch(df: DataFrame, text_col: str, split, n: int) -> np.ndarray:
    """Logarithmic excess of each bucket's count over what chance puts there: 4 MB, whatever the corpus."""
    rows = df.select(F.col(text_col).alias("t")).mapInArrow(lambda it: tidy(_sketch_rows(it, split, n)), "p int, salt int, c binary")
    for _ in range(LEVELS):  # each level sums FAN rows of a part, so that no group grows with the number of tasks
        rows = rows.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("p", "salt").applyInArrow(_add, "p int, salt int, c binary")
    counts = np.zeros((PARTS, 1 << (SKETCH_BITS - 6)), np.float64)
    for r in rows.collect():  # PARTS rows, 16 MB
        counts[r["p"]] += np.frombuffer(r["c"], np.uint32)
    mean = counts.mean()
    excess = np.maximum(counts.ravel() - mean - 4 * np.sqrt(mean), 0)
    return np.ceil(4 * np.log2(1 + excess)).astype(np.uint8)


def fingerprints(h: np.ndarray, start: np.ndarray, seed: int = 0):
    """Two 64-bit sums that stand for a set."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    salt = np.uint64(0x6A09E667F3BCC909 + 2 * seed)
    return np.add.reduceat(mix(h ^ salt), start), np.add.reduceat(mix(h ^ (salt << np.uint64(7))), start)


def _prefix(h, unit, n_units: int, level: np.ndarray, percent: int, adaptive: bool):
    """(tokens of the prefixes, their lengths, l) of non-empty units in order."""
    own = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = order_in_units(unit, h, n_units, own, 8)
    h, own = h[order], own[order]
    start = runs(unit[order], n_units)
    size = np.diff(start)
    start = start[:-1]
    need = -(-percent * size // 100)
    longer = np.minimum(1, size)
    if adaptive:
        cost_of = np.concatenate([[0.0], np.cumsum(2.0 ** (own / 4.0) - 1)])
        best = np.full(n_units, np.inf)
        alike = -(-2 * percent * size // (100 + percent))  # the overlap that a partner of the same size needs: most partners read no more
        for k in range(1, LONGEST + 1):
            length = np.minimum(size - alike + k, size)
            lists = cost_of[start + length] - cost_of[start]
            cost = np.where(k <= need, length + lists + VERIFY * lists / k, np.inf)
            longer = np.where(cost < best, k, longer)
            best = np.minimum(best, cost)
    length = np.where(size > 0, size - need + longer, 0)
    return h[ragged(start, length)], length, longer.astype(np.int32)


class Join:
    """One set-similarity join over df: which units, how many words a shingle, what threshold, and how it is laid out.

    The texts are read twice: for the sketch, and for `rows`, a table of a row per
    unit with its prefix tokens, on which all else works.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, split, n: int, percent: int, adaptive: bool):
        ship(df.sparkSession)
        self.texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("k"))
        self.kind = dict(df.dtypes)[id_col]
        self.split, self.n, self.percent, self.adaptive, self.seed = split, n, percent, adaptive, 0
        self.level = df.sparkSession.sparkContext.broadcast(sketch(df, text_col, split, n))
        self._number()
        while not self.classes.where("f2 != g2").isEmpty():  # two sets with one 64-bit number: number them anew
            self.seed += 1
            self._number()

    def _number(self) -> None:
        """rows: document id i, a hash k of its text, line, place, set size n, class number c (null without words), a second fingerprint, prefix tokens t and their l."""
        split, n, seed, percent, adaptive, level = self.split, self.n, self.seed, self.percent, self.adaptive, self.level
        rows = cut(self.texts.mapInArrow(
            lambda it: tidy(_unit_rows(it, split, n, seed, level.value, percent, adaptive)), f"i {self.kind}, k long, line int, n int, c long, f2 long, t array<long>, l int"
        ))
        self._set_places(rows)
        self.rows = rows.withColumn("place", self.place)
        self.classes = cut(self.rows.where("n > 0").groupBy("c").agg(
            F.min("place").alias("place"), F.count("*").alias("members"), F.min("f2").alias("f2"), F.max("f2").alias("g2"), F.min("i").alias("low"),
        ))

    def _set_places(self, rows: DataFrame) -> None:
        """A column that orders units by id and line: one long where both fit, else a struct; null ids come first."""
        self.shift, self.place = None, F.struct("i", "line")
        if self.kind not in ("bigint", "int"):
            return
        x = self.texts.agg(F.min("i").alias("a"), F.max("i").alias("b")).first()
        if (x["a"] or 0) < 0:
            return
        bits, shift = int(x["b"] or 0).bit_length(), 31
        if bits + shift > 62:
            shift = int(rows.agg(F.max("line")).first()[0] or 0).bit_length()
        if bits + shift <= 62:
            self.shift = shift
            self.place = F.shiftleft(F.coalesce(F.col("i"), F.lit(-1)).cast("long"), shift).bitwiseOR(F.col("line").cast("long"))

    def _located(self, classes: DataFrame) -> DataFrame:
        """(c, i, line) of rows (c, place)."""
        if self.shift is None:
            return classes.select("c", F.col("place.i").alias("i"), F.col("place.line").alias("line"))
        i = F.shiftright("place", self.shift)
        return classes.select("c", F.when(i >= 0, i).cast(self.kind).alias("i"), F.col("place").bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int").alias("line"))

    def lists(self) -> DataFrame:
        """Prefix tokens that two classes share: a row (token, c, place, n, pos, l) per class, with the place of the list's first class.

        Most prefix tokens stand in one class only.  They are found without making a row
        of each: chunks of units send packed keys to shards by token, and get back a bit
        for each.  A chunk sends a token with its least and greatest class only, hence a
        frequent token loads no shard.  What is left is grouped exactly.
        """
        worded = self.rows.where("n > 0").select("i", "line", "n", "c", "l", "t")
        total = worded.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
        shards, kind = max(LEAST_SHARDS, total // SHARD_ENTRIES), self.kind
        asked = worded.select("c", "t").mapInArrow(lambda it: tidy(_ask_rows(it, shards)), "shard int, chunk long, a binary, b binary")
        answers = asked.groupBy("shard").applyInArrow(_answer, "shard int, chunk long, a binary")
        own = worded.mapInArrow(lambda it: tidy(_own_rows(it)), f"chunk long, i {kind}, line int, n int, c long, l int, t array<long>")
        kept = answers.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(
            lambda x, y: _shared_rows(x, y, shards), f"token long, c long, i {kind}, line int, n int, pos int, l int"
        )
        one = [F.min(x).alias(x) for x in ("place", "n", "pos", "l")]  # of a class all but the places are equal
        lists = cut(kept.withColumn("place", self.place).groupBy("token", "c").agg(*one))
        first = cut(lists.groupBy("token").agg(F.min("place").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"))
        return cut(lists.join(small(first), "token"))

    def stars(self, lists: DataFrame) -> DataFrame:
        """(a, pa, b, pb): for each class the class b that comes first in most of its lists, if that isn't itself and their sizes allow a link."""
        votes = lists.where(F.col("place") != F.col("first")).groupBy("c", "place", "first", "n").agg(F.count("*").alias("v"))
        lead = cut(lists.where(F.col("place") == F.col("first")).select("first", F.col("c").alias("yc"), F.col("n").alias("yn")).distinct())
        fits = 100 * F.least("n", "yn") >= self.percent * F.greatest("n", "yn")
        good = votes.join(small(lead), "first").where(fits & (F.col("c") != F.col("yc")))
        rank = F.shiftleft("v", 32) + F.pmod(F.xxhash64("yc"), F.lit(1 << 32))
        best = good.groupBy("c", "place").agg(F.max_by("yc", rank).alias("b"), F.max_by("first", rank).alias("pb"))
        return best.select(F.col("c").alias("a"), F.col("place").alias("pa"), "b", "pb")

    def _sets(self, at: DataFrame, quarter: bool) -> DataFrame:
        """(c, h): the sets of classes at (c, place), or the quarter of their tokens of lowest hash bits.  Each document is read once, whatever its lines are asked for."""
        split, n, seed = self.split, self.n, self.seed
        asked = cut(self._located(at).groupBy("i").agg(F.collect_list("line").alias("lines")))
        many = asked.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
        found = self.texts.join(small(asked.withColumnRenamed("i", "__i"), extra=8 * many), F.col("i").eqNullSafe(F.col("__i"))).select("t", "lines")
        sets = cut(found.mapInArrow(lambda it: tidy(_set_rows(it, split, n, seed, quarter)), f"c long, h array<{'int' if quarter else 'long'}>"))
        return sets if sets.count() <= many else cut(sets.dropDuplicates(["c"]))  # rows of equal id hold a class twice, or others

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, pa, b, pb) of classes whose sets reach the threshold.

        Of whole documents a quarter of each set's tokens, chosen by their hashes, comes
        first: as many of it as one set lacks of the other's, the sets differ in at
        least.  Pairs that can't be similar go by that alone.  Whole sets decide.
        """
        pairs = cut(pairs.select("a", "pa", "b", "pb").dropDuplicates(["a", "b"]))
        for quarter in (True, False) if self.split is whole else (False,):
            ends = pairs.select(F.col("a").alias("c"), F.col("pa").alias("place")).union(pairs.select(F.col("b").alias("c"), F.col("pb").alias("place")))
            sets = self._sets(ends.dropDuplicates(["c"]), quarter)
            x, y = (sets.select(F.col("c").alias(k), F.col("h").alias(f"h{k}")) for k in "ab")
            both = pairs.join(x, "a").join(y, "b")
            common, na, nb = F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb")
            if quarter:  # the first entry is the size of the whole set, negated
                na, nb = -F.get("ha", F.lit(0)), -F.get("hb", F.lit(0))
                overlap = F.ceil(self.percent * (na + nb) / (100.0 + self.percent) - 1e-9)
                common = F.size(F.array_intersect(F.slice("ha", 2, 1 << 30), F.slice("hb", 2, 1 << 30)))
                near = (F.size("ha") - 1 - common <= na - overlap) & (F.size("hb") - 1 - common <= nb - overlap)
            else:
                near = 100 * common >= self.percent * (na + nb - common)
            pairs = cut(both.where(near).select("a", "pa", "b", "pb"))
        return pairs


def _chunked(batches, split, *columns):
    for b in batches:
        data, offsets = utf8(b.column("t"))
        for i, j in chunks(offsets):
            part, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            yield (part, *split(part, o), *(b.column(c).slice(i, j - i) for c in columns))


def _classes(h: np.ndarray, unit: np.ndarray, n_units: int, seed: int):
    """(sizes, first fingerprints, second ones) of units from their sets."""
    size = np.bincount(unit, minlength=n_units)
    full = np.flatnonzero(size)
    f = np.zeros((2, n_units), np.uint64)
    f[:, full] = fingerprints(h, (np.cumsum(size) - size)[full], seed)
    return size, f[0], f[1]


def _unit_rows(batches, split, n: int, seed: int, level: np.ndarray, percent: int, adaptive: bool):
    for part, units, doc, line, ids, key in _chunked(batches, split, "i", "k"):
        h, unit = shingle_sets(*hashed_words(part, units), len(doc), n)
        size, f, g = _classes(h, unit, len(doc), seed)
        tokens, length, longer = _prefix(h, unit, len(doc), level, percent, adaptive)
        upto = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(doc)), key.take(pa.array(doc)), pa.array(line), pa.array(size.astype(np.int32)), pa.array(signed(f), mask=size == 0), pa.array(signed(g)),
             pa.ListArray.from_arrays(pa.array(upto), pa.array(signed(tokens))), pa.array(longer)],
            ["i", "k", "line", "n", "c", "f2", "t", "l"],
        )


def _numbered(batches):
    """(chunk number, batch of at most CHUNK_TOKENS tokens or one row): the same numbers each time the same rows are read."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    for b in batches:
        upto = np.cumsum(np.diff(b.column("t").offsets.to_numpy()))
        i = 0
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK_TOKENS, side="right")))
            yield number, b.slice(i, j - i)
            number += 1
            i = j


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, lengths) of a list column."""
    return column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())


def _entries(tokens: np.ndarray, c: np.ndarray, shards: int):
    """(token, class) entries of a chunk in order of shards, and the ends of each shard's: of a token its least and, if another, its greatest class."""
    order = np.argsort(tokens)
    t, k = tokens[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    low, high = np.minimum.reduceat(k, start), np.maximum.reduceat(k, start)
    two = low != high
    t, k = np.concatenate([t[start], t[start][two]]), np.concatenate([low, high[two]])
    shard = (mix(t ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(shards)).astype(np.uint32)
    order = np.argsort(shard, kind="stable")
    return t[order], k[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _ask_rows(batches, shards: int):
    for chunk, b in _numbered(batches):
        tokens, lens = _flat(b.column("t"))
        t, k, at = _entries(tokens, np.repeat(b.column("c").to_numpy(), lens), shards)
        low = t.astype(np.uint32)  # inside a shard 32 bits tell most tokens apart; what they don't is grouped exactly later
        full = np.flatnonzero(np.diff(at)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([low[at[s]:at[s + 1]].tobytes() for s in full], pa.binary()),
             pa.array([k[at[s]:at[s + 1]].tobytes() for s in full], pa.binary())], ["shard", "chunk", "a", "b"]
        )


def _answer(asked: pa.Table) -> pa.Table:
    """For each chunk's entries a bit: whether two classes have the token."""
    a, b = asked.column("a").to_pylist(), asked.column("b").to_pylist()
    t, k = np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.int64)
    order = np.argsort(t, kind="stable")
    s, k = t[order], k[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    shared = np.empty(len(t), bool)
    shared[order] = np.repeat(np.minimum.reduceat(k, start) != np.maximum.reduceat(k, start), np.diff(start, append=len(t)))
    ends = np.cumsum([len(x) // 4 for x in a])
    return pa.table({
        "shard": asked.column("shard"), "chunk": asked.column("chunk"),
        "a": pa.array([np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])], pa.binary()),
    })


def _own_rows(batches):
    for chunk, b in _numbered(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), chunk, np.int64)), *(b.column(c) for c in ("i", "line", "n", "c", "l", "t"))], ["chunk", "i", "line", "n", "c", "l", "t"])


def _shared_rows(answers: pa.Table, own: pa.Table, shards: int) -> pa.Table:
    """A row for each posting of a chunk whose token is shared."""
    own = own.combine_chunks()
    tokens, lens = _flat(own.column("t").chunk(0))
    c = np.repeat(own.column("c").to_numpy(), lens)
    t, _, at = _entries(tokens, c, shards)
    good = np.zeros(len(t), bool)
    for s, bits in zip(answers.column("shard").to_pylist(), answers.column("a").to_pylist()):
        good[at[s]:at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[s + 1] - at[s])).astype(bool)
    known = np.sort(t[good])
    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens) if len(known) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens))[hit]
    of = pa.array(row[hit])
    return pa.table({
        "token": signed(tokens[hit]), "c": c[hit], **{k: own.column(k).take(of) for k in ("i", "line", "n")}, "pos": pos.astype(np.int32), "l": own.column("l").take(of),
    })


def _set_rows(batches, split, n: int, seed: int, quarter: bool):
    for part, units, doc, line, wanted in _chunked(batches, split, "lines"):
        asked = np.zeros(len(doc), bool)  # units are in order of documents and lines
        first = runs(doc, len(wanted) + 1)
        lines = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        inside = lines < (first[of + 1] - first[of])  # rows of equal id may have fewer lines
        asked[(first[of] + lines)[inside]] = True
        lens = np.diff(units)
        part = part[ragged(units[:-1][asked], lens[asked])] if not asked.all() else part
        units = np.concatenate([[0], np.cumsum(lens[asked])])
        k = len(units) - 1
        h, unit = shingle_sets(*hashed_words(part, units), k, n)
        size, f, _ = _classes(h, unit, k, seed)
        if quarter:
            some = h & np.uint64(3) == 0
            low, unit = (h[some] >> np.uint64(32)).astype(np.uint32), unit[some]
            fresh = np.ones(len(low), bool)  # in order of units and hashes: tokens of equal upper halves count once
            fresh[1:] = (low[1:] != low[:-1]) | (unit[1:] != unit[:-1])
            low, unit = low[fresh], unit[fresh]
            upto = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=k) + 1)])
            values = np.empty(int(upto[-1]), np.int32)
            values[upto[:-1]] = -size
            values[np.arange(len(low)) + unit + 1] = low.view(np.int32)
        else:
            upto, values = np.concatenate([[0], np.cumsum(size)]), signed(h)
        yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))], ["c", "h"])


def candidates(left: DataFrame, right: DataFrame, percent: int, apart: Column, ordered: bool = False) -> DataFrame:
    """Pairs (a, pa, b, pb), a > b (`ordered`: a of left, b of right), of rows of the same token that satisfy `apart` (over x and y) and share l tokens of their l-prefixes.

    A pair's l is the smaller of the two; a token counts if it lies in both prefixes
    of that l, for the overlap that these two sizes need.  Sizes must allow the threshold, and a token's places must leave
    enough tokens after them (length and positional filters).
    """
    x, y = left.alias("x"), right.alias("y")
    l = F.least("x.l", "y.l")  # noqa: E741

    total = F.col("x.n") + F.col("y.n")
    overlap = F.ceil(percent * total / (100.0 + percent) - 1e-9)

    def inside(t: str) -> Column:
        return F.col(f"{t}.pos") < F.col(f"{t}.n") - overlap + l

    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    can = room + F.least("x.pos", "y.pos") >= overlap
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & fits & can & inside("x") & inside("y"))
    if not ordered:
        swap = F.col("x.c") < F.col("y.c")
        ends = [F.when(swap, F.col(f"y.{k}")).otherwise(F.col(f"x.{k}")) for k in ("c", "place")] + [F.when(swap, F.col(f"x.{k}")).otherwise(F.col(f"y.{k}")) for k in ("c", "place")]
    else:
        ends = [F.col(f"{t}.{k}") for t in "xy" for k in ("c", "place")]
    counted = pairs.groupBy(*(e.alias(k) for e, k in zip(ends, ("a", "pa", "b", "pb")))).agg(F.count("*").alias("k"), F.min(l).alias("l"))
    return counted.where(F.col("k") >= F.col("l")).select("a", "pa", "b", "pb")
