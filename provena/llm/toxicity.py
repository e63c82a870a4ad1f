"""Counterfactually regularised toxicity classifier (operator 2).

A sparse logistic model over words and word beginnings: that a text holds one, and that it holds it several times.  In
labelled sentences that name a group, the name is swapped for others; the change
of the score that the swap makes is penalised, so that naming a group counts
neither for nor against a text.  Weights are few (L1), hence whole texts of any
length are scored by looking up the words that bear a weight.

Null and empty texts get the score of a text without weighted words; repeated
rows get equal scores; without labelled rows of both kinds every score is the
label's smoothed rate; an empty table has no scores.  Rows of a null id are scored
and never fitted.  Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.labelled import sample
from provena.llm.textarrays import LOWER, chunks, hash_spans, ship, signed, tidy, utf8, word_bounds

#: Names of groups, swapped within a line.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["immigrant", "refugee", "foreigner", "native"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["frauen", "männer"], ["mujeres", "hombres"], ["femmes", "hommes"],
    ["muslime", "christen", "juden"], ["musulmanes", "cristianos", "judíos"], ["musulmans", "chrétiens", "juifs"],
]

#: Bytes of words here: letters only, so that marks around a word do not hide it.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
BEGINNINGS = (4, 5, 6, 8)
#: A feature counts again where a text holds it so many times: chance gives one word of a stem, not several.
TIMES = (1, 2, 3, 5)
SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(len(TIMES))]


def features(data: np.ndarray, offsets: np.ndarray):
    """(feature hashes, document numbers) of words and of their beginnings."""
    low = LOWER[data]
    s, e, doc = word_bounds(low, offsets, LETTER)
    hashes, docs = [hash_spans(low, s, e)], [doc]
    for n in BEGINNINGS:
        long = e - s > n
        hashes.append(hash_spans(low, s[long], s[long] + n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def text_features(text: str) -> set:
    raw = np.frombuffer(text.encode(), np.uint8)
    return set(held(*features(raw, np.array([0, len(raw)])))[0].tolist())


def held(h, doc):
    """(features, documents): a hash once, and once more, under another number, for each of TIMES that it is reached."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    parts = [(h[count >= t] ^ salt, doc[count >= t]) for t, salt in zip(TIMES, SALTS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _document_counts(batches):
    """How many documents of each label hold a feature, summed over a batch."""
    for batch in batches:
        data, offsets = utf8(batch.column("t"))
        y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False))
        for i, j in chunks(offsets):
            h, doc = held(*features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
            u, back = np.unique(h, return_inverse=True)
            pos = np.bincount(back, weights=y[i:j][doc], minlength=len(u)).astype(np.int64)
            n = np.bincount(back, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(pos), pa.array(n - pos)], ["f", "pos", "neg"])


def _swaps(text: str, at: dict, terms: list):
    """Feature changes of the sentences of a text that name a group, for each swap of the name."""
    for sentence in re.split(r"[.!?\n]", text):
        low = sentence.lower()
        for line in terms:
            for k, term in enumerate(line):
                if not re.search(rf"\b{re.escape(term)}\b", low):
                    continue
                was = text_features(low)
                for other in line[k + 1:] + line[:k]:
                    now = text_features(re.sub(rf"\b{re.escape(term)}\b", other, low))
                    yield sorted((at[f], 1.0 if f in now else -1.0) for f in was ^ now if f in at)


def _swap_products(batches, vocabulary: np.ndarray, terms: list):
    """Sums over a batch of the products of two features' changes by a swap, as (i, j, v) with i <= j; (-1, -1, number of swaps)."""
    at = {int(f): i for i, f in enumerate(vocabulary)}
    named = re.compile("|".join(re.escape(t) for line in terms for t in line) or "$^")
    for batch in batches:
        sums: dict = {}
        for text in batch.column("t").to_pylist():
            if not text or not named.search(text.lower()):
                continue
            for changed in _swaps(text, at, terms):
                sums[-1, -1] = sums.get((-1, -1), 0.0) + 1.0
                for k, (i, u) in enumerate(changed):
                    for j, v in changed[k:]:
                        sums[i, j] = sums.get((i, j), 0.0) + u * v
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in sums], pa.int32()) for c in (0, 1)] + [pa.array(list(sums.values()), pa.float64())], ["i", "j", "v"])


def _changes(products: list, width: int) -> tuple[np.ndarray, int]:
    """(rows whose mean squared score change is that of all swaps, number of swaps): a root of the sums of products."""
    n = sum(v for i, _, v in products if i < 0)
    own = sorted({k for i, j, _ in products if i >= 0 for k in (i, j)})
    if not n or not own:
        return np.zeros((0, width), np.float32), int(n)
    place = {k: x for x, k in enumerate(own)}
    gram = np.zeros((len(own), len(own)))
    for i, j, v in products:
        if i >= 0:
            gram[place[i], place[j]] = gram[place[j], place[i]] = v
    size, direction = np.linalg.eigh(gram)
    rows = np.zeros((len(own), width), np.float32)
    rows[:, own] = np.sqrt(np.maximum(size, 0) * len(own) / n)[:, None] * direction.T
    return rows, int(n)


def _rows(batches, vocabulary: np.ndarray):
    """The features of the vocabulary that a document holds."""
    for batch in batches:
        data, offsets = utf8(batch.column("t"))
        for i, j in chunks(offsets):
            h, doc = held(*features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
            pos = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[pos] == h)
            hit = hit[np.argsort(doc[hit], kind="stable")]
            found = np.split(pos[hit].astype(np.int32), np.searchsorted(doc[hit], np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), pa.array(found, pa.list_(pa.int32()))], ["y", "held"])


def fit_weights(y: np.ndarray, x: np.ndarray, changes: np.ndarray, l1: float, fairness: float, steps: int = 400):
    """FISTA for logistic loss + l1 * |w| + fairness * mean squared score change; the intercept is free."""
    n = len(y)
    share = np.clip(y.mean(), 0.5 / n, 1 - 0.5 / n)
    weight = np.sqrt(np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))  # the rarer label counts more, not fully alike
    v = np.ones(x.shape[1] + 1)
    for _ in range(20):  # the greatest curvature, by power iteration
        v /= np.linalg.norm(v)
        u = weight * (x @ v[:-1] + v[-1]) / (4 * n)
        v = np.append(x.T @ u + (2 * fairness * changes.T @ (changes @ v[:-1]) / len(changes) if len(changes) else 0), u.sum())
    bound = 1.2 * np.linalg.norm(v)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, t = w.copy(), b, 1.0
    rate = 1.0 / max(bound, 1e-9)
    before = np.inf
    for _ in range(steps):
        z = x @ vw + vb
        g = weight * (1 / (1 + np.exp(-z)) - y) / n
        gw, gb = x.T @ g, g.sum()
        if len(changes):
            gw = gw + 2 * fairness * changes.T @ (changes @ vw) / len(changes)
        nw = vw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = vb - rate * gb
        z = x @ nw + nb
        loss = (weight * (np.logaddexp(0, z) - y * z)).mean() + l1 * np.abs(nw).sum() + (fairness * ((changes @ nw) ** 2).mean() if len(changes) else 0)
        if loss > before:  # restart the momentum; a rate too great is halved
            rate, t, vw, vb, before = rate / 2, 1.0, w.copy(), b, np.inf
            continue
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t, before = nw, nb, nt, loss
    return w, b


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        rows: int = 6000, vocabulary: int = 2048, l1: float = 1e-3, fairness: float = 5.0, terms: list | None = None) -> dict:
    """A model fitted on at most `rows` labelled documents, all their swaps: hashes, weights, intercept, and how many swaps it was held to.

    `terms` are lists of names that may stand for one another; only names that labelled
    sentences hold are swapped, so that on texts without any the penalty has nothing to do.
    """
    terms = IDENTITY_TERMS if terms is None else terms
    ship(df.sparkSession)
    chosen = sample(df, labels, label, rows, id_col, text_col, keep).select(F.col(text_col).alias("t"), "y")
    counts = chosen.mapInArrow(lambda it: tidy(_document_counts(it)), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = chosen.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {"hash": np.zeros(0, np.uint64), "weight": np.zeros(0), "bias": float(np.log((n1 + 0.5) / (n0 + 0.5))), "swaps": 0}
    p1, p0 = F.col("pos") / n1, F.col("neg") / n0
    p = (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-6)
    top = counts.where(F.col("pos") + F.col("neg") >= 4).orderBy(F.desc(z), "f").limit(vocabulary).select("f").collect()
    own = {f for line in terms for t in line for f in text_features(t)}
    words = np.unique(np.concatenate([np.array([r["f"] for r in top], np.int64).view(np.uint64), np.array(sorted(own), np.uint64)]))
    got = chosen.mapInArrow(lambda it: tidy(_rows(it, words)), "y int, held array<int>").toPandas()
    x = np.zeros((len(got), len(words)), np.float32)
    for i, h in enumerate(got["held"]):
        x[i, np.asarray(h, np.int64)] = 1
    products = chosen.select("t").mapInArrow(lambda it: tidy(_swap_products(it, words, terms)), "i int, j int, v double")
    changes, swaps = _changes([tuple(r) for r in products.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()], len(words))
    w, b = fit_weights(got["y"].to_numpy(float), x, changes, l1, fairness)
    kept = w != 0
    return {"hash": words[kept], "weight": w[kept], "bias": b, "swaps": swaps}


def score_texts(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    h, doc = features(data, offsets)
    z = np.full(len(offsets) - 1, model["bias"])
    known = model["hash"]
    if len(known):
        bases = np.unique(np.concatenate([known ^ salt for salt in SALTS]))
        pos = np.minimum(np.searchsorted(bases, h), len(bases) - 1)
        h, doc = h[bases[pos] == h], doc[bases[pos] == h]  # the few words that may bear a weight
        h, doc = held(h, doc)
        pos = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[pos] == h
        z += np.bincount(doc[hit], weights=model["weight"][pos[hit]], minlength=len(z))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            got = [score_texts(model, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in chunks(offsets)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(lambda it: tidy(run(it)), f"`{id_col}` {dict(df.dtypes)[id_col]}, score double, predicted int")
