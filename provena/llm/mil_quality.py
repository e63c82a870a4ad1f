"""Quality classifier by gated-attention multiple-instance learning (operator 10).

A document is a bag of passages.  Each passage is encoded from the shares of byte
classes and of repeated words in it; gated attention, learned from labels of whole
documents only, weighs the encodings, and the weighted sum is scored.

All passages of a text are encoded, whatever its length.  Null and empty texts
are a bag of one empty passage; repeated rows get equal scores; without labelled
rows of both kinds every score is the label's smoothed rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.labelled import sample
from provena.llm.textarrays import chunks, hash_spans, ship, tidy, utf8, word_blocks, word_bounds

PASSAGE = 512
#: Bytes whose classes are counted at once.
BLOCK = 1 << 20
SINGLE = b"#*$%&|<>!?.,;:-_()[]{}\"'/\\=+@~^`"


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, np.int64)
    c[ord("a"):ord("z") + 1] = 1
    c[ord("A"):ord("Z") + 1] = 2
    c[ord("0"):ord("9") + 1] = 3
    c[0x20], c[0x0A], c[0x80:0xC0], c[0xC0:] = 4, 5, 6, 7
    for k, b in enumerate(SINGLE):
        c[b] = 8 + k
    return c


CLASS = _byte_classes()
CLASSES = int(CLASS.max()) + 1
WIDTH = CLASSES + 4


def encode(data: np.ndarray, offsets: np.ndarray):
    """(features of passages, passages of each document).  Bytes are read in blocks, so that a long text needs no array of a number a byte."""
    lens = np.diff(offsets)
    count = np.maximum(1, -(-lens // PASSAGE))
    base = np.cumsum(count) - count
    n = int(count.sum())
    x = np.zeros((n, WIDTH), np.float32)
    size = np.full(n, PASSAGE)
    size[np.cumsum(count) - 1] = np.maximum(1, lens - (count - 1) * PASSAGE)

    def passage(at, doc):
        return base[doc] + (at - offsets[doc]) // PASSAGE

    for i in range(0, len(data), BLOCK):
        at = np.arange(i, min(i + BLOCK, len(data)))
        p = passage(at, np.searchsorted(offsets, at, side="right") - 1)
        got = np.bincount((p - p[0]) * CLASSES + CLASS[data[i:i + BLOCK]])
        rows = -(-len(got) // CLASSES)
        got.resize(rows * CLASSES)
        x[p[0]:p[0] + rows, :CLASSES] += got.reshape(rows, CLASSES)
    x[:, :CLASSES] /= size[:, None]
    words, sums, last = np.zeros(n), np.zeros((3, n)), (np.uint64(0), -1)
    for i, block, own, first in word_blocks(data, offsets):
        s, e, wd = word_bounds(block, own)
        if not len(s):
            continue
        h, wd = hash_spans(block, s, e), wd + first
        at = passage(s + i, wd)
        same = (h == np.concatenate([[last[0]], h[:-1]])) & (wd == np.concatenate([[last[1]], wd[:-1]]))
        last = h[-1], wd[-1]
        second = block[np.minimum(s + 1, len(block) - 1)]
        upper = (block[s] >= 65) & (block[s] <= 90) & (e - s > 2) & (second >= 65) & (second <= 90)
        words += np.bincount(at, minlength=n)
        for k, weight in enumerate((same, upper, e - s)):
            sums[k] += np.bincount(at, weights=weight, minlength=n)
    x[:, CLASSES:CLASSES + 3] = (sums / np.maximum(1, words) * np.array([[1], [1], [0.1]])).T
    x[:, CLASSES + 3] = np.log1p(words) / 5
    return x, count


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def forward(m: dict, x: np.ndarray, count: np.ndarray):
    x = (x - m["mean"]) / m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    u, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    a = (u * g) @ m["w"]
    at = np.cumsum(count) - count
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), count))
    a /= np.repeat(np.add.reduceat(a, at), count)
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return x, h, u, g, a, z, z @ m["c"] + m["d"]


def _gradients(m, x, count, y, weight):
    x, h, u, g, a, z, logit = forward(m, x, count)
    dl = weight * (_sigmoid(logit) - y) / len(y)
    dz = np.repeat(dl, count)[:, None] * m["c"]
    at = np.cumsum(count) - count
    da = (dz * h).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, at), count))
    du, dg = ds[:, None] * m["w"] * g * (1 - u * u), ds[:, None] * m["w"] * u * g * (1 - g)
    dh = (a[:, None] * dz + du @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ du, "U": h.T @ dg, "w": (u * g).T @ ds, "c": z.T @ dl, "d": dl.sum()}


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, size: int = 16, epochs: int = 40, batch: int = 256, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    m = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    m |= {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, size)), "b": np.zeros(size), "V": rng.normal(0, 0.3, (size, size)), "U": rng.normal(0, 0.3, (size, size)),
          "w": rng.normal(0, 0.3, size), "c": rng.normal(0, 0.3, size), "d": 0.0}
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    at = np.cumsum(count) - count
    first, second, t = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            docs = order[k:k + batch]
            own = np.concatenate([np.arange(at[i], at[i] + count[i]) for i in docs])
            t += 1
            for name, grad in _gradients(m, x[own], count[docs], y[docs], weight[docs]).items():
                grad = grad + 1e-4 * m[name]
                first[name] = 0.9 * first.get(name, 0) + 0.1 * grad
                second[name] = 0.999 * second.get(name, 0) + 0.001 * grad**2
                step = 0.01 * (1 - epoch / epochs) * first[name] / (1 - 0.9**t)
                m[name] = m[name] - step / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
    return m


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        rows: int = 6000) -> dict:
    """A model fitted on at most `rows` labelled documents, all their passages."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("t"))
            ys = b.column("y")
            for i, j in chunks(offsets):
                x, count = encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                upto = np.cumsum(count)
                raw = [x[e - c:e].astype(np.float16).tobytes() for e, c in zip(upto, count)]
                yield pa.RecordBatch.from_arrays([ys.slice(i, j - i), pa.array(raw, pa.binary())], ["y", "x"])

    got = sample(df, labels, label, rows, id_col, text_col, keep).select(F.col(text_col).alias("t"), F.col("y"), F.xxhash64(id_col).alias("o"))
    got = got.select("t", "y").mapInArrow(run, "y int, x binary").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"rate": float((y.sum() + 0.5) / (len(y) + 1))}
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"]]
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))  # the same whatever order rows came in
    x = np.concatenate([bags[i] for i in order]).astype(np.float32)
    return train(x, np.array([len(bags[i]) for i in order]), y[order])


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, and n_passages."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(text_col))
            scores, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in chunks(offsets):
                x, count = encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                scores.append(np.full(j - i, model["rate"]) if "rate" in model else _sigmoid(forward(model, x, count)[-1]))
                counts.append(count)
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.concatenate(counts))], [id_col, "score", "predicted", "n_passages"]
            )

    return df.select(id_col, text_col).mapInArrow(lambda it: tidy(run(it)), f"`{id_col}` {dict(df.dtypes)[id_col]}, score double, predicted int, n_passages long")


def keep(df: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df, all columns, whose score is at least `least`."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(text_col))
            good = [np.zeros(0, bool)]
            for i, j in chunks(offsets):
                x, count = encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                s = np.full(j - i, model["rate"]) if "rate" in model else _sigmoid(forward(model, x, count)[-1])
                good.append(s >= least)
            yield b.filter(pa.array(np.concatenate(good)))

    return df.mapInArrow(lambda it: tidy(run(it)), df.schema)
