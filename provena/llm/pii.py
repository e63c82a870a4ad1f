"""Personal data by a character-level BiLSTM with CRF transitions (operator 3).

Fixed patterns give the base spans of whole texts.  A bidirectional LSTM over
character classes with a linear-chain CRF, trained in numpy from labelled spans,
adds spans that the patterns miss: national phone numbers, cards and addresses in
other writing, and items that the patterns drop because they ran on into a number
behind them.  Overlapping windows are decoded, each character takes the tag of the
window in which it lies deepest, and spans are read from the whole tag sequence.
An added span must pass the checks of its kind and touch no base span.

Every kind needs a digit or an at sign, written out or not, so windows lie around
those that no base span holds, over the whole text; a text made of them is decoded
throughout.  Texts are handled in chunks of bytes, and a long text needs two bytes
a character beside itself.  Null and empty texts have no spans, repeated rows get
equal spans, an empty table gives an empty one; only the id and the text are read,
whatever the other columns are called.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.labelled import lowest
from provena.llm.textarrays import chunks, ship, tidy, utf8

KINDS = ("email", "ip", "card", "phone")

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What an added address must look like: the at sign or the dots apart, bracketed or written out.
_AT, _DOT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?)", r"(?: ?\. ?| ?[\[({] ?(?:dot|\.) ?[\])}] ?)"
ADDED_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
ADDED_IP = re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}")
#: What windows lie around.
SIGNS = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]", re.IGNORECASE)

WINDOW, STRIDE, AROUND = 64, 32, 24
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
CLASSES = 18
PAD = 17


def _char_classes() -> np.ndarray:
    c = np.full(128, 14, np.uint8)
    c[:33] = 15
    c[ord("0"):ord("9") + 1] = 0
    c[ord("a"):ord("z") + 1] = 1
    c[ord("A"):ord("Z") + 1] = 2
    for k, ch in enumerate("@.-+() _,:/"):
        c[ord(ch)] = 3 + k
    c[ord("%")] = c[ord("_")]
    for left, right in ("[]", "{}"):
        c[ord(left)], c[ord(right)] = c[ord("(")], c[ord(")")]
    return c


CHAR = _char_classes()


def char_classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, CHAR[np.minimum(cp, 127)], 16).astype(np.uint8)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of EMAIL in linear time: from each at sign back over the local part, then on over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for run in DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                for m in IP.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = re.sub("[^0-9]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=by_place)


def by_place(span) -> tuple[int, int]:
    return span[0], span[2]


def _allowed(text: str, s: int, e: int, kind: int) -> bool:
    """The checks that an added span must pass."""
    said = text[s:e]
    digits = re.sub("[^0-9]", "", said)
    outside = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    if not outside:
        return False
    if kind == 0:
        return bool(ADDED_EMAIL.fullmatch(said))
    if kind == 1:
        parts = re.findall("[0-9]+", said)
        return bool(ADDED_IP.fullmatch(said)) and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", said)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", said)) and 9 <= len(digits) <= 15 and len(said) > len(digits)


# --- the network -------------------------------------------------------------


def _sig(z):
    return 1 / (1 + np.exp(-z))


def _lstm(x, wx, wh, b, keep: bool):
    """Hidden states (n, T, H) of one direction; with `keep` also what backpropagation needs."""
    n, steps = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), wx.dtype), np.zeros((n, size), wx.dtype)
    out, kept = np.empty((n, steps, size), wx.dtype), []
    for t in range(steps):
        z = wx[x[:, t]] + h @ wh + b
        g = np.tanh(z[:, 3 * size:])
        s = _sig(z[:, :3 * size])
        i, f, o = s[:, :size], s[:, size:2 * size], s[:, 2 * size:]
        was = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, was, tc, h))
        h = o * tc
        out[:, t] = h
    return out, kept


def _lstm_back(x, d_out, kept, wh, grads, name):
    n, steps = x.shape
    size = wh.shape[0]
    dh, dc = np.zeros((n, size)), np.zeros((n, size))
    for t in range(steps - 1, -1, -1):
        i, f, o, g, was, tc, before = kept[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(grads["wx" + name], x[:, t], dz)
        grads["wh" + name] += before.T @ dz
        grads["b" + name] += dz.sum(0)
        dh, dc = dz @ wh.T, dc * f


def emissions(m: dict, x: np.ndarray, keep: bool = False):
    hf, kf = _lstm(x, m["wxf"], m["whf"], m["bf"], keep)
    hb, kb = _lstm(x[:, ::-1], m["wxb"], m["whb"], m["bb"], keep)
    both = np.concatenate([hf, hb[:, ::-1]], 2)
    return both @ m["wo"] + m["bo"], (both, kf, kb)


def _lse(a, axis):
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + np.squeeze(top, axis)


def loss_and_gradients(m: dict, x: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
    e, (both, kf, kb) = emissions(m, x, True)
    n, steps, k = e.shape
    tr, st = m["tr"], m["st"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + st
    for t in range(1, steps):
        alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1][:, :, None] + tr, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _lse(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - z[:, None, None])
    rows = np.arange(n)
    gold = e[rows[:, None], np.arange(steps), y].sum(1) + st[y[:, 0]] + tr[y[:, :-1], y[:, 1:]].sum(1)
    grads = {name: np.zeros_like(v) for name, v in m.items()}
    de = marginal.copy()
    de[rows[:, None], np.arange(steps), y] -= 1
    de /= n
    grads["st"] = de[:, 0].sum(0)
    for t in range(1, steps):
        pair = np.exp(alpha[:, t - 1][:, :, None] + tr + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
        grads["tr"] += pair.sum(0) / n
    np.add.at(grads["tr"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
    grads["wo"] = np.einsum("nth,ntk->hk", both, de)
    grads["bo"] = de.sum((0, 1))
    d = de @ m["wo"].T
    size = m["whf"].shape[0]
    _lstm_back(x, d[:, :, :size], kf, m["whf"], grads, "f")
    _lstm_back(x[:, ::-1], d[:, ::-1, size:], kb, m["whb"], grads, "b")
    return float((z - gold).mean()), grads


def train(x: np.ndarray, y: np.ndarray, size: int = 20, steps: int = 450, batch: int = 128, seed: int = 5) -> dict:
    """Adam on windows (n, WINDOW) of classes and tags."""
    rng = np.random.default_rng(seed)
    m = {}
    for d in "fb":
        m |= {"wx" + d: rng.normal(0, 0.3, (CLASSES, 4 * size)), "wh" + d: rng.normal(0, 0.3, (size, 4 * size)), "b" + d: np.zeros(4 * size)}
        m["b" + d][size:2 * size] = 1
    m |= {"wo": rng.normal(0, 0.3, (2 * size, TAGS)), "bo": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS)), "st": np.zeros(TAGS)}
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for t in range(1, steps + 1):
        rows = rng.choice(len(x), min(batch, len(x)), replace=False)
        _, grads = loss_and_gradients(m, x[rows], y[rows])
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] = m[k] - 0.03 * (1 - 0.8 * t / steps) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def viterbi(m: dict, x: np.ndarray) -> np.ndarray:
    """The best tags of windows; a kind's inside follows only its own begin or inside."""
    e, _ = emissions(m, x)
    n, steps, k = e.shape
    tr, st = m["tr"].copy(), m["st"].copy()
    for kind in range(len(KINDS)):
        b, i = 1 + 2 * kind, 2 + 2 * kind
        stays = tr[[b, i], i].copy()
        tr[:, i] = -1e4
        tr[[b, i], i] = stays
    back = np.empty((n, steps, k), np.uint8)
    a = e[:, 0] + st
    for t in range(1, steps):
        s = a[:, :, None] + tr
        back[:, t] = s.argmax(1)
        a = e[:, t] + s.max(1)
    out = np.empty((n, steps), np.uint8)
    out[:, -1] = a.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[rows, t, out[:, t]]
    return out


# --- windows and spans -------------------------------------------------------


def _starts(text: str, spans) -> list[int]:
    """Where windows begin: around digits and at signs outside the base spans, every STRIDE in long stretches."""
    ends, regions, k = sorted((s, e) for s, e, _ in spans), [], 0
    for m in SIGNS.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if k < len(ends) and ends[k][0] <= m.start() and m.end() <= ends[k][1]:
            continue
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        out += list(range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE))
    return out


def _windows(classes: np.ndarray, starts) -> np.ndarray:
    at = np.asarray(starts)[:, None] + np.arange(WINDOW)
    return np.where(at < len(classes), classes[np.minimum(at, len(classes) - 1)], PAD)


def added_spans(texts: list[str], bases: list, m: dict, block: int = 512) -> list[list]:
    """The model's spans of each text that pass the checks and touch no base span."""
    out, jobs = [[] for _ in texts], []
    open_docs: dict = {}  # document: classes, tag of each character, how deep it lay in the window that gave it

    def decode():
        got = viterbi(m, np.concatenate([_windows(open_docs[d][0], [s]) for d, s in jobs]))
        for (d, s), row in zip(jobs, got):
            _, tags, deep = open_docs[d]
            n = min(WINDOW, len(tags) - s)
            won = np.flatnonzero(DEPTH[:n] >= deep[s:s + n])
            tags[s + won], deep[s + won] = row[won], DEPTH[won]
        last = jobs[-1][0]
        jobs.clear()
        for d in [d for d in open_docs if d != last]:
            close(d)

    def close(d):
        tags = open_docs.pop(d)[1]
        if tags.any():
            out[d] = _passed(texts[d], bases[d], tags)

    for d, (text, base) in enumerate(zip(texts, bases)):
        for s in _starts(text, base):
            if d not in open_docs:
                open_docs[d] = char_classes(text), np.zeros(len(text), np.uint8), np.zeros(len(text), np.uint8)
            jobs.append((d, s))
            if len(jobs) == block:
                decode()
    if jobs:
        decode()
    for d in list(open_docs):
        close(d)
    return out


#: How deep each place of a window lies in it.
DEPTH = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.uint8)


def _passed(text: str, taken: list, tags: np.ndarray) -> list:
    """The spans of a tag sequence, without blanks and marks at their ends, that pass the checks."""
    out, starts = [], [s for s, _, _ in sorted(taken)]
    longest = max((e - s for s, e, _ in taken), default=0)
    by_start = sorted(taken)
    for s, e, kind in _tags_to_spans(tags):
        while e > s and text[e - 1] in " .,":
            e -= 1
        while s < e and text[s] in " .,":
            s += 1
        near = by_start[bisect.bisect_left(starts, s - longest):bisect.bisect_left(starts, e)]
        if e > s and not any(s < be for _, be, _ in near) and _allowed(text, s, e, kind):
            out.append((s, e, kind))
    return out


def _tags_to_spans(tags: np.ndarray):
    """(start, end, kind) of the tag sequence; an inside after another kind begins a span."""
    hot = np.flatnonzero(tags)
    if not len(hot):
        return
    t = tags[hot]
    kind = (t.astype(np.int64) - 1) // 2
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (t[1:] % 2 == 1) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(new)
    for i, j in zip(first.tolist(), np.append(first[1:], len(hot)).tolist()):
        yield int(hot[i]), int(hot[j - 1]) + 1, int(kind[i])


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=by_place))


# --- training windows --------------------------------------------------------


def _tagged(text: str, spans, start: int):
    y = np.zeros(WINDOW, np.uint8)
    for s, e, kind in spans:
        a, b = max(s - start, 0), min(e - start, WINDOW)
        if a < b:
            y[a:b] = 2 + 2 * kind
            if s >= start:
                y[a] = 1 + 2 * kind
    return _windows(char_classes(text), [start])[0].astype(np.uint8), y


def made_texts(n: int, seed: int):
    """(text, spans) written by rule: each kind in several forms, alone or one behind another, and numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    dig = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    pick = lambda *a: a[rng.integers(len(a))]

    def card():
        size = int(rng.choice([13, 15, 16, 16, 16, 16, 19]))
        body = str(rng.integers(2, 7)) + dig(size - 2)
        d = body + next(str(c) for c in range(10) if luhn(body + str(c)))
        return pick(d, d, *(mark.join(d[i:i + 4] for i in range(0, size, 4)) for mark in " -./"))

    def no_card():
        body = dig(15)
        d = body + next(str(c) for c in range(9, -1, -1) if not luhn(body + str(c)))
        return pick(d, " ".join(d[i:i + 4] for i in range(0, 16, 4)))

    at, dot = lambda: pick("@", " @ ", " [at] ", " (at) ", "[at]"), lambda: pick(".", ".", " . ", " [dot] ", " (dot) ", "[.]")
    name = lambda: f"{word()}{pick('', '.', '_')}{dig(int(rng.integers(0, 3)))}"
    forms = [
        (0, lambda: f"{name()}@{word()}.{pick('com', 'org', 'example.com')}"), (0, lambda: f"{name()}{at()}{word()}{dot()}{pick('com', 'net', 'org')}"),
        (0, lambda: f"{name()}{at()}{word()}{dot()}{pick('com', 'net', 'org')}"),
        (1, lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))), (1, lambda: pick("[.]", " . ", "(.)", " [dot] ").join(str(x) for x in rng.integers(0, 256, 4))),
        (2, card), (2, card),
        (3, lambda: f"+{pick('1', '49', '33', '351')} ({dig(3)}) {dig(3)}-{dig(4)}"), (3, lambda: f"+{pick('1', '44', '34')} {dig(3)} {dig(3)} {dig(4)}"),
        (3, lambda: f"({dig(3)}) {dig(3)}-{dig(4)}"), (3, lambda: f"{dig(3)}-{dig(3)}-{dig(4)}"), (3, lambda: f"{dig(3)}.{dig(3)}.{dig(4)}"),
        (None, lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"), (None, lambda: f"{dig(1)}.{dig(1)}"), (None, lambda: dig(int(rng.integers(1, 9)))),
        (None, lambda: "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(16, 41))))), (None, lambda: f"{dig(3)},{dig(3)}.{dig(2)}"), (None, lambda: f"v{dig(1)}.{dig(2)}.{dig(1)}"),
        (None, no_card), (None, lambda: f"{pick('12', '7', '19')}:{dig(2)}"), (None, lambda: "".join(rng.choice(list("ABCDEFGHKLMNPQRSTUVWXYZ0123456789"), 20))),
    ]
    for k in range(n):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 8))), []
        text += pick(" ", " ", "\n", ": ", ", ") if text else ""
        for j in range(int(rng.choice([1, 1, 2, 3]))):  # what stands behind one another has a blank between
            kind, make = forms[k % len(forms)] if j == 0 else forms[int(rng.integers(len(forms)))]
            item = make()
            text += " " * (j > 0)
            if kind is not None:
                spans.append((len(text), len(text) + len(item), kind))
            text += item
        yield text + pick("", ".", "%%% ", " ", ", ", "!! ", " | ") + " " + " ".join(word() for _ in range(8)), spans


def made_windows(n: int = 2600, seed: int = 3):
    """Labelled windows of made texts."""
    rng = np.random.default_rng(seed + 1)
    xs, ys = [], []
    for text, spans in made_texts(n, seed):
        sign = SIGNS.search(text)
        x, y = _tagged(text, spans, int(max(0, (sign.start() if sign else 0) - rng.integers(0, 40))))
        xs.append(x)
        ys.append(y)
    return np.array(xs), np.array(ys)


def _doubtful(text: str, spans) -> list[tuple[int, int]]:
    """Numbers of more digits than their kind may have, outside base spans: what they hold the patterns can't say."""
    out = []
    for pattern, most in ((CARD, 19), (PHONE, 15)):
        out += [m.span() for m in pattern.finditer(text) if sum(c.isdigit() for c in m[0]) > most]
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000, windows: int = 4000) -> dict:
    """A model from spans written by rule and from the base spans of a sample: at most `rows` documents and `windows` of all their windows, those of the lowest hashes."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for text in b.column("t").to_pylist():
                spans = base_spans(text)
                doubt = _doubtful(text, spans)
                at = [max(0, s - 20) for s, _, _ in spans] + _starts(text, spans)
                at = [s for s in at if not any(a < s + WINDOW and s < e for a, e in doubt)]
                for k in range(0, len(at), 1000):
                    pairs = [_tagged(text, spans, s) for s in at[k:k + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in pairs], pa.binary()), pa.array([y.tobytes() for _, y in pairs], pa.binary())], ["x", "y"])

    ids = lowest(df.select(F.col(id_col).alias("i")).where("i is not null").distinct(), "i", rows)
    few = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i").where(F.col("t").rlike("[0-9@]"))
    seen = few.select("t").mapInArrow(run, "x binary, y binary").distinct()
    got = sorted((bytes(r["x"]), bytes(r["y"])) for r in seen.orderBy(F.xxhash64("x", "y"), "x", "y").limit(windows).collect())
    x, y = made_windows()
    if got:
        x = np.concatenate([x, np.array([np.frombuffer(a, np.uint8) for a, _ in got])])
        y = np.concatenate([y, np.array([np.frombuffer(b, np.uint8) for _, b in got])])
    return train(x.astype(np.int64), y.astype(np.int64))


def find(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, number of spans of each kind, digest of the base spans, all spans, and how many were added."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for i, j in chunks(utf8(b.column(text_col))[1]):
                cols = {k: [] for k in (*KINDS, "sha", "spans", "added")}
                texts = [t or "" for t in b.column(text_col).slice(i, j - i).to_pylist()]
                bases = [base_spans(t) for t in texts]
                for base, more in zip(bases, added_spans(texts, bases, model)):
                    every = base + more
                    for k, name in enumerate(KINDS):
                        cols[name].append(sum(x[2] == k for x in every))
                    cols["sha"].append(hashlib.sha256(said(base).encode()).hexdigest())
                    cols["spans"].append(said(every))
                    cols["added"].append(len(more))
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).slice(i, j - i), *(pa.array(cols[k], pa.int64()) for k in KINDS), pa.array(cols["sha"], pa.string()), pa.array(cols["spans"], pa.string()), pa.array(cols["added"], pa.int64())],
                    [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return df.select(id_col, text_col).mapInArrow(lambda it: tidy(run(it)), schema)
