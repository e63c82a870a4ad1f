"""The operators of the llm subpackage against brute force, round trips and held-out labels, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import bloom_lm, bpe, chat, decontaminate, line_dedup, mil_quality, ngram_join, pii, quality_rules, toxicity
from provena.llm.components import components
from provena.llm.textarrays import HashIndex, chunks, hash_spans, utf8, word_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, y int, i int, t string, n_removed int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(lower(t or ""))


def frame(spark, texts):
    """Documents with extra columns whose names are those that operators use inside."""
    pairs = texts.items() if isinstance(texts, dict) else enumerate(texts)
    return spark.createDataFrame([(k, v, "en", 1, 2, "x", 3) for k, v in pairs], DOCS)


def vocabulary(seed=1, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, a shared passage, odd rows and a long one."""
    rng, voc = random.Random(7), vocabulary()
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    passage = make(30)
    texts = {}
    base = make(120)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(voc)
        texts[k] = " ".join(w)
    for k in range(60, 140):
        w = make(rng.randint(1, 90))
        if k % 3 == 0:
            w += passage
        texts[k] = " ".join(w).capitalize()
    for k in range(140, 150):
        texts[k] = texts[k - 80]
    texts |= {150: None, 151: "", 152: " \n\t ", 153: "one", 154: "ONE", 155: "a b c", 156: "a b c", 157: " ".join(make(6000)), 158: "Ünïcode ß 中文 𝒳 é"}
    for k in range(60, 70):
        texts[k] = texts[k] + "\n" + " ".join(passage) + "\n" + texts[k + 1]
    return texts


# --- text arrays ----------------------------------------------------------------


def test_words_and_hashes(corpus):
    import pyarrow as pa

    data, offsets = utf8(pa.array(list(corpus.values())).slice(3))
    got = []
    for i, j in chunks(offsets, 500):
        part, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        s, e, d = word_bounds(part, o)
        got += [(i + k, part[a:b].tobytes().decode()) for a, b, k in zip(s, e, d)]
    assert got == [(k, w) for k, t in enumerate(list(corpus.values())[3:]) for w in WORD.findall(t or "")]
    s, e, _ = word_bounds(data, offsets)
    said = [data[a:b].tobytes() for a, b in zip(s, e)]
    h = hash_spans(data, s, e)
    assert len(set(zip(said, h.tolist()))) == len(set(said)) == len(set(h.tolist()))


def thue_morse(n):
    """Two words of n letters, each the other's letters swapped: sums of powers modulo 2^64 cannot tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 256, 1024, 2048])
def test_hashes_tell_thue_morse_words_apart(n):
    from provena.llm.textarrays import hashed_words

    data = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
    h, _ = hashed_words(data, np.array([0, len(data)]))
    assert len(set(h.tolist())) == 2


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_thue_morse_words_apart(spark, n):
    import public_tokenizers
    import tiktoken.load

    x, y = thue_morse(n)
    df = frame(spark, [x, y])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(df).collect()} == {0: 0, 1: 1}
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()} == {0: x, 1: y}
    got = {r["doc_id"]: r["n_known"] for r in bloom_lm.score(df, bloom_lm.fit(df.where("doc_id = 0"))).collect()}
    assert got == {0: 2, 1: 1}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.Encoder(path)
    want = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    for t in (x, y):
        assert enc.encode(t) == want.encode_ordinary(t)
        assert enc.decode(enc.encode(t)).decode() == t


def test_long_texts_in_blocks(monkeypatch):
    from provena.llm import textarrays

    rng = random.Random(3)
    units = ["".join(rng.choice("ab  C\n") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["x" * 300, ""]
    data = np.frombuffer("".join(units).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    h, unit = textarrays.hashed_words(data, offsets)
    monkeypatch.setattr(textarrays, "WORD_BLOCK", 37)
    # A block's end is not a unit's end: words of two units that touch stay apart.
    h2, unit2 = textarrays.hashed_words(data, offsets)
    assert (h == h2).all() and (unit == unit2).all()


def test_order_in_units_resolves_ties():
    from provena.llm.textarrays import order_in_units

    rng = np.random.default_rng(2)
    unit, level = np.sort(rng.integers(0, 300, 5000)), rng.integers(0, 5, 5000).astype(np.uint8)
    for key in (rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 40, 5000, dtype=np.uint64)):
        for args, columns in ((dict(level=level, level_bits=8), (unit, level, key)), ({}, (unit, key))):
            order = order_in_units(unit, key, 300, **args)
            assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns))


def test_hash_index():
    keys = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    index = HashIndex(keys, np.arange(1000))
    assert (index.get(keys) == np.arange(1000)).all() and (index.get(keys + np.uint64(1)) == -1).all()
    assert (HashIndex(keys[:0], np.zeros(0, int)).get(keys) == -1).all()


# --- operator 1 -------------------------------------------------------------------


def link_components(texts, n=4, percent=85):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("adaptive", [True, False])
def test_ngram_join_equals_brute_force(spark, corpus, adaptive):
    got = ngram_join.ngram_join(frame(spark, corpus), adaptive=adaptive).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == link_components(corpus)
    assert len(got) == len(corpus)


def test_ngram_join_odd_tables(spark):
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    df = frame(spark, ["a b c d e", "a b c d e"]).union(frame(spark, {0: "a b c d e"})).union(spark.createDataFrame([(None, "a b c d e", "", 0, 0, "", 0), (None, "", "", 0, 0, "", 0)], DOCS))
    got = ngram_join.ngram_join(df).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["n_shingles"]) == [("0", 0), ("0", 0), ("1", 0), ("None", 0)]
    assert [r["component_id"] for r in got if not r["n_shingles"]] == [None]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(12)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["c"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and set(label) - set(got) <= {a for a, b in pairs if a == b}


# --- operator 6 ------------------------------------------------------------------------


def lines_left(texts, n=5, percent=80):
    seen, out = [], {}
    for k in sorted(texts):
        if texts[k] is None:
            out[k] = None
            continue
        left = []
        for line in texts[k].split("\n"):
            w = words(line)
            s = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
            if not s or not any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        out[k] = "\n".join(left)
    return out


def test_line_dedup_equals_brute_force(spark, corpus):
    df = frame(spark, corpus)
    out = line_dedup.line_dedup(df)
    assert set(out.columns) == {*df.columns, "n_lines"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == lines_left(corpus)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# --- operators 2 and 10 --------------------------------------------------------------------


def test_toxicity_learns_words_and_ignores_groups(spark):
    rng, voc = random.Random(5), vocabulary(5)
    texts, labels = {}, []
    for k in range(240):
        w = [rng.choice(voc) for _ in range(30)]
        toxic = k % 3 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(["zzidiot", "zzscum"])
        if k % 4 == 0 or toxic and k % 2 == 0:
            w.insert(3, "women")
        texts[k] = " ".join(w) + "."
        labels.append((k, 1, int(toxic), 9))
    df, lab = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    model = toxicity.fit(df, lab, keep=F.col("doc_id") % 5 != 0, vocabulary=600)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [k for k in texts if k % 5 == 0]
    assert sum((got[k]["score"] >= 0.5) == (k % 3 == 0) for k in held) >= 0.95 * len(held)
    odd = toxicity.score(frame(spark, {1: None, 2: "", 3: "women women", 4: "men", 5: "zzidiot " * 3000}), model)
    s = {r["doc_id"]: r["score"] for r in odd.collect()}
    assert s[1] == s[2] and abs(s[3] - s[4]) < 0.05 and s[3] < 0.5 < s[5]
    none = toxicity.fit(df, lab.where("false"))
    assert toxicity.score(df, none).select("score").distinct().count() == 1


def test_counterfactual_penalty_pulls_weights_together():
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 2).astype(float)
    x = np.stack([y, (rng.random(200) < 0.2 + 0.6 * y)], 1).astype(np.float32)
    changes = np.tile(np.array([[0.0, 1.0]], np.float32), (20, 1))
    free, _ = toxicity.fit_weights(y, x, changes[:0], 1e-3, 0.0)
    tied, _ = toxicity.fit_weights(y, x, changes, 1e-3, 5.0)
    assert abs(tied[1]) < 0.2 * abs(free[1]) + 0.05 and tied[0] > 1


def test_swaps_are_summed_as_they_are():
    """The root that the fit gets has the mean squared score change of all swaps."""
    import pyarrow as pa

    texts = ["Some women are here. All men came.", "no group", "a muslim woman. Women!", None]
    known = np.unique(np.array(sorted({f for t in texts if t for s in re.split("[.!]", t.lower()) for w in ("women", "men", "woman", "man", "girls", "christian") for f in toxicity.text_features(s + w)}), np.uint64))
    rows = {}
    for b in toxicity._swap_products([pa.record_batch({"t": pa.array(texts)})], known, toxicity.IDENTITY_TERMS):
        for i, j, v in zip(*(c.to_pylist() for c in b.columns)):
            rows[i, j] = rows.get((i, j), 0) + v
    changes, n = toxicity._changes([(i, j, v) for (i, j), v in rows.items()], len(known))
    at, w = {int(f): i for i, f in enumerate(known)}, np.random.default_rng(1).normal(size=len(known))
    each = [sum(v * w[f] for f, v in swap) for t in texts if t for swap in toxicity._swaps(t, at, toxicity.IDENTITY_TERMS)]
    assert n == len(each) == 17 and np.mean((changes @ w) ** 2) == pytest.approx(np.mean(np.square(each)), rel=1e-4)


def test_penalty_equals_brute_force_descent():
    """FISTA's weights are no worse than those of many small plain proximal steps on the same loss."""
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 120).astype(float), (rng.random((120, 6)) < 0.4).astype(np.float32)
    x[:, 0] = np.where(rng.random(120) < 0.85, y, x[:, 0])
    changes = rng.normal(size=(30, 6)).astype(np.float32)
    share = y.mean()
    weight = np.sqrt(np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - y * z)).mean() + 1e-2 * np.abs(w).sum() + 0.5 * ((changes @ w) ** 2).mean()

    w, b = np.zeros(6), 0.0
    for _ in range(6000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w = w - 0.05 * (x.T @ g + changes.T @ (changes @ w) / len(changes))
        w, b = np.sign(w) * np.maximum(np.abs(w) - 0.05 * 1e-2, 0), b - 0.05 * g.sum()
    assert loss(*toxicity.fit_weights(y, x, changes, 1e-2, 0.5)) <= loss(w, b) + 1e-5


def test_mil_quality(spark):
    rng, voc = random.Random(6), vocabulary(6)
    texts, labels = {}, []
    for k in range(200):
        w = [rng.choice(voc) for _ in range(rng.randint(20, 300))]
        if k % 2:
            at = rng.randrange(max(1, len(w) - 15))
            w[at:at + 15] = [x + "$$$" for x in w[at:at + 15]]
        texts[k] = " ".join(w)
        labels.append((k, int(k % 2 == 0), 0))
    df, lab = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mil_quality.fit(df, lab, keep=F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in mil_quality.score(df, model).collect()}
    held = [k for k in texts if k % 3 == 1]
    assert sum((got[k] >= 0.5) == (k % 2 == 0) for k in held) >= 0.9 * len(held)
    odd = mil_quality.score(frame(spark, {1: None, 2: "", 3: " ", 4: "x" * 5000}), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    kept = mil_quality.keep(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k] >= 0.5}
    assert mil_quality.fit(df, lab.where("false")) == {"rate": 0.5}


def test_mil_gradients():
    rng = np.random.default_rng(2)
    x, count, y = rng.random((9, mil_quality.WIDTH)), np.array([3, 2, 4]), np.array([1.0, 0.0, 1.0])
    m = mil_quality.train(x, count, y, size=4, epochs=1)
    g = mil_quality._gradients(m, x, count, y, np.ones(3))

    def loss(m):
        z = mil_quality.forward(m, x, count)[-1]
        return (np.logaddexp(0, z) - y * z).mean()

    for name in ("W", "V", "U", "w", "c"):
        at = tuple(np.array(m[name].shape) // 2)
        up, down = {k: np.copy(v) for k, v in m.items()}, {k: np.copy(v) for k, v in m.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


# --- operator 3 -------------------------------------------------------------------------------


def plain_spans(t):
    """The contract's base spans, said anew: own patterns, own digit sum, by start and then kind."""
    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def passes(kind, said):
        d = [int(c) for c in said if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in said.split("."))
        if kind == 2:
            doubled = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
            return 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    found = [(m.start(), kind, m.end()) for kind, x in enumerate(kinds) for m in re.finditer(x, t) if passes(kind, m[0])]
    return [(s, e, kind) for s, kind, e in sorted(found)]


def span_text(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[kind]}:{s}:{e}" for s, e, kind in spans)


@pytest.fixture(scope="module")
def tagger():
    x, y = pii.made_windows(420)
    return pii.train(x.astype(np.int64), y.astype(np.int64), steps=150)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@+- (9)0b%4") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("+1-555-123-4567@sms.net", "4111111111111111@mail.com", "000000000000.1.1.1", "4111111111111111.1.1.1@x.y"):  # kinds that share a start
        assert pii.base_spans(t) == plain_spans(t) and len(plain_spans(t)) > 1
        assert pii.said(reversed(pii.base_spans(t))) == span_text(plain_spans(t))
    assert pii.said(pii.base_spans("+1-555-123-4567@sms.net")) == "email:0:23,phone:0:15"


def test_tagger_finds_what_the_patterns_miss():
    """Recall of spans that the base lacks, and correctness of what is added, on texts written with another seed."""
    x, y = pii.made_windows()
    model = pii.train(x.astype(np.int64), y.astype(np.int64), steps=300)
    made = list(pii.made_texts(1200, 77))
    bases = [pii.base_spans(t) for t, _ in made]
    added = pii.added_spans([t for t, _ in made], bases, model)
    free = [[s for s in spans if not any(s[0] < e and b < s[1] for b, e, _ in base)] for (_, spans), base in zip(made, bases)]
    hits = sum(s in a for want, a in zip(free, added) for s in want)
    assert sum(map(len, free)) > 500 and hits >= 0.9 * sum(map(len, free))
    assert sum(s in spans for (_, spans), a in zip(made, added) for s in a) >= 0.97 * sum(map(len, added))


def test_tagger_reads_long_texts_alike(tagger):
    near = "call (279) 555-0216 now, or 033-877-2796. "
    long = near * 400
    got = pii.added_spans([near, long, ""], [pii.base_spans(near), pii.base_spans(long), []], tagger)
    assert [(s, e) for s, e, k in got[0]] == [(s, e) for s, e, k in got[1] if e <= len(near)] and got[2] == []
    assert len(got[1]) >= 400 * len(got[0]) - 2


def test_crf_gradients():
    x, y = (a.astype(np.int64) for a in pii.made_windows(14))
    m = {k: v.astype(float) for k, v in pii.train(x, y, steps=2).items()}
    _, g = pii.loss_and_gradients(m, x, y)
    for name, at in (("wxf", (1, 3)), ("whb", (2, 7)), ("wo", (3, 2)), ("tr", (0, 1)), ("st", (0,))):
        up, down = {k: v.copy() for k, v in m.items()}, {k: v.copy() for k, v in m.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((pii.loss_and_gradients(up, x, y)[0] - pii.loss_and_gradients(down, x, y)[0]) / 2e-5, abs=1e-6)


def test_pii_query_rows(spark, tagger):
    card = "4111 1111 1111 1111"
    texts = {1: "write a.b@x.example.com or +1 (279) 555-0216", 2: f"ip 10.0.0.300, {card}", 3: None, 4: "", 5: "no numbers here", 6: "é𝒳 " * 40 + "call (279) 555-0216 now",
             7: "12" * 3000, 8: "v2.0 of 1999-10-12", 9: "host 1.2.3.4 " * 50}
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts), tagger).collect()}
    for k, t in texts.items():
        base = plain_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(span_text(base).encode()).hexdigest()
        every = got[k]["spans"].split(",") if got[k]["spans"] else []
        assert set(span_text(base).split(",")) - {""} <= set(every) and len(every) == sum(got[k][f"n_{x}"] for x in pii.KINDS)
    assert [got[k]["n_added"] for k in (3, 4, 5, 8)] == [0, 0, 0, 0]
    start = texts[6].index("(279)")
    assert got[6]["spans"] == f"phone:{start}:{start + 14}"


# --- operator 4 ---------------------------------------------------------------------------------


def test_language_model(spark, corpus):
    df = frame(spark, corpus)
    train = {k: t for k, t in corpus.items() if zlib.crc32(str(k).encode()) % 5 != 1}
    model = bloom_lm.fit(df.where(F.col("doc_id").isin(*train)), frequent=100, context=40)
    got = {r["doc_id"]: r for r in bloom_lm.score(df, model).collect()}
    c = collections.Counter(w for t in train.values() for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for k, t in corpus.items():
        w = [*words(t), None]
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_language_model_score_equals_brute_force(spark):
    """With a filter wide enough to err nowhere, the score is the formula's on quantised counts."""
    rng, voc = random.Random(12), vocabulary(12, 60)
    texts = {k: " ".join(rng.choice(voc) for _ in range(rng.randint(0, 40))) for k in range(60)} | {60: None, 61: "", 62: "Never Seen words"}
    df = frame(spark, texts)
    model = bloom_lm.fit(df.where("doc_id < 50"), frequent=20, bits_per_entry=400.0, probes=6)
    base, share = model["base"], 0.7
    count, pairs = collections.Counter(), collections.Counter()
    for k in range(50):
        t = [*words(texts[k]), None]
        count.update(t)
        pairs.update(zip([None, *t[:-1]], t))
    total, distinct = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
    for r in bloom_lm.score(df, model).collect():
        t = [*words(texts[r["doc_id"]]), None]
        want = 0.0
        for v, w in zip([None, *t[:-1]], t):
            n = pairs[v, w]
            c = min(base ** (int(bloom_lm.level_of(np.array([n]), base)[0]) - 0.5) if n else 0.0, count[v], count[w])
            want += math.log10(share * c / count[v] + (1 - share) * p(w)) if count[v] else math.log10(p(w))
        assert r["score"] == pytest.approx(want, abs=1e-6)


def test_language_model_counts_bigrams_of_rare_words(spark):
    """More words than were once told apart in bigrams: those that were seen together are likelier than those that were not."""
    w = [f"w{k}" for k in range(10_000)]
    df = frame(spark, {k: f"{w[k]} {w[k + 1]} {w[k]} {w[k + 1]}" for k in range(0, 10_000, 2)})
    model = bloom_lm.fit(df, frequent=50, context=40)
    odd = {k: f"{w[k]} {w[k + 3]} {w[k]} {w[k + 3]}" for k in range(0, 9000, 100)}
    got = {r["doc_id"]: r for r in bloom_lm.score(df.where("doc_id < 9000 and doc_id % 100 = 0"), model).collect()}
    other = {r["doc_id"]: r for r in bloom_lm.score(frame(spark, odd), model).collect()}
    n, v = 25_000, 10_001
    p, end = 2.5 / (n + 0.5 * (v + 1)), 5000.5 / (n + 0.5 * (v + 1))
    for k in odd:
        assert got[k]["base_score"] == pytest.approx(4 * math.log10(p) + math.log10(end), rel=1e-9) and got[k]["base_score"] == pytest.approx(other[k]["base_score"], rel=1e-9)
        c2, c1 = 1.5 ** 1.5, 1.5 ** 0.5  # the middle of the levels of counts 2 and 1
        first, inner, turn, last = c1 / 5000, min(c2, 2) / 2, c1 / 2, c1 / 2
        want = math.log10(0.7 * first + 0.3 * p) + 2 * math.log10(0.7 * inner + 0.3 * p) + math.log10(0.7 * turn + 0.3 * p) + math.log10(0.7 * last + 0.3 * end)
        assert got[k]["score"] >= want - 1e-9
    assert sum(got[k]["score"] - want < 1e-6 for k in odd) > 0.8 * len(odd)
    assert all(got[k]["score"] > other[k]["score"] + 3 for k in odd)


def test_bloom_counts_are_quantised_counts():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys, n = np.arange(5000), rng.integers(1, 4000, 5000)
    q = bloom_lm.level_of(n, 1.5)
    seg = bloom_lm.Bloom.places(keys, 1, 0)[0]
    build = bloom_lm._segment(1.5, 12.0, 6)
    parts = [build(pa.table({"k": keys[seg == s], "q": q[seg == s], "seg": seg[seg == s].astype(np.int32)})).column("bits")[0].as_py() for s in range(bloom_lm.SEGMENTS)]
    bloom = bloom_lm.Bloom(parts, 6, 1.5)
    got = bloom.levels(keys)
    assert (got >= q).all() and (got == q).mean() > 0.97  # a filter overstates now and then, never understates
    assert (bloom.levels(np.arange(10_000, 20_000)) > 0).mean() < 0.03


def test_language_model_without_rows(spark, corpus):
    model = bloom_lm.fit(frame(spark, []))
    got = bloom_lm.score(frame(spark, {1: "a b", 2: None}), model).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert bloom_lm.score(frame(spark, []), model).count() == 0


# --- operator 5 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(path).ranks, special_tokens={})


def test_bpe_equals_the_library(spark, corpus, tokenizer):
    path, library = tokenizer
    rng = random.Random(1)
    texts = dict(corpus)
    for k in range(200, 600):
        texts[k] = "".join(rng.choice("aZé 1²'  \n\tsrelvmd!ß中٣   '''x..😀") for _ in range(rng.randint(0, 60)))
    texts |= {600: "ab" * 3000 + "x" * 5000, 601: " " * 400, 602: "'s't're've'm'll'd 's 'S"}
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), path).collect()}
    for k, t in texts.items():
        ids = library.encode_ordinary(t or "")
        r = got[k]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert r["ends"] == list(np.cumsum([len(library.decode_single_token_bytes(i)) for i in ids]).astype(int))
    back = bpe.decode(bpe.encode(frame(spark, texts), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in texts.items()}


def test_classes_of_all_code_points(tokenizer):
    path, library = tokenizer
    cps = [c for c in range(0x250) if not 0xD800 <= c < 0xE000] + list(range(0x2000, 0x2070)) + [0x3000, 0x1680, 0x4E00, 0x660, 0x1D4B3]
    for c in cps:
        t = f"a{chr(c)}1 {chr(c)}{chr(c)}b"
        assert bpe.encoder(path).encode(t) == library.encode_ordinary(t), hex(c)


# --- operator 7 ---------------------------------------------------------------------------------


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(1, 5, rng.integers(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a.astype(np.uint64), b[None].astype(np.uint64))[0] == h.max()


def test_decontamination_finds_copies_and_edits(spark):
    rng, voc = random.Random(8), vocabulary(8)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    items = {k: make(40) for k in range(6)}
    texts, want = {}, set()
    for k in range(120):
        w = make(150)
        if k % 4 == 0:
            passage = list(items[k % 6])
            for at in range(3, 40, 8):
                if k % 8:
                    passage[at] = rng.choice(voc)
            w[50:50] = passage if k % 3 else [x.upper() + "," for x in passage]
            want.add((k, k % 6))
        texts[k] = " ".join(w)
    texts |= {200: None, 201: "", 202: "two words"}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(6, None), (7, ""), (8, "two words")], "item_id long, text string")
    df = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == want | {(202, 8)}
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(texts) - {a for a, _ in got}
    assert decontaminate.matches(df, bench.where("false")).count() == 0 and decontaminate.matches(frame(spark, []), bench).count() == 0


def test_decontamination_finds_copies_with_most_ngrams_broken(spark):
    """Every 4th or 5th word changed, with and without exact copies elsewhere."""
    rng, voc = random.Random(21), vocabulary(21)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    items = {k: make(45) for k in range(8)}
    texts, want = {}, set()
    for k, own in items.items():
        copy = list(own)
        for at in range(3, 45, 4 + k % 2):
            copy[at] = f"changed{at}"
        for j, passage in enumerate([copy] + [own] * (5 if k % 4 > 1 else 0)):
            texts[10 * k + j] = " ".join(make(60) + passage + make(60))
            want.add((10 * k + j, k))
    texts |= {1000 + k: " ".join(make(150)) for k in range(20)}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame(spark, texts), bench).collect()} == want


def test_decontamination_equals_brute_force_on_all_pairs(spark):
    """Every document aligned whole with every item by plain Smith-Waterman; those that share no three words in a row can't be found."""
    rng, voc = random.Random(31), vocabulary(31, 80)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    items = {k: make(rng.randint(5, 30)) for k in range(7)}
    texts = {}
    for k in range(70):
        w, own = make(rng.randint(0, 40)), list(items[k % 7])
        for _ in range(rng.randint(0, len(own))):  # words changed, left out, put in
            at, what = rng.randrange(len(own)), rng.random()
            own[at:at + 1] = [rng.choice(voc)] if what < 0.5 else [] if what < 0.75 else [own[at], rng.choice(voc)]
            own = own or ["gone"]
        at = rng.randint(0, len(w))
        texts[k] = w[:at] + own + w[at:]

    def best(a, b):
        h, top = np.zeros(len(b) + 1, int), 0
        for x in a:
            new = np.zeros_like(h)
            for j, y in enumerate(b):
                new[j + 1] = max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, new[j] - 1)
            h, top = new, max(top, new.max())
        return top / (2 * len(a))

    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    want = {(k, q): best(own, w) for k, w in texts.items() for q, own in items.items() if grams(w) & grams(own)}
    want = {pair: score for pair, score in want.items() if score >= 0.5}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(frame(spark, {k: " ".join(w) for k, w in texts.items()}), bench).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[x] == pytest.approx(want[x]) for x in want)


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "string", "date"])
def test_decontamination_of_any_item_id(spark, kind):
    said = "2024-01-05" if kind == "date" else "5"
    bench = spark.sql(f"SELECT CAST('{said}' AS {kind}) AS doc_id, 'one two three four five six' AS text")
    got = decontaminate.matches(frame(spark, {1: "x one two three four five six y", 2: "x"}), bench, item_col="doc_id").collect()
    assert [(r["doc_id"], str(r["item_doc_id"])) for r in got] == [(1, said)]


# --- operator 8 ---------------------------------------------------------------------------------


def test_quality_rules(spark, corpus):
    texts = dict(corpus)
    rng, voc = random.Random(9), vocabulary(9)
    good = {300 + k: " ".join(rng.choice(voc) for _ in range(80)) for k in range(60)}
    junk = {400 + k: " ".join(f"zq{rng.randrange(9)}$#" for _ in range(80)) for k in range(20)}
    texts |= good | junk | {500: "a\na\n \n \nb c\nb c\nb c", 501: "x y z " * 40}
    trusted = spark.createDataFrame([(k, 1) for k in list(good)[:40]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts), trusted).collect()}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        inside = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)
        )
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert all(got[k]["kept"] for k in list(good)[40:]) and not any(got[k]["kept"] for k in junk)
    plan = quality_rules.quality_rules(frame(spark, texts), trusted)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    alone = quality_rules.quality_rules(frame(spark, good), trusted.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in alone)


def test_quality_ratio_and_threshold_equal_brute_force(spark):
    import xxhash

    rng, voc = random.Random(19), vocabulary(19, 120)
    texts = {k: " ".join(rng.choice(voc[:60] if k % 3 else voc) for _ in range(rng.randint(40, 90))) for k in range(90)} | {90: None, 91: "", 92: "one"}
    target = [k for k in range(90) if k % 3]
    trusted = spark.createDataFrame([(k, 1) for k in target], "doc_id long, quality int")
    size, deviations = 256, 0.5
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts), trusted, n_buckets=size, deviations=deviations).collect()}

    def grams(t):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(t or "")]
        return [x % size for x in h] + [((x << 1) ^ (h[i + 1] if i + 1 < len(h) else 1)) % size for i, x in enumerate(h)]

    aside = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    raw, own = collections.Counter(range(size)), collections.Counter(range(size))
    for k, t in texts.items():
        raw.update(grams(t))
        if k in target and not aside(k):
            own.update(grams(t))
    r, o = sum(raw.values()), sum(own.values())
    ratio = {b: math.log(own[b] / o) - math.log(raw[b] / r) for b in range(size)}
    mean = {k: sum(ratio[b] for b in grams(t)) / max(1, len(grams(t))) for k, t in texts.items()}
    held = [mean[k] for k in target if aside(k) and len(WORD.findall(texts[k])) >= 50]
    least = np.mean(held) - deviations * np.std(held)
    for k in texts:
        assert got[k]["log_ratio"] == pytest.approx(mean[k], abs=2e-5)
        assert got[k]["kept"] == (not got[k]["base_failed"] and mean[k] >= least) or abs(mean[k] - least) < 2e-5
    assert 0 < sum(r["kept"] for r in got.values()) < sum(not r["base_failed"] for r in got.values())
    assert quality_rules.quality_rules(frame(spark, []), trusted).count() == 0


# --- operator 9 ---------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, "assistant", "x"), (3, 1, None, "</turn>\n\\b\\"),
             (4, 0, "a: b#", "### user: \n"), (-7, 0, "user", odd), (-7, 1, "assistant", odd), (5, 0, "user", "long " * 4000), (5, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    out = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    marks = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for k, r in back.items():
        own = sorted((t for t in turns if t[0] == k), key=lambda t: t[1])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r["loss_text"] == loss and marks[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and marks[k]["loss_chars"] == len(loss)
        assert marks[k]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert marks[k]["formatted_chars"] == len(r["formatted"]) and marks[k]["n_turns"] == len(own)
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    assert {k: r["first_error"] for k, r in marks.items()} == {1: 0, 2: 0, 3: 1, 4: 1, -7: 0, 5: 0}
    assert chat.format_chats(df.where("false")).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng, voc = random.Random(11), vocabulary(11, 900)
    make = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    clean = {k: "\n".join(make(40) for _ in range(3)) for k in range(80)}
    item = make(40)
    texts = dict(clean)
    texts |= {100: clean[3], 101: clean[4] + "\n" + make(40), 102: make(60) + " " + item + " " + make(60)}
    texts |= {200 + k: " ".join(w + "$$$" for w in make(120).split()) for k in range(40)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 200), 0) for k in texts if k % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "leaks", "tokens"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert name == "tokens" or now.columns == docs.columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert set(clean) <= kept[-1] and not any(k >= 200 for k in kept[0])
    assert 100 not in kept[1] and 101 in kept[1] and 102 in kept[2] and 102 not in kept[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[-1]


ODD = "doc_id long, text string, lang string, source string, n_chars long, __k string, __bad int, __lost long, c int, i int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2, 3, 4, 5) for i, t in rows], ODD)


def test_stages_keep_rows_apart_that_share_an_id(spark, tmp_path):
    """Null ids, repeated ids and rows, null, empty and wordless texts, columns of names used inside."""
    import corpus_pipeline

    rng, voc = random.Random(41), vocabulary(41, 900)
    make = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    a, b, c, item = make(80), make(80), make(80), make(30)
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (3, None), (3, ""), (4, " \n "), (4, " \n "), (5, c), (5, c), (6, b + " " + item), (6, make(60))]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs(spark, rows)
    left = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect())
    assert left == collections.Counter([(1, a), (1, b), (3, None), (3, ""), (4, " \n "), (4, " \n "), (5, c), (6, rows[-2][1]), (6, rows[-1][1])])
    left = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect())
    assert left == collections.Counter(rows) - collections.Counter([rows[-2]])
    found = corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in found.collect())
    # a and c go where an earlier row, null ids first, holds them; b and the last texts stand in one place each
    assert left == collections.Counter([(1, b), (None, a), (None, c), (3, None), (3, ""), (4, " \n "), (4, " \n "), (6, rows[-2][1]), (6, rows[-1][1])])


def test_stages_pass_empty_tables_through(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs(spark, []), str(tmp_path))
        assert out.count() == 0 and (name == "tokens" or out.columns == odd_docs(spark, []).columns)


def test_operators_on_empty_tables(spark):
    import public_tokenizers

    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for out in (
        toxicity.score(none, toxicity.fit(none, labels)), mil_quality.score(none, mil_quality.fit(none, labels)), bloom_lm.score(none, bloom_lm.fit(none)),
        bpe.encode(none, path), bpe.encode(none, path, digests_only=True), line_dedup.line_dedup(none), ngram_join.ngram_join(none),
    ):
        assert out.count() == 0


def test_near_copies_of_the_pipeline_are_those_of_0_8(spark):
    """A copy cut to its first 82 % goes, one cut to its first 78 % stays."""
    import corpus_pipeline

    words_of = lambda k: [f"a{k}b{i}" for i in range(300)]
    texts = {1: words_of(1), 2: words_of(1)[:246], 3: words_of(3), 4: words_of(3)[:234]}
    got = corpus_pipeline.near_copies(spark, frame(spark, {k: " ".join(w) for k, w in texts.items()}), "")
    assert {r["doc_id"] for r in got.collect()} == {1, 3, 4}
