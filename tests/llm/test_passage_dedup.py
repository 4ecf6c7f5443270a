import hashlib
import random

import numpy as np
import pytest

from quillbank.llm import passage_dedup as pd
from quillbank.llm.lyndon_suffix import suffix_array


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((d, i))
    gone = [np.zeros(len(r) + 1, bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for raw, g in zip(raws, gone, strict=True):
        g = g[: len(raw)]
        out.append((len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(raw, g, strict=True) if not x)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdé \n"

    def text(n):
        return "".join(rng.choices(alphabet, k=n))

    shared = [text(rng.randint(20, 200)) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 30))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], None, "", "a" * 3000, "ab" * 700, "a" * 39, text(30) * 2, texts[5][10:]]
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 1)])
def test_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in pd.cut_repeats(df, length=40, gram=10, step=10, hot=hot, block=2000).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_production_parameters(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) + (passage[rng.randint(0, 90) :] if i % 3 else "") + " ".join(rng.choices(words, k=50)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in pd.cut_repeats(df).collect()}
    want = brute(texts, pd.LENGTH)
    assert sum(w[1] for w in want) > 5000
    assert [got[i] for i in range(len(texts))] == want


def test_shared_and_missing_keys(spark):
    a, b = "x1y2" * 20 + "q", "".join(random.Random(1).choices("abcdefghij", k=90))
    df = spark.createDataFrame([(1, a), (1, b), (None, b), (None, "short")], "doc_id long, text string")
    got = sorted((r.text, r.n_removed) for r in pd.cut_repeats(df, length=40, gram=10, step=10).collect())
    assert got == sorted([(a, brute([a, b], 40)[0][1]), (b, 90), (b, 90), ("short", 0)])


def test_empty(spark):
    assert pd.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for k in range(400):
        size = rng.integers(1, 50)
        text = np.concatenate([rng.integers(0 if k % 2 else 1, rng.integers(2, 6), size), [0]]).astype(np.int32)
        ends = np.flatnonzero(text == 0)
        upto = [ends[np.searchsorted(ends, i)] + 1 for i in range(len(text))]
        got = suffix_array(text)
        assert sorted(got.tolist()) == list(range(len(text)))
        assert [tuple(text[i : upto[i]]) for i in got] == sorted(tuple(text[i : upto[i]]) for i in range(len(text)))


def test_one_key_for_many_texts(spark):
    """Thousands of different texts under one key or none: the names of rows are told by all their bits."""
    rng = random.Random(3)
    texts = [f"{i:05d}" + "".join(rng.choices("abcdefgh", k=10)) for i in range(3000)]
    texts += [f"{i}" + "z" * 45 + f"{i}" for i in range(100, 130)]
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    names = df.select(*(c.alias(n) for c, n in zip(pd._names("doc_id", "text"), "ab", strict=True)))
    assert names.select("a").distinct().count() == len(texts)
    got = {r.text: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in pd.cut_repeats(df, length=40, gram=10, step=10).collect()}
    assert [got[t] for t in texts] == brute(texts, 40)


def test_copies_are_sorted_once(monkeypatch):
    """Contexts that share a passage, at different lengths, between different bytes: one suffix array holds the passage once, and every place is told."""
    rng = random.Random(5)
    left, middle, right = ("".join(rng.choices("abcdefgh", k=n)).encode() for n in (60, 10, 60))
    contexts, texts = [], []
    for i in range(40):
        a, b = left[rng.randint(0, 40) :] if i else left, right[: rng.randint(20, 60)] if i else right
        raw = bytes(rng.choices(b"ijklm", k=12)) + a + middle + b + bytes(rng.choices(b"nopqr", k=12))
        at = 12 + len(a)
        lo, hi = max(at - 30, 0), min(at + 40, len(raw))
        contexts.append((7, at - lo, raw[lo:hi]))
        texts.append(raw[lo:hi].decode())
    parts = pd.thin_out(pd.Grams(40, 10, 10), contexts)
    own = [k for k, p in enumerate(parts) if p[3] == k]
    assert len(parts) == 40 and len(own) < 4
    strings = [(contexts[parts[k][0]][2][parts[k][1] : parts[k][2]], contexts[parts[k][0]][1] - parts[k][1]) for k in own]
    sorted_bytes = []
    monkeypatch.setattr("quillbank.llm.lyndon_suffix.suffix_array", lambda text: sorted_bytes.append(len(text)) or suffix_array(text))
    copies = np.array([(own.index(s), shift, b - a - 39) for _, a, b, s, shift in parts])
    copy, lo, hi = pd.repeated_in(strings, copies, 40, 10)
    assert sum(sorted_bytes) < 4 * 70
    gone = [np.zeros(len(t) + 1, int) for t in texts]
    for c, a, b in zip(copy, lo, hi, strict=True):
        i, begin = parts[c][:2]
        gone[i][begin + a : begin + b] = 1
    assert [(int(g.sum()), int((np.diff(np.concatenate([[0], g])) == 1).sum())) for g in gone] == [w[1:3] for w in brute(texts, 40)]


def test_large_suffix_array_of_copies():
    """Groups of which few members are split at a time."""
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 5, 120)
    text = np.concatenate([np.concatenate([rng.integers(1, 5, rng.integers(0, 40)), shared[rng.integers(0, 60) :], [300 + k % 7, 0]]) for k in range(60)]).astype(np.int32)
    ends = np.flatnonzero(text == 0)
    upto = [ends[np.searchsorted(ends, i)] + 1 for i in range(len(text))]
    got = suffix_array(text)
    assert sorted(got.tolist()) == list(range(len(text)))
    assert [tuple(text[i : upto[i]]) for i in got] == sorted(tuple(text[i : upto[i]]) for i in range(len(text)))
