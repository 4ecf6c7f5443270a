import random

import numpy as np
import pytest

from quillbank.llm import near_dedup
from quillbank.llm.components import components


def sets(text, width):
    w = near_dedup.split_words(text)
    width = min(width, len(w))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def brute(rows, width, percent=80):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    full = {d: sets(t, width) for d, t in rows}
    for a in full:
        for b in full:
            shared = len(full[a] & full[b])
            if a < b and shared and near_dedup.linked(len(full[a]), len(full[b]), shared, percent):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(full[d]), root(d)) for d in full}


def corpus(seed, copies=120):
    rng = random.Random(seed)
    vocabulary = [f"Word{i}" for i in range(400)]
    rows, bases = [], [rng.choices(vocabulary, k=80) for _ in range(4)]
    for i in range(copies):
        words = list(bases[0] if i % 2 else rng.choice(bases))
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(words)))
    rows += [(copies + i, t) for i, t in enumerate([None, "", "  ", "one", "ONE", "one two", "one two ", "É é", "é é", "x " * 30000, "x x", rows[3][1], rows[3][1].upper()])]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, digest string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df.repartition(3), width=width).collect()}
    assert got == brute(rows, width)
    kept = near_dedup.keep_one(df, width=width)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in got.items() if d == c}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    factors = near_dedup.multipliers()
    a, b = (rng.integers(0, 2**63, 900, dtype=np.uint64) for _ in range(2))
    b[:800] = a[:800]
    x, y = near_dedup.registers(a, factors), near_dedup.registers(b, factors)
    assert (near_dedup.merge(x, y) == near_dedup.registers(np.union1d(a, b), factors)).all()
    got = near_dedup.estimate([(x > y).sum()], [(x < y).sum()], [900], [900])[0]
    assert abs(got - 0.8) < 0.15


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_rows_that_share_a_key_or_have_none(spark):
    words = [f"w{i}" for i in range(2000)]
    text = [" ".join(words[100 * i : 100 * i + 60]) for i in range(12)]
    near = [t + " more" for t in text]
    rows = [
        (1, text[0]), (None, text[0]), (None, text[1]), (None, None), (2, text[2]), (2, text[3]), (1, text[3]), (3, near[2]), (4, near[3]),
        (None, text[4]), (None, near[4]), (5, text[5]), (5, text[5]), (5, text[6]), (None, text[7]), (None, text[7]),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 9
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (3, 4)} == {3: 2, 4: 1}
    kept = [near_dedup.keep_one(d).collect() for d in (df, df.repartition(5))]
    assert all(sorted(k, key=str) == sorted(kept[0], key=str) for k in kept)
    held = sorted(((r.doc_id, r.text) for r in kept[0] if r.text not in (text[4], near[4])), key=str)
    assert held == sorted([(1, text[0]), (None, text[1]), (None, None), (2, text[2]), (1, text[3]), (5, text[5]), (5, text[6]), (None, text[7])], key=str)
    assert len(kept[0]) == 9 and {r.extra for r in kept[0]} >= {11, 14}


def crowded(rng, vocabulary, length, edits, copies):
    """Near copies on a ring: neighbours are alike, those further apart share bands without being linked."""
    base = rng.choices(vocabulary, k=length)
    rows = []
    for _ in range(copies):
        at = rng.randrange(length - edits)
        base = [*base[:at], *rng.choices(vocabulary, k=edits), *base[at + edits :]]
        rows.append(" ".join(base))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_crowded_buckets_in_small_blocks(spark, monkeypatch, width):
    """Blocks of a few texts: some hold nothing but texts that ask, and texts outgrow their block."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 200)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(4) for t in crowded(rng, vocabulary, 70, 6, 40)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=width).collect()}
    assert got == brute(rows, width)


def test_long_texts_that_share_bands_unlinked(spark):
    """Texts beyond a block's bytes at pairwise similarity 0.69: in common buckets, never linked, with blocks that only ask."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60_000)]
    base = rng.sample(vocabulary, 40_000) * 6
    rows = []
    for i in range(4):
        # Distinct shingles decide: tails of new words, a tenth and a bit of the distinct ones each.
        rows.append((i, " ".join(base + [f"tail{i}x{j}" for j in range(8_900)])))
    rows.append((9, rows[2][1] + " one more"))
    assert min(len(t) for _, t in rows) > near_dedup.BLOCK_BYTES
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), width=2).collect()}
    want = brute(rows, 2)
    assert got == want and {c for _, c in want.values()} == {0, 1, 2, 3}
