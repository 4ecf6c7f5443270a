import numpy as np

from quillbank.llm import embedding_dedup as ed


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    pairs = 0
    for n, (i, a) in enumerate(ok):
        for j, b in ok[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                pairs += 1
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (links[i], root(i)) for i, _ in rows}, pairs


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 24))
    rows = [base[i % 60] * (1 + i % 3) + (0.1 * rng.normal(size=24) if i >= 60 else 0) for i in range(300)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, [float("inf")] + [1.0] * 23), (404, [None] + [1.0] * 23), (405, []), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    return rows


def test_recall_and_precision(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df.repartition(3)).collect()}
    want, pairs = brute(rows)
    assert got.keys() == want.keys() and pairs > 1000
    assert sum(n for n, _, _ in got.values()) / 2 >= 0.9 * pairs
    assert all(got[i][0] <= want[i][0] for i in want)
    for i in range(400, 406):
        assert got[i] == (0, i, True)
    assert got[406] == (1, 406, True) and got[407] == (1, 406, False)
    assert all(k == (c == i) for i, (_, c, k) in got.items())


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(1)
    one = rng.normal(size=24)
    rows = [(i, [float(np.float32(x)) for x in one + 0.05 * rng.normal(size=24)]) for i in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want, pairs = brute(rows)
    assert sum(n for n, _ in got.values()) / 2 >= 0.9 * pairs and all(got[i][0] <= want[i][0] for i in want)
    assert {c for _, c in got.values()} == {0}


def test_empty(spark):
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_many_lengths(spark, monkeypatch):
    """Lengths beyond those that have pivots are compared exactly, in blocks."""
    monkeypatch.setattr(ed, "MOST_LENGTHS", 2)
    monkeypatch.setattr(ed, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = []
    for dim in range(1, 8):
        base = rng.normal(size=(3, dim))
        rows += [(len(rows) + i, [float(np.float32(x)) for x in base[i % 3] + 0.05 * rng.normal(size=dim)]) for i in range(60 - 4 * dim)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want, _ = brute(rows)
    lengths = {i: len(v) for i, v in rows}
    assert all(got[i] == want[i] for i in want if lengths[i] > 2)
    assert all(got[i][0] <= want[i][0] for i in want)


def test_samples_are_bounded():
    for dim in (2, 64, 768, 4096, 100_000):
        k = ed.n_pivots(10**12, dim)
        assert k == 2 * ed.NEAREST or 8 * dim * k <= ed.PIVOT_BYTES
        assert ed.n_sample(k, dim) * 8 * dim <= max(2 * ed.PIVOT_BYTES, 4 * ed.NEAREST * 8 * dim)
