import random
import zlib

import numpy as np
import pytest

from quillbank.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    common = random.Random(9)
    plain = ["".join(common.choices("abdeinorst", k=common.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(0, 200))
        y = i % 4 == 0
        for _ in range(2 if y else 0):
            # The stem is what tells; the rest of the word is seldom seen twice.
            words.insert(rng.randrange(len(words) + 1), "zux" + "".join(rng.choices("aeiou", k=5)))
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return tx.fit(*corpus(400, 1))


def test_held_out_accuracy(model):
    texts, labels = corpus(200, 2)
    got = tx.Scorer(*model).scores(texts) >= tx.THRESHOLD
    assert (got == np.array(labels, bool)).mean() >= 0.95


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        first, length, doc = tx.windows([7, n])
        own = doc == 1
        covered = np.zeros(n + 1, int)
        for f, k in zip(first[own] - 7, length[own], strict=True):
            covered[f : f + k] += 1
        assert (covered[:n] >= 1).all() and own.sum() >= 1
        assert n <= 48 or (covered[16 : n - 32] >= 2).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.project = lambda x: np.stack([x @ net.p["wx"][d] + net.p["b"][d] for d in (0, 1)], axis=1)
    x = rng.normal(size=(6, tx.DIM))
    ids, mask = rng.integers(0, 6, (3, 5)), np.ones((3, 5))
    mask[1, 3:] = 0
    y = np.array([1.0, 0.0, 1.0])
    _, g, d_x = net.gradients(x, ids, mask, y)

    def loss():
        return net.gradients(x, ids, mask, y)[0]

    for name in ("wx", "u", "b", "a", "v", "o", "c"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name
    x[2, 1] += 1e-3
    up = loss()
    x[2, 1] -= 2e-3
    assert d_x[2, 1] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=2e-4)


def test_rows(spark, model):
    texts, _ = corpus(10, 3)
    rows = [(i, t, 0.5) for i, t in enumerate([*texts, None, "", "x" * 20000, "word " * 20000, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = {r.doc_id: r for r in tx.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[10].score == got[11].score and got[0].score == got[14].score
    assert tx.drop_toxic(df, model).columns == df.columns
    assert tx.score(df.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in tx.score(docs, tx.train(docs, labels)).collect()] == [0.0]


def plain_score(vocabulary, net, text):
    """Window by window and word by word, with plain loops over the formulas of the network."""
    words = [tx.core(w) for w in tx.split(text)]
    h_, p = tx.HIDDEN, {k: np.asarray(v, float) for k, v in net.p.items()}
    starts, at = [0], 0
    while at + tx.WINDOW < len(words):
        at += tx.STRIDE
        starts.append(at)
    best = -np.inf
    for start in starts:
        window = words[start : start + tx.WINDOW]
        inputs = []
        for w in window:
            fixed, bucket, grams, _ = vocabulary.inputs([w])
            inputs.append(np.concatenate([fixed[0], p["word"][bucket[0]], p["gram"][grams].mean(axis=0)]))
        states = np.zeros((len(window), 2 * h_))
        for d, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
            h = np.zeros(h_)
            for t in order:
                x, u = inputs[t] @ p["wx"][d] + p["b"][d], h @ p["u"][d]
                z, r = (1 / (1 + np.exp(-(x[k * h_ : (k + 1) * h_] + u[k * h_ : (k + 1) * h_]))) for k in (0, 1))
                n = np.tanh(x[2 * h_ :] + r * u[2 * h_ :])
                h = z * h + (1 - z) * n
                states[t, d * h_ : (d + 1) * h_] = h
        pooled = np.zeros(2 * h_)
        if len(window):
            weight = np.exp([float(np.tanh(s @ p["a"]) @ p["v"][:, 0]) for s in states])
            pooled = (weight / weight.sum()) @ states
        best = max(best, float(pooled @ p["o"][:, 0] + p["c"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_against_plain_loops():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) + (" zuxx" if i % 2 else "") for i in range(60)]
    held = tx.fit(texts, [i % 2 for i in range(60)])
    asked = [None, "", "one", "zuxx", " ".join(vocabulary), " ".join(vocabulary[: tx.WINDOW]), " ".join(vocabulary[: tx.WINDOW + 1]), "w" * 300 + " Word, (word) É", *texts[:6]]
    scorer = tx.Scorer(*held)
    want = [plain_score(*held, t) for t in asked]
    assert np.allclose(scorer.scores(asked), want, atol=1e-4)
    # In other company and other chunks a text keeps its score.
    assert np.allclose([scorer.scores([t])[0] for t in asked], want, atol=1e-4)


def test_sample_is_bounded(spark, monkeypatch):
    """Rows and bytes of the fitting sample have bounds, whatever repeats; rows go in order of their key's hash."""
    monkeypatch.setattr(tx, "MOST_FIT", 6)
    monkeypatch.setattr(tx, "FIT_BYTES", 100)
    rows = [(i, "w" * (30 if i % 2 else 60)) for i in range(40)] + [(3, "w" * 30)] * 20 + [(3, f"other {i}") for i in range(20)] + [(41, None), (None, "no key")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, print string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)] * 2 + [(None, 1), (5, 7)], "doc_id long, toxic int")
    got = [(r.key, r.y, r.text) for r in tx.training_rows(docs, labels, "doc_id", "text", "toxic", 1).collect()]
    assert len(set(got)) == len(got) and {y for _, y, _ in got} == {0, 1}
    for y in (0, 1):
        own = [t or "" for _, k, t in got if k == y]
        assert 0 < len(own) <= 6 and sum(map(len, own)) - max(map(len, own)) < 100
    assert all(zlib.crc32(str(k).encode()) % 3 != 1 for k, _, _ in got)
    whole = tx.training_rows(docs, labels, "doc_id", "text", "toxic").filter("key = 3").count()
    assert whole <= 6
