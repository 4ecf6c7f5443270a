"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: from the word side, its log-odds of standing in a toxic document (0 if
unseen) and a learned vector out of a hashed table; from the character side, the greatest
and the mean log-odds of its character grams (word edges marked) and the mean of learned
vectors of those grams. Two gated recurrent units read a window of ``WINDOW`` words in
either direction; attention pools their states; a logistic unit scores the window. A
text's score is that of its highest window, and every window of the text is scored, from its
first word to its last: half-overlapping windows, which start every ``STRIDE`` words, so each
word is in two and any ``STRIDE`` neighbouring words lie in one whole; the last one reaches the end.

Fitting happens in one task, on at most ``MOST_FIT`` labelled rows of each class (those
of least key hash, taken in that order while those before them hold less than ``FIT_BYTES``
of text; a row that repeats wholly counts once): log-odds are counted on two folds and applied across them, so the
network never trains on a word's own document; then, in rounds, the currently highest
window of each document (and a random one of clean documents) is trained on by
backpropagation through time with Adam. Scoring is one narrow pass without a shuffle.

Null and empty texts have one window without words; its score is the network's for an
empty window. Words of more than ``LONG_WORD`` characters are read in pieces. Without
labelled rows of both classes every score is 0. Rows are independent of each other, so
ties, repeats and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, give_back, in_a_process_of_its_own

WINDOW, STRIDE = 32, 16
#: Labelled rows of each class at most: the bound of the sample that the network is fitted on.
MOST_FIT = 2500
#: Bytes of text of each class after which no further labelled row joins that sample.
FIT_BYTES = 32 << 20
HIDDEN, ATTEND, LEARNED = 8, 8, 4
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 16
LONG_WORD = 64
SMOOTH = 3.0
ROUNDS, BATCH, RATE = 4, 64, 0.01
#: Batches of a round and fold at least; few rows are gone over more often.
LEAST_STEPS = 40
THRESHOLD = 0.7
#: Distinct words that a worker remembers between chunks.
REMEMBERED = 250_000
FIXED = 4
DIM = FIXED + 2 * LEARNED


def split(text: str | None) -> list[str]:
    words = text.lower().split() if text else []
    if words and max(map(len, words)) > LONG_WORD:
        words = [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]
    return words


def core(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|*#%&-_") or word


def grams(word: str) -> list[int]:
    """Buckets of the grams of 3 to 5 bytes of ``^word$``."""
    w, crc, m = f"^{word}$".encode(), zlib.crc32, GRAM_BUCKETS - 1
    n = len(w)
    if n < 3:
        return [crc(w) & m]
    return [crc(w[i : i + k]) & m for k in (3, 4, 5) for i in range(n - k + 1)]


class Vocabulary:
    """Log-odds of words and of grams, from documents' distinct words (without the marks around them)."""

    def __init__(self, docs, labels):
        import numpy as np

        total = [SMOOTH * 2, SMOOTH * 2]
        words: list[dict[str, int]] = [{}, {}]
        self_grams = np.full((2, GRAM_BUCKETS), SMOOTH)
        known: dict[str, np.ndarray] = {}
        for doc, y in zip(docs, labels, strict=True):
            total[y] += 1
            held = set(doc)
            for w in held:
                words[y][w] = words[y].get(w, 0) + 1
                if w not in known:
                    known[w] = np.array(grams(w), np.uint16)
            if held:
                self_grams[y, np.unique(np.concatenate([known[w] for w in held]))] += 1
        base = np.log(total[0] / total[1])
        self.gram = (np.log(self_grams[1] / self_grams[0]) + base).astype(np.float32)
        every = {w: np.log((words[1].get(w, 0) + SMOOTH) / (words[0].get(w, 0) + SMOOTH)) + base for w in words[1].keys() | words[0].keys()}
        # Words that say little are as unseen ones.
        self.word = {w: float(v) for w, v in every.items() if abs(v) > 0.7}

    def inputs(self, words):
        """(fixed inputs, word buckets, grams of all words in a row, where each word's grams start) of words."""
        import numpy as np

        fixed = np.zeros((len(words), FIXED), np.float32)
        bucket = np.zeros(len(words), np.int32)
        flat, starts = array("H"), np.zeros(len(words) + 1, np.int64)
        for i, w in enumerate(words):
            fixed[i, 0] = self.word.get(w, 0.0)
            bucket[i] = zlib.crc32(w.encode()) % WORD_BUCKETS
            flat.extend(grams(w))
            starts[i + 1] = len(flat)
        flat = np.frombuffer(flat, np.uint16) if flat else np.zeros(0, np.uint16)
        if len(words):
            odds = self.gram[flat]
            n = np.diff(starts)
            fixed[:, 1] = np.maximum.reduceat(odds, starts[:-1])
            fixed[:, 2] = np.add.reduceat(odds, starts[:-1]) / n
            fixed[:, 3] = 1.0
        return np.clip(fixed, -4, 4) / 2, bucket, flat, starts


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass and backpropagation. Directions are side by side: columns of 2 * HIDDEN."""

    def __init__(self, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)

        def draw(*shape, scale=None):
            return (rng.normal(size=shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        self.p = {
            "word": draw(WORD_BUCKETS, LEARNED, scale=0.1), "gram": draw(GRAM_BUCKETS, LEARNED, scale=0.1),
            "wx": draw(2, DIM, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN),
            "a": draw(2 * HIDDEN, ATTEND), "v": draw(ATTEND, 1), "o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32),
        }

    def embed(self, inputs):
        """The input vectors of words, from ``Vocabulary.inputs``."""
        import numpy as np

        fixed, bucket, flat, starts = inputs
        out = np.empty((len(fixed), DIM), np.float32)
        out[:, :FIXED], out[:, FIXED : FIXED + LEARNED] = fixed, self.p["word"][bucket]
        for at in range(0, len(fixed), 1 << 14):
            own = starts[at : at + (1 << 14) + 1]
            sums = np.add.reduceat(self.p["gram"][flat[own[0] : own[-1]]], own[:-1] - own[0])
            out[at : at + len(own) - 1, FIXED + LEARNED :] = sums / np.diff(own)[:, None]
        return out

    def project(self, x):
        """What the words put into the gates of both directions: (n, 2, 3 * HIDDEN)."""
        import numpy as np

        return np.stack([x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)], axis=1).astype(np.float32)

    def forward(self, gates, ids, mask, keep: bool = False):
        """Logits of windows. gates: (n, 2, 3H) per word; ids: (B, T) into it; mask: (B, T)."""
        import numpy as np

        h_, (b, t_) = HIDDEN, ids.shape
        u = self.p["u"]
        h = np.zeros((2, b, h_), np.float32)
        states = np.zeros((t_, b, 2 * h_), np.float32)
        trace = []
        for t in range(t_):
            back = t_ - 1 - t
            at = (ids[:, t], ids[:, back])
            m = np.stack([mask[:, t], mask[:, back]])[:, :, None]
            x = np.stack([gates[at[0], 0], gates[at[1], 1]])
            hu = h @ u
            zr = 1 / (1 + np.exp(-(x[..., : 2 * h_] + hu[..., : 2 * h_])))
            z, r = zr[..., :h_], zr[..., h_:]
            n = np.tanh(x[..., 2 * h_ :] + r * hu[..., 2 * h_ :])
            after = h + m * (1 - z) * (n - h)
            if keep:
                trace.append((h, z, r, n, hu[..., 2 * h_ :], m))
            h = after
            states[t, :, :h_] = h[0]
            states[back, :, h_:] = h[1]
        inner = np.tanh(states @ self.p["a"])
        score = (inner @ self.p["v"])[..., 0]
        score = np.where(mask.T > 0, score, -1e9)
        weight = np.exp(score - score.max(axis=0)) * (mask.T > 0)
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[..., None] * states).sum(axis=0)
        logit = (pooled @ self.p["o"])[:, 0] + self.p["c"][0]
        return (logit, (trace, states, inner, weight, pooled)) if keep else logit

    def gradients(self, x, ids, mask, y):
        """Loss and gradients of the parameters, and of the input vectors x, for one batch of windows."""
        import numpy as np

        h_, p = HIDDEN, self.p
        logit, (trace, states, inner, weight, pooled) = self.forward(self.project(x), ids, mask, keep=True)
        prob = sigmoid(logit)
        d_logit = ((prob - y) / len(y)).astype(np.float32)[:, None]
        g = {k: np.zeros_like(p[k]) for k in ("wx", "b", "u", "a", "v", "o", "c")}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(axis=0)
        d_pooled = d_logit @ p["o"].T
        d_states = weight[..., None] * d_pooled[None]
        d_weight = (states * d_pooled[None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = (inner * d_score[..., None]).sum(axis=(0, 1))[:, None]
        d_inner = d_score[..., None] * p["v"][:, 0] * (1 - inner**2)
        g["a"] = np.einsum("tbi,tbj->ij", states, d_inner)
        d_states = d_states + d_inner @ p["a"].T
        d_x = np.zeros((len(x), DIM), np.float32)
        d_h = np.zeros((2, len(y), h_), np.float32)
        t_ = ids.shape[1]
        for t in reversed(range(t_)):
            back = t_ - 1 - t
            h, z, r, n, hun, m = trace[t]
            d_h = d_h + np.stack([d_states[t, :, :h_], d_states[back, :, h_:]])
            d_new = m * d_h
            dn = d_new * (1 - z) * (1 - n**2)
            dz = d_new * (h - n) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            into_u = np.concatenate([dz, dr, dn * r], axis=2)
            into_x = np.concatenate([dz, dr, dn], axis=2)
            for d, at in ((0, ids[:, t]), (1, ids[:, back])):
                g["u"][d] += h[d].T @ into_u[d]
                g["wx"][d] += x[at].T @ into_x[d]
                g["b"][d] += into_x[d].sum(axis=0)
                np.add.at(d_x, at, into_x[d] @ p["wx"][d].T)
            d_h = d_h * (1 - m) + d_new * z + into_u @ np.swapaxes(p["u"], 1, 2)
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        return loss, g, d_x


class Adam:
    def __init__(self, params):
        import numpy as np

        self.params, self.t = params, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads, rate: float = RATE):
        import numpy as np

        self.t += 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def windows(counts):
    """(first word of each window in the row of all words, its number of words, its document) for documents of these counts."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    number = 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0)
    doc = np.repeat(np.arange(len(counts)), number)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
    first = np.repeat(np.cumsum(counts) - counts, number) + inside
    return first, np.minimum(WINDOW, counts[doc] - inside), doc


def window_ids(ids, first, length):
    import numpy as np

    place = np.arange(WINDOW)[None, :]
    mask = place < length[:, None]
    return np.where(mask, ids[np.minimum(first[:, None] + place, max(len(ids) - 1, 0))] if len(ids) else 0, 0), mask.astype(np.float32)


def score_windows(net: Network, gates, ids, counts, batch: int = 2048):
    """Logits of all windows, and the windows."""
    import numpy as np

    first, length, doc = windows(counts)
    out = np.empty(len(first), np.float32)
    for at in range(0, len(first), batch):
        own, mask = window_ids(ids, first[at : at + batch], length[at : at + batch])
        out[at : at + batch] = net.forward(gates, own, mask)
    return out, first, length, doc


def fit(texts: list[str | None], labels: list[int], seed: int = 5) -> tuple[Vocabulary, Network] | None:
    """A fitted pair, or None if a class is missing."""
    import numpy as np

    if len(set(labels)) < 2:
        return None
    one: dict[str, str] = {}
    # Words without the marks around them; equal ones are one object, as the sample is held in memory.
    docs, y = [[one.get(w) or one.setdefault(w, core(w)) for w in split(t)] for t in texts], np.array(labels)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(docs)) % 2
    for c in (0, 1):
        # Both folds get rows of both classes.
        fold[y == c] = np.arange((y == c).sum()) % 2
    net = Network(seed)
    sides = []
    for f in (0, 1):
        own = np.flatnonzero(fold == f)
        other = np.flatnonzero(fold != f)
        vocabulary = Vocabulary([docs[i] for i in other], y[other].tolist()) if len(set(y[other].tolist())) == 2 else Vocabulary(docs, y.tolist())
        names = {w: i for i, w in enumerate(dict.fromkeys(w for i in own for w in docs[i]))}
        ids = np.array([names[w] for i in own for w in docs[i]], np.int64)
        sides.append((y[own], vocabulary.inputs(list(names)), ids, [len(docs[i]) for i in own]))
    adam = Adam(net.p)
    for step in range(ROUNDS):
        for y_own, inputs, ids, counts in sides:
            if step == 0:
                # Before anything is learned: the window with the greatest sum of odds.
                first, length, doc = windows(counts)
                summed = np.concatenate([[0], np.cumsum(inputs[0][ids, 0] + np.maximum(inputs[0][ids, 1], 0))]) if len(ids) else np.zeros(1)
                value = summed[first + length] - summed[first]
            else:
                value, first, length, doc = score_windows(net, net.project(net.embed(inputs)), ids, counts)
            order = np.lexsort((value, doc))
            best = order[np.flatnonzero(np.diff(np.append(doc[order], -1)))]
            clean = np.flatnonzero(y_own[doc] == 0)
            chosen = np.concatenate([best, rng.choice(clean, min(len(clean), len(best) // 2), replace=False)])
            for _ in range(max(2, -(-LEAST_STEPS * BATCH // max(len(chosen), 1)))):
                rng.shuffle(chosen)
                for at in range(0, len(chosen), BATCH):
                    part = chosen[at : at + BATCH]
                    own, mask = window_ids(ids, first[part], length[part])
                    used, small = np.unique(own, return_inverse=True)
                    if not len(ids):
                        continue
                    fixed, bucket, flat, starts = inputs
                    n = starts[used + 1] - starts[used]
                    mine = flat[np.repeat(starts[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    local = (fixed[used], bucket[used], mine, np.concatenate([[0], np.cumsum(n)]))
                    _, g, d_x = net.gradients(net.embed(local), small.reshape(own.shape), mask, y_own[doc[part]].astype(np.float32))
                    adam_step(net, adam, g, d_x, bucket[used], mine, n)
    return Vocabulary(docs, y.tolist()), net


def adam_step(net: Network, adam: Adam, g, d_x, bucket, flat, n):
    """Adam for the network, plain descent for the rows of the two tables that the batch used."""
    import numpy as np

    adam.step(g)
    d_word, d_gram = d_x[:, FIXED : FIXED + LEARNED], d_x[:, FIXED + LEARNED :] / n[:, None]
    np.add.at(net.p["word"], bucket, -np.clip(d_word, -1, 1))
    np.add.at(net.p["gram"], flat, -np.clip(np.repeat(d_gram, n, axis=0), -1, 1))


class Scorer:
    """Scores texts with a fitted pair; lives in one Python worker."""

    def __init__(self, vocabulary: Vocabulary, net: Network):
        import numpy as np

        self.vocabulary, self.net = vocabulary, net
        self.names: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.gates = np.empty((1024, 2, 3 * HIDDEN), np.float32)

    def learn(self, words) -> None:
        import numpy as np

        names, cores = self.names, self.cores
        fresh = [w for w in dict.fromkeys(words) if w not in names]
        plain = [core(w) for w in fresh]
        new = [w for w in dict.fromkeys(plain) if w not in cores]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            rows = self.net.project(self.net.embed(self.vocabulary.inputs(part)))
            n = len(cores)
            while n + len(part) > len(self.gates):
                # Rows that aren't written take no memory yet.
                grown = np.empty((2 * len(self.gates), *self.gates.shape[1:]), np.float32)
                grown[:n] = self.gates[:n]
                self.gates = grown
            self.gates[n : n + len(part)] = rows
            cores.update(zip(part, range(n, n + len(part)), strict=True))
        names.update(zip(fresh, map(cores.__getitem__, plain), strict=True))

    def scores(self, texts):
        """One score per text: that of its highest window."""
        import numpy as np

        if len(self.names) > REMEMBERED:
            self.names, self.cores = {}, {}
        docs = [split(t) for t in texts]
        words = [w for d in docs for w in d]
        self.learn(words)
        ids = np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))
        logits, _, _, doc = score_windows(self.net, self.gates, ids, [len(d) for d in docs])
        best = np.full(len(docs), -np.inf, np.float32)
        np.maximum.at(best, doc, logits)
        return sigmoid(best.astype(np.float64))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fold: int | None = None) -> DataFrame:
    """At most ``MOST_FIT`` labelled rows of each class, those of least key hash, up to ``FIT_BYTES``; without the fold ``fold`` of three."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)")
    if fold is not None:
        known = known.filter(F.crc32(F.col("_key").cast("string")) % 3 != fold)
    order = [F.xxhash64("_key"), F.col("_key")]
    drawn = known.filter("_y = 1").orderBy(*order).limit(MOST_FIT).union(known.filter("_y = 0").orderBy(*order).limit(MOST_FIT))
    # Two limits bound this side, so it is broadcast.
    held = docs.join(F.broadcast(drawn.distinct()), F.col(key) == F.col("_key")).select(F.col(key).alias("key"), F.col("_y").alias("y"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    # Sizes first, so that no more text is moved than the sample may hold; a key that repeats must not outgrow it either.
    sizes = held.groupBy("key", "y", "print").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    order = [F.xxhash64("key"), F.col("key"), F.col("print")]
    least = sizes.filter("y = 1").orderBy(*order).limit(MOST_FIT).union(sizes.filter("y = 0").orderBy(*order).limit(MOST_FIT))
    before = F.sum("size").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    chosen = least.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < FIT_BYTES)
    names = ["key", "y", "print"]
    return held.join(F.broadcast(chosen.select(*names)), names, "left_semi").dropDuplicates(names).select(*names, "text")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fold: int | None = None):
    """A fitted pair, or None. It is fitted in one task, as its sample has a fixed bound; only the model (some MB) visits the driver."""
    import pickle

    rows = training_rows(docs, labels, key, text, label, fold).repartition(1).sortWithinPartitions("key", "y", "print")

    def run(batches):
        import pyarrow as pa

        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(in_a_process_of_its_own(fit, texts, y))], pa.binary())], names=["model"])

    found = rows.select("text", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def score(df: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` and ``predicted``. One narrow pass; the model (fixed size but for its words, which the sample bounds) is broadcast."""
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    source = df.select(*kept)
    at = kept.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*shared.value) if shared.value else None
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                found = scorer.scores(part.column(at).to_pylist()) if scorer else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, "score"])
        del scorer
        give_back()

    scored = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(df: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows whose score reaches the threshold."""
    return score(df, model, text, threshold).filter("predicted = 0").select(*df.columns)
