"""Embedding near-dedup by a pivot-permutation index.

Pivots are fitted on a bounded sample (vectors of least key hash, twice as many as pivots,
of which a farthest-first walk picks the pivots). Their number is twice the square root of
the number of vectors, so that lists keep their length as the table grows, until the
pivots fill ``PIVOT_BYTES``; beyond that, lists grow with the table and the work on them
faster than it. ``PIVOT_BYTES`` is for the ``MOST_LENGTHS`` commonest lengths of vectors
together; vectors of any other length have no pivots and meet in one list for each length,
which is exact. Every vector is described by its permutation: its ``NEAREST`` pivots,
nearest first. Inverted lists hold the vectors by pairs of these pivots, so two vectors
meet in a list if and only if their count of shared pivots is ``SHARED = 2`` at least,
whatever the order; each pair that meets is settled in the least list it shares. Vectors
are indexed without exception.

Equal vectors are one class before anything else, whatever their number; only classes
are indexed. A long list is cut into blocks and every pair of blocks is a unit of work
of bounded size. Postings carry no vectors but codes of one byte a component, with a bound
of their error: in a unit, members that no partner can reach by that bound go. For the
others the vectors are fetched, and links are told by the cosine in double precision. What
comes out of a unit is a count of links per vector and one link to the least vector of its
group, never the pairs.

Null vectors, zero vectors and vectors that hold a null or a non-finite component link
with nothing (n_links 0, a component of their own). Vectors of different lengths never
link. Repeated rows are equal vectors; rows that repeat the key count as vectors of
their own for ``n_links``. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle, small_join
from .components import components

#: Bytes of all pivots at most (the sample they are picked from: twice that), whatever the input.
PIVOT_BYTES = 16 << 20
#: Lengths of vectors, the commonest ones, that have pivots.
MOST_LENGTHS = 16
LEAST_SAMPLE = 4096
#: Nearest pivots that describe a vector, and how many of them two vectors must share to meet.
NEAREST = 7
SHARED = 2
COSINE = 0.9
#: Vectors of one inverted list that a unit of work holds.
BLOCK = 1024


def n_pivots(n: int, dim: int, most_bytes: int = PIVOT_BYTES) -> int:
    return max(2 * NEAREST, min(most_bytes // (8 * dim), 2 * math.isqrt(max(n, 1))))


def n_sample(k: int, dim: int, most_bytes: int = PIVOT_BYTES) -> int:
    return max(2 * k, min(LEAST_SAMPLE, 2 * most_bytes // (8 * dim)))


def pick_pivots(sample, k: int):
    """Farthest-first walk over unit vectors: each pivot is the one least like those before it.

    The walk ends when all of the sample is near a pivot: pivots inside one group of near
    duplicates would tell its members apart by chance and hide their links.
    """
    import numpy as np

    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        at = int(near.argmin())
        if near[at] >= COSINE:
            break
        chosen.append(at)
        np.maximum(near, sample @ sample[at], out=near)
    return sample[chosen]


def permutation(vectors, pivots):
    """The places of the ``NEAREST`` pivots of each unit vector, nearest first."""
    import numpy as np

    like = vectors @ pivots.T
    m = min(NEAREST, like.shape[1])
    top = np.argpartition(-like, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, axis=1), axis=1, kind="stable"), axis=1)


def list_keys(nearest, dim: int):
    """Keys of the inverted lists a vector is in: one for each pair of its nearest pivots, told from those of other lengths."""
    import numpy as np

    m = nearest.shape[1]
    if m < SHARED:
        return np.full((len(nearest), 1), dim << 44, np.int64)
    i, j = np.triu_indices(m, 1)
    a, b = nearest[:, i].astype(np.int64), nearest[:, j].astype(np.int64)
    return (np.int64(dim) << 44) | (np.minimum(a, b) << 22) | np.maximum(a, b)


def settled_here(key: int, a, b):
    """Whether pairs of vectors, given their nearest pivots, have this list as the least that they share."""
    import numpy as np

    if a.shape[1] < SHARED:
        return np.ones(len(a), bool)
    most = np.iinfo(np.int32).max
    shared = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, most), axis=1)
    return (shared[:, 0] == ((key >> 22) & 0x3FFFFF)) & (shared[:, 1] == (key & 0x3FFFFF))


def encode(x):
    """Unit vectors as rows of bytes: the error of the code, its step, and a signed byte per component."""
    import numpy as np

    step = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    step32 = step.astype(np.float32)
    error = np.linalg.norm(x - code * step32.astype(np.float64)[:, None], axis=1) * 1.0001 + 1e-6
    return [e.tobytes() + t.tobytes() + c.tobytes() for e, t, c in zip(error.astype(np.float32), step32, code, strict=True)]


def decode(rows):
    """(errors, vectors) of encoded rows of one length."""
    import numpy as np

    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return head[:, 0], raw[:, 8:].view(np.int8).astype(np.float32) * head[:, 1:2]


def unit(rows):
    import numpy as np

    x = np.asarray(rows, np.float64)
    # Scaled first, so that neither huge nor tiny components over- or underflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(every row with its class's digest, or null; a row per class: rep, mult, dim and the vector in double precision)."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("v", F.when(sound, F.transform(v, lambda x: x + F.lit(0.0)))).withColumn("digest", F.when(v.isNotNull(), F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ",").cast("binary"), 256)))
    keyed = rows.select("vec_id", "digest")
    found = rows.filter(v.isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = rows.filter(v.isNotNull()).join(found, "digest").filter("vec_id = rep").dropDuplicates(["digest"]).select("digest", "rep", "mult", F.size("v").alias("dim"), "v")
    return keyed, classes


def _describe(classes: DataFrame, pivots) -> DataFrame:
    """A row per class: rep, mult, its lists' keys, its nearest pivots and its code. pivots: a broadcast of arrays by length."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("rep", pa.int64()), ("mult", pa.int64()), ("keys", pa.list_(pa.int64())), ("near", pa.binary()), ("code", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rep, mult, dim = (batch.column(c).to_numpy() for c in range(3))
                for d in np.unique(dim).tolist():
                    every = np.flatnonzero(dim == d)
                    held = pivots.value.get(d)
                    # Few rows at a time where there are many pivots.
                    rows = max(16, (1 << 21) // len(held)) if held is not None else 1024
                    for own in np.split(every, range(rows, len(every), rows)):
                        x = unit(batch.column(3).take(pa.array(own)).flatten().to_numpy().reshape(-1, d))
                        near = permutation(x, held).astype(np.int32) if held is not None else np.zeros((len(own), 0), np.int32)
                        keys = list_keys(near, d)
                        yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(mult[own]), pa.array(list(keys), pa.list_(pa.int64())), pa.array([r.tobytes() for r in near], pa.binary()), pa.array(encode(x), pa.binary())], schema=schema)

    return classes.select("rep", "mult", "dim", "v").mapInArrow(run, "rep long, mult long, keys array<long>, near binary, code binary")


def _possible(key: int, low, high, cosine: float):
    """Of a unit the members that may have a link there: (places in low, places in high). low and high: (nearest pivots, errors, decoded)."""
    import numpy as np

    same = high is None
    high = low if same else high
    slack = low[1][:, None] + high[1][None, :] + 3 * low[1][:, None] * high[1][None, :]
    near = low[2] @ high[2].T + slack >= cosine - 1e-5
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    kept = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        kept[at : at + 20_000] = settled_here(key, low[0][i[at : at + 20_000]], high[0][j[at : at + 20_000]])
    return np.unique(i[kept]), np.unique(j[kept])


def _settle_unit(key: int, low, high, cosine: float):
    """Links of one unit of work. low and high: (rep, mult, nearest pivots, unit vectors); high is None for a block with itself."""
    import numpy as np

    same = high is None
    high = low if same else high
    near = low[3] @ high[3].T >= cosine
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    kept = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        kept[at : at + 20_000] = settled_here(key, low[2][i[at : at + 20_000]], high[2][j[at : at + 20_000]])
    i, j = i[kept], j[kept]
    if not len(i):
        return None
    a, b = low[0][i], high[0][j]
    reps = np.concatenate([a, b])
    counts = np.concatenate([high[1][j], low[1][i]])
    ids, back = np.unique(reps, return_inverse=True)
    # Whole numbers all the way: a bincount with weights would count in floating point.
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, back, counts)
    # Least vector reachable inside the unit, so that one link per vector says it all.
    least, u, w = np.arange(len(ids)), back[: len(a)], back[len(a) :]
    while True:
        before = least.copy()
        low_end = np.minimum(least[u], least[w])
        np.minimum.at(least, u, low_end)
        np.minimum.at(least, w, low_end)
        least = least[least]
        if (before == least).all():
            return ids, links, ids[least]


def _units(batches, columns: int):
    """(key, lo, hi, rows of block lo, rows of block hi or None) of rows sorted by key, lo, hi; each row without these and own."""

    def cut(head, rows):
        key, lo, hi = head
        low = [r[1:] for r in rows if r[0] == lo]
        high = [r[1:] for r in rows if r[0] == hi] if hi != lo else None
        if low and high != [] and (high is not None or len(low) > 1):
            yield key, lo, hi, low, high

    head, rows = None, []
    for batch in batches:
        for key, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True):
            if (key, lo, hi) != head:
                if len(rows) > 1:
                    yield from cut(head, rows)
                head, rows = (key, lo, hi), []
            rows.append(row)
    if len(rows) > 1:
        yield from cut(head, rows)


def _links(described: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, least) by unit of work."""
    postings = described.select(F.explode("keys").alias("key"), "rep", "near", "code")
    crowded = described.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    crowded = settle(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    # Only lists of more than one block need to know their size.
    placed = small_join(postings, crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit_of = ["key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")]
    rows = spread.select(*unit_of, "own", "rep", "near", "code").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own")

    def sift(batches):
        import numpy as np
        import pyarrow as pa

        def pack(rows):
            return (np.frombuffer(b"".join(r[1] for r in rows), np.int32).reshape(len(rows), -1), *decode([r[2] for r in rows]))

        out: list[tuple] = []
        for key, lo, hi, low, high in _units(batches, 7):
            i, j = _possible(key, pack(low), pack(high) if high else None, cosine)
            if high is None:
                out += [(key, lo, hi, lo, low[x][0]) for x in np.union1d(i, j).tolist()]
            else:
                out += [(key, lo, hi, lo, low[x][0]) for x in i.tolist()] + [(key, lo, hi, hi, high[x][0]) for x in j.tolist()]
            if len(out) >= 4096:
                yield batch_of(pa, out)
                out = []
        if out:
            yield batch_of(pa, out)

    def batch_of(pa, out):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "lo", "hi", "own", "rep"])

    likely = settle(rows.mapInArrow(sift, "key long, lo int, hi int, own int, rep long"), "likely")
    exact = likely.join(described.select("rep", "mult", "near"), "rep").join(classes.select("rep", "v"), "rep")
    exact = exact.select("key", "lo", "hi", "own", "rep", "mult", "near", "v").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pack(rows):
            return (
                np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                np.frombuffer(b"".join(r[2] for r in rows), np.int32).reshape(len(rows), -1), unit([r[3] for r in rows]),
            )

        for key, _, _, low, high in _units(batches, 8):
            found = _settle_unit(key, pack(low), pack(high) if high else None, cosine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rep", "links", "least"])

    links = settle(exact.mapInArrow(run, "rep long, links long, least long"), "links")
    discard(crowded, likely)
    return links


def _fit_pivots(classes: DataFrame) -> dict:
    """Pivots by length of vector, for the commonest lengths."""
    import numpy as np

    by_length = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    common = by_length.orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    share = PIVOT_BYTES // max(len(common), 1)
    pivots = {}
    for dim, n in common:
        k = n_pivots(n, dim, share)
        sample = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("rep", "digest")).select("v").limit(n_sample(k, dim, share)).collect()
        pivots[dim] = pick_pivots(unit(np.array([r.v for r in sample])), k)
    return pivots


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    keyed, classes = _classes(df, key, vector)
    classes = settle(classes, "vectors")
    pivots = _fit_pivots(classes)
    described = settle(_describe(classes, df.sparkSession.sparkContext.broadcast(pivots)), "index")
    found = _links(described, classes, cosine)
    discard(described)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    of_class = (
        classes.select("digest", "rep", "mult")
        .join(counts, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    rows = keyed.join(of_class, "digest", "left")
    least = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).cast(T.LongType()).alias("n_links"), least.alias("component_id"), (F.col("vec_id") == least).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT vec_id, r, e, len(e) AS dim FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.dim = b.dim AND a.r <> b.r
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END
), counts AS (SELECT r, count(*) AS n FROM pairs GROUP BY r),
edges AS (SELECT DISTINCT a, b FROM pairs),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
named AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM v LEFT JOIN counts USING (r) JOIN named ON node = vec_id
"""
