"""MinHash near-dedup with SetSketch registers.

A document's set is that of its distinct shingles of ``width`` words (with fewer words,
the whole sequence is its one shingle). Its sketch has ``M`` registers: register j is
``floor(1 - log_b x_j)``, cut off to ``0 .. Q + 1``, of the least ``x_j`` of exponential
variables with rate ``A`` drawn by shingle and register. The registers of a union are
the maxima of the registers, so sketches merge; equal registers become likelier as sets
grow alike, so ``BANDS`` bands of registers bring candidates together.

1. Equal sets (same 128-bit digest of the sorted shingles) are one class, whatever their
   number; it has a number of its own, and one of its rows represents it: that of the
   least key, rows without a key last, then of the least hash of the text.
2. Representatives that share a band are in one bucket. Each is paired with the bucket's
   least member; the pair's Jaccard similarity is estimated from both sketches jointly
   by maximum likelihood, given the exact set sizes, and pairs whose estimate is far
   below the threshold go. The rest is verified on the full sets.
3. Verified links give components. Buckets that still hold several components are
   settled among bucket-mates: every member outside the component that has most members
   there (the lead) is held against the others, in blocks of bounded size, first by
   sketches, in the first band that a pair shares. Only texts with a likely partner of
   another component are then compared, on full sets of words, again in blocks of bounded
   size. No pair is emitted that isn't a link.

Links between different sets are confirmed word by word; sets are counted and told to be
equal by 64-bit hashes of their shingles, under a 128-bit digest. So what can be lost is only a pair that shares no band at all: at the threshold 0.8 a
chance of ``(1 - 0.8 ** 4) ** 32``, 5e-8, and less above it.

Nulls and texts without words have an empty set and link with nothing. Rows are told
apart by number, key and text, never by key alone: rows that share a key, or have none, are
compared and judged each by its own text. Of a component exactly one row is kept; its
``component_id`` is its least key, null where none of its rows has one. Rows that repeat
wholly are equal sets, and one of them stays. An empty table gives an empty result. Extra
columns are ignored by ``near_duplicates``; ``keep_one`` returns the input's columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, give_back, settle, small_join
from .components import components

M = 128
ROWS = 4
BANDS = M // ROWS
BASE = 1.001
RATE = 20.0
Q = 65_533
#: Standard errors of the estimate that a pair must lie below the threshold to go unverified.
MARGIN = 6.0
#: Sketches that a unit of a crowded bucket holds, and bytes of text that a unit of the exact comparison holds.
BLOCK_DOCS = 4096
BLOCK_BYTES = 2 << 20


def split_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, lower-cased A to Z: what bytes.lower and bytes.split do."""
    return text.encode("utf-8").lower().split() if text else []


class Hasher:
    """64-bit hashes of words and of shingles; lives in one Python worker."""

    def __init__(self, width: int, remembered: int = 200_000):
        self.width, self.remembered, self.known = width, remembered, {}

    def word(self, w: bytes) -> int:
        import xxhash

        if len(self.known) >= self.remembered:
            self.known.clear()
        h = self.known[w] = xxhash.xxh64_intdigest(w, 7)
        return h

    def shingles(self, text: str | None):
        """Sorted distinct shingle hashes."""
        import numpy as np

        words = split_words(text)
        known, word = self.known, self.word
        h = np.array([known.get(w) or word(w) for w in words], dtype=np.uint64)
        n = len(h)
        if not n:
            return h
        width = min(self.width, n)
        with np.errstate(over="ignore"):
            mixed = np.full(n - width + 1, width, dtype=np.uint64)
            for i in range(width):
                mixed = (mixed ^ h[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def multipliers():
    import numpy as np

    return np.random.default_rng(20).integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes, factors):
    """The sketch of a set of 64-bit hashes: ``M`` unsigned 16-bit registers."""
    import numpy as np

    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[at : at + 2048, None] * factors).min(axis=0), out=least)
    # The least of n uniform variables, made the least of n exponential ones.
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a, b):
    """The sketch of the union of two sets."""
    import numpy as np

    return np.maximum(a, b)


def estimate(above, below, size_a, size_b):
    """Joint likelihood estimate of the Jaccard similarity: of ``M`` registers, ``above`` are greater in a and ``below`` greater in b; sizes are known."""
    import numpy as np

    above, below = np.asarray(above, float)[:, None], np.asarray(below, float)[:, None]
    u = (np.asarray(size_a, float) / (np.asarray(size_a, float) + np.asarray(size_b, float)))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, 201)[None, :]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    pa, pb = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    fit = above * np.log(pa) + below * np.log(pb) + (M - above - below) * np.log(np.clip(1 - pa - pb, 1e-12, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def sketch(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(row, doc, print, n, digest, sketch) of every row; one narrow pass."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        hasher, factors = Hasher(width), multipliers()
        for batch in batches:
            for part in chunks(batch, 3):
                n, digest, regs = [], [], []
                for t in part.column(3).to_pylist():
                    h = hasher.shingles(t)
                    n.append(len(h))
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    regs.append(registers(h, factors).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["row", "doc", "print", "n", "digest", "sketch"]
                )
        del hasher
        give_back()

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row long, doc long, print long, n long, digest binary, sketch binary")


def bands(reps: DataFrame) -> DataFrame:
    """(doc, n, sketch) to (bucket, doc, n), ``BANDS`` rows each. A bucket is a hash whose remainder by ``BANDS`` is the band."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        factor = np.random.default_rng(21).integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        place = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                with np.errstate(over="ignore"):
                    h = np.broadcast_to(place, (len(regs), BANDS)).copy()
                    for r in range(ROWS):
                        h = (h ^ regs[:, :, r]) * factor[r]
                        h ^= h >> np.uint64(31)
                h = (h & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))], names=["bucket", "doc", "n"]
                )

    return reps.select("doc", "n", "sketch").mapInArrow(run, "bucket long, doc long, n long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose joint estimate isn't ``MARGIN`` standard errors below the threshold."""
    one = reps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "sa", "sb")
    least = percent / 100 - MARGIN * math.sqrt(percent / 100 * (1 - percent / 100) / M)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in (4, 5))
                near = estimate((sa > sb).sum(axis=1), (sa < sb).sum(axis=1), batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def linked(size_a: int, size_b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (size_a + size_b - shared)


def full_set(text: str | None, width: int) -> frozenset:
    """The shingles themselves, as tuples of words."""
    words = split_words(text)
    return frozenset(zip(*(words[i:] for i in range(min(width, len(words)))), strict=False))


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b) those whose full sets reach the threshold."""
    one, two = (texts.select(F.col("doc").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "text_a", "b", "text_b")

    def run(batches):
        import pyarrow as pa

        held, own = None, frozenset()
        for whole in batches:
            for batch in chunks(whole, 1):
                a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                kept = []
                for i, (x, tx, ty) in enumerate(zip(a, batch.column(1), batch.column(3).to_pylist(), strict=True)):
                    if held != x:
                        held, own = x, full_set(tx.as_py(), width)
                    other = full_set(ty, width)
                    if linked(len(own), len(other), len(own & other), percent):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sift(units: DataFrame, percent: int) -> DataFrame:
    """Of the members of a unit those with a likely partner of another component, told by sketches alone.

    units: (bucket, block, asks, component, doc, n, sketch) with a block's stored members
    before those that ask. A pair is looked at only in the first band it shares, and by
    one of its two when both ask. Gives (bucket, block, asks, component, doc).
    """
    dealt = units.select("bucket", "block", "asks", "component", "doc", "n", "sketch").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks", "doc")
    least = percent / 100 - MARGIN * math.sqrt(percent / 100 * (1 - percent / 100) / M)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit, stored, held = None, [], None
        for batch in batches:
            out: set[tuple] = set()
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for bucket, block, asks, component, doc, n, sketch in zip(*columns, strict=True):
                if unit != (bucket, block):
                    unit, stored, held = (bucket, block), [], None
                if not asks:
                    stored.append((component, doc, n, sketch))
                    continue
                if not stored:
                    continue
                if held is None:
                    names, sizes = (np.array([r[c] for r in stored], np.int64) for c in (0, 2))
                    regs = np.frombuffer(b"".join(r[3] for r in stored), np.uint16).reshape(-1, M)
                    held = (names, sizes, regs)
                names, sizes, regs = held
                able = np.flatnonzero((names != component) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                if not len(able):
                    continue
                same = regs[able] == np.frombuffer(sketch, np.uint16)
                able, same = able[near := same.sum(axis=1) >= least * M], same[near]
                if not len(able):
                    continue
                first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == bucket % BANDS
                for i in able[first].tolist():
                    out.add((bucket, block, 0, stored[i][0], stored[i][1]))
                if first.any():
                    out.add((bucket, block, 1, component, doc))
            cols = zip(*sorted(out), strict=True) if out else ((),) * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "block", "asks", "component", "doc"])

    return dealt.mapInArrow(run, "bucket long, block int, asks int, component long, doc long")


def _compare(units: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets of shingles, word by word.

    units: (bucket, block, part, asks, component, text), a part's stored texts before
    those that ask. A part may hold texts that ask and nothing to ask of; it has no links.
    """
    keys = ["bucket", "block", "part"]
    dealt = units.select(*keys, "asks", "component", "text").repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit, ids, sets, names, held = None, {}, [], [], None
        for whole in batches:
            for batch in chunks(whole, 5):
                found: set[tuple[int, int]] = set()
                columns = [batch.column(c).to_pylist() for c in range(6)]
                for bucket, block, part, asks, component, text in zip(*columns, strict=True):
                    if unit != (bucket, block, part):
                        unit, ids, sets, names, held = (bucket, block, part), {}, [], [], None
                    mine = full_set(text, width)
                    if not asks:
                        sets.append(np.array([ids.setdefault(s, len(ids)) for s in mine], np.int64))
                        names.append(component)
                        continue
                    if not sets:
                        continue
                    if held is None:
                        size = np.array([len(s) for s in sets])
                        held = (np.concatenate(sets), np.cumsum(size) - size, size, np.array(names, np.int64), np.zeros(len(ids), np.int64))
                    flat, starts, size, owner, flag = held
                    at = [ids[s] for s in mine if s in ids]
                    flag[at] = 1
                    shared = np.add.reduceat(flag[flat], starts)
                    flag[at] = 0
                    near = (100 * shared >= percent * (size + len(mine) - shared)) & (owner != component)
                    found.update((component, int(c)) for c in np.unique(owner[near]))
                a, b = zip(*sorted(found), strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def settle_buckets(members: DataFrame, named: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, block_docs: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """Links between components that share a bucket, each component's least member standing for a linked one.

    members: (bucket, doc); named: (doc, component); reps: (doc, n, sketch). Settled.
    """
    block_docs, block_bytes = block_docs or BLOCK_DOCS, block_bytes or BLOCK_BYTES
    placed = settle(members.join(named, "doc").select("bucket", "doc", "component"), "placed")
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    leads = shares.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("best"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") / F.lit(block_docs)).cast("int").alias("blocks")
    leads = settle(leads.filter("k > 1").select("bucket", (-F.col("best.c")).alias("lead"), blocks), "leads")
    # Bucket-mates only: members outside a bucket's lead ask all the bucket holds, block by block.
    crowd = placed.join(leads, "bucket")
    stored = crowd.select("bucket", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "component", "doc")
    asking = crowd.filter("component <> lead").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "component", "doc")
    flagged = settle(_sift(stored.union(asking).join(reps, "doc"), percent), "flagged")
    sized = flagged.distinct().join(texts.select("doc", F.octet_length("text").alias("bytes")), "doc")
    sized = settle(sized, "sized")
    parts = sized.filter("asks = 0").groupBy("bucket", "block").agg(F.ceil((F.sum("bytes") + 1) / F.lit(block_bytes)).cast("int").alias("parts"))
    spread = sized.join(parts, ["bucket", "block"])
    own = F.array(F.pmod(F.xxhash64("doc", "block"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("asks") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part")
    units = spread.select("bucket", "block", part, "asks", "component", "doc").join(texts, "doc")
    links = settle(_compare(units, width, percent).distinct(), "bucket-links")
    discard(placed, leads, flagged, sized)
    return links


def _verdicts(df: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc, print, n, least, kept) of every row: its key, the hash of its text, and the least key of its component."""
    # Numbers of rows and classes hold once they are written.
    sketches = settle(sketch(df, key, text, width), "sketches")
    order = F.struct(F.col("doc").isNull().alias("keyless"), "doc", "print", "row")
    classes = sketches.filter("n > 0").groupBy("digest").agg(F.min(order).alias("first"))
    classes = settle(classes.select("digest", F.monotonically_increasing_id().alias("id"), "first.doc", "first.print", "first.row"), "classes")
    # From here to the links, doc is the number of a class.
    reps = settle(classes.select("row", "id").join(sketches.filter("n > 0"), "row").select(F.col("id").alias("doc"), "n", "sketch"), "reps", hashes=True)
    spread = settle(bands(reps), "bands", hashes=True)
    buckets = spread.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Written out, so that the join shuffles both sides for itself and Spark may split a crowded bucket.
    buckets = settle(buckets, "buckets", hashes=True)
    members = settle(spread.join(buckets, "bucket").select("bucket", "doc", "n", F.col("pivot.doc").alias("pivot"), F.col("pivot.n").alias("np")), "members", hashes=True)
    pairs = members.filter("doc <> pivot").filter(100 * F.least("n", "np") >= percent * F.greatest("n", "np")).select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    wanted = settle(members.select("doc").distinct(), "wanted")
    named_rows = settle(classes.join(wanted.select(F.col("doc").alias("id")), "id").select("id", F.col("doc").alias("_key"), F.col("print").alias("_print")), "wanted-rows")
    source = df.select(F.col(key).cast("long").alias("own"), F.xxhash64(text).alias("print"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    own = F.col("own").eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print"))
    texts = settle(small_join(source, named_rows, own).select(F.col("id").alias("doc"), "text").dropDuplicates(["doc"]), "texts")
    links = settle(verify(likely(pairs, reps, percent), texts, width, percent), "verified")
    first = components(links)
    named = wanted.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))
    named = settle(named, "named")
    more = settle_buckets(members.select("bucket", "doc"), named, reps, texts, width, percent)
    joined = named.filter("doc <> component").select(F.col("doc").alias("a"), F.col("component").alias("b"))
    last = settle(components(joined.union(more)).withColumnRenamed("node", "id"), "last")
    discard(reps, spread, buckets, members, wanted, named_rows, named, texts, links, more)
    # Of a component the first row of all its classes, by the same order as within a class.
    heads = settle(last.join(classes, "id").groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.doc").alias("head"), F.col("first.row").alias("head_row")), "heads")
    headed = small_join(last, heads, "component").select("id", "head", "head_row")
    told = F.col("head_row").isNotNull()
    class_of = classes.join(headed, "id", "left").select("digest", F.when(told, F.col("head")).otherwise(F.col("doc")).alias("least"), F.coalesce("head_row", "row").alias("best"))
    found = sketches.select("row", "doc", "print", "n", "digest").join(class_of, "digest", "left")
    least = F.when(F.col("best").isNull(), F.col("doc")).otherwise(F.col("least"))
    return found.select("doc", "print", "n", least.alias("least"), F.coalesce(F.col("row") == F.col("best"), F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = _verdicts(df, key, text, width, percent)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "kept")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each group of near duplicates: one with the least key."""
    rows = _verdicts(df, key, text, **options).filter("n > 0").groupBy(F.col("doc").alias("_doc"), F.col("print").alias("_print"))
    marked = settle(rows.agg(F.count(F.lit(1)).alias("_rows"), F.max("kept").alias("_kept")).filter("NOT _kept OR _rows > 1"), "marked")
    own = F.col(key).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_print"))
    single = df.join(marked, own, "left_anti")
    again = marked.filter("_kept")
    if again.isEmpty():
        return single
    # Rows of one key and text: the least by all columns stays.
    least = df.join(again, own).groupBy("_doc", "_print").agg(F.min(F.struct(*df.columns)).alias("_least"))
    return single.union(least.select("_least.*"))


ORACLE = """
WITH RECURSIVE cut AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END)) AS s FROM cut
), classes AS (SELECT s, min(id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT rep AS node, rep AS seen FROM classes
  UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen
), named AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.id AS doc_id, len(s.s) AS n_shingles, coalesce(component, s.id) AS component_id, coalesce(component, s.id) = s.id AS kept
FROM s LEFT JOIN classes ON classes.s = s.s LEFT JOIN named ON named.node = classes.rep
"""
