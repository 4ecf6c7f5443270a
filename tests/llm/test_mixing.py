import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillbank.llm import mixing


def fixture(spark, n=400):
    sources = ["b", "a", None, "ü", "c"]
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else sources[i % 5]
        rows.append((i, "w " * ((i * 37) % 500), s, 1))
    rows += [(n, None, "a", 1), (n + 1, "", "zero", 1), (n + 2, "long " * 30000, "b", 1), (4, rows[4][1], rows[4][2], 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / heavy for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_taken(spark):
    rows, df = fixture(spark)
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    again = {(r.doc_id, r["size"], r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r["size"], r.taken) for r in got}


def test_permutations(spark):
    for n in (1, 2, 3, 10, 1048583, 5000):
        place = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(123456789123456789))
        rows = spark.range(min(n, 5000)).select(place.alias("p")).collect()
        assert len({r.p for r in rows}) == len(rows) and all(0 <= r.p < n for r in rows)


def test_repeat_keeps_columns(spark):
    rows, df = fixture(spark)
    got = mixing.repeat(df)
    assert got.columns == df.columns
    counts = {}
    for r in got.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert counts and max(counts.values()) <= 4


def test_empty(spark):
    _, df = fixture(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.repeat(df.limit(0)).count() == 0


def hashed(*values):
    """What the engine's xxhash64 gives for strings and longs; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64 if seed >> 63 else 0)


def permuted(index, n, seed):
    factor = next(p for p in (1048583, 1048589, 1048601) if n % p)
    first = (index * factor + seed % (1 << 31)) % n
    half = (n + 1) // 2
    riffled = 2 * first if first < half else 2 * (first - half) + 1
    return (riffled * factor + (seed >> 31) % (1 << 31)) % n


def plain_mix(rows):
    """(doc_id, size) of rows to the words taken, slot by slot and word by word; and the draws of each shard."""
    docs = [(d, s, len((t or "").split()), hashed(t)) for d, t, s in rows]
    parts = max(64, math.isqrt(len(rows)))
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    blocks = {s: -(-sizes[s] // mixing.BLOCK) for s in names}
    wanted = {s: min(math.floor(target[s] * blocks[s] / sizes[s] + 0.5), 2 * blocks[s]) if sizes[s] else 0 for s in names}
    line = [s for s in names for _ in range(wanted[s])]
    length = -(-len(line) // mixing.SHARDS)
    draws = {s: Counter() for s in names}
    for i in range(len(line)):
        draws[line[hashed("draw", i) % len(line)]][i // length] += 1
    times = {}
    for s in names:
        drawn = sum(draws[s].values())
        taken = min(max(drawn, math.ceil(wanted[s] * (1 - mixing.DRIFT))), math.floor(wanted[s] * (1 + mixing.DRIFT)), 2 * blocks[s])
        seed = abs(hashed("mix", s)) % (1 << 62)
        times[s] = Counter(permuted(k % blocks[s], blocks[s], seed) for k in range(taken))
    at = dict.fromkeys(names, 0)
    found = []
    for d, s, n, mark in sorted(docs, key=lambda r: (hashed(r[0], r[3]) % parts, r[0], r[3])):
        found.append((d, n, sum(times[s][(at[s] + i) // mixing.BLOCK] for i in range(n)), at[s], s))
        at[s] += n
    return found, draws, times


def test_taken_against_a_plain_loop(spark):
    rows, df = fixture(spark)
    want, draws, times = plain_mix([r[:3] for r in rows])
    got = sorted((r.doc_id, r["size"], r.taken) for r in mixing.mix(df.repartition(3)).collect())
    assert got == sorted(w[:3] for w in want)
    offset, sources = mixing._placed(df, "doc_id", "text", "source", mixing.BLOCK, F.xxhash64("text"))
    place = {r.place: r.source for r in sources.collect()}
    counted = {(place[r.place], r.shard): r.n for r in mixing.draw_counts(sources).collect()}
    assert counted == {(s, k): n for s, c in draws.items() for k, n in c.items()}
    # Slots are numbered without gaps and lie in ranges of shards.
    slots = mixing.plan_slots(sources).collect()
    for s in times:
        own = sorted((r.k, r.shard) for r in slots if place[r.place] == s)
        assert [k for k, _ in own] == list(range(sum(times[s].values()))) and [h for _, h in own] == sorted(h for _, h in own)


def test_draws_are_multinomial(spark):
    sources = spark.createDataFrame([(0, 6000, 5000, 7), (1, 3000, 5000, 8), (2, 1000, 5000, 9)], "place int, wanted long, blocks long, seed long")
    counts = mixing.draw_counts(sources, 50).collect()
    assert sum(r.n for r in counts) == 10_000
    # Per shard 200 draws at chances .6, .3, .1: Pearson's sum over 50 shards has 100 degrees of freedom.
    held = {(r.shard, r.place): r.n for r in counts}
    pearson = sum((held.get((s, k), 0) - 200 * p) ** 2 / (200 * p) for s in range(50) for k, p in enumerate((0.6, 0.3, 0.1)))
    assert 50 < pearson < 170


def test_repeat_takes_first_words_blocks(spark):
    rows, df = fixture(spark)
    df = df.dropDuplicates(["doc_id", "text"])
    got = Counter(r.doc_id for r in mixing.repeat(df).collect())
    marks = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(*df.columns).alias("h")).collect()}
    offset, sources = mixing._placed(df, "doc_id", "text", "source", mixing.BLOCK, F.xxhash64(*df.columns))
    place = {r.source: r.place for r in sources.collect()}
    times = {(r.place, r.block): r.times for r in mixing._times(sources).collect()}
    want = Counter({r.doc_id: times.get((place[r.source], r.start // mixing.BLOCK), 0) for r in offset.collect() if r["size"] and r.print == marks[r.doc_id]})
    assert got == +want and max(got.values()) <= 2


def test_rows_equal_throughout(spark):
    rows = [(1, "a b c", "s", 0)] * 50 + [(i, "x " * 40, "t", 0) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = Counter(r.doc_id for r in mixing.repeat(df).collect())
    assert 0 < got[1] <= 100 and got == Counter(r.doc_id for r in mixing.repeat(df.repartition(5)).collect())
