"""Mixing sources to target weights.

The words of each source, in a fixed pseudorandom order of its documents, are packed
into blocks of ``block`` words (a source's last block may be shorter; documents
straddle blocks). The mix is a row of numbered slots, a block each, cut into ``SHARDS``
output shards of equal length.

1. Draw. Every slot draws its source by a seeded uniform number, with chances in
   proportion to the targets. Counted by shard and source that is one multinomial draw
   per shard (``draw_counts``).
2. Settle. A source's draws over all shards may stray from its target by ``DRIFT`` at
   most and never pass two uses of a block; where they do, the counts of its shards are
   scaled to the nearest number allowed, by rounded running sums. A shard may thereby
   differ a little from the length it was drawn with.
3. Place. A source's k-th slot, counted shard after shard, holds its block ``q(k mod
   m)``, ``q`` a pseudorandom permutation of its ``m`` blocks. Slots and blocks are then
   joined by (source, block index).

Targets: sources in code-point order, null last, weigh 5, 2, 1, 5, ...; together they
get 150% of all words, none above twice its own, the excess reshared by weight: that is
``min(2 * size, level * weight)`` for the one level at which the targets sum up. One row
per source passes through one task for this; nothing else does.

``mix`` says how many words of each document are taken. ``repeat`` gives whole documents
instead: each as often as slots hold the block of its first word, 0 to 2 times.

Null texts have no words, as have empty ones; documents without words are taken 0
times. Repeated rows are separate documents. An empty table, or one without words,
gives targets of 0. Extra columns are dropped by ``mix`` and kept by ``repeat``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, settle, small_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Words of a block.
BLOCK = 64
#: Output shards.
SHARDS = 64
#: Share of a source's target by which its draws may differ from it.
DRIFT = 1 / 2000
#: Slots that one row is exploded into, and slots that a task makes.
STEP, TASK_SLOTS = 1 << 12, 1 << 20
#: Buckets that the targets' number line is cut into, at least.
LEAST_BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). One row per source, so one window over them."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))
    )
    # Sources in the order in which a rising level fills them; those before the first
    # one that the level leaves unfilled are full.
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (
        weighed.withColumn("full", F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(before), F.lit(0.0)))
        .withColumn("lighter", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("lighter")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(most))
        .withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("source_size") * F.lit(most), F.coalesce(F.col("final") * F.col("weight"), F.col("source_size") * F.lit(most)))
    return filled.select("source", "source_size", "weight", target.alias("target"), "place")


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, for n up to 2**42.

    Two maps ``x -> a * x + c mod n`` with ``a`` coprime to n, and between them a riffle
    (lower half to even places); each of the three is a bijection.
    """
    # Three primes just above 2**20: a number below 2**42 cannot be a multiple of all of them.
    factor = F.when(n % 1048583 != 0, F.lit(1048583)).when(n % 1048589 != 0, F.lit(1048589)).otherwise(F.lit(1048601))
    first = F.pmod(index * factor + F.pmod(seed, F.lit(1 << 31)), n)
    half = F.floor((n + 1) / 2).cast("long")
    riffled = F.when(first < half, first * 2).otherwise((first - half) * 2 + 1)
    return F.pmod(riffled * factor + F.pmod(F.shiftright(seed, 31), F.lit(1 << 31)), n)


def _placed(df: DataFrame, key: str, text: str, source: str, block: int, mark: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with size, mark, source and the offset of their first word in their source; sources with targets, blocks and the draws wanted)."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), mark.alias("print"))
    docs = settle(docs, "mix-sizes")  # read several times below; without the texts
    # Parts of a source: as many as rows in each, so neither numbering a part nor adding up the parts of a source is one long task.
    parts_each = max(64, math.isqrt(docs.count()))
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "print"), F.lit(parts_each)).cast("int"))
    by_part = docs.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "part").orderBy("doc_id", "print").rowsBetween(Window.unboundedPreceding, 0)
    numbered = docs.withColumn("upto", F.sum("size").over(within))
    same = numbered["source"].eqNullSafe(parts["source"]) & (numbered["part"] == parts["part"])
    offset = numbered.join(parts, same).select(numbered["doc_id"], numbered["source"], "print", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    sizes = by_part.groupBy("source").agg(F.sum("words").alias("source_size"))
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = settle(
        targets(sizes)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        .withColumn("wanted", F.least(wanted, F.col("blocks") * 2))
        .withColumn("seed", F.abs(F.xxhash64(F.lit("mix"), "source") % F.lit(1 << 62))),
        "mix-sources",
    )
    return offset, sources


def draw_counts(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, place, n): of each shard's slots the number that drew each source; one multinomial draw per shard."""
    spark = sources.sparkSession
    slots, n = sources.agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.count(F.lit(1))).first()
    if not slots:
        return sources.filter("false").select(F.lit(0).alias("shard"), "place", F.col("wanted").alias("n"))
    # Sources are stretches of a number line. It is cut into buckets, so that a number finds its stretch by equality and few comparisons.
    width = -(-slots // (4 * max(n, LEAST_BUCKETS // 4)))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    line = sources.select("place", "wanted", F.coalesce(F.sum("wanted").over(before), F.lit(0)).alias("lo")).filter("wanted > 0")
    line = line.withColumn("hi", F.col("lo") + F.col("wanted"))
    line = settle(line.withColumn("bucket", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})"))).select("bucket", "place", "lo", "hi"), "mix-line")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))
    drawn = spark.range(0, slots, 1, tasks).select(F.expr(f"id div {-(-slots // shards)}").cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(slots)).alias("value"))
    met = small_join(drawn.withColumn("bucket", F.expr(f"value div {width}")), line, "bucket").filter("lo <= value AND value < hi")
    return met.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))


def settle_counts(sources: DataFrame, counts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(place, shard, base, n, blocks, seed): the counts to be taken, and the number of the source's slots in earlier shards."""
    drawn = counts.groupBy("place").agg(F.sum("n").alias("drawn"))
    low, high = F.ceil(F.col("wanted") * (1 - DRIFT)), F.least(F.floor(F.col("wanted") * (1 + DRIFT)), F.col("blocks") * 2)
    aims = sources.select("place", "blocks", "seed", "wanted").join(drawn, "place", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    aims = aims.withColumn("taken", F.least(F.greatest("drawn", low), high).cast("long")).filter("taken > 0")
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("shard"))
    run = counts.select("place", "shard", "n", upto.alias("upto")).withColumnRenamed("n", "raw")
    # Products of two counts can pass 64 bits.
    scaled = "cast(taken as decimal(19, 0)) * cast({} as decimal(19, 0)) div cast(drawn as decimal(19, 0))"
    kept = aims.join(run, "place").withColumn("base", F.expr(scaled.format("(upto - raw)"))).withColumn("n", F.expr(scaled.format("upto")) - F.col("base"))
    # A small source that no slot drew gets its slots in a shard of its own choice.
    undrawn = aims.filter("drawn = 0").select("place", F.pmod(F.xxhash64(F.lit("shard"), "place"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("base"), F.col("taken").alias("n"), "blocks", "seed")
    return kept.select("place", "shard", "base", "n", "blocks", "seed").filter("n > 0").unionByName(undrawn)


def plan_slots(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every slot of the mix: (shard, place of the source, k, block)."""
    spark = sources.sparkSession
    counts = settle(draw_counts(sources, shards), "mix-draws")
    placed = settle(settle_counts(sources, counts, shards), "mix-counts")
    discard(counts)
    slots = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # An explicit number of tasks, which isn't coalesced: the few rows here become all slots.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))
    groups = placed.withColumn("g", F.explode(F.expr(f"sequence(0L, (n - 1) div {STEP})"))).repartition(tasks, "place", "shard", "g")
    k = F.explode(F.sequence(F.col("g") * STEP, F.least((F.col("g") + 1) * STEP, F.col("n")) - 1))
    slot = groups.withColumn("k", k).withColumn("k", F.col("base") + F.col("k"))
    return slot.select("shard", "place", "k", permuted(F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), F.col("seed")).alias("block"))


def _times(sources: DataFrame) -> DataFrame:
    return plan_slots(sources).groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's) and taken, the words that the mix takes of it."""
    offset, sources = _placed(df, key, text, source, block, F.xxhash64(F.col(text)))
    info = sources.select(F.col("source").alias("s"), "place", "source_size", "target")
    docs = offset.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    covered = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    held = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    # A document's blocks are consecutive, so a pair (source, block) meets its few documents in one task, however large the source is.
    # Spark's estimate of the slots, which are exploded from one row per source, is far too low: without the hint it broadcasts them.
    taken = covered.withColumn("held", held).join(_times(sources).hint("merge"), ["place", "block"], "left").withColumn("got", F.col("held") * F.coalesce("times", F.lit(0)))
    with_words = taken.groupBy("place", "start", "doc_id", "source", "size", "source_size", "target").agg(F.sum("got").alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    without = docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return with_words.select(*columns).unionByName(without.select(*columns))


def repeat(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """``df`` with each document as often as slots of the mix hold the block of its first word; rows equal in all columns share their slots."""
    row = F.xxhash64(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    offset, sources = _placed(df, key, text, source, block, row)
    info = sources.select(F.col("source").alias("s"), "place")
    first = offset.filter("size > 0").join(info, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "print", "place", F.floor(F.col("start") / block).cast("long").alias("block"))
    held = first.join(_times(sources).hint("merge"), ["place", "block"], "left")
    times = held.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.coalesce("times", F.lit(0))).alias("_times")).filter("_times > 0")
    times = settle(times.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "_rows", "_times"), "mix-times")
    own = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_print"))
    marked = df.select("*", row.alias("_own"))
    single = marked.join(times.filter("_rows = 1"), own).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    found = single.select(*df.columns)
    again = times.filter("_rows > 1")
    if again.isEmpty():
        return found
    # Rows that are equal throughout: one of them, as often as all of them are taken, in steps.
    one = marked.join(again, own).groupBy("_id", "_print").agg(F.first(F.struct(*df.columns)).alias("_row"), F.first("_times").alias("_times"))
    steps = one.withColumn("_step", F.explode(F.expr(f"sequence(0L, (_times - 1) div {STEP})")))
    copies = steps.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP), F.col("_times") - F.col("_step") * STEP))))
    return found.union(copies.select(*[F.col("_row").getField(c).alias(c) for c in df.columns]))
