"""Sharding through fixed virtual slots.

Every record is hashed into one of ``N_VIRTUAL`` virtual slots, whatever the number of
shards. Bytes are summed per virtual slot, and a versioned map says which shard holds
each virtual slot. ``assign`` stores the map and places records by the version it reads
back. Where the path given already holds a map, the latest version is edited
(``rebalance``: only virtual slots that must move do) and stored as the next one, unless
nothing moves; records never change their virtual slot. Without a path the map is version 1 of its
own folder, so reruns agree. The map has ``N_VIRTUAL`` rows however large the input is: it
is the one thing that visits the driver and the one thing that is broadcast unseen.

Law: ``bytes``. Sizes of shards are as near equal as whole virtual slots allow. Groups of
equal texts, however large, don't unbalance them: a virtual slot follows from key and
checksum, so copies under different keys scatter; only rows equal in both stay together.

Null texts have no bytes (size 1, checksum 0); empty texts the same. Rows that repeat
wholly share a virtual slot but get places of their own. An empty table gives an
empty result. Extra columns are kept by ``assign``; a column that is called like an
output is replaced.
"""

from __future__ import annotations

import bisect
import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import exists, settle, shared_dir, small_join, utf8_len

#: Virtual slots; a multiple of any sensible number of shards, and small enough to broadcast always.
N_VIRTUAL = 8192
#: Share of a fair load by which shards may differ before a map is edited.
UNEVEN = 0.01
#: Records that are numbered in one go; a virtual slot with more is numbered in parts.
PART_ROWS = 50_000
MAP_SCHEMA = T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType())])


def virtual_slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(N_VIRTUAL)).cast("int")


def first_map(weights: dict[int, int], shards: int) -> dict[int, int]:
    """Heaviest virtual slot first, each to the lightest shard so far; empty slots go round."""
    loads = [(0, s) for s in range(shards)]
    found = {}
    for v in sorted(range(N_VIRTUAL), key=lambda v: (-weights.get(v, 0), v)):
        load, s = heapq.heappop(loads)
        found[v] = s
        heapq.heappush(loads, (load + max(weights.get(v, 0), 0), s))
    return found


def rebalance(current: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """A new version of ``current`` for ``shards`` shards: only virtual slots that must move do.

    Slots of shards that are gone go to the lightest shard. Then, while shards differ by
    more than ``UNEVEN`` of a fair share, the heaviest shard that has a slot of at most half
    its lead over the lightest one gives it the largest such slot.
    """
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in load}
    loose, found = [], dict(current)
    for v, s in current.items():
        if s not in load:
            loose.append(v)
        else:
            load[s] += weights.get(v, 0)
            if weights.get(v, 0):
                held[s].append((weights[v], v))
    for s in held:
        held[s].sort()

    def give(v: int, s: int) -> None:
        found[v] = s
        load[s] += weights.get(v, 0)
        if weights.get(v, 0):
            bisect.insort(held[s], (weights[v], v))

    for v in sorted(loose, key=lambda v: (-weights.get(v, 0), v)):
        give(v, min(load, key=lambda s: (load[s], s)))
    near = UNEVEN * sum(weights.values()) / shards
    while True:
        light = min(load, key=lambda s: (load[s], s))
        for heavy in sorted(load, key=lambda s: (-load[s], s)):
            lead = load[heavy] - load[light]
            at = bisect.bisect_right(held[heavy], (lead // 2, N_VIRTUAL))
            if lead > near and at:
                weight, v = held[heavy].pop(at - 1)
                load[heavy] -= weight
                give(v, light)
                break
        else:
            return found


def store_map(spark: SparkSession, shard_of: dict[int, int], weights: dict[int, int], path: str, version: int = 1) -> None:
    """Write one version as a folder of its own, whole or not at all; versions that are there already are never touched."""
    rows = [(v, s, int(weights.get(v, 0))) for v, s in sorted(shard_of.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    return sorted(r.version for r in spark.read.parquet(path).select("version").distinct().collect())


def map_frame(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(vslot, shard) of one version."""
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").select("vslot", "shard")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    version = versions(spark, path)[-1] if version is None else version
    return {r.vslot: r.shard for r in map_frame(spark, path, version).collect()}


def current_map(spark: SparkSession, weights: dict[int, int], shards: int, path: str) -> int:
    """The version to place records by: the first one, or an edit of the latest where that leaves shards unbalanced, of another number or out."""
    known = versions(spark, path)
    if not known:
        store_map(spark, first_map(weights, shards), weights, path, 1)
        return 1
    before = load_map(spark, path, known[-1])
    after = rebalance(before, weights, shards)
    if after == before:
        return known[-1]
    store_map(spark, after, weights, path, known[-1] + 1)
    return known[-1] + 1


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot, grown_shard and vslot.

    ``slot`` is the record's place in its shard, gapless from 0: its rank in its part of
    a virtual slot (the only sort, over ``PART_ROWS`` records or so at a time) plus the
    records of earlier parts and of the shard's earlier virtual slots.
    Two passes: one over sizes for the map, one that places the rows.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "_part", "_rank", "_before", "_within")
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in made]
    content = F.coalesce(F.crc32(F.col(text)), F.lit(0).cast("long"))
    records = df.select(*kept, (utf8_len(F.col(text)) + 1).alias("size"), content.alias("text_crc32"))
    records = records.withColumn("vslot", virtual_slot(F.col(key), F.col("text_crc32")))
    totals = settle(records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slot-bytes")
    counted = totals.collect()
    path = map_path or f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    version = current_map(spark, {r.vslot: r.bytes for r in counted}, shards, path)
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = map_frame(spark, path, version).join(totals.select("vslot", "n"), "vslot", "left")
    places = places.select("vslot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    parts = -(-max((r.n for r in counted), default=1) // PART_ROWS)
    records = records.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), F.col(key), "text_crc32"), F.lit(parts)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("vslot", "_part").orderBy(F.col(key), F.col("text_crc32"), F.col("size")))
    ranked = records.withColumn("_rank", rank).join(F.broadcast(places), "vslot")  # N_VIRTUAL rows, whatever the input
    if parts > 1:
        ahead = Window.partitionBy("vslot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = records.groupBy("vslot", "_part").agg(F.count(F.lit(1)).alias("n"))
        inner = settle(sizes.select("vslot", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_within")), "slot-parts")
        ranked = small_join(ranked, inner, ["vslot", "_part"])
    else:
        ranked = ranked.withColumn("_within", F.lit(0))
    slot = F.col("_before") + F.col("_within") + F.col("_rank") - 1
    return ranked.select(
        *kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
