"""Benchmark decontamination: size-partitioned MinHash containment search.

Both sides are sets of five-word shingles (words lower-cased A to Z). An item is found
in a document that holds at least ``threshold`` of the item's distinct shingles.

Search. Items are partitioned by size (powers of two of their number of shingles), and
each partition has its sketch length: the item's ``floor((1 - threshold + SPARE) * upper) + 1``
least shingle hashes, ``upper`` being the partition's largest size; shingles that more than
``COMMON`` items share (prompt templates) come after all others. An item of n shingles
misses at most ``n - ceil(threshold * n)`` of them in any document that counts, so a
document must hold all of the sketch but that many: no document is lost, short or long,
and one that holds a few common words is no candidate. Documents are probed whole against
the sketches, with no signature of their own, which would fade for long ones. Where the
sketches are too many to broadcast, a document's shingles first pass a bit table of
``FILTER_BITS`` bits of them; what gets through is shuffled.

Verification. For each candidate pair the distinct shingles of the item that occur in
the document are counted, compared word by word.

Null, empty and shorter texts have no shingles and are never found, on either side.
Equal items are found each by itself. Rows without a key are searched like others, under
the null key. Rows with the same key are searched apart and
reported once, with the largest containment. Extra columns are ignored by
``find_contained`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, is_small, settle, shingles, small_join, words

WIDTH = 5
THRESHOLD = 0.8
#: Share of an item's shingles by which its sketch is longer than the bound asks; so many must be hit.
SPARE = 0.2
#: Items that may share a shingle before it goes to the end of their order.
COMMON = 64
#: Bits of the table that filters shingles: 2 MB, whatever the input. A word holds 64, a row ``ROW_WORDS`` words.
FILTER_BITS, ROW_WORDS = 1 << 24, 512
#: Sketch rows that are broadcast.
SKETCH_ROWS = 200_000


def _hash_of(*parts: Column) -> Column:
    return F.xxhash64(*[F.xxhash64(p) for p in parts])


def _hashes(df: DataFrame, text: Column, *keys: Column, width: int) -> DataFrame:
    """Keys and the hash h of every shingle place. Words are hashed before they are put side by side: rows of numbers only."""
    # The array is a column of its own first: written inside inline() it would be computed anew for every slice.
    cut = df.select(*keys, F.transform(words(text), lambda w: F.xxhash64(w)).alias("_words"))
    rows = cut.select(*cut.columns[:-1], F.inline(shingles(F.col("_words"), width)))
    return rows.withColumn("h", F.xxhash64(*[F.col(f"w{i}") for i in range(width)])).drop(*[f"w{i}" for i in range(width)])


def _exploded(df: DataFrame, text: Column, *keys: Column, width: int) -> DataFrame:
    """Keys, the words as ``shingle`` and their hash h of every shingle place."""
    cut = df.select(*keys, words(text).alias("_words"))
    rows = cut.select(*cut.columns[:-1], F.inline(shingles(F.col("_words"), width)))
    parts = [F.col(f"w{i}") for i in range(width)]
    return rows.withColumn("h", _hash_of(*parts)).withColumn("shingle", F.struct(*parts)).drop(*[f"w{i}" for i in range(width)])


def item_shingles(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    rows = _exploded(items, F.col(text), F.col(key).alias("item_id"), F.xxhash64(text).alias("item_print"), width=width)
    return rows.select("item_id", "item_print", "h", "shingle").distinct()


def sketches(parts: DataFrame, threshold: float) -> DataFrame:
    """(item_id, item_print, h, need): the first hashes of each item, as many as its size partition asks for, and how many of them a document must hold."""
    item = Window.partitionBy("item_id", "item_print")
    common = parts.groupBy("h").agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") > COMMON).select("h", F.lit(True).alias("common"))
    sized = parts.join(common, "h", "left").withColumn("n", F.count(F.lit(1)).over(item))
    ranked = sized.withColumn("rank", F.row_number().over(item.orderBy(F.col("common").isNotNull(), "h", "shingle")))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    # The small addends keep rounding from taking a value that the bound needs.
    length = F.least(F.floor((1 - threshold + SPARE) * upper + 1e-9) + 1, F.col("n"))
    missed = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)
    kept = ranked.filter(F.col("rank") <= length)
    # Shingles whose hashes collide are one hash to a document, so fewer hashes are asked of it.
    distinct = kept.groupBy("item_id", "item_print", "h").agg(F.count(F.lit(1)).alias("same"), F.first(missed).alias("missed"))
    need = F.greatest(F.count(F.lit(1)).over(item) - F.col("missed"), F.lit(1).cast("long"))
    return distinct.select("item_id", "item_print", "h", need.alias("need"))


def bit_rows(index: DataFrame, bits: int) -> DataFrame:
    """(row, words): the hashes of ``index`` as set bits in rows of ``ROW_WORDS`` words."""
    at = F.pmod("h", F.lit(bits))
    word = index.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = word.groupBy(F.expr(f"word div {ROW_WORDS}").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % ROW_WORDS).alias("k"), "bits"))).alias("m"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("words"))


def _probed(hashes: DataFrame, index: DataFrame, rows: int | None = None, bits: int | None = None) -> DataFrame:
    """Rows of ``hashes`` whose h is in the settled ``index``, with the items."""
    rows, bits = SKETCH_ROWS if rows is None else rows, bits or FILTER_BITS
    if is_small(index, rows):
        return hashes.join(F.broadcast(index), "h")
    table = F.broadcast(settle(bit_rows(index, bits), "bits"))  # FILTER_BITS / 8 bytes, whatever the index
    placed = hashes.withColumn("_at", F.pmod("h", F.lit(bits)))
    held = placed.join(table, F.expr(f"_at div {64 * ROW_WORDS}") == F.col("row"))
    bit = F.expr(f"shiftright(words[cast((_at div 64) % {ROW_WORDS} as int)], cast(_at % 64 as int)) & 1L")
    return held.filter(bit == 1).select(*hashes.columns).join(index, "h")


def _found(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD,
) -> DataFrame:
    """Every pair of a document's text and an item found in it, told apart by keys and hashes of the texts."""
    parts = settle(item_shingles(items, item_key, item_text, width), "items")
    keys = [F.col(key).alias("doc_id"), F.xxhash64(text).alias("doc_print")]
    index = settle(sketches(parts, threshold), "sketches")
    pair = ["doc_id", "doc_print", "item_id", "item_print"]
    probed = _probed(_hashes(docs, F.col(text), *keys, width=width), index).groupBy(*pair, "h").agg(F.first("need").alias("need"))
    hits = probed.groupBy(*pair).agg(F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
    candidates = settle(hits.filter("hits >= need").select(*pair), "candidates")
    # Only documents that are candidates are cut up again.
    # Keys may be null, and a null is a key like any other here.
    wanted = settle(candidates.select(F.col("doc_id").alias("_d"), F.col("doc_print").alias("_p")).distinct(), "wanted")
    keyed = docs.select(*keys, F.col(text).alias("_text"))
    held = small_join(keyed, wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_print") == F.col("_p")), "left_semi")
    seen = _exploded(held, F.col("_text"), F.col("doc_id"), F.col("doc_print"), width=width)
    seen = small_join(seen, parts, ["h", "shingle"])
    shared = seen.groupBy("doc_id", "doc_print", "item_id", "item_print").agg(F.countDistinct("shingle").alias("n_shared"))
    sizes = parts.groupBy(F.col("item_id").alias("_i"), F.col("item_print").alias("_ip")).agg(F.count(F.lit(1)).alias("n_item"))
    own_item = F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_print") == F.col("_ip"))
    asked = candidates.select(*[F.col(c).alias(f"_{c}") for c in candidates.columns])
    own_pair = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("doc_print") == F.col("_doc_print"))
    own_pair = own_pair & F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_print") == F.col("_item_print"))
    found = shared.join(asked, own_pair, "left_semi").join(sizes, own_item)
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    # n_shared * 100 against a whole number: no rounding decides.
    reached = F.col("n_shared") * 100 >= F.round(F.lit(threshold * 100)).cast("long") * F.col("n_item")
    kept = settle(found.filter(reached).select("doc_id", "doc_print", "item_id", "n_item", "n_shared", "containment"), "found")
    discard(parts, index, candidates, wanted)
    return kept


def find_contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item found in a document."""
    found = _found(docs, items, key, text, **options)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those in whose own text an item is found."""
    hit = settle(_found(docs, items, key, text, **options).select(F.col("doc_id").alias("_hit"), F.col("doc_print").alias("_hit_print")).distinct(), "hit")
    if is_small(hit):
        hit = F.broadcast(hit)
    return docs.join(hit, F.col(key).eqNullSafe(F.col("_hit")) & (F.xxhash64(text) == F.col("_hit_print")), "left_anti")


ORACLE = """
WITH cut AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), item_cut AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), d AS (
  SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)
), q AS (
  SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM item_cut)
), n AS (SELECT id, count(*) AS n_item FROM q GROUP BY id),
shared AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared FROM d JOIN q ON d.s = q.s GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN n ON n.id = item_id WHERE n_shared * 100 >= 80 * n_item
"""
