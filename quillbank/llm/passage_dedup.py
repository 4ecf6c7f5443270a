"""Repeated passages: suffix arrays over the places where a repeat can be.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in the
same document or another, is removed. Strings are judged on the input.

1. Anchors. Each ``LENGTH``-byte string (window) has one anchor: of its ``GRAM``-byte
   grams the one of least hash, the leftmost of equals. Equal windows have equal anchors
   at equal offsets, so windows can be compared anchor by anchor, and each window is
   looked at under one anchor only. The windows of one anchor are neighbours; together
   they are the anchor's context. Texts are gone over once for this; anchors whose hash
   occurs once are done with.
2. Contexts that occur twice as a whole, by a 128-bit digest under their anchor, are
   repeats as a whole; no bytes need to move.
3. Of the rest, those go on that share the inner ``INNER`` bytes of some of their windows
   with another context of their anchor: any window that repeats does. Their bytes are
   cut out of the texts and dealt out by anchor, and suffix arrays are built over blocks
   of them (``lyndon_suffix``). Suffixes that agree in their first ``LENGTH`` bytes stand
   side by side there; they are compared byte by byte. Before, windows are left out whose
   hash no other context of the anchor has, and of what is left bytes that stand in one
   another are sorted once and counted as often as they stand.
4. An anchor with more than ``HOT`` such contexts isn't put into one task: its contexts are
   cut into pieces of ``STEP / FINE`` neighbouring windows, which are dealt out by the string that
   all windows of a piece hold. Equal windows lie in pieces of one string, so suffix arrays
   over the pieces of a string find all that those over the whole anchor would.
5. The repeated stretches of each document are merged and cut out.

Null texts are empty; texts of fewer than ``LENGTH`` bytes lose nothing. Repeated rows repeat each other. Rows
are told apart by hashes of key and text, 95 bits together, so rows that share a key, however
many, don't disturb each other; rows without a key are handled alike. An empty table gives an empty result. Columns that are
called like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, settle, small_join, split_semi_join

LENGTH = 200
GRAM = 50
#: Windows of one anchor are told apart roughly by their offset, in steps of so many bytes.
STEP = 50
INNER = LENGTH - STEP
#: Steps of pieces of contexts in each ``STEP``.
FINE = 5
#: Contexts of one anchor that stay together; beyond, they are cut into pieces.
HOT = 2_000
#: Bytes over which one suffix array is built.
BLOCK = 1 << 20

_INDEX_BITS = 22
_FACTOR = 0x9E3779B97F4A7C15


class Grams:
    """Rolling hashes of byte strings; lives in one Python worker."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, step: int = STEP):
        import numpy as np

        self.length, self.gram, self.step = length, gram, step
        self.inner = length - step
        self.table = np.random.default_rng(4).integers(1, 2**63, 256, dtype=np.uint64)
        self.reserve(1 << 20)

    def reserve(self, n: int) -> None:
        import numpy as np

        inverse = 1
        for _ in range(7):
            inverse = inverse * (2 - _FACTOR * inverse) % 2**64
        with np.errstate(over="ignore"):
            self.power, self.back = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, f, np.uint64))]) for f in (_FACTOR, inverse))

    def sums(self, data):
        import numpy as np

        if len(data) >= len(self.power):
            self.reserve(2 * len(data))
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.power[: len(data)])])

    def hashes(self, sums, at, n: int):
        """Hashes of the n bytes from each place."""
        import numpy as np

        with np.errstate(over="ignore"):
            h = (sums[at + n] - sums[at]) * self.back[at]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))

    def anchors(self, data, ends):
        """The anchors of texts that stand one after the other in ``data``, each up to its place in ``ends``.

        (hash, text, place, first window, last window, hashes of inner strings); places in ``data``.
        """
        import numpy as np

        wide = self.length - self.gram + 1
        if len(data) < self.length:
            none = np.zeros(0, np.int64)
            return (none, none, none, none, none, np.zeros((0, -(-wide // self.step)), np.int64))
        sums = self.sums(data)
        n = len(data) - self.gram + 1
        h = self.hashes(sums, np.arange(n), self.gram)
        # The least hash of each window: of its upper bits, then the leftmost. Very long
        # texts go in overlapping pieces, each with places of its own.
        size = 1 << _INDEX_BITS
        low = np.uint64(size - 1)
        best = np.concatenate([
            (_sliding_least((h[p : p + size] & ~low) | np.arange(min(size, n - p), dtype=np.uint64), wide) & low).astype(np.int64) + p
            for p in range(0, n - wide + 1, size - wide + 1)
        ])
        # Windows that lie in one text.
        text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        start = np.flatnonzero(text[: len(best)] == text[self.length - 1 :])
        best = best[start]
        turn = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else np.zeros(0, np.int64)
        place = best[turn]
        first, last = start[turn], start[np.append(turn[1:], len(start)) - 1] if len(start) else turn
        inner = np.zeros((len(place), -(-wide // self.step)), np.int64)
        for k in range(inner.shape[1]):
            # Windows that start between step * k and step * (k + 1) - 1 bytes before the anchor all hold this string.
            at = place - self.step * k
            held = (place - first >= self.step * k) & (place - last < self.step * (k + 1))
            held &= (at >= 0) & (at + self.inner <= len(data))
            inner[:, k] = np.where(held, self.hashes(sums, np.where(held, at, 0), self.inner).view(np.int64) | 1, 0)
        return h[place].view(np.int64), text[place], place, first, last, inner


def _sliding_least(values, width: int):
    import numpy as np

    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def repeated_in(strings: list[tuple[bytes, int]], copies, length: int = LENGTH, gram: int = GRAM):
    """(copy, first byte, last byte + 1) as arrays: of each copy its stretches covered by ``length``-byte strings that start elsewhere in the copies too, by one suffix array.

    strings: different bytes, each with a place whose ``gram`` bytes all its windows hold.
    copies: (string, first window, number of windows) of all that stands somewhere, an array
    with a row each; a string itself is a copy of all its windows. Copies are counted, not sorted.
    """
    import numpy as np

    from .lyndon_suffix import suffix_array

    joined = np.frombuffer(b"\0".join(s for s, _ in strings) + b"\0", np.uint8)
    sizes = np.array([len(s) + 1 for s, _ in strings])
    ends = np.cumsum(sizes) - 1
    base = ends - sizes + 1
    text = joined.astype(np.int32) + 1
    text[ends] = 0
    dropped = np.zeros(len(text) + 1, np.int8)
    if gram > 2:
        # Of the bytes that all windows of a string hold two codes are left, which say which bytes they are: equal windows stay equal, others different.
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(s[at : at + gram], len(number)) for s, at in strings])
        digits = int(len(number) ** 0.5) + 1
        place = base + np.array([at for _, at in strings])
        text[place], text[place + 1] = 257 + which // digits, 257 + which % digits
        dropped[place + 2], dropped[place + gram] = 1, -1
    where = np.flatnonzero(np.cumsum(dropped[:-1], dtype=np.int8) == 0)
    order = where[suffix_array(text[where])]
    order = order[np.repeat(ends, sizes)[order] - order >= length]
    weight = np.zeros(len(text) + 1, np.int64)
    string, first, windows = copies.T
    np.add.at(weight, base[string] + first, 1)
    np.add.at(weight, base[string] + first + windows, -1)
    weight = np.cumsum(weight)
    hit = np.zeros(len(text), bool)
    if len(order):
        views = np.lib.stride_tricks.sliding_window_view(joined, length)
        other = np.ones(len(order), bool)
        for at in range(0, len(order) - 1, 8192):
            upto = min(at + 8192, len(order) - 1)
            held = views[order[at : upto + 1]]
            other[at + 1 : upto + 1] = (held[1:] != held[:-1]).any(axis=1)
        turn = np.flatnonzero(other)
        hit[order] = np.repeat(np.add.reduceat(weight[order], turn) > 1, np.diff(np.append(turn, len(order))))
    # All windows of all copies in a row.
    done = np.cumsum(windows)
    copy = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(copy)) - np.repeat(done - windows, windows)
    hit = hit[(base[string] + first)[copy] + window]
    edge = np.ones(len(copy) + 1, bool)
    edge[1:-1] = copy[1:] != copy[:-1]
    start = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stop = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
    return copy[start], window[start], window[stop] + length


def thin_out(grams: Grams, contexts: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int, int]]:
    """(index, first, last, string, shift): of contexts (anchor, the anchor's place in the bytes, bytes) the parts that can hold a repeat.

    A part goes from the first to the last window that another context of the anchor has
    by its hash. ``string`` is the number in this list of the part in whose bytes it stands,
    ``shift`` bytes from their start: often another one, as copies of a passage have the same parts.
    """
    import numpy as np

    length = grams.length
    size = np.array([len(c[2]) for c in contexts])
    base = np.cumsum(size) - size
    place = base + np.array([c[1] for c in contexts])
    anchor = np.array([c[0] for c in contexts], np.int64).view(np.uint64)
    raw = b"".join(c[2] for c in contexts)
    sums = grams.sums(np.frombuffer(raw, np.uint8))
    first, last = np.maximum(base, place - length + grams.gram), np.minimum(base + size - length, place)
    windows = np.maximum(last - first + 1, 0)
    own = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(own)) + np.repeat(first - np.cumsum(windows) + windows, windows)
    with np.errstate(over="ignore"):
        h = grams.hashes(sums, at, length) ^ (anchor * np.uint64(_FACTOR))[own]
    order = np.argsort(h)
    turn = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])) if len(order) else order
    number = np.diff(np.append(turn, len(order)))
    shared = np.zeros(len(own), bool)
    shared[order[np.repeat(number > 1, number)]] = True
    shared = np.flatnonzero(shared)
    if not len(shared):
        return []
    opens = np.flatnonzero(np.concatenate([[True], own[shared[1:]] != own[shared[:-1]]]))
    head, tail = shared[opens], shared[np.append(opens[1:], len(shared)) - 1]
    kept, lo, hi = own[head], at[head], at[tail]
    part = np.full(len(size), -1)
    part[kept] = np.arange(len(kept))
    # Of the parts that have a part's first window, the one that goes on farthest from there; of equals the one that begins farthest before, then the first.
    group = np.empty(len(own), np.int64)
    group[order] = np.repeat(np.arange(len(turn)), number)
    mine = part[own]
    rank = np.where((mine >= 0) & (at >= lo[mine]) & (at <= hi[mine]), ((hi[mine] - at) << 47) | ((at - lo[mine]) << 31) | ((1 << 31) - 1 - mine), -1)
    best = np.maximum.reduceat(rank[order], turn)[group[head]]
    string = (1 << 31) - 1 - (best & ((1 << 31) - 1))
    shift = (best >> 31) & 0xFFFF
    for i in np.flatnonzero(string != np.arange(len(kept))).tolist():
        from_ = int(lo[string[i]] + shift[i])
        if raw[from_ : from_ + int(hi[i] - lo[i]) + length] != raw[int(lo[i]) : int(hi[i]) + length]:
            string[i], shift[i] = i, 0
    # A part stands in a longer one or in an earlier equal one, so this ends.
    while (string[string] != string).any():
        shift, string = shift + shift[string], string[string]
    begin = base[kept]
    return list(zip(*(x.tolist() for x in (kept, lo - begin, hi - begin + length, string, shift)), strict=True))


def merge_runs(lo, hi):
    """Overlapping and touching runs made one: (starts, ends) in order."""
    import numpy as np

    order = np.lexsort((hi, lo))
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(lo) else hi
    turn = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.zeros(0, np.int64)
    return lo[turn], hi[np.append(turn[1:], len(lo)) - 1] if len(lo) else hi


_NAME = "doc long, print int"


def _names(key: str, text: str):
    """What tells rows apart, 95 bits from two hashes: a row's key and text together, then its text by itself."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text)), F.pmod(F.hash(text), F.lit(1 << 31)).cast("int")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    doc, mark = _names(key, text)
    return df.select(doc.alias("doc"), mark.alias("print"), F.col(text).alias("text"))


def _long_enough(batches, length: int):
    """(docs, prints, bytes of the texts one after the other, their ends) of texts of ``length`` bytes or more."""
    import numpy as np

    for whole in batches:
        for batch in chunks(whole, 2, 1 << 20):
            docs, marks, raws = [], [], []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                raw = text.encode() if text else b""
                if len(raw) >= length:
                    docs.append(doc)
                    marks.append(mark)
                    raws.append(raw)
            if raws:
                yield np.array(docs), np.array(marks, np.int32), b"".join(raws), np.cumsum([len(r) for r in raws])


def _anchor_rows(keyed: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        digest = hashlib.blake2b
        grams = Grams(length, gram, step)
        for docs, marks, raw, ends in _long_enough(batches, length):
            h, text, place, first, last, inner = grams.anchors(np.frombuffer(raw, np.uint8), ends)
            base = (ends - np.diff(np.concatenate([[0], ends])))[text]
            # A context is its bytes and the anchor's place in them.
            offset = [n.to_bytes(4, "little") for n in range(length)]
            at = (place - first).tolist()
            ctx = np.frombuffer(b"".join([digest(raw[a : b + length], digest_size=16, salt=offset[k]).digest() for k, a, b in zip(at, first.tolist(), last.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            # Only half of an inner hash goes on: it only has to thin out, and 0 still says none.
            half = (inner >> 32).astype(np.int32) | (inner != 0)
            columns = [h, ctx[:, 0], ctx[:, 1], docs[text], marks[text], (first - base).astype(np.int32), (last - base + length).astype(np.int32), (place - first).astype(np.int32), *half.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["anchor", "ctx", "ctx2", "doc", "print", "lo", "hi", "at", *(f"v{k}" for k in range(inner.shape[1]))])

    bins = ", ".join(f"v{k} int" for k in range(-(-(length - gram + 1) // step)))
    return keyed.mapInArrow(run, f"anchor long, ctx long, ctx2 long, {_NAME}, lo int, hi int, at int, {bins}")


def pieces(raw: bytes, at: int, anchor: int, length: int, gram: int, fine: int):
    """(key, first byte, bytes, place of the string) of the pieces of a context: windows that start in one step of ``fine`` bytes before the anchor, under a hash of the string they all hold."""
    import xxhash

    for k in range(-(-(length - gram + 1) // fine)):
        held = at - fine * k
        first, last = max(0, held - fine + 1), min(len(raw) - length, held)
        if first <= last:
            key = xxhash.xxh64_intdigest(raw[held : held + length - fine], (anchor + k) % 2**64)
            yield key - (1 << 64 if key >> 63 else 0), first, raw[first : last + length], held - first


def _cut_out(wanted: DataFrame, keyed: DataFrame, length: int, gram: int, fine: int) -> DataFrame:
    """The bytes of contexts, those of crowded anchors in pieces: (anchor, doc, print, lo, bytes, at)."""
    by_doc = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("anchor", "hot", "lo", "hi", "at")).alias("places"))
    joined = keyed.join(by_doc, ["doc", "print"]).select("doc", "print", "text", "places")

    def run(batches):
        import pyarrow as pa

        names = ["anchor", "doc", "print", "lo", "bytes", "at"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        for whole in batches:
            for batch in chunks(whole, 2, 1 << 20):
                rows = []
                for doc, mark, text, places in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = text.encode()
                    for p in places:
                        anchor, lo, held, at = p["anchor"], p["lo"], raw[p["lo"] : p["hi"]], p["at"]
                        if p["hot"]:
                            rows += [(key, doc, mark, lo + first, part, place) for key, first, part, place in pieces(held, at, anchor, length, gram, fine)]
                        else:
                            rows.append((anchor, doc, mark, lo, held, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return joined.mapInArrow(run, f"anchor long, {_NAME}, lo int, bytes binary, at int")


def _by_suffix_arrays(contexts: DataFrame, length: int, gram: int, step: int, block: int) -> DataFrame:
    # Suffix arrays take far more time a byte than anything else, so tasks are told by bytes, and an explicit number isn't coalesced.
    total = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * block)))
    dealt = contexts.select("anchor", "doc", "print", "lo", "bytes", "at").repartition(tasks, "anchor").sortWithinPartitions("anchor")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        grams = Grams(length, gram, step)
        raws, raw_size, strings, copies, size, last = [], 0, [], [], 0, None

        def thinned():
            """What is left of the contexts of some whole anchors goes to the block."""
            nonlocal raws, raw_size, size
            parts = thin_out(grams, [(r[0], r[5], r[4]) for r in raws]) if len(raws) > 1 else []
            number = {}
            for k, (i, a, b, string, _) in enumerate(parts):
                if string == k:
                    number[k] = len(strings)
                    strings.append((raws[i][4][a:b], raws[i][5] - a))
                    size += b - a
            for i, a, b, string, shift in parts:
                copies.append((raws[i][1], raws[i][2], raws[i][3] + a, number[string], shift, b - a - length + 1))
            raws, raw_size = [], 0

        def settled():
            nonlocal strings, copies, size
            doc, mark, lo = (np.array(c) for c in zip(*(c[:3] for c in copies), strict=True))
            copy, a, b = repeated_in(strings, np.array([c[3:] for c in copies]), length, gram)
            strings, copies, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc[copy], mark[copy], lo[copy] + a, lo[copy] + b), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc", "print", "lo", "hi"])

        for batch in batches:
            for anchor, doc, mark, lo, raw, at in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                # A block ends between two anchors.
                if anchor != last and raw_size >= block:
                    thinned()
                    if size >= block:
                        yield settled()
                raws.append((anchor, doc, mark, lo, raw, at))
                raw_size, last = raw_size + len(raw), anchor
        thinned()
        if copies:
            yield settled()

    return dealt.mapInArrow(run, f"{_NAME}, lo int, hi int")


def repeated_stretches(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, hot: int | None = None, block: int = BLOCK
) -> DataFrame:
    """(doc, print, lo, hi): stretches of bytes, overlapping, that together are all that repeats; rows by ``_names``."""
    keyed = _keyed(df, key, text)
    hot, fine = HOT if hot is None else hot, max(step // FINE, 1)
    rows = settle(_anchor_rows(keyed, length, gram, step), "anchors", hashes=True)
    bins = [c for c in rows.columns if c.startswith("v")]
    again = settle(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again", hashes=True)
    shared = settle(split_semi_join(rows, again, ["anchor"]), "shared", hashes=True)
    discard(rows, again)
    name = ["anchor", "ctx", "ctx2"]
    # Rows of one context differ only in where they stand, so any of them will do; of fixed-width columns the first can be kept in a hash table.
    one = [F.first(c).alias(c) for c in ("doc", "print", "lo", "hi", "at", *bins)]
    contexts = settle(shared.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), *one), "contexts", hashes=True)
    repeated = settle(contexts.filter("n > 1").select(*name, "n"), "repeated", hashes=True)
    whole = settle(split_semi_join(shared, repeated, name).select("doc", "print", "lo", "hi"), "whole", hashes=True)
    discard(shared, repeated)
    # Contexts that share an inner string with another context of their anchor.
    inner = contexts.select(*name, F.posexplode(F.array(*bins)).alias("k", "v")).filter("v <> 0")
    met = settle(inner.groupBy("anchor", "k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met", hashes=True)
    near = split_semi_join(inner, met, ["anchor", "k", "v"]).groupBy(*name).agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    # Of a context only the windows between the first and the last step that is shared.
    place = F.col("lo") + F.col("at")
    lo, hi = F.greatest(F.col("lo"), place - step * (F.col("k1") + 1) + 1), F.least(F.col("hi"), place - step * F.col("k0") + length)
    wanted = settle(contexts.join(near, name).select("anchor", "doc", "print", lo.alias("lo"), hi.alias("hi"), (place - lo).cast("int").alias("at")), "wanted", hashes=True)
    discard(contexts, met)
    crowded = wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    crowded = settle(crowded, "crowded")
    marked = small_join(wanted, crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    bytes_of = settle(_cut_out(marked, keyed, length, gram, fine), "bytes")
    found = settle(whole.union(_by_suffix_arrays(bytes_of, length, gram, step, block)), "stretches")
    discard(whole, wanted, crowded, bytes_of)
    return found


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, spans and kept (the bytes that are left)."""
    made = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    kept = [c for c in df.columns if c not in made]
    by_doc = repeated_stretches(df, key, text, **options).groupBy("doc", "print").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("_runs"))
    doc, mark = _names(key, text)
    named = df.select(*kept, doc.alias("_doc"), mark.alias("_print"))
    joined = named.join(by_doc.withColumnsRenamed({"doc": "_doc", "print": "_print"}), ["_doc", "_print"], "left").select(*kept, "_runs")
    at, runs_at = kept.index(text), len(kept)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for whole in batches:
            for batch in chunks(whole, at, 1 << 20):
                n_bytes, n_removed, spans, left = [], [], [], []
                # Runs come packed, start and end in one number: all of a batch are one array.
                packed = batch.column(runs_at)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(packed), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                values = packed.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], ends[:-1]])
                for value, p, q in zip(batch.column(at).to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                    raw = value.encode() if value else b""
                    lo, hi = merge_runs(values[p:q] >> 32, values[p:q] & 0xFFFFFFFF)
                    parts, done = [], 0
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        parts.append(raw[done:a])
                        done = b
                    parts.append(raw[done:])
                    n_bytes.append(len(raw))
                    n_removed.append(int((hi - lo).sum()))
                    spans.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                    left.append(b"".join(parts))
                arrays = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:runs_at], *arrays], names=[*batch.schema.names[:runs_at], *made])

    extra = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<struct<lo:int,hi:int>>, kept binary")
    return joined.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *extra.fields]))


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS raw FROM documents),
long_enough AS (SELECT r, raw FROM d WHERE octet_length(raw) >= 200),
windows AS (SELECT r, i, md5(array_slice(raw, i, i + 199)) AS h FROM (SELECT r, raw, unnest(range(1, octet_length(raw) - 198)) AS i FROM long_enough)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM windows SEMI JOIN again USING (h)),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM hit),
numbered AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY r, run),
bounds AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS done FROM spans),
cut AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS rest,
    string_agg(CASE WHEN lo > done THEN hex(array_slice(raw, done, lo - 1)) ELSE '' END, '' ORDER BY lo) AS head
  FROM bounds JOIN long_enough USING (r) GROUP BY r
)
SELECT doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN rest IS NULL THEN raw ELSE unhex(head || CASE WHEN rest <= octet_length(raw) THEN hex(array_slice(raw, rest, octet_length(raw))) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
