"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary holds strings that its own merges build out of single
bytes. Which of them come out *whole*, as one token, is proved once on the driver by
running the merges over every vocabulary string (``prove_whole``). When counting, a
pre-token that is in the proven set counts as one token without any merging; only the
rest is merged, and the merged counts are remembered in a bounded table.

Texts are cut at single spaces first: the pre-token pattern never carries anything
across a space that stands between two other characters, so each stretch between
such spaces is counted alone and stretches that recur are counted once.

Null texts count as empty; special strings inside a text become one token each, as
the library does by default. Rows are independent: ties, repeated rows, empty tables
and extra columns change nothing (the input's own columns are kept, and a column of
the input that is called like an output is replaced).
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, utf8_len

#: Remembered stretches, and pre-tokens, per Python worker; a table is emptied when full.
REMEMBERED = 400_000
#: A pre-token of more bytes is merged with a heap rather than by rescanning.
LONG_PRETOKEN = 64
#: Fixed value: the pattern that cuts a text into pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it prints, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left once the merges have run, lowest rank first, leftmost first."""
    if len(symbols) > LONG_PRETOKEN:
        return _merge_count_heap(symbols, ranks)
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return len(symbols)


def _merge_count_heap(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The same for long pre-tokens in n log n: a heap of pairs over a linked list."""
    import heapq

    n, parts = len(symbols), list(symbols)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], left = a + b, False, left - 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (p := before[i]) >= 0 and (r := ranks.get((parts[p], parts[i]))) is not None:
            heapq.heappush(heap, (r, p, parts[p], parts[i]))
    return left


@lru_cache(maxsize=4)
def prove_whole(path: str) -> tuple[frozenset, dict, tuple[str, ...]]:
    """Of the tokenizer file: the vocabulary strings that encode alone as one token, the merge ranks, the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
    ranks = {m: i for i, m in enumerate(merges)}
    whole = frozenset(v for v in spec["model"]["vocab"] if merge_count(list(v), ranks) == 1)
    return whole, ranks, tuple(t["content"] for t in spec.get("added_tokens", []))


class Counter:
    """Counts tokens of texts from a proof; lives in one Python worker."""

    def __init__(self, whole, ranks, specials):
        import regex

        self.whole, self.ranks = whole, ranks
        self.find = regex.compile(PRETOKEN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.letters = byte_alphabet()
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.merged = self.direct = 0

    def pretoken(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.fresh(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def fresh(self, piece: str) -> int:
        coded = "".join([self.letters[b] for b in piece.encode("utf-8")])
        if coded in self.whole:
            self.direct += 1
            return 1
        self.merged += 1
        return merge_count(list(coded), self.ranks)

    def stretch(self, piece: str) -> int:
        n = sum(map(self.pretoken, self.find(piece)))
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n

    def plain(self, text: str) -> int:
        words = text.split(" ")
        known, total, start = self.known, 0, 0
        # A cut at a space is sound only if the characters on both sides are no white space.
        pending = words[0]
        for word in words[1:]:
            if word and pending and not word[0].isspace() and not pending[-1].isspace():
                n = known.get(pending)
                total += self.stretch(pending) if n is None else n
                pending = " " + word
            else:
                pending += " " + word
        if pending:
            n = known.get(pending)
            total += self.stretch(pending) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return sum(self.plain(p) for p in parts if p) + len(parts) - 1


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit``. One narrow pass, no shuffle; the proof (fixed size: the vocabulary) is broadcast."""
    spark = df.sparkSession
    proof = spark.sparkContext.broadcast(prove_whole(tokenizer_path))
    kept = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    source = df.select(*kept)
    at = kept.index(text)

    def run(batches):
        import pyarrow as pa

        counter = Counter(*proof.value)
        for batch in batches:
            for part in chunks(batch, at):
                n = [counter.count(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n_tokens"])

    schema = T.StructType([*source.schema.fields, T.StructField("n_tokens", T.LongType())])
    counted = source.mapInArrow(run, schema)
    return counted.withColumn("n_bytes", utf8_len(F.col(text))).withColumn("over_limit", F.col("n_tokens") > limit)
