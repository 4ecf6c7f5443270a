"""Anchored fixed windows per key: a window opens with the first hit and lasts ``window_ms``.

A hit at or after the window's end opens the next one. Hits beyond ``most`` are refused
but count. This is neither a tumbling window (aligned to the clock) nor a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbank.sources import model

UNKNOWN = "unknown"


def rate_limit(df: DataFrame, key: str = "key", ts: str = "ts", order: str = "seq", window_ms: int = model.WINDOW_MS, most: int = model.MAX_HITS) -> DataFrame:
    """key, seq and ts of ``df`` with hit_no, allowed, remaining, reset_ms and retry_after_s.

    Where a window starts depends on where the one before ended, so the hits of a key are
    walked in order of time: one pass over sorted rows, in Arrow batches, that holds a
    count and the end of the current window and jumps from window to window. A key's hits
    go to one task, which may spill them; none has to fit in memory.
    """
    hits = df.select(F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN)).alias("key"), F.col(order).alias("seq"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("now"))
    dealt = hits.repartition("key").sortWithinPartitions("key", "now", "seq")

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        held, n, reset = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, now = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            numbers, resets = np.empty(len(now), np.int32), np.empty(len(now), np.int64)
            turns = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for start, stop in zip([0, *turns.tolist()], [*turns.tolist(), len(now)], strict=True):
                if keys[start] != held:
                    held, n, reset = keys[start], 0, None
                at = start
                while at < stop:
                    if reset is None or now[at] >= reset:
                        n, reset = 0, int(now[at]) + window_ms
                    upto = at + int(np.searchsorted(now[at:stop], reset))
                    numbers[at:upto] = np.arange(n + 1, n + 1 + upto - at)
                    resets[at:upto] = reset
                    n, at = n + upto - at, upto
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(resets)], names=[*batch.schema.names, "hit_no", "reset_ms"])

    # A hit without a time opens no window; it has no place in the order.
    made = T.StructType([*hits.schema.fields, T.StructField("hit_no", T.IntegerType()), T.StructField("reset_ms", T.LongType())])
    return verdicts(dealt.filter("now IS NOT NULL").mapInArrow(walk, made), most)


def verdicts(df: DataFrame, most: int) -> DataFrame:
    late = F.ceil((F.col("reset_ms") - F.col("now")) / 1000).cast("long")
    return df.select(
        "key", "seq", "ts", "hit_no", (F.col("hit_no") <= most).alias("allowed"), F.greatest(F.lit(0), most - F.col("hit_no")).alias("remaining"), "reset_ms",
        F.when(F.col("hit_no") > most, late).alias("retry_after_s"),
    )


def tumbling_count(df: DataFrame, key: str = "key", ts: str = "ts", width: str = "1 day") -> DataFrame:
    """Hits per key and clock-aligned window: a different thing, under its own name."""
    return df.groupBy(F.col(key).alias("key"), F.window(F.col(ts), width).alias("w")).agg(F.count(F.lit(1)).alias("hits")).select("key", F.col("w.start").alias("start"), "hits")
