"""The anchored-window limiter as a stream: per key a count and the end of its window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillbank.operators.limiter import UNKNOWN, verdicts
from quillbank.sources import model

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnchoredWindow(StatefulProcessor):
    """State per key: (count, reset_ms). It is evicted ``keep_ms`` of the clock after the key's last hit, so keys that are gone cost nothing."""

    def __init__(self, window_ms: int, keep_ms: int | None):
        self.window_ms, self.keep_ms = window_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "n int, reset_ms long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        n, reset = self.state.get() if self.state.exists() else (0, None)
        frame = pd.concat(list(rows)).sort_values(["now", "seq"])
        numbers, resets = [], []
        for now in frame["now"]:
            if reset is None or now >= reset:
                n, reset = 0, int(now) + self.window_ms
            n += 1
            numbers.append(n)
            resets.append(reset)
        self.state.update((n, reset))
        yield pd.DataFrame({"key": key[0], "seq": frame["seq"], "now": frame["now"], "hit_no": numbers, "reset_ms": resets})

    def close(self) -> None:
        pass


def rate_limit_stream(df: DataFrame, key: str = "key", ts: str = "ts", order: str = "seq", window_ms: int = model.WINDOW_MS, most: int = model.MAX_HITS, keep_ms: int | None = None, evict: bool = True) -> DataFrame:
    """The streaming form of ``operators.limiter.rate_limit``; needs the RocksDB state store.

    Within a micro-batch the hits of a key are taken in order of time. A key's state goes
    ``keep_ms`` after its last hit was read (one window, if not given): live hits of a window
    are never further apart. Where old hits are replayed more slowly than they came, give more,
    or ``evict=False``: then state stays, and a run over all that is available comes to its
    end, which with eviction, that goes by the clock, it never does.
    """
    hits = df.select(F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN)).alias("key"), F.col(order).cast("long").alias("seq"), F.unix_millis(F.col(ts).cast("timestamp")).alias("now"))
    keep = (window_ms if keep_ms is None else keep_ms) if evict else None
    counted = hits.groupBy("key").transformWithStateInPandas(
        statefulProcessor=AnchoredWindow(window_ms, keep), outputStructType="key string, seq long, now long, hit_no int, reset_ms long", outputMode="append", timeMode="processingTime" if evict else "none"
    )
    return verdicts(counted.withColumn("ts", F.timestamp_millis("now")), most)
