import datetime
import random

import pytest

from quillbank.operators import limiter
from quillbank.streaming import limiter as stream


def test_stream_agrees_with_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(2)
    base = datetime.datetime(2026, 1, 1)
    now, rows = base, []
    for i in range(300):
        now += datetime.timedelta(milliseconds=rng.choice([0, 500, 5000, 60000]))
        rows.append((rng.choice("abc"), now, i))
    schema = "key string, ts timestamp, seq long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = (
            stream.rate_limit_stream(source, most=4, evict=False).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        assert run.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    columns = ["key", "seq", "hit_no", "allowed", "remaining", "reset_ms", "retry_after_s"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())
    batch = spark.createDataFrame(rows, schema)
    assert got == sorted(tuple(r) for r in limiter.rate_limit(batch, most=4).select(*columns).collect())


def test_state_of_keys_that_are_gone_is_evicted(spark, tmp_path):
    """Between two batches the state's time runs out, so the second hit opens a window of its own."""
    import time

    pytest.importorskip("google.protobuf")
    base = datetime.datetime(2026, 1, 1)
    schema = "key string, ts timestamp, seq long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        for keep, want in ((1, [1, 1]), (600_000, [1, 2])):
            at = tmp_path / str(keep)
            for i in range(2):
                spark.createDataFrame([("a", base + datetime.timedelta(seconds=i), i)], schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
                run = (
                    stream.rate_limit_stream(spark.readStream.schema(schema).parquet(str(at / "in")), keep_ms=keep).writeStream.format("parquet").outputMode("append")
                    .option("path", str(at / "out")).option("checkpointLocation", str(at / "state")).trigger(once=True).start()
                )
                assert run.awaitTermination(120)
                time.sleep(0.1)
            assert [r.hit_no for r in spark.read.parquet(str(at / "out")).orderBy("seq").collect()] == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
