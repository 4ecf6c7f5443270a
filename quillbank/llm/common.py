"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes up at a time.
CHUNK_BYTES = 4 << 20
#: The words of all contracts: runs of anything but these six characters.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def settle(df: DataFrame, label: str = "step", hashes: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Dictionaries are off, as most columns are keys or hashes that hardly repeat;
    ``hashes`` says that the rest is such too, so that little can be gained by compressing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4_raw" if hashes else "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    # What the write shuffled can go; Spark removes it when the driver's garbage is collected.
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what ``settle`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def utf8_len(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def chunks(batch, column: int = 0, limit: int = CHUNK_BYTES):
    """Slices of a record batch, each with about ``limit`` bytes in ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, lower-cased A to Z; none for a null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), lambda w: w != "")


def shingles(found: Column, n: int) -> Column:
    """Array of structs of ``n`` neighbouring words each; empty where there are fewer words."""
    count = F.greatest(F.size(found) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(found, i + 1, count).alias(f"w{i}") for i in range(n)])


def is_small(settled: DataFrame, rows: int = 200_000, most_bytes: int = 48 << 20) -> bool:
    """Whether a settled table may be broadcast: both its rows and the bytes in them are counted."""
    if settled.count() > rows:
        return False
    size = settled.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= most_bytes


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """``left`` joined with a settled ``right``: broadcast if its counted rows and bytes are few, else left to a shuffle join."""
    if is_small(right, rows):
        right = F.broadcast(right)
    return left.join(right, on, how)


def split_semi_join(left: DataFrame, keys: DataFrame, on: list[str], most: int = 50_000, least: int = 2_000) -> DataFrame:
    """Rows of ``left`` (settled) whose key is in ``keys`` (settled; with ``n``, how many rows each key has).

    Keys that hold more than one in ``most`` of the rows are at most ``most``, so they are
    broadcast and their rows stay where they are, however many; the rest is shuffled.
    """
    bound = max(least, (keys.agg(F.sum("n")).first()[0] or 0) // most)
    hot = keys.filter(F.col("n") > bound).select(*on)
    if hot.isEmpty():
        return left.join(keys.select(*on), on, "left_semi")
    rest = left.join(F.broadcast(hot), on, "left_anti").join(keys.filter(F.col("n") <= bound).select(*on), on, "left_semi")
    return left.join(F.broadcast(hot), on, "left_semi").union(rest)


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task; a Python worker waits for the next one with all it once took."""
    import ctypes
    import gc
    import sys

    gc.collect()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_a_process_of_its_own(f, *args):
    """``f(*args)`` from a forked process, so that the memory it takes goes back when it is done; a Python worker that is used again would keep it."""
    import multiprocessing
    import pickle

    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(duplex=False)
    process = context.Process(target=lambda: send.send_bytes(pickle.dumps(f(*args))))
    process.start()
    send.close()
    try:
        return pickle.loads(receive.recv_bytes())
    finally:
        process.join()
