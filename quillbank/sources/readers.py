"""Where rows come from: JSON bodies, files, databases, images and a model's replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions import scalars as S
from quillbank.sources import model


def read_batch(spark: SparkSession, body: str) -> DataFrame:
    """The questions of one request body, with their index; a body has a bounded size."""
    if len(body.encode()) > model.MAX_JSON_BYTES:
        raise ValueError("the body is too large")
    rows = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", f"questions {model.EXTRACTED_SCHEMA}").alias("b"))
    return rows.select(F.posexplode("b.questions").alias("idx", "q")).select("idx", "q.*")


def read_files(spark: SparkSession, path: str, max_bytes: int = model.MAX_PDF_BYTES, modified_before: str | None = None, content: bool = True) -> DataFrame:
    """Files of at most ``max_bytes``; without ``content`` only their names and times are read."""
    reader = spark.read.format("binaryFile")
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    found = reader.load(path).filter(F.col("length") <= max_bytes)
    return found if content else found.select("path", "modificationTime", "length")


def stale_files(spark: SparkSession, path: str, before: str, keep: str = ".gitkeep") -> DataFrame:
    return read_files(spark, path, 1 << 62, before, content=False).filter(~F.col("path").endswith(keep))


def encode_files(files: DataFrame) -> DataFrame:
    return files.select("path", F.base64("content").alias("base64"))


def extract(files: DataFrame, client: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, raw_json) of files through a client that turns a file into a reply; without one, every reply is an empty list."""

    def ask(frames):
        for frame in frames:
            yield frame.assign(raw_json=[client(bytes(c)) if client else "[]" for c in frame["content"]])[["path", "raw_json"]]

    return files.select("path", "content").mapInPandas(ask, "path string, raw_json string")


def extracted_questions(replies: DataFrame) -> DataFrame:
    return replies.select("path", F.posexplode(S.unfence_json(F.col("raw_json"))).alias("idx", "q")).select("path", "idx", "q.*")


def open_checked(url: str, timeout: float):
    """The answer of an address; every hop of a redirect must be as safe as the first address."""
    from urllib.error import URLError
    from urllib.request import HTTPRedirectHandler, build_opener

    class Checked(HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if not S.is_safe_address(newurl):
                raise URLError("redirected to an address that isn't safe")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    return build_opener(Checked).open(url, timeout=timeout)


def fetch_images(urls: DataFrame, timeout: float = 8.0, max_bytes: int = model.MAX_IMAGE_BYTES, opener: Callable | None = None) -> DataFrame:
    """``urls`` (url) with ``bytes``: null where the address isn't safe or the answer is no image of a fair size."""
    checked = urls.withColumn("_safe", S.is_safe_url(F.col("url")))

    def get(frames):
        def one(url, safe):
            if not safe:
                return None
            try:
                with (opener or open_checked)(url, timeout=timeout) as answer:
                    kind, data = answer.headers.get("content-type") or "", answer.read(max_bytes + 1)
            except Exception:  # noqa: BLE001  an image that can't be had is left out
                return None
            return data if kind.startswith("image/") and len(data) <= max_bytes else None

        for frame in frames:
            yield frame.assign(bytes=[one(u, s) for u, s in zip(frame["url"], frame["_safe"], strict=True)])[["url", "bytes"]]

    return checked.select("url", "_safe").mapInPandas(get, "url string, bytes binary")


def read_jdbc(spark: SparkSession, options: dict[str, str], table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 10) -> DataFrame:
    """A table of a database; with a numeric ``column`` and its ``bounds`` in as many ranges, else in one task."""
    reader = spark.read.format("jdbc").options(**options, dbtable=table)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, connections: int = 10) -> None:
    df.coalesce(connections).write.format("jdbc").options(**options, dbtable=table).mode("append").save()


def has_object(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
