"""Changing the bank: every mutation is a DataFrame to a DataFrame.

Tables of one transaction are committed together (``commit``): each is written to a folder
of its own, and one small file that names all of them appears last and at once. Readers go
by the newest such file, so they see all tables as before or all as after.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbank.functions import scalars as S
from quillbank.sources import model


def with_defaults(rows: DataFrame) -> DataFrame:
    """Incoming fields as they are stored."""
    return rows.select(
        "subject",
        S.js_trim(F.col("chapter")).alias("chapter"),
        S.default_falsy(F.col("question_type"), model.DEFAULT_TYPE).alias("question_type"),
        S.normalize_difficulty(S.default_null(F.col("difficulty").cast("string"), str(model.DEFAULT_DIFFICULTY))).alias("difficulty"),
        S.js_trim(F.col("question_text")).alias("question_text"),
        *[(F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("question_img", "solution_img")],
        S.default_falsy(F.col("answer_text"), model.DEFAULT_ANSWER).alias("answer_text"),
        F.lit("{}").alias("history_json"),
        "idx",
    )


def insert(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """``bank`` and the incoming rows with defaults and the next ids, in order of ``idx``.

    Incoming rows are one request, so one sequence numbers them.
    """
    start = bank.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_last"))
    numbered = with_defaults(rows).crossJoin(F.broadcast(start)).withColumn("id", F.col("_last") + F.row_number().over(Window.orderBy("idx")))
    added = numbered.drop("_last", "idx").withColumn("created_at", F.lit(None).cast("timestamp") if "created_at" not in bank.columns else F.current_timestamp())
    return bank.unionByName(added.select(*[c for c in bank.columns if c in added.columns]), allowMissingColumns=True)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def new_rows(bank: DataFrame, rows: DataFrame, key: str = "question_text", order: str = "idx") -> DataFrame:
    """Incoming rows that the bank doesn't hold yet, and of equal ones the first."""
    return first_of_each(rows, key, order).join(bank.select(key).distinct(), key, "left_anti")


def insert_new(bank: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the bank with the new rows; one row with inserted and skipped)."""
    fresh = new_rows(bank, rows)
    counts = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted"))).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))
    return insert(bank, fresh), counts


def add_paper(papers: DataFrame, title: str, student: str, ids: list[int], created_at=None) -> DataFrame:
    spark = papers.sparkSession
    last = papers.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_last"))
    one = spark.createDataFrame([(title, student, ids)], "title string, student_name string, ids array<bigint>")
    row = one.crossJoin(last).select((F.col("_last") + 1).alias("id"), "title", "student_name", S.ids_to_json(F.col("ids")).alias("question_ids"), F.lit(created_at).cast("timestamp").alias("created_at"))
    return papers.unionByName(row)


def record(bank: DataFrame, ids: list[int], student: str, day: str) -> DataFrame:
    """``bank`` with the student's entry in the history of the given questions."""
    entry = S.record(F.col("history_json"), F.lit(student), F.lit(day))
    return bank.withColumn("history_json", F.when(F.col("id").isin(ids), entry).otherwise(F.col("history_json")))


def patch(bank: DataFrame, patches: DataFrame, columns: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the bank with patched columns; one row with affected). Other columns stay, a blank answer becomes the default one."""
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))

    def value(c: str) -> Column:
        new = F.col(f"_new_{c}")
        if c == "answer_text":
            new = S.default_falsy(S.js_trim(new), model.DEFAULT_ANSWER)
        return F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c)

    joined = bank.join(renamed, key, "left")
    return joined.select(*[value(c) if c in columns else F.col(c) for c in bank.columns]), joined.agg(F.count("_hit").alias("affected"))


def remove(bank: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    return bank.join(ids, key, "left_anti"), bank.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("affected"))


def update_changed(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with new values and ``changed``: whether any differs, nulls compared as values."""
    any_changed = F.lit(False)
    for c, value in new.items():
        any_changed = any_changed | S.changed(F.col(c), value)
    return df.withColumn("changed", any_changed).withColumns(new)


def views(bank: DataFrame, subjects: dict[str, str]) -> None:
    """A view per subject (name to value). A view keeps no order; readers sort."""
    columns = ["id", "chapter", "question_type", "difficulty", "question_text", "answer_text", "history_json", "created_at"]
    for name, subject in subjects.items():
        bank.filter(F.col("subject") == subject).select(*[c for c in columns if c in bank.columns]).createOrReplaceTempView(name)


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def lay_out(bank: DataFrame, path: str) -> None:
    """The layout that stands in for the (subject, chapter) index: a folder per subject, rows sorted so that row groups can be skipped.

    Tasks are ranges of (subject, chapter, id), so few subjects don't mean few tasks.
    """
    bank.repartitionByRange("subject", "chapter", "id").sortWithinPartitions("subject", "chapter", "id").write.partitionBy("subject").mode("overwrite").parquet(path)


class Conflict(RuntimeError):
    """Another commit came first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(number of the last commit, table name to folder); (0, {}) before the first one."""
    fs, at = _fs(spark, f"{root}/_commits")
    if not fs.exists(at):
        return 0, {}
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    last = max(numbers)
    return last, json.loads(spark.read.text(f"{root}/_commits/{last:020d}", wholetext=True).first().value)


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)[1][name]}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int | None = None) -> int:
    """Write tables (name to content) under ``root`` and make all of them current at once; the number of the commit.

    Tables that aren't given stay as they are. The file that names the folders is written
    aside and renamed, which succeeds for one writer only: if another commit has appeared
    since ``after`` (the last one, if not given), this one fails with ``Conflict`` and
    leaves nothing behind. Folders of earlier commits stay for readers that still use them.
    """
    last, held = current(spark, root)
    last = last if after is None else after
    staged = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    aside = f"{root}/_commits/_{uuid.uuid4().hex}"
    jvm = spark._jvm
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{staged[name]}")
        fs, at = _fs(spark, aside)
        out = fs.create(at, False)
        out.write(json.dumps({**held, **staged}).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/_commits/{last + 1:020d}")
        try:
            files.rename(at, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {last + 1} of {root} is there already") from e
            raise
    except Exception:
        for there in (*[f"{root}/{path}" for path in staged.values()], aside):
            fs, at = _fs(spark, there)
            fs.delete(at, True)
        raise
    return last + 1
