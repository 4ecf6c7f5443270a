"""Drawing a paper: unseen questions of one chapter, in paper order, recorded with the draw."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions import rules
from quillbank.functions import scalars as S
from quillbank.operators import document, mutate, relational
from quillbank.sources import model, readers


class Refused(ValueError):
    """A request that can't be met; ``code`` says why."""

    def __init__(self, code: str, **details):
        super().__init__(code if not details else f"{code}: {details}")
        self.code, self.details = code, details


@dataclass
class Paper:
    bank: DataFrame
    papers: DataFrame
    questions: list
    title: str
    ids: list[int]


def pool(bank: DataFrame, student: str, subject: str, chapter: str) -> DataFrame:
    return relational.scan_eq(bank, subject=subject, chapter=chapter).filter(S.unseen(F.col("history_json"), F.lit(student)))


def generate_paper(bank: DataFrame, papers: DataFrame, student_name, subject, chapter, count, seed, now, tz: str = "UTC") -> Paper:
    """A paper of ``count`` unseen questions, with the bank and the papers as they are afterwards.

    The draw is one bounded row set (at most ``MAX_DRAW``); it is taken to the driver once,
    and both what is recorded and what is returned come from that one draw.
    """
    spark: SparkSession = bank.sparkSession
    asked = spark.createDataFrame([(student_name, subject, chapter, None if count is None else str(count))], "student_name string, subject string, chapter string, count string")
    asked = rules.check_request(asked).select(
        "*", S.sanitize_name(F.col("student_name")).alias("safe"), S.js_trim(F.col("student_name")).alias("trimmed"), S.js_parse_int(F.col("count")).alias("n"),
        S.title(S.js_trim(F.col("student_name")), F.col("chapter"), F.lit(now).cast("timestamp")).alias("title"), S.day(F.lit(now).cast("timestamp"), tz).alias("day"),
    )
    one = asked.first()
    if one.error_code:
        raise Refused(one.error_code)
    found = pool(bank, one.safe, subject, chapter)
    drawn = relational.sample_k(found, one.n, seed)
    ordered = drawn.orderBy(*relational.paper_order(F.col("question_type"), F.col("difficulty"), F.col("id")))
    questions = ordered.select("id", "question_text", "question_type", "difficulty", "answer_text").collect()
    if len(questions) < one.n:
        raise Refused("shortage", available=len(questions))
    ids = [q.id for q in questions]
    return Paper(mutate.record(bank, ids, one.safe, one.day), mutate.add_paper(papers, one.title, one.trimmed, ids, now), questions, one.title, ids)


def draw_and_commit(spark: SparkSession, root: str, student_name, subject, chapter, count, seed, now, tz: str = "UTC") -> Paper:
    """``generate_paper`` on the committed ``questions`` and ``exam_papers`` under ``root``, with both changes in one commit.

    A draw that another commit has overtaken fails with ``mutate.Conflict`` and changes nothing.
    """
    last, _ = mutate.current(spark, root)
    bank, papers = (mutate.read_committed(spark, root, name) for name in ("questions", "exam_papers"))
    drawn = generate_paper(bank, papers, student_name, subject, chapter, count, seed, now, tz)
    mutate.commit(spark, root, {"questions": drawn.bank, "exam_papers": drawn.papers}, after=last)
    return drawn


def export_paper(bank: DataFrame, title: str, student: str, ids: list[int] | None, now, fetch=readers.fetch_images) -> tuple[str, bytes]:
    """(file name, Word file) of the listed questions, in this order; ids that the bank lacks drop out, an empty list is refused."""
    if not isinstance(ids, list) or not ids:
        raise Refused("no_questions")
    spark = bank.sparkSession
    papers = mutate.add_paper(spark.createDataFrame([], model.PAPER_SCHEMA), title, student, ids, now)
    plan = document.doc_plan(papers, bank.filter(F.col("id").isin(ids)))
    images = fetch(plan.filter("kind = 'image'").select(F.col("text").alias("url")).distinct()) if fetch else None
    name = papers.select(F.concat(S.filename(F.col("title")), F.lit(".docx")).alias("name")).first().name
    return name, bytes(document.write_docx(plan, images).first().docx)


def extract_questions(files: DataFrame, client=None) -> DataFrame:
    """(path, idx and the fields) of the questions that a client reads out of files; no file at all is refused."""
    if files.isEmpty():
        raise Refused("no_file")
    return readers.extracted_questions(readers.extract(files, client))


def batch_save(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """``bank`` with a validated batch, all of it or none; an empty batch is refused."""
    if rows.isEmpty():
        raise Refused("empty")
    checked = rules.validate_batch(rows)
    told = rules.batch_errors(checked).first()
    if told.n_errors:
        raise Refused("invalid", n=told.n_errors, message=told.message)
    return mutate.insert(bank, rows.select(*[c for c in rows.columns if c not in ("question_img", "solution_img")]))


def seed(bank: DataFrame, rows: DataFrame, minimum: int = 5) -> tuple[DataFrame, DataFrame]:
    """``bank`` with the seed rows it lacks, and the counts; refused if a row is unsound or a chapter too thin to draw from."""
    if rules.validate_seed(rows).filter("error_code IS NOT NULL").limit(1).count():
        raise Refused("invalid_seed")
    if relational.density(rows, ["subject", "chapter"], minimum).filter("thin").limit(1).count():
        raise Refused("thin_chapter")
    return mutate.insert_new(bank, rows)


def list_questions(bank: DataFrame, subject=None, chapter=None, question_type=None, q=None, page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    found = relational.filter_bank(bank, {"subject": subject, "chapter": chapter, "question_type": question_type}, q)
    columns = [c for c in ("id", "subject", "chapter", "question_type", "difficulty", "question_text", "answer_text", "created_at") if c in bank.columns]
    return relational.page(found.select(*columns), page, limit)


def create_question(bank: DataFrame, row: DataFrame) -> DataFrame:
    """``bank`` with one more question; blanks that pass as text are stored trimmed."""
    code = rules.validate_create(row).first().error_code
    if code:
        raise Refused(code)
    trimmed = row.withColumn("answer_text", S.js_trim(F.col("answer_text")))
    return mutate.insert(bank, trimmed.withColumn("idx", F.lit(0)))


def update_question(bank: DataFrame, patch: DataFrame) -> DataFrame:
    code = rules.validate_update(patch).first().error_code
    if code:
        raise Refused(code)
    ready = mutate.with_defaults(patch.withColumn("idx", F.lit(0))).drop("idx")
    changed, affected = mutate.patch(bank, ready.crossJoin(patch.select("id")), ["subject", "chapter", "question_type", "difficulty", "question_text", "answer_text"])
    if not affected.first().affected:
        raise Refused("not_found")
    return changed


def delete_question(bank: DataFrame, question_id) -> DataFrame:
    ids = bank.sparkSession.createDataFrame([(str(question_id),)], "raw string").select(S.js_parse_int(F.col("raw")).cast("long").alias("id"))
    if ids.first().id is None:
        raise Refused("id")
    left, affected = mutate.remove(bank, ids)
    if not affected.first().affected:
        raise Refused("not_found")
    return left


def chapter_whitelist(spark: SparkSession) -> DataFrame:
    return relational.whitelist_map(model.chapters(spark))
