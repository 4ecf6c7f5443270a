"""Reading the bank: filters, pages, joins, counts, order and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbank.functions import scalars as S
from quillbank.sources import model


def scan_eq(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; the predicates reach the scan."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in equal.items()], F.lit(True)))


def scan(df: DataFrame, cols: list[str], order_by: str | None = None) -> DataFrame:
    found = df.select(*cols)
    return found.orderBy(order_by) if order_by else found


def multi_get(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isin(ids)) if ids else df.limit(0)


def existing(df: DataFrame, incoming: DataFrame, key: str = "question_text") -> DataFrame:
    """``incoming`` with ``exists``: whether the bank holds its key."""
    held = df.select(F.col(key).alias("_held")).distinct()
    return incoming.join(held, F.col(key) == F.col("_held"), "left").withColumn("exists", F.col("_held").isNotNull()).drop("_held")


def filter_bank(df: DataFrame, equal: dict[str, str | None], q: str | None = None, searched: tuple[str, ...] = ("question_text", "answer_text")) -> DataFrame:
    """Only the filters that are given apply; ``q`` is searched in any of the columns."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v]
    if q:
        tests.append(reduce(lambda a, b: a | b, [S.js_like(F.col(c), q) for c in searched]))
    return reduce(lambda found, test: found.filter(test), tests, df)


def page_numbers(page=None, limit=None) -> tuple[int, int]:
    """(page, limit) as they apply: unreadable or zero means the default, then clamped."""

    def number(x, default):
        digits = str(x if x is not None else "").strip()
        sign = -1 if digits[:1] == "-" else 1
        body = digits.lstrip("+-") if digits[:1] in "+-" else digits
        head = body[: next((i for i, c in enumerate(body) if not c.isdigit()), len(body))]
        return sign * int(head) if head and int(head) else default

    return max(number(page, 1), 1), min(max(number(limit, model.PAGE_SIZE), 1), model.MAX_PAGE_SIZE)


def page(df: DataFrame, page=None, limit=None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the page, newest first; one row with total, page, limit and totalPages)."""
    page, limit = page_numbers(page, limit)
    rows = df.orderBy(F.desc(key)).offset((page - 1) * limit).limit(limit)
    summary = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.greatest(S.ceil_div(F.col("total"), F.lit(limit)), F.lit(1).cast("long")).alias("totalPages")
    )
    return rows, summary


def envelope(rows: DataFrame, summary: DataFrame, key: str = "id") -> DataFrame:
    """One JSON answer; a page has ``MAX_PAGE_SIZE`` rows at most, so it fits a row."""
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(key), *[c for c in rows.columns if c != key])), asc=False).alias("questions"))
    return summary.join(listed).select(F.to_json(F.struct("total", "page", "limit", "totalPages", "questions")).alias("json"))


def in_whitelist(df: DataFrame, dimension: DataFrame, keys: list[str], violations: bool = False) -> DataFrame:
    """Rows inside (or outside) the whitelist, which is a dimension of fixed size."""
    return df.join(F.broadcast(dimension), keys, "left_anti" if violations else "left_semi")


def chapters_of(df: DataFrame, subject: str) -> DataFrame:
    return df.filter(F.col("subject") == subject)


def anti_seen(bank: DataFrame, history: DataFrame, student, key: str = "id") -> DataFrame:
    """Questions that the student has no history with. history: (question_id, student, day)."""
    own = history.filter(F.col("student") == student).select(F.col("question_id").alias(key)).distinct()
    return bank.join(own, key, "left_anti")


def ordered_fetch(lists: DataFrame, bank: DataFrame, key: str = "id") -> DataFrame:
    """(list_id, ids) to the listed rows with ``pos``: order and repeats are kept, misses drop out."""
    wanted = lists.select("list_id", F.posexplode("ids").alias("pos", key))
    return wanted.join(bank, key)


def distinct_pairs(df: DataFrame, a: str = "subject", b: str = "chapter") -> DataFrame:
    return df.filter(S.nonblank(F.col(b))).select(a, b).distinct()


def subject_counts(df: DataFrame, named: dict[str, str], column: str = "subject") -> DataFrame:
    """One row: a count per name of ``named`` (output column to value) and ``other``, nulls included; one pass."""
    counted = [F.count_if(F.col(column) == v).alias(c) for c, v in named.items()]
    return df.agg(*counted, F.count_if(S.not_in_or_null(F.col(column), named.values())).alias("other"))


def density(df: DataFrame, keys: list[str], minimum: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("thin", F.col("n") < minimum)


def spread(counted: DataFrame) -> DataFrame:
    return counted.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("groups"))


def shortage(pool: DataFrame, wanted: int) -> DataFrame:
    return pool.agg(F.count(F.lit(1)).alias("available")).select("available", F.lit(wanted).alias("wanted"), (F.col("available") >= wanted).alias("enough"))


def draw_key(seed, key: Column) -> Column:
    """What rows are shuffled by: the same in any partitioning, and in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def permute(df: DataFrame, seed, key: str = "id") -> DataFrame:
    """``df`` with ``pos``: a uniform permutation. Numbering all rows needs one sorted sequence: meant for pools, not for whole banks."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(draw_key(seed, F.col(key)), F.col(key))))


def sample_k(df: DataFrame, k: int, seed, key: str = "id") -> DataFrame:
    """k rows without replacement; a top-k, so no full sort."""
    return df.orderBy(draw_key(seed, F.col(key)), F.col(key)).limit(k)


def paper_order(question_type: Column, difficulty: Column, key: Column) -> list[Column]:
    """Sort keys of a paper: weight of the type, difficulty (none or 0 counts as 3), then id."""
    return [S.type_weight(question_type), F.coalesce(F.nullif(difficulty, F.lit(0)), F.lit(model.DEFAULT_DIFFICULTY)), key]


def change_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.agg(F.count_if(S.changed(F.col(old), F.col(new))).alias("updated"), F.count_if(~S.changed(F.col(old), F.col(new))).alias("untouched"))


def whitelist_map(dimension: DataFrame) -> DataFrame:
    """One row: subject to its chapters in order."""
    each = dimension.groupBy("subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "chapter"))), lambda x: x["chapter"]).alias("chapters"))
    return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subject", "chapters")))).alias("whitelist"))
