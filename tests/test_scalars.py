import datetime

import pytest
from pyspark.sql import functions as F

from quillbank.functions import scalars as S


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("expression", "values", "want"),
    [
        (S.normalize_difficulty, ["3abc", "2.9", "0", "6", "", None, " 5", "-1", "99999999999"], [3, 2, None, None, None, None, 5, None, None]),
        (S.sanitize_name, ["  A  ", 'A"B', "\\", "　　", '" A "', None], ["A", "AB", None, None, " A ", None]),
        (S.js_trim, ["　x﻿", "\n x \t", ""], ["x", "x", ""]),
        (S.check_count, [None, "0", "-1", "51", "5", "x", "50.9"], ["required", "not_positive", "not_positive", "too_many", None, "not_positive", None]),
        (S.strip_unsafe, ["a😀★\x07b\n", "中文\x7f"], ["ab\n", "中文"]),
        (S.xml_safe_clean, [" a\x85b "], ["ab"]),
        (S.unify_newlines, ["a\r\nb\rc"], ["a\nb\nc"]),
        (S.has_cjk, ["a", "a中", "（"], [False, True, True]),
        (S.plain_fallback, ["$\\frac{a}_b^c$"], ["fracabc"]),
        (S.html_escape, ["<a & b>", None], ["&lt;a &amp; b&gt;", ""]),
        (S.filename, ["a b(1)~卷.docx"], ["a%20b(1)~%E5%8D%B7.docx"]),
        (S.unfence, ["```json\n[1]\n```", "[2]", " ```\n{}\n``` "], ["[1]", "[2]", "{}"]),
        (lambda c: F.array_join(S.csv_list(c, lower=True), "|"), [" A, ,b,", None], ["a|b", ""]),
        (lambda c: S.unseen(c, F.lit("A")), ["{}", '{"A":null}', "{bad", None, '{"A":"2026-01-01"}'], [True, False, True, True, False]),
        (lambda c: S.record(c, F.lit("A"), F.lit("d")), ['{"A":"x","B":"y"}', None], ['{"B":"y","A":"d"}', '{"A":"d"}']),
        (lambda c: S.default_falsy(c, "略"), ["", None, "x"], ["略", "略", "x"]),
        (lambda c: S.default_null(c, "略"), ["", None], ["", "略"]),
    ],
)
def test_texts(spark, expression, values, want):
    assert column(spark, values, expression) == want


def test_urls(spark):
    urls = ["ftp://x", "http://localhost", "http://10.0.0.1", "http://172.31.0.1", "http://172.32.0.1", "https://a.local", "not a url", None, "http://[::1]/x", "https://fc-x.org/", "http://[fd00::1]/"]
    assert column(spark, urls, S.is_safe_url) == [False, False, False, False, True, False, False, False, False, True, False]
    assert column(spark, ["https://fc-x.org/", "http://[::1]/x"], lambda c: S.is_safe_url(c, strict=False)) == [False, True]
    assert column(spark, ["https://a.org/x", "https://b.org/"], lambda c: S.is_safe_url(c, allow=[" A.org"])) == [True, False]


def test_like(spark):
    texts = ["100%", "a_b", "axb", "\\frac{1}{2}", "frac", "$"]
    assert column(spark, texts, lambda c: S.js_like(c, "_b")) == [False, True, True, False, False, False]
    assert column(spark, texts, lambda c: S.js_like(c, "\\frac")) == [False, False, False, True, True, False]
    assert column(spark, texts, lambda c: S.js_like(c, "\\_")) == [False, True, False, False, False, False]


def test_dates(spark):
    ts = [datetime.datetime(2026, 8, 1, 23, 30)]
    assert column(spark, ts, S.title_date, "timestamp") == ["2026_8_1"]
    assert column(spark, ts, lambda c: S.day(c, "Asia/Taipei"), "timestamp") == ["2026-08-02"]
    assert column(spark, ts, S.print_date, "timestamp") == ["2026/8/1"]


def test_weights(spark):
    assert column(spark, ["單選", "多選", "填空", "計算", "證明", "其他", None], S.type_weight) == [1, 2, 3, 4, 5, 99, 99]
