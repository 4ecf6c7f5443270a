import pytest
from pyspark.sql import functions as F

from quillbank.functions import rules


def texts(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.x for r in rows.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


REPAIRS = {
    "[FRAC:1|2]": r"\frac{1}{2}",
    "[SUPER:x|2]": "x^{2}",
    "[SUB:a|n]": "a_{n}",
    "[SQRT:3]": r"\sqrt{3}",
    "[SQRT:3}": r"\sqrt{3}",
    "$x$^{2}": "$x^{2}$",
    "$x$_{1}": "$x_{1}$",
    "a×b $c×d$": r"a$\times$b $c×d$",
    r"\pi中": r"$\pi$中",
    r"\pi / 2": r"$\pi/2$",
    "\\pi\u3000/\u30002": r"$\pi/2$",
    "\\pi\u3000^2": "\\pi\u3000^2",
    r"\theta^2": r"\theta^2",
    r"\theta _1": r"\theta _1",
    "lone $ b × \\pi": r"lone $ b $\times$ $\pi$",
    r"\pix": r"\pix",
    r"$\frac{T}{2}$^{[SUPER:R|3}]=K": r"$\frac{T^2}{R^3}=K$",
}


def test_repair(spark):
    assert texts(spark, [*REPAIRS, None, ""], rules.repair) == [*REPAIRS.values(), None, ""]


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("a $", {"odd_dollars"}),
        ("{{}", {"unbalanced_braces"}),
        ("a/b", {"slash_fraction"}),
        ("a\u3000/\u3000b", {"slash_fraction"}),
        ("https://x.org/a/b", set()),
        ("a ≤ b", {"unicode_math"}),
        ("x^2", {"bare_latex"}),
        ("$x^2$", set()),
        (r"\sin中", {"bare_latex"}),
        ("  ", set()),
        (None, set()),
    ],
)
def test_issues(spark, text, codes):
    [found] = texts(spark, [text], rules.issues)
    assert {i.code for i in found} == codes


def test_audit_answers(spark):
    rows = spark.createDataFrame([(1, "x", "略"), (2, "x", " "), (3, "x", None), (4, "x", "ok"), (5, "$", "a/b")], "id long, question_text string, answer_text string")
    got = {(r.id, r.field, r.code) for r in rules.audit(rows).collect()}
    assert got == {(1, "answer", "no_answer"), (2, "answer", "no_answer"), (3, "answer", "no_answer"), (5, "question", "odd_dollars"), (5, "answer", "slash_fraction")}


def test_audit_reports_what_cannot_be_converted(spark):
    rows = spark.createDataFrame([(1, "bad", "ok"), (2, "fine", "bad"), (3, " ", "ok")], "id long, question_text string, answer_text string")
    got = {(r.id, r.field, r.sev, r.code) for r in rules.audit(rows, converts=lambda c: c == "fine").collect()}
    assert got == {(1, "question", "error", "unconvertible"), (1, "answer", "error", "unconvertible"), (2, "answer", "error", "unconvertible"), (3, "answer", "error", "unconvertible")}


def test_clean(spark):
    dirty = ["[FRAC:1", "a frac b", "an ell", "$^2", "a$", "${a$", "x}$}"]
    clean = [None, "", r"\frac{1}{2}", "ellipse", "$a$ b", r"fraction \ell"]
    assert texts(spark, dirty, rules.is_clean) == [False] * len(dirty)
    assert texts(spark, clean, rules.is_clean) == [True] * len(clean)


def test_classify(spark):
    rows = spark.createDataFrame([(1, "[FRAC:1|2]", "x"), (2, "[FRAC:1|2] $", "x"), (3, "a $", "x"), (4, "a", "x")], "id long, question_text string, answer_text string")
    assert {r.id: r.bucket for r in rules.classify(rows).collect()} == {1: "auto", 2: "manual", 3: "manual", 4: None}


def test_legacy(spark):
    given = ["[FRAC:1|2]", "[SUPER: |2]", "√(x)", "x²", "π r", "[SQRT:3]​", None]
    want = [r"$\frac{1}{2}$", "^{2}", r"$\sqrt{x}$", "$x^{2}$", r"\pi  r", r"$\sqrt{3}$", ""]
    assert texts(spark, given, rules.legacy_normalize) == want


def test_validation(spark):
    rows = [
        (0, "數學", " 實數　", "", None, "x", "y"), (1, "化學", "實數", "單選", "3", "x", "y"), (2, "數學", "靜電學", "單選", "3", "x", "y"),
        (3, "物理", "靜電學", "口試", "3", "x", "y"), (4, "物理", "靜電學", "證明", "6", "x", "y"), (5, "物理", "靜電學", "證明", "2.9", " ", "y"), (6, "物理", "靜電學", "證明", "1", "x", ""),
    ]
    df = spark.createDataFrame(rows, "idx int, subject string, chapter string, question_type string, difficulty string, question_text string, answer_text string")

    def codes(checked):
        return [r.error_code for r in checked.orderBy("idx").collect()]

    assert codes(rules.validate_batch(df)) == [None, "subject", "chapter", "question_type", "difficulty", "question_text", None]
    assert codes(rules.validate_create(df)) == [None, "subject", "chapter", "question_type", "difficulty", None, "required"]
    assert codes(rules.validate_update(df)) == [None, "subject", "chapter", "question_type", "difficulty", "required", None]
    told = rules.batch_errors(rules.validate_batch(df)).first()
    assert told.n_errors == 5 and told.message.split("\n")[0] == "第 2 題：subject" and told.message.count("\n") == 4
