"""Rule sets over questions: validation, formula audit, repair, cleanliness and the old normaliser.

Every rule is a Column expression; a rule set is one CASE or one array of issues, so a
whole audit is a single narrow pass over the bank.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.functions import scalars as S
from quillbank.sources import model

# The commands, names, characters and patterns that the rules look for.
UNICODE_MATH = "[×÷≤≥≠±√∞∑∫∏∂∇αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ°·∈∉⊂⊆∪∩→←⇒⇔]"
AUDITED_COMMANDS = (
    "frac", "sqrt", "int", "sum", "prod", "lim", "vec", "hat", "bar", "times", "div", "leq", "geq", "neq", "approx", "infty", "pm", "cdot",
    "alpha", "beta", "gamma", "delta", "theta", "pi", "sigma", "omega", "lambda", "mu", "phi", "sin", "cos", "tan", "log", "ln",
)
REPAIRED_GREEK = (
    "pi", "theta", "alpha", "beta", "gamma", "delta", "omega", "lambda", "nu", "sigma", "phi", "varphi", "rho", "tau", "varepsilon", "epsilon", "psi", "chi", "mu",
)
UNICODE_COMMANDS = {"×": "\\times", "÷": "\\div", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "±": "\\pm", "≈": "\\approx"}
EXACT_FIXES = {r"$\frac{T}{2}$^{[SUPER:R|3}]=K": r"$\frac{T^2}{R^3}=K$"}
SLASH_FRACTION = rf"[0-9a-zA-Zπ]{S.SPACE}*/{S.SPACE}*[0-9a-zA-Zπ]"
WEB_ADDRESS = "https?://"
MARKER_REPAIRS = (
    (r"\[FRAC:([^|\]]*)\|([^\]]*)\]", r"\\frac{$1}{$2}"),
    (r"\[SUPER:([^|\]]*)\|([^\]]*)\]", "$1^{$2}"),
    (r"\[SUB:([^|\]]*)\|([^\]]*)\]", "$1_{$2}"),
    (r"\[SQRT:([^\]}]*)[}\]]", r"\\sqrt{$1}"),
    (r"\$(\^\{[^{}]*\})", r"$1\$"),
    (r"\$(_\{[^{}]*\})", r"$1\$"),
)
STRAY_DOLLAR, STRAY_DOLLAR_ROUNDS = (r"\$\}", r"}\$"), 5
DOLLAR_PARTS, DOLLAR_SPAN = r"(\$[^$]*\$|[^$]+|\$)", r"(\$[^$]*\$)"
LEFT_MARKER = r"\[(FRAC|SUPER|SUB|SQRT):"
BARE_COMMAND = r"(^|[^\\A-Za-z])(frac|sqrt)([^A-Za-z]|$)"
BARE_ELL = r"(^|[^A-Za-z\\])ell([^A-Za-z]|$)"
DOLLAR_SCRIPT = r"\$\^|\$_|\$\}"
LEGACY_STEPS = (
    (r"\x{200B}", ""),
    (r"\[FRAC:([^|]+)\|([^\]]+)\]", r"\\frac{$1}{$2}"),
    (r"\[SQRT:([^\]]+)\]", r"\\sqrt{$1}"),
    (rf"\[SUPER:{S.SPACE}*\|([^\]]+)\]", "^{$1}"),
    (r"\[SUPER:([^|]+)\|([^\]]+)\]", "$1^{$2}"),
    (rf"\[SUB:{S.SPACE}*\|([^\]]+)\]", "_{$1}"),
    (r"\[SUB:([^|]+)\|([^\]]+)\]", "$1_{$2}"),
    ("π", r"\\pi "), ("θ", r"\\theta "), ("ω", r"\\omega "), ("∝", r"\\propto "),
    (r"√\((.*?)\)", r"\\sqrt{$1}"), ("√([a-zA-Z0-9])", r"\\sqrt{$1}"),
    ("([a-zA-Z0-9])²", "$1^{2}"), ("([a-zA-Z0-9])³", "$1^{3}"), ("([a-zA-Z0-9])₁", "$1_{1}"), ("([a-zA-Z0-9])₂", "$1_{2}"),
    (r"(?<!\$)(\\[a-zA-Z]+\{[^}]*\}(?:\{[^}]*\})?)(?!\$)", r"\$$1\$"),
    (r"(?<!\$)([a-zA-Z0-9]+[\^_]\{[^}]*\})(?!\$)", r"\$$1\$"),
    (S.WIDE_CONTROLS, ""),
)
#: An ASCII word boundary after a name: Java's own takes CJK characters for word characters.
WORD_END = "(?![A-Za-z0-9_])"


def _first(checks: list[tuple[Column, str]]) -> Column:
    return reduce(lambda case, check: case.when(check[0], check[1]), checks[1:], F.when(*checks[0]))


def _type_or_default() -> Column:
    return S.default_falsy(F.col("question_type"), model.DEFAULT_TYPE)


def _difficulty() -> Column:
    return S.normalize_difficulty(S.default_null(F.col("difficulty").cast("string"), str(model.DEFAULT_DIFFICULTY)))


def _placement(chapter: Column) -> list[tuple[Column, str]]:
    return [
        (~S.is_valid_subject(F.col("subject")), "subject"),
        (~S.is_valid_chapter(F.col("subject"), chapter), "chapter"),
        (~S.is_valid_type(_type_or_default()), "question_type"),
        (_difficulty().isNull(), "difficulty"),
    ]


def validate_create(df: DataFrame) -> DataFrame:
    """``error_code`` of a new question: what is missing counts before trimming, so blanks pass as text."""
    missing = reduce(lambda a, b: a | b, [S.is_missing(F.col(c)) for c in ("subject", "chapter", "question_text", "answer_text")])
    return df.withColumn("error_code", _first([(missing, "required"), *_placement(S.js_trim(F.col("chapter")))]))


def validate_update(df: DataFrame) -> DataFrame:
    """``error_code`` of a changed question: trimmed first; the answer may be missing."""
    trimmed = [S.is_missing(F.col("subject")), *[S.is_missing(S.js_trim(F.col(c))) for c in ("chapter", "question_text")]]
    return df.withColumn("error_code", _first([(reduce(lambda a, b: a | b, trimmed), "required"), *_placement(S.js_trim(F.col("chapter")))]))


def validate_batch(df: DataFrame) -> DataFrame:
    """``error_code`` of each row of a batch; the text is looked at last."""
    chapter = S.js_trim(F.coalesce(F.col("chapter"), F.lit("")))
    blank = S.is_missing(S.js_trim(F.col("question_text")))
    return df.withColumn("error_code", _first([*_placement(chapter), (blank, "question_text")]))


def validate_seed(df: DataFrame) -> DataFrame:
    """Whether a seed row may be loaded."""
    sound = S.is_valid_chapter(F.col("subject"), F.col("chapter")) & S.is_valid_type(F.col("question_type")) & S.normalize_difficulty(F.col("difficulty").cast("string")).isNotNull()
    return df.withColumn("error_code", F.when(~sound, "seed"))


def check_id(c: Column) -> Column:
    return F.when(S.js_parse_int(c).isNull(), "id")


def check_request(df: DataFrame) -> DataFrame:
    """``error_code`` of a request for a paper: (student_name, subject, chapter, count)."""
    missing = reduce(lambda a, b: a | b, [S.is_missing(F.col(c)) for c in ("student_name", "subject", "chapter")])
    missing = missing | F.col("count").isNull()
    return df.withColumn(
        "error_code",
        F.when(missing, "required").otherwise(F.coalesce(S.check_count(F.col("count")), F.when(S.sanitize_name(F.col("student_name")).isNull(), "student_name"))),
    )


def check_constraints(df: DataFrame) -> DataFrame:
    """Stored rows that break the table's own constraints."""
    sound = F.col("difficulty").between(1, 5) & S.is_valid_subject(F.col("subject")) & S.is_valid_type(F.col("question_type"))
    return df.filter(~F.coalesce(sound, F.lit(False)))


def batch_errors(df: DataFrame) -> DataFrame:
    """One row: n_errors and all messages of a validated batch, 1-based, in input order.

    A batch is one request of bounded size, so its messages fit one row.
    """
    said = F.struct("idx", F.concat(F.lit("第 "), (F.col("idx") + 1).cast("string"), F.lit(" 題："), F.col("error_code")).alias("message"))
    collected = F.sort_array(F.collect_list(F.when(F.col("error_code").isNotNull(), said)))
    return df.agg(F.count("error_code").alias("n_errors"), F.array_join(F.transform(collected, lambda x: x["message"]), "\n").alias("message"))


def issues(c: Column) -> Column:
    """All that is wrong with a text: array of (sev, code)."""
    dollars = S.char_count(c, "$")
    command = rf"\\({'|'.join(AUDITED_COMMANDS)}){WORD_END}"
    found = [
        (dollars % 2 != 0, "error", "odd_dollars"),
        (S.char_count(c, "{") != S.char_count(c, "}"), "error", "unbalanced_braces"),
        (c.rlike(SLASH_FRACTION) & ~c.rlike(WEB_ADDRESS), "warn", "slash_fraction"),
        (c.rlike(UNICODE_MATH), "warn", "unicode_math"),
        ((dollars < 2) & (c.rlike(command) | c.rlike(r"[\^_]")), "info", "bare_latex"),
    ]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(sev).alias("sev"), F.lit(code).alias("code"))) for test, sev, code in found]))
    nothing = F.lit(None).cast("array<struct<sev:string,code:string>>")
    return F.coalesce(F.when(S.is_missing(S.js_trim(c)), nothing).otherwise(rows), F.array().cast("array<struct<sev:string,code:string>>"))


def audit(df: DataFrame, question: str = "question_text", answer: str = "answer_text", key: str = "id", converts: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, field, sev, code): a row per issue of question or answer.

    ``converts`` (``latex.converts``) also has every text converted, in Arrow batches, and
    reports those that can't be; without it the audit stays in the JVM.
    """
    blank = S.is_missing(S.js_trim(F.col(answer))) | (S.js_trim(F.col(answer)) == model.DEFAULT_ANSWER)
    none = F.array(F.struct(F.lit("info").alias("sev"), F.lit("no_answer").alias("code")))
    empty = F.array().cast("array<struct<sev:string,code:string>>")
    no_row = F.array().cast("array<struct<sev:string,code:string>>")
    broken = F.array(F.struct(F.lit("error").alias("sev"), F.lit("unconvertible").alias("code")))

    def found(column: str) -> Column:
        if converts is None:
            return issues(F.col(column))
        failed = ~S.is_missing(S.js_trim(F.col(column))) & ~converts(F.col(column))
        return F.concat(issues(F.col(column)), F.when(F.coalesce(failed, F.lit(False)), broken).otherwise(no_row))

    answered = F.concat(found(answer), F.when(F.coalesce(blank, F.lit(True)), none).otherwise(empty))

    def tagged(those: Column, field: str) -> Column:
        return F.transform(those, lambda x: F.struct(F.lit(field).alias("field"), x["sev"].alias("sev"), x["code"].alias("code")))

    rows = df.select(F.col(key).alias("id"), F.explode(F.concat(tagged(found(question), "question"), tagged(answered, "answer"))).alias("issue"))
    return rows.select("id", "issue.field", "issue.sev", "issue.code")


def severity_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("sev").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("id").alias("questions"))


def _outside(c: Column, edit) -> Column:
    """``edit`` applied to what stands outside of ``$...$``."""
    parts = F.regexp_extract_all(c, F.lit(DOLLAR_PARTS), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{DOLLAR_SPAN}$"), p).otherwise(edit(p))), "")


def repair_markers(c: Column) -> Column:
    """Old markers back to LaTeX, and stray dollars back to where they belong."""
    for old, new in EXACT_FIXES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    for pattern, out in (*MARKER_REPAIRS, *[STRAY_DOLLAR] * STRAY_DOLLAR_ROUNDS):
        c = F.regexp_replace(c, pattern, out)
    return c


def repair_outside(c: Column) -> Column:
    """Bare symbols and Greek names outside of formulas wrapped in dollars."""
    greek = rf"\\({'|'.join(REPAIRED_GREEK)}){WORD_END}(?!{S.SPACE}*[\^_])(?:{S.SPACE}*(/){S.SPACE}*([0-9]+))?"

    def edit(p: Column) -> Column:
        for char, command in UNICODE_COMMANDS.items():
            p = F.replace(p, F.lit(char), F.lit(f"${command}$"))
        return F.regexp_replace(p, greek, r"\$\\$1$2$3\$")

    return _outside(c, edit)


def repair(c: Column) -> Column:
    return repair_outside(repair_markers(c))


def is_clean(c: Column) -> Column:
    """Whether nothing is left that repair would have had to touch; a null is clean."""
    spans = F.regexp_extract_all(c, F.lit(DOLLAR_SPAN), F.lit(1))
    unbalanced = F.exists(spans, lambda p: S.char_count(p, "{") != S.char_count(p, "}"))
    dirty = (
        c.rlike(LEFT_MARKER)
        | c.rlike(BARE_COMMAND)
        | c.rlike(BARE_ELL)
        | c.rlike(DOLLAR_SCRIPT)
        | (S.char_count(c, "$") % 2 != 0)
        | unbalanced
    )
    return ~F.coalesce(dirty, F.lit(False))


def classify(df: DataFrame, question: str = "question_text", answer: str = "answer_text") -> DataFrame:
    """``df`` with new_question, new_answer and bucket: auto, manual or null (nothing to do)."""
    new = df.withColumn("new_question", repair(F.col(question))).withColumn("new_answer", repair(F.col(answer)))
    touched = S.changed(F.col(question), F.col("new_question")) | S.changed(F.col(answer), F.col("new_answer"))
    now = is_clean(F.col("new_question")) & is_clean(F.col("new_answer"))
    before = is_clean(F.col(question)) & is_clean(F.col(answer))
    return new.withColumn("bucket", F.when(touched & now, "auto").when(touched | ~before, "manual"))


def legacy_normalize(c: Column) -> Column:
    """The old normaliser: other markers, scripts and roots as characters, lone formulas wrapped."""
    c = F.coalesce(c, F.lit(""))
    for pattern, out in LEGACY_STEPS:
        c = F.regexp_replace(c, pattern, out)
    return S.js_trim(c)
