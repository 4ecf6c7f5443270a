"""Scalar building blocks as Column expressions; all of them stay in the JVM.

They follow the semantics of the application's own language where that differs from
Spark's: trimming takes all Unicode white space, numbers are read by prefix, and empty
strings and zeros count as missing where a default is meant for missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbank.sources import model

# What counts as white space, CJK spaces included; what leaves a text before printing; private hosts.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EDGE_SPACE = rf"^{SPACE}+|{SPACE}+$"
LEADING_INTEGER = rf"^{SPACE}*([+-]?[0-9]+)"
FENCE_START, FENCE_END = rf"^```[A-Za-z]*{SPACE}*", rf"{SPACE}*```$"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{1F1E6}-\x{1F1FF}\x{FE0F}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
WIDE_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
CJK = r"[\x{2E80}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{3400}-\x{4DBF}]"
LOCAL_HOSTS = ("localhost", "0.0.0.0")
PRIVATE_HOST = r"^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[0-1])\.|^169\.254\."
PRIVATE_LITERAL, PRIVATE_NAME = r"^\[(::1\]|f[cd][0-9a-f]{0,2}:|fe80:)", r"^::1$|^fc|^fd|^fe80"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def is_missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _leading_integer(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), LEADING_INTEGER, 1)


def js_parse_int(c: Column) -> Column:
    """The integer that a text starts with, null if it starts with none (or with one beyond 64 bits)."""
    return _leading_integer(c).try_cast("bigint")


def js_parse_number(c: Column) -> Column:
    """The same as a double, which has room for any number of digits."""
    return _leading_integer(c).try_cast("double")


def js_like(c: Column, q: str) -> Column:
    """Substring search in which ``%`` and ``_`` stay wildcards; a backslash escapes only those and itself."""
    kept, i = [], 0
    while i < len(q):
        if q[i] == "\\":
            if i + 1 < len(q) and q[i + 1] in "%_\\":
                kept.append(q[i : i + 2])
                i += 2
                continue
            i += 1
            continue
        kept.append(q[i])
        i += 1
    return c.like(f"%{''.join(kept)}%")


def sanitize_name(c: Column) -> Column:
    """Trimmed, without quotes and backslashes; null (reject) if nothing is left."""
    return F.nullif(F.regexp_replace(js_trim(c), r'["\\]', ""), F.lit(""))


def strip_unsafe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMOJI, ""), CONTROLS, "")


def xml_safe_clean(c: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(c, EMOJI, ""), WIDE_CONTROLS, ""))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def plain_fallback(c: Column) -> Column:
    return F.translate(c, "\\{}^_$", "")


def lines(c: Column) -> Column:
    return F.split(unify_newlines(c), "\n")


def html_escape(c: Column) -> Column:
    safe = F.coalesce(c, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(plain), F.lit(entity))
    return safe


def is_safe_url(c: Column, allow: list[str] | None = None, strict: bool = True) -> Column:
    """Whether an image may be fetched from there. ``strict`` also refuses private IPv6 literals; without it their patterns are matched against bare host names."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    inner = PRIVATE_LITERAL if strict else PRIVATE_NAME
    bad = host.isin(*LOCAL_HOSTS) | host.endswith(".local") | host.rlike(PRIVATE_HOST) | host.rlike(inner)
    good = scheme.isin("http", "https") & host.isNotNull() & ~bad
    if allow:
        good = good & host.isin([a.strip().lower() for a in allow])
    return F.coalesce(good, F.lit(False))


def is_safe_address(url: str) -> bool:
    """``is_safe_url`` for one address outside of a query: the hop of a redirect."""
    import re
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        host = parts.netloc.rpartition("@")[2].lower()
        host = host[: host.index("]") + 1] if host.startswith("[") else host.partition(":")[0]
    except ValueError:
        return False
    bad = host in LOCAL_HOSTS or host.endswith(".local") or re.search(PRIVATE_HOST, host) or re.search(PRIVATE_LITERAL, host)
    return parts.scheme.lower() in ("http", "https") and bool(host) and not bad


def csv_list(c: Column, lower: bool = False) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(js_trim(x)) if lower else js_trim(x))
    return F.filter(parts, lambda x: x != "")


def unfence(c: Column) -> Column:
    """A reply without its Markdown fence; replies that don't start with one stay as they are."""
    body = js_trim(c)
    inner = F.regexp_replace(F.regexp_replace(body, FENCE_START, ""), FENCE_END, "")
    return F.when(body.startswith("```"), inner).otherwise(body)


def unfence_json(c: Column, schema: str = model.EXTRACTED_SCHEMA) -> Column:
    return F.from_json(unfence(c), schema)


def stars(c: Column) -> Column:
    return F.repeat(F.lit("★"), c)


def title(student: Column, chapter: Column, ts: Column) -> Column:
    return F.concat(student, F.lit("-"), chapter, F.lit("特訓卷("), title_date(ts), F.lit(")"))


def question_label(number: Column, question_type: Column, difficulty: Column) -> Column:
    return F.concat(F.lit("第 "), number.cast("string"), F.lit(" 題. ["), question_type, F.lit("] (難度: "), stars(difficulty), F.lit(")"))


def filename(c: Column) -> Column:
    """Percent-encoded; a space becomes %20, and the five marks that need no encoding stay."""
    coded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        coded = F.replace(coded, F.lit(code), F.lit(mark))
    return coded


def snippet(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_line(c: Column, n: int) -> Column:
    return snippet(F.split(c, "\n")[0], n)


def char_count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def normalize_difficulty(c: Column) -> Column:
    n = js_parse_int(c)
    return F.when(n.between(1, 5), n.cast("int"))


def default_null(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def default_falsy(c: Column, value) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def check_count(c: Column, most: int = model.MAX_DRAW) -> Column:
    """Null if a requested number of questions is sound, else what is wrong with it."""
    n = js_parse_number(c)
    return F.when(c.isNull(), "required").when(n.isNull() | (n < 1), "not_positive").when(n > most, "too_many")


def local(ts: Column, tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(ts, tz)


def title_date(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy_M_d")


def day(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy-MM-dd")


def print_date(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy/M/d")


def age_ms(ts: Column, now: Column) -> Column:
    return F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))


def history(c: Column) -> Column:
    """The seen-on map of a question; broken or missing JSON is an empty one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def unseen(c: Column, student: Column) -> Column:
    """True where the map has no such key; a key with a null value counts as seen."""
    return ~F.map_contains_key(history(c), student)


def record(c: Column, student: Column, on: Column) -> Column:
    """The map with the student's entry set or overwritten, as JSON."""
    rest = F.map_filter(history(c), lambda k, _: k != student)
    return F.to_json(F.map_concat(rest, F.create_map(student, on)))


def ids_to_json(c: Column) -> Column:
    return F.to_json(c)


def ids_from_json(c: Column) -> Column:
    return F.from_json(c, "array<bigint>")


def type_weight(c: Column) -> Column:
    """The place of a question type on a paper; others come last."""
    weight = F.lit(None).cast("int")
    for name, w in model.TYPE_WEIGHTS.items():
        weight = F.when(c == name, w).otherwise(weight)
    return F.coalesce(weight, F.lit(model.OTHER_WEIGHT))


def nonblank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def not_in_or_null(c: Column, values) -> Column:
    return ~c.isin(*values) | c.isNull()


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def is_valid_subject(c: Column) -> Column:
    return F.coalesce(c.isin(*model.CHAPTERS), F.lit(False))


def is_valid_type(c: Column) -> Column:
    return F.coalesce(c.isin(*model.TYPE_WEIGHTS), F.lit(False))


def is_valid_chapter(subject: Column, chapter: Column) -> Column:
    """As an expression, for CASE chains; ``relational.in_whitelist`` is the join."""
    found = F.lit(False)
    for name, chapters in model.CHAPTERS.items():
        found = found | ((subject == name) & chapter.isin(*chapters))
    return F.coalesce(found, F.lit(False))
