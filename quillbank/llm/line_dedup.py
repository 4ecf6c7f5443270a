"""Line dedup by a log-template tree.

Lines are parsed into a tree of fixed depth: first by their number of tokens, then by
their first ``DEPTH`` tokens, a token with a digit counting as the wildcard. In a leaf
the later tokens are generalised: a token stays in the template where it stands at its
place in at least ``min_docs`` line-document pairs of the leaf, else the field is
variable and becomes the wildcard. A template recurs if lines of at least ``min_docs``
distinct documents have it and at least ``similarity`` of its fields are fixed; every
line of a recurring template is dropped, in all documents. So is every line that stands
token by token in ``min_docs`` distinct documents, however many of its tokens hold a
digit: a template all of whose fields are fixed. Lines of fewer documents stay. All counts
are over the whole table and do not depend on an order, so reruns and partitionings agree.

Lines end at a line feed; tokens are runs of anything but the six white-space
characters. Lines of any length count, short ones too; blank lines, which have no token,
are kept. ``min_tokens`` leaves shorter lines alone where a caller wants that. Leaves,
shapes and templates are told apart by 128-bit hashes. The work on a text grows with its
length alone, however many of its lines go.

Null texts have no lines, empty texts one blank line. Rows that share a key are one
document for the counts and keep their lines apart; so are all rows without a key. Extra
columns are kept by ``drop_recurring``, except those called like an output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, settle, small_join

DEPTH = 3
MIN_TOKENS = 1
MIN_DOCS = 5
SIMILARITY = 0.6
WILD = "<*>"
_NO_KEY = -(1 << 63)


def masked(tokens: list[bytes]) -> list[bytes]:
    wild = WILD.encode()
    return [t if t.translate(None, b"0123456789") == t else wild for t in tokens]


def parse(text: str, min_tokens: int = MIN_TOKENS):
    """(line number, tokens, fields) of each line that has a token. bytes.split() cuts at just the six white-space characters."""
    for i, line in enumerate(text.encode().split(b"\n")):
        tokens = line.split()
        if tokens and len(tokens) >= min_tokens:
            yield i, tokens, masked(tokens)


def leaf_of(fields: list[bytes]) -> bytes:
    import xxhash

    # Tokens hold no space, so a space keeps them apart.
    return xxhash.xxh3_128_digest(b"%d " % len(fields) + b" ".join(fields[:DEPTH]))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))


def _leaves(keyed: DataFrame, min_tokens: int) -> DataFrame:
    """(doc, leaf), once per text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole, 1):
                docs, leaves = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {leaf_of(fields) for _, _, fields in parse(text, min_tokens)} if text else ()
                    docs += [doc] * len(found)
                    leaves += found
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(leaves, pa.binary())], names=["doc", "leaf"])

    return keyed.select("doc", "text").mapInArrow(run, "doc long, leaf binary")


def _shapes(keyed: DataFrame, min_tokens: int) -> DataFrame:
    """Every line: (doc, print, line_no, leaf, shape, verbatim, fields)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        names = ["doc", "print", "line_no", "leaf", "shape", "verbatim", "fields"]
        for whole in batches:
            for batch in chunks(whole, 2, 1 << 20):
                rows = []
                for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    for i, tokens, fields in parse(text, min_tokens) if text else ():
                        joined = b" ".join(fields)
                        rows.append((doc, mark, i, leaf_of(fields), digest(joined), digest(b" ".join(tokens)), joined))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(t) if t == pa.string() else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return keyed.mapInArrow(run, "doc long, print long, line_no int, leaf binary, shape binary, verbatim binary, fields string")


def _often(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """The values of ``key`` that stand in enough distinct documents. Pairs are made distinct first, so a hot value is counted in many tasks."""
    return rows.select(key, "doc").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)


def recurring_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, print, line_no) of every line whose template recurs; doc is the key, -2**63 for none."""
    keyed = _keyed(df, key, text)
    # First the leaves that enough documents reach: of a line, its leaf and its document are shuffled.
    leaves = settle(_often(_leaves(keyed, min_tokens), "leaf", min_docs).select("leaf"), "leaves")
    placed = settle(small_join(_shapes(keyed, min_tokens), leaves, "leaf"), "placed")
    # Lines that differ in nothing but masked fields are one shape from here on.
    docs = placed.select("leaf", "shape", "doc").distinct().groupBy("leaf", "shape").agg(F.count(F.lit(1)).alias("docs"))
    first = placed.groupBy("shape").agg(F.first("fields").alias("fields"))
    shapes = settle(docs.join(first, "shape"), "shapes")
    fields = shapes.select("leaf", "shape", "docs", F.posexplode(F.split("fields", " ")).alias("place", "token"))
    support = fields.filter(F.col("place") >= DEPTH).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= min_docs)
    support = settle(support, "support")
    fixed = (F.col("place") < DEPTH) | F.col("support").isNotNull()
    told = small_join(fields, support, ["leaf", "place", "token"], "left").withColumn("token", F.when(fixed, F.col("token")).otherwise(F.lit(WILD)))
    templates = (
        told.groupBy("leaf", "shape")
        .agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("fields"))
        .select(
            "shape",
            F.unhex(F.md5(F.concat(F.col("leaf"), F.array_join("fields.token", " ").cast("binary")))).alias("template"),
            F.size(F.filter("fields.token", lambda t: t != WILD)).alias("fixed"),
            F.size("fields").alias("n"),
        )
        .filter(F.col("fixed") >= similarity * F.col("n"))
    )
    templates = settle(templates.select("shape", "template"), "templates")
    matched = small_join(placed.select("doc", "print", "line_no", "shape"), templates, "shape")
    recurring = settle(_often(matched, "template", min_docs).select("template"), "recurring")
    verbatim = settle(_often(placed, "verbatim", min_docs).select("verbatim"), "verbatim")
    by_template = small_join(matched, recurring, "template", "left_semi").select("doc", "print", "line_no")
    found = settle(by_template.union(small_join(placed, verbatim, "verbatim", "left_semi").select("doc", "print", "line_no")), "gone")
    discard(leaves, placed, shapes, support, templates, recurring, verbatim)
    return found


def drop_recurring(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with kept_text, n_lines and n_dropped (lines of recurring templates left out)."""
    kept = [c for c in df.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    gone = recurring_lines(df, key, text, **options).groupBy("doc", "print").agg(F.collect_set("line_no").alias("_gone"))
    named = gone.select(F.col("doc").alias("_doc"), F.col("print").alias("_print"), "_gone")
    marked = df.select(*kept, F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("_doc"), F.xxhash64(text).alias("_print"))
    joined = marked.join(named, ["_doc", "_print"], "left").select(*kept, "_gone")
    at, gone_at = kept.index(text), len(kept)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for batch in chunks(whole, at):
                texts, lost = batch.column(at), batch.column(gone_at)
                changed = pc.is_valid(lost)
                left = []
                for raw, numbers in zip(texts.filter(changed).to_pylist(), lost.filter(changed).to_pylist(), strict=True):
                    held = set(numbers)
                    left.append("\n".join([line for i, line in enumerate(raw.split("\n")) if i not in held]))
                n_lines = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32())
                n_dropped = pc.fill_null(pc.list_value_length(lost), 0).cast(pa.int32())
                whole_text = pc.replace_with_mask(texts, changed, pa.array(left, texts.type))
                yield pa.RecordBatch.from_arrays([*batch.columns[:gone_at], whole_text, n_lines, n_dropped], names=[*kept, "kept_text", "n_lines", "n_dropped"])

    extra = T.StructType.fromDDL("kept_text string, n_lines int, n_dropped int")
    return joined.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *extra.fields]))


ORACLE = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, i, regexp_split_to_array(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS t
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
), m AS (SELECT doc_id, i, t, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS f FROM l WHERE t <> ['']),
leaves AS (SELECT len(f) AS n, f[1:3] AS h FROM m GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
placed AS (SELECT m.* FROM m JOIN leaves ON len(f) = n AND f[1:3] = h),
shapes AS (SELECT f, count(DISTINCT doc_id) AS docs FROM placed GROUP BY f),
fields AS (SELECT f, docs, unnest(range(1, len(f) + 1)) AS place FROM shapes),
support AS (SELECT len(f) AS n, f[1:3] AS h, place AS spot, f[place] AS token, sum(docs) AS support FROM fields GROUP BY ALL),
told AS (
  SELECT f, place, CASE WHEN place <= 3 OR support >= 5 THEN f[place] ELSE '<*>' END AS token
  FROM fields JOIN support ON n = len(f) AND h = f[1:3] AND spot = place AND support.token = f[place]
), templates AS (SELECT f, list(token ORDER BY place) AS template FROM told GROUP BY f),
matched AS (SELECT doc_id, i, template FROM placed JOIN templates USING (f) WHERE 10 * len(list_filter(template, lambda x: x <> '<*>')) >= 6 * len(template)),
recurring AS (SELECT template FROM matched GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
verbatim AS (SELECT t FROM m GROUP BY t HAVING count(DISTINCT doc_id) >= 5),
lost AS (SELECT doc_id, i FROM matched JOIN recurring USING (template) UNION SELECT doc_id, i FROM m JOIN verbatim USING (t)),
gone AS (SELECT doc_id, list(i) AS g FROM lost GROUP BY doc_id),
kept AS (
  SELECT doc_id, parts, g, array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: parts[i]), chr(10)) AS kept
  FROM cut LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(len(g), 0) AS n_dropped, strlen(coalesce(kept, '')) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""
