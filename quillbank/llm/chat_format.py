"""Chat formatting by columnar byte assembly.

Each turn becomes ``header + escaped text + footer``. A block of turns is assembled at
once: the lengths of all segments, their cumulative offsets and the scatter indices are
numpy arrays, and headers, contents and footers are copied into one preallocated Arrow
buffer, out of which the formatted conversations are slices.

Escaping is reversible: a backslash is doubled, and in a control string of the template
a backslash is put after its first character; ``unescape`` takes both back, so no text
can pass for a mark of the template, and what is read back is what went in.

The loss mask is the spans of assistant contents in the formatted text, in code points.

Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows
have one order. Null texts and roles are empty ones. Rows without a conversation key
form one conversation, the null one. A conversation is formatted in parts of bounded
size that follow each other in one partition: the parts of one conversation, however
long, never have to be in memory together. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# The marks of the template.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER = ("[ROLE ", "]", " [/ROLE]")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]")

_TO_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    """Header and footer of a role. A role of another name stands in its header, its own brackets escaped."""
    if role in MARKS:
        return MARKS[role]
    return OTHER[0] + escape(role).replace("]", "\\]") + OTHER[1], OTHER[2]


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    found, at = [], 0
    while at < len(formatted):
        for role in ("user", "system"):
            head, foot = MARKS[role]
            if formatted.startswith(head, at):
                break
        else:
            if formatted.startswith(OTHER[0], at):
                end = re.compile(r"(?:[^\\\]]|\\.)*", re.S).match(formatted, at + len(OTHER[0])).end()
                role, foot = unescape(formatted[at + len(OTHER[0]) : end]), OTHER[2]
                head = formatted[at : end + 1]
            else:
                role, (head, foot) = "assistant", MARKS["assistant"]
        at += len(head)
        end = formatted.index(foot.strip(), at) - (len(foot) - len(foot.lstrip()))
        found.append((role, unescape(formatted[at:end])))
        at = end + len(foot)
    return found


def assemble(roles: list[str], texts, ends):
    """Formatted blocks and loss spans.

    roles: one per turn; texts: an Arrow string array of as many; ends: the number of
    turns up to the end of each block. Returns (an Arrow array with a string per block,
    per turn its content's start in its block in code points, its length in code points).
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, "|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
    if pc.any(odd).as_py():
        plain = texts.to_pylist()
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            plain[i] = escape(plain[i])
        texts = pa.array(plain, pa.string())
    n = len(texts)
    # Headers and footers: one small table of distinct marks, and for each turn its places there.
    names, code = np.unique(np.array(roles, dtype=object), return_inverse=True)
    heads, feet = zip(*((h.encode(), f.encode()) for h, f in map(marks, names)), strict=True)
    table = np.frombuffer(b"".join(heads + feet), np.uint8)
    size = np.array([len(x) for x in heads + feet], np.int64)
    place = np.concatenate([[0], np.cumsum(size)[:-1]])
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    lengths = np.empty((n, 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = size[code], np.diff(bounds), size[code + len(heads)]
    stop = np.cumsum(lengths.ravel())
    start = (stop - lengths.ravel()).reshape(n, 3)
    total = int(stop[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)

    def scatter(source, at, length, to):
        inside = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + inside] = source[np.repeat(at, length) + inside]

    scatter(table, place[code], lengths[:, 0], start[:, 0])
    scatter(content, bounds[:-1], lengths[:, 1], start[:, 1])
    scatter(table, place[code + len(heads)], lengths[:, 2], start[:, 2])
    last = np.asarray(ends, np.int64)
    edges = np.concatenate([[0], start[:, 2][last - 1] + lengths[:, 2][last - 1]]) if len(last) else np.zeros(1, np.int64)
    blocks = pa.LargeStringArray.from_buffers(len(last), pa.py_buffer(edges.astype(np.int64).tobytes()), buffer)
    # Code points are the bytes that don't continue one.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)]).astype(np.int64)
    block_of = np.repeat(np.arange(len(last)), np.diff(np.concatenate([[0], last])))
    begin = points[start[:, 1]] - points[edges[block_of]]
    return blocks, begin, points[start[:, 1] + lengths[:, 1]] - points[start[:, 1]]


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_start, loss_length, n_turns): parts of conversations, in order within their partition."""
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.coalesce("role", F.lit("")).alias("role"), "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole, 2):
                conv_ids, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                n = len(conv_ids)
                ends = [i + 1 for i in range(n) if i + 1 == n or conv_ids[i] != conv_ids[i + 1]]
                blocks, begin, length = assemble(roles, batch.column(2), ends)
                starts = [0, *ends[:-1]]
                own = np.array([r == "assistant" for r in roles])
                spans = [np.flatnonzero(own[a:b]) + a for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([conv_ids[a] for a in starts], pa.int64()), blocks.cast(pa.string()),
                        pa.array([begin[s].tolist() for s in spans], pa.list_(pa.int64())), pa.array([length[s].tolist() for s in spans], pa.list_(pa.int64())),
                        pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["conv_id", "formatted", "loss_start", "loss_length", "n_turns"],
                )

    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_length array<long>, n_turns long")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from what is read back out of the formatted parts alone.

    Parts of a conversation follow each other, so a running hash is all that is kept.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        class Digest:
            def __init__(self, conv_id):
                self.conv_id, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def row(self):
                return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held = None
        for batch in batches:
            done = []
            for conv_id, text, begin, length in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        done.append(held.row())
                    held = Digest(conv_id)
                for role, content in read_back(text):
                    held.n += 1
                    held.turns.update(f"{role}\n{content}\n".encode())
                for b, k in zip(begin, length, strict=True):
                    piece = unescape(text[b : b + k])
                    held.loss_chars += len(piece)
                    held.loss.update(piece.encode())
                held.chars += len(text)
            if done:
                yield out(done)
        if held is not None:
            yield out([held.row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Of ``digests`` over all conversations and the probe of the query; an escape adds one character wherever it strikes.
ORACLE = r"""
WITH held AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, role AS raw_role, text AS raw_text, coalesce(role, '') AS role, coalesce(text, '') AS text,
    '\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE|\[/ROLE\]' AS control
  FROM held
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, control)) + CASE role
    WHEN 'user' THEN length('[INST] ') + length(' [/INST]')
    WHEN 'assistant' THEN length(' ') + length(' </s>')
    WHEN 'system' THEN length('<<SYS>>') + 1 + length('<</SYS>>') + 3
    ELSE length('[ROLE ') + length(role) + len(regexp_extract_all(role, control)) + len(regexp_extract_all(role, '\]')) + length(']') + length(' [/ROLE]') END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
