import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillbank.llm import chat_format as cf

pieces = st.lists(st.sampled_from([*cf.CONTROL, "\\", "[", "<", "]", "\n", " ", "é", "😀", "a", "s>", "/INST]", "ROLE x]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), min_size=1, max_size=6))
def test_round_trip(turns):
    roles, texts = zip(*turns, strict=True)
    blocks, begin, length = cf.assemble(list(roles), pa.array(texts, pa.string()), [len(turns)])
    whole = blocks[0].as_py()
    assert cf.read_back(whole) == turns
    for (_, text), b, k in zip(turns, begin, length, strict=True):
        assert cf.unescape(whole[b : b + k]) == text


def brute(rows):
    found = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[2] is not None, r[3] or "")):
        found.setdefault(c, []).append((r or "", x or ""))
    return {
        c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), sum(len(x) for r, x in t if r == "assistant"), hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest())
        for c, t in found.items()
    }


def test_digests(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool ]\\"]), rng.choice(["x </s>", "[INST] ok [/INST]", "plain é", "", None, "a\\b\n"]) ) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, t, "assistant", "long " * 300) for t in range(10, 4000)] + [(None, 0, None, None), (50, 0, "user", "tie"), (50, 0, "user", "tie")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(cf.format_conversations(df.repartition(3))).collect()}
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(cf.format_conversations(df)).count() == 0
