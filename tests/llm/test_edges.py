"""Nulls in any column, ties, repeats, long texts and columns that are called like outputs: every operator gives a whole result."""

import pytest

from quillbank.llm import chat_format, decontaminate, embedding_dedup, line_dedup, mixing, near_dedup, passage_dedup, queries, sharding, token_count, toxicity

CLASHING = (
    "n_tokens n_bytes over_limit score predicted shard slot size law vslot component_id kept n_shingles digest doc n sketch bucket block times taken target weight place h w0 line tokens leaf "
    "template anchor ctx lo hi spans n_removed item_id containment n_lines n_dropped kept_text print start source_size"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    long = "lorem ipsum dolor " * 3000
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, None, "s"), (3, "", None), (None, "x y z", "t"), (None, "x y z", "t"), (None, None, None), (4, long, "t"), (5, long, "t"), (6, " \n\n ", "s"), (7, "\0 \x1f é", "ü")]
    return spark.createDataFrame([(*r, *([7] * len(CLASHING))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHING))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f", 0), (None, "a b c d e", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, h int")


@pytest.mark.parametrize(
    ("run", "rows"),
    [
        (lambda d, i: token_count.count_tokens(d, queries.tokenizer_path()), 11),
        (lambda d, i: toxicity.score(d, toxicity.fit(["a b", "c d"] * 4, [0, 1] * 4)), 11),
        (lambda d, i: sharding.assign(d, 3), 11),
        (lambda d, i: near_dedup.near_duplicates(d), 11),
        (lambda d, i: near_dedup.near_duplicates(d, width=2), 11),
        (lambda d, i: passage_dedup.cut_repeats(d), 11),
        (lambda d, i: line_dedup.drop_recurring(d), 11),
        (lambda d, i: mixing.mix(d), 11),
        (lambda d, i: decontaminate.find_contained(d, i), 2),
        (lambda d, i: decontaminate.drop_contaminated(d, i), 9),
    ],
)
def test_documents(docs, items, run, rows):
    assert len(run(docs, items).collect()) == rows
    assert len(run(docs.limit(0), items.limit(0)).collect()) == 0


def test_stages_keep_columns(docs):
    assert near_dedup.keep_one(docs).columns == docs.columns
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns and repeated.count() > 0


def test_conversations(spark):
    rows = [(None, None, None, None, 1), (1, None, "user", None, 1), (1, 2, None, "x", 1), (1, 2, None, "x", 1), (2, 0, "assistant", "</s>", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r.n_turns for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    assert got == {None: 1, 1: 3, 2: 1}


def test_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [1e300, 1e300], 1), (5, [1e-300, 1e-300], 1), (6, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = sorted(((r.vec_id, r.n_links) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2), (1, 2), (1, 2), (2, 0), (3, 0), (4, 1), (5, 1), (6, 0)], key=str)
