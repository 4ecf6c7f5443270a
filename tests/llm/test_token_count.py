import pytest

from quillbank.llm import queries, token_count

TEXTS = [
    "", None, " ", "  a  b\n\n c ", "a<|endoftext|>b <|endoftext|>", "\x1c x\x1fy", "can't we'll 123 45%$", "日本語 テ  スト",
    "x" * 5000, "word " * 4000, " \x85 b", "😀😀 👍", "tie", "tie",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_counts_are_the_librarys(spark, library):
    rows = [(i, t, -1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_count.count_tokens(df, queries.tokenizer_path()).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_tokens == want, t
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (want > 512)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.count_tokens(df, queries.tokenizer_path()).count() == 0


def test_heap_agrees_with_rescan():
    whole, ranks, _ = token_count.prove_whole(queries.tokenizer_path())
    assert "Ġthe" in whole
    text = "internationalizationthethethe" * 2
    assert token_count._merge_count_heap(list(text), ranks) == token_count.merge_count(list(text), ranks)
