import itertools

import duckdb

from quillbank.llm import line_dedup

VARIABLE = "User 17 logged in from host {} today at noon"


def test_templates_recur(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows = [(i, VARIABLE.format(w) + f"\nthis line number is only of document {w} {w}{w}\n\nshort one") for i, w in enumerate(words)]
    rows += [(7, None), (8, ""), (9, "The quick brown fox came alone here"), (10, "x " * 20000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.drop_recurring(df).collect()}
    assert len(got) == 11
    for i, w in enumerate(words):
        assert got[i].n_lines == 4 and not got[i].kept_text.startswith("User")
    assert got[9].kept_text == rows[9][1] and got[9].n_dropped == 0
    assert got[7].kept_text is None and got[7].n_lines == 0
    assert got[8].kept_text == "" and got[8].n_lines == 1
    assert got[10].n_dropped == 0


def test_leaf_alone_is_no_template(spark):
    import random

    rng = random.Random(1)
    rows = [(i, "the same start " + " ".join(f"{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuvwx')}{rng.choice('ijklmnop')}" for _ in range(9))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.drop_recurring(df).collect()) == 0


def test_empty(spark):
    assert line_dedup.drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_recur(spark):
    rows = [(i, f"All rights reserved.\nLes.\n\nshort one {'abcdef'[i]}{'uvwxyz'[i]}\n{'abcdef'[i]}{'ghijkl'[i]}\nPage {i}") for i in range(6)]
    rows += [(6, "\n\n"), (7, "only here"), (8, "Les.\nbare")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        # The third field of a three-token line is part of its leaf, so "short one ..." is of one document only.
        assert got[i].n_lines == 6 and got[i].n_dropped == 2 and got[i].kept_text == rows[i][1].split("\n", 2)[2]
    assert got[6].kept_text == "\n\n" and got[7].kept_text == "only here" and got[8].kept_text == "bare"


def rows_of(df, **options):
    return {r.doc_id: (r.n_lines, r.n_dropped, len((r.kept_text or "").encode())) for r in line_dedup.drop_recurring(df, **options).collect()}


def test_against_sql(spark):
    """All lines but blank ones, and with ``min_tokens`` the same SQL over longer lines only."""
    con = duckdb.connect()
    path = "/root/testdata/sf0.001/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    docs = spark.read.parquet(path)
    whole, cut = "WHERE t <> ['']", "WHERE len(t) >= 5"
    assert line_dedup.ORACLE.count(whole) == 1
    for sql, options in ((line_dedup.ORACLE, {}), (line_dedup.ORACLE.replace(whole, cut), {"min_tokens": 5})):
        assert rows_of(docs, **options) == {r[0]: r[1:4] for r in con.execute(sql).fetchall()}


def test_lines_full_of_digits(spark):
    """A line that recurs word for word goes even if most of its tokens hold a digit; one that only shares their shape stays."""
    rows = [(i, f"+49 30 1234 5678 2026-01-01 v1.2\nno {i}{i} x{i} 7{i} 8{i} 9{i}\nown words {'abcdefg'[i]}") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == 1 and got[i].kept_text == rows[i][1].split("\n", 1)[1] for i in range(6))
    # Four documents are too few.
    assert all(n == 0 for _, n, _ in rows_of(spark.createDataFrame(rows[:4], "doc_id long, text string")).values())


def test_rows_without_a_key_are_one_document(spark):
    rows = [(None, f"shared line of some words\nown {c}") for c in "abcdefg"] + [(1, "shared line of some words")]
    got = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 8 and all(r.n_dropped == 0 for r in got)
    more = rows + [(i, "shared line of some words") for i in range(2, 5)]
    got = line_dedup.drop_recurring(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert len(got) == 11 and all(r.n_dropped == 1 for r in got)


def test_many_recurring_lines_in_one_text(spark):
    """100,000 lines that all go: the work grows with the text, not with its square."""
    import time

    text = "\n".join(f"{w} recurs in every text {w}{v}" for w in "abcdefghij" for v in ["".join(p) for p in itertools.product("klmnopqrst", repeat=4)])
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(9, text + "\nkept alone")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.drop_recurring(df).collect()}
    assert time.perf_counter() - began < 120
    assert got[0].n_lines == 100_000 == got[0].n_dropped and got[9].kept_text == "kept alone"
