import random

import pytest

from quillbank.llm import decontaminate


def brute(docs, items, threshold=80):
    import re

    def grams(t):
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    found = {}
    for d, t in docs:
        for i, u in items:
            q = grams(u)
            if q and 100 * len(q & grams(t)) >= threshold * len(q):
                found[d, i] = len(q & grams(t))
    return found


@pytest.mark.parametrize("limits", [{}, {"SKETCH_ROWS": 0, "FILTER_BITS": 1 << 16, "COMMON": 1}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for i in range(30)] + [(30, None), (31, ""), (32, "w1 w2 w3 w4 w5"), (33, "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 3:
            held = items[rng.randrange(30)][1].split()
            if d % 3 == 2 and len(held) > 8:
                held[rng.randrange(len(held))] = "Other"
            text[len(text) // 2 : len(text) // 2] = held
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(text).upper()))
    docs += [(80, None), (81, ""), (82, "w1 W2 w3 w4 w5"), (83, " ".join(vocabulary) * 3000)]
    a = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.find_contained(a, b).collect()}
    want = brute(docs, items)
    assert len(want) > 30 and got == want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(a, b).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(a, b).count() == 0
    assert decontaminate.drop_contaminated(a, b).count() == 1
    assert decontaminate.drop_contaminated(a.limit(0), b).count() == 0


def test_only_texts_with_a_hit_go(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "quite another text here now"), (1, "x a b c d e f"), (1, "clean text under the same key"), (1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    left = {r.text for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert left == {"quite another text here now", "clean text under the same key", None}


def test_items_that_share_a_template(spark, monkeypatch):
    """Documents that hold only what many items share are no candidates; those that hold an item are found."""
    monkeypatch.setattr(decontaminate, "COMMON", 8)
    template = "answer the following question with one of the letters given below and nothing else"
    items = [(i, f"{template} " + " ".join(f"item{i}word{j}" for j in range(30))) for i in range(40)]
    docs = [(i, f"some words before {template} and words after it {i}") for i in range(30)] + [(100 + i, f"before it {t} after it") for i, t in items[:5]]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contained(a, b).collect()}
    assert got == set(brute(docs, items)) == {(100 + i, i) for i in range(5)}
    parts = decontaminate.item_shingles(b, "item_id", "text", 5)
    index = decontaminate.settle(decontaminate.sketches(parts, 0.8), "test")
    hashes = decontaminate._hashes(a.filter("doc_id < 100"), decontaminate.F.col("text"), decontaminate.F.col("doc_id"), width=5)
    assert decontaminate._probed(hashes, index).count() == 0
