import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_near_dedup


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abdeinorst", k=rng.randint(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(6)]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        toxic = i % 4 == 0
        if toxic:
            words[5] = "zux" + "".join(rng.choices("aeiou", k=4))
            words[-5] = "zuxxer"
        if i % 10 == 3:
            words[10:10] = rng.choice(items)[1].split()
        text = " ".join(words)
        if i % 7 == 6:
            text = docs[-1][1] + (" more" if i % 2 else "")
            toxic = (i - 1) % 4 == 0
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", items, "item_id long, text string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, items, {i for i, _, y in labels if y}


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    path, items, toxic = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        had, has = {r.doc_id: r.text for r in before}, {r.doc_id: r.text for r in after}
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            wrong = len(set(has) & toxic) + len(set(had) - set(has) - toxic)
            assert wrong <= 0.05 * len(had)
        if name == "near_dedup":
            groups = test_near_dedup.brute(list(had.items()), 5)
            assert has.keys() == {d for d, (_, c) in groups.items() if d == c} and len(has) < len(had)
        if name == "decontaminate":
            hit = {d for d, _ in test_decontaminate.brute(had.items(), items)}
            assert hit and has.keys() == had.keys() - hit
        if name == "mixing":
            size = {r.doc_id: len((r.text or "").split()) for r in before}
            source, sizes, taken = {r.doc_id: r.source for r in before}, {}, {}
            for d, n in size.items():
                sizes[source[d]] = sizes.get(source[d], 0) + n
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
            want = test_mixing.brute_targets(sizes)
            assert all(abs(taken.get(s, 0) - want[s]) <= 0.35 * want[s] + 200 for s in sizes)
        if name == "sharding":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            loads = [sum(r["size"] for r in after if r.shard == s) for s in range(8)]
            assert max(loads) <= 1.3 * min(loads)


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns) and got.count() > 50


def test_run_on_empty_and_bare_tables(spark, tables, tmp_path):
    """No rows at all; and rows of nulls, empty texts, repeats and shared keys, without labels or benchmark."""
    schemas = {name: spark.read.parquet(f"{tables[0]}/{name}.parquet").schema for name in ("documents", "benchmark", "labels")}
    for case, rows in (("empty", []), ("bare", [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0)] * 3 + [(1, "a b c", None, None, 5), (1, "d e f", "x", None, 5), (2, "a b c", "en", "s", 5)])):
        path = str(tmp_path / case)
        for name, schema in schemas.items():
            spark.createDataFrame(rows if name == "documents" else [], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert (not got) if case == "empty" else {r.text for r in got} <= {"a b c", "d e f"}
        assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
