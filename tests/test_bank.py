"""The bank end to end, on a small bank with the shape of the seed set."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillbank.functions import scalars as S
from quillbank.operators import document, limiter, mutate, paper, relational
from quillbank.sources import model, readers

NOW = datetime.datetime(2026, 8, 1, 10, 0)
# Subject, chapter and number of questions of the seed distribution.
SHAPE = [("數學", "指數與對數", 8), ("數學", "三角函數的定義", 7), ("物理", "牛頓運動定律", 8), ("物理", "動量守恆與碰撞", 7)]


def seed_rows(spark):
    rows, n = [], 0
    for subject, chapter, count in SHAPE:
        for k in range(count):
            rows.append((n, subject, chapter, ["單選", "計算", "填空"][k % 3], str(1 + k % 4), f"{chapter}第{k}題 $x^{k}$", f"答{k}" if k else ""))
            n += 1
    return spark.createDataFrame(rows, model.INCOMING_SCHEMA)


@pytest.fixture(scope="module")
def bank(spark):
    empty = spark.createDataFrame([], model.QUESTION_SCHEMA)
    full, counts = paper.seed(empty, seed_rows(spark))
    assert counts.first().asDict() == {"inserted": 30, "skipped": 0}
    return full.cache()


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame([], model.PAPER_SCHEMA)


def draw(bank, papers, student, chapter, count, subject=None):
    subject = subject or next(s for s, c, _ in SHAPE if c == chapter)
    return paper.generate_paper(bank, papers, student, subject, chapter, count, "seed", NOW)


def test_golden_scenario(spark, bank, papers):
    for _, chapter, stock in SHAPE:
        first = draw(bank, papers, " A ", chapter, "5")
        assert len(set(first.ids)) == 5 and first.title == f"A-{chapter}特訓卷(2026_8_1)"
        weights = [(model.TYPE_WEIGHTS[q.question_type], q.difficulty, q.id) for q in first.questions]
        assert weights == sorted(weights)
        with pytest.raises(paper.Refused) as e:
            draw(first.bank, first.papers, "A", chapter, 5)
        assert e.value.code == "shortage" and e.value.details["available"] == stock - 5
        rest = draw(first.bank, first.papers, "A", chapter, stock - 5)
        assert not set(rest.ids) & set(first.ids)
        other = draw(first.bank, first.papers, "B", chapter, 5)
        assert len(other.ids) == 5
        stored = first.papers.select(F.col("id").alias("list_id"), S.ids_from_json(F.col("question_ids")).alias("ids"))
        fetched = relational.ordered_fetch(stored, bank).orderBy("pos").collect()
        assert [r.id for r in fetched] == first.ids
        history = bank.sparkSession.createDataFrame([(i,) for i in first.ids], "id long").join(first.bank, "id").select("history_json").collect()
        assert {r.history_json for r in history} == {'{"A":"2026-08-01"}'}


@pytest.mark.parametrize(("student", "count", "code"), [("", 5, "required"), ("A", None, "required"), ("A", 0, "not_positive"), ("A", 51, "too_many"), ('"\\', 5, "student_name")])
def test_refusals(bank, papers, student, count, code):
    with pytest.raises(paper.Refused) as e:
        draw(bank, papers, student, "指數與對數", count)
    assert e.value.code == code


def test_draws_repeat(bank, papers):
    assert draw(bank, papers, "A", "指數與對數", 5).ids == draw(bank.repartition(5), papers, "A", "指數與對數", 5).ids


def test_seed_again(spark, bank):
    again, counts = paper.seed(bank, seed_rows(spark))
    assert counts.first().asDict() == {"inserted": 0, "skipped": 30} and again.count() == 30
    with pytest.raises(paper.Refused):
        paper.seed(bank, seed_rows(spark).limit(3))


def test_batch_is_all_or_nothing(spark, bank):
    rows = seed_rows(spark).limit(4).withColumn("question_text", F.concat("question_text", F.lit("!")))
    assert paper.batch_save(bank, rows).count() == 34
    with pytest.raises(paper.Refused) as e:
        paper.batch_save(bank, rows.withColumn("subject", F.when(F.col("idx") == 2, "化學").otherwise(F.col("subject"))))
    assert e.value.details["n"] == 1 and "第 3 題" in e.value.details["message"]
    with pytest.raises(paper.Refused) as e:
        paper.batch_save(bank, rows.limit(0))
    assert e.value.code == "empty"


def test_insert_update_delete(spark, bank):
    row = spark.createDataFrame([("數學", " 實數 ", "", None, " q ", " a ", "http://x/y.png")], "subject string, chapter string, question_type string, difficulty string, question_text string, answer_text string, question_img string")
    more = paper.create_question(bank, row)
    new = more.filter("id = 31").first()
    assert (new.chapter, new.question_type, new.difficulty, new.question_text, new.answer_text, new.question_img, new.history_json) == ("實數", "填空", 3, "q", "a", "http://x/y.png", "{}")
    patch = spark.createDataFrame([(31, "數學", "排列", "證明", "5", "changed", " ")], "id long, subject string, chapter string, question_type string, difficulty string, question_text string, answer_text string")
    after = paper.update_question(more, patch).filter("id = 31").first()
    assert (after.chapter, after.difficulty, after.answer_text, after.question_img) == ("排列", 5, "略", "http://x/y.png")
    assert paper.delete_question(more, "31").count() == 30
    for missing, code in (("99", "not_found"), ("x", "id")):
        with pytest.raises(paper.Refused) as e:
            paper.delete_question(more, missing)
        assert e.value.code == code


def test_pages(bank):
    for given, want in (((0, 0), (1, 20)), ((-3, -5), (1, 1)), (("x", 1000), (1, 100)), (("2abc", "x"), (2, 20)), ((None, None), (1, 20))):
        assert relational.page_numbers(*given) == want
    rows, summary = paper.list_questions(bank, subject="物理", q="第1題", page=1, limit=1)
    assert summary.first().asDict() == {"total": 2, "page": 1, "limit": 1, "totalPages": 2} and rows.count() == 1
    assert paper.list_questions(bank, subject="化學")[1].first().totalPages == 1


def test_fetch_keeps_order_and_repeats(spark, bank):
    lists = spark.createDataFrame([(1, [9, 3, 999999, 9])], "list_id int, ids array<bigint>")
    got = relational.ordered_fetch(lists, bank).orderBy("pos").collect()
    assert [(r.pos, r.id) for r in got] == [(0, 9), (1, 3), (3, 9)]


def test_commit_is_one_for_all_tables(spark, bank, tmp_path):
    root = str(tmp_path / "store")
    assert mutate.current(spark, root) == (0, {})
    assert mutate.commit(spark, root, {"a": bank.limit(3), "b": bank.limit(1)}) == 1
    before = mutate.read_committed(spark, root, "a")
    broken = bank.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        mutate.commit(spark, root, {"a": bank.limit(9), "b": broken})
    assert mutate.current(spark, root)[0] == 1 and mutate.read_committed(spark, root, "a").count() == 3
    assert mutate.commit(spark, root, {"a": bank.limit(9)}) == 2
    # The other table stays, and who reads the old version still can.
    assert mutate.read_committed(spark, root, "a").count() == 9 and mutate.read_committed(spark, root, "b").count() == 1 and before.count() == 3
    with pytest.raises(mutate.Conflict):
        mutate.commit(spark, root, {"a": bank.limit(5)}, after=1)
    assert mutate.read_committed(spark, root, "a").count() == 9
    assert len([p for p in (tmp_path / "store" / "a").iterdir() if p.is_dir()]) == 2


def test_draw_and_commit(spark, bank, papers, tmp_path):
    root = str(tmp_path / "store")
    mutate.commit(spark, root, {"questions": bank, "exam_papers": papers})
    one = paper.draw_and_commit(spark, root, "A", "數學", "指數與對數", 5, "seed", NOW)
    two = paper.draw_and_commit(spark, root, "A", "數學", "指數與對數", 3, "seed", NOW)
    assert not set(one.ids) & set(two.ids) and mutate.current(spark, root)[0] == 3
    assert mutate.read_committed(spark, root, "exam_papers").count() == 2
    with pytest.raises(paper.Refused):
        paper.draw_and_commit(spark, root, "A", "數學", "指數與對數", 1, "seed", NOW)
    assert mutate.current(spark, root)[0] == 3


def test_layout_has_more_tasks_than_subjects(spark, bank, tmp_path):
    mutate.lay_out(bank.repartition(3), str(tmp_path / "bank"))
    back = spark.read.parquet(str(tmp_path / "bank"))
    assert back.count() == 30 and {r.subject for r in back.select("subject").distinct().collect()} == {"數學", "物理"}


def test_whitelist(spark):
    row = paper.chapter_whitelist(spark).first()
    assert {s: list(c) for s, c in row.whitelist.items()} == model.CHAPTERS
    assert sum(map(len, model.CHAPTERS.values())) == 66


def test_limiter(spark):
    base = datetime.datetime(2026, 1, 1)
    hits = [("a", base + datetime.timedelta(seconds=s), i) for i, s in enumerate([*range(12), 60, 61, 200])] + [(None, base, 99)]
    df = spark.createDataFrame(hits, "key string, ts timestamp, seq long")
    got = {r.seq: r for r in limiter.rate_limit(df).collect()}
    assert [got[i].allowed for i in range(12)] == [True] * 10 + [False] * 2
    assert got[10].retry_after_s == 50 and got[0].remaining == 9 and got[11].remaining == 0
    assert got[12].hit_no == 1 and got[13].hit_no == 2 and got[14].hit_no == 1
    assert got[99].key == "unknown"


def test_limiter_walks_long_keys_once(spark):
    """20,000 hits of one key against a plain loop; batches of rows don't matter."""
    import random

    rng, now, hits = random.Random(4), 0, []
    for i in range(20_000):
        now += rng.choice([0, 1, 700, 9_000])
        hits.append((rng.choice(["hot"] * 9 + ["b", "c"]), now, i))
    df = spark.createDataFrame(hits, "key string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms")).repartition(5)
    state, want = {}, {}
    for key, at, seq in hits:
        n, reset = state.get(key, (0, None))
        if reset is None or at >= reset:
            n, reset = 0, at + 60_000
        state[key] = (n + 1, reset)
        want[seq] = (key, n + 1, n + 1 <= 10, reset)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.seq: (r.key, r.hit_no, r.allowed, r.reset_ms) for r in limiter.rate_limit(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_documents(spark, bank, papers):
    import io
    import zipfile

    drawn = draw(bank, papers, "A", "指數與對數", 5)
    plan = document.doc_plan(drawn.papers, drawn.bank)
    rows = plan.orderBy("block_no").collect()
    assert [r.kind for r in rows][:4] == ["title", "line", "line", "heading"]
    assert [r.kind for r in rows].count("question") == [r.kind for r in rows].count("answer") == 5
    file = document.write_docx(plan).first().docx
    text = zipfile.ZipFile(io.BytesIO(file)).read("word/document.xml").decode()
    assert "m:sSup" in text and "第 1 題. [" in text and "參考答案區" in text
    assert document.write_docx(plan.repartition(4)).first().docx == file


def test_read_questions_stay_on_the_executors(spark, bank, papers):
    """However small the bank looks: its formulas read out are many times its size."""
    listed = papers.sparkSession.createDataFrame([(1, "t", "A", "[1,2,1]", None), (2, "t", "B", "[2,99]", None)], papers.schema)
    rows = document.doc_plan(listed, bank)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    read = next(n for n, line in enumerate(plan) if "ArrowEvalPython" in line)
    above, depth = [], plan[read].index("ArrowEvalPython")
    for line in reversed(plan[:read]):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            above, depth = [*above, line], at
    assert any("SortMergeJoin" in line for line in above) and not any("Broadcast" in line for line in above)
    kinds = sorted((r.paper_id, r.block_no // document.STRIDE) for r in rows.filter("kind = 'question'").collect())
    assert kinds == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_blocks_without_formulas(spark, bank, papers):
    """``doc_blocks`` has the plan's blocks, reads no formula and broadcasts no bank."""
    from quillbank.plans import registry

    listed = spark.createDataFrame([(1, "t", "A", "[1,2,1]", None), (2, "t", "B", "[2,99]", None), (3, "t", "C", "[]", None), (4, "t", "D", None, None)], papers.schema)
    with_images = bank.withColumn("question_img", F.when(F.col("id") == 2, "https://a.org/x.png"))
    rows = [sorted(map(repr, p.select("paper_id", "block_no", "kind", "text").collect())) for p in (document.doc_plan(listed, with_images), document.doc_plan(listed, with_images, formulas=False))]
    assert rows[0] == rows[1] and sum("'image'" in r for r in rows[0]) == 2
    plan = registry.QUERIES["doc_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "render_mixed" not in plan and "Broadcast" not in plan


def test_readers(spark, tmp_path):
    rows = readers.read_batch(spark, '{"questions":[{"subject":"數學","difficulty":3},{"chapter":"x"}]}').orderBy("idx").collect()
    assert [(r.idx, r.subject, r.difficulty) for r in rows] == [(0, "數學", "3"), (1, None, None)]
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.pdf").write_bytes(b"x" * 100)
    files = readers.read_files(spark, str(tmp_path), max_bytes=50)
    assert [r.base64 for r in readers.encode_files(files).collect()] == ["YWJj"]
    reply = '```json\n[{"subject":"物理","difficulty":"2"}]\n```'
    found = readers.extracted_questions(readers.extract(files, lambda content: reply)).collect()
    assert [(r.subject, r.difficulty) for r in found] == [("物理", "2")]
    assert readers.extracted_questions(readers.extract(files)).count() == 0
    assert readers.read_files(spark, str(tmp_path), modified_before="2000-01-01T00:00:00", content=False).count() == 0


def test_images(spark):
    class Answer:
        headers = {"content-type": "image/png"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self, n):
            return b"png"

    urls = spark.createDataFrame([("https://a.org/x.png",), ("http://localhost/x",), ("https://b.org/fails",)], "url string")

    def opener(url, timeout):
        if "fails" in url:
            raise OSError
        return Answer()

    assert {r.url: r.bytes for r in readers.fetch_images(urls, opener=opener).collect()} == {"https://a.org/x.png": b"png", "http://localhost/x": None, "https://b.org/fails": None}


def test_redirects_are_checked():
    assert all(S.is_safe_address(u) for u in ("https://a.org/x", "http://172.32.0.1/x", "https://user@b.org:8080/x"))
    unsafe = ("http://localhost/x", "http://10.0.0.1", "https://a.local/", "ftp://a.org", "http://[::1]/", "http://[fd00::1]/x", "http://user@127.0.0.1/", "x", "http://[broken")
    assert not any(S.is_safe_address(u) for u in unsafe)


def test_redirect_to_a_private_host_is_refused():
    import http.server
    import threading
    import urllib.error

    class Redirects(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(302)
            self.send_header("Location", "http://127.0.0.1:1/secret")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Redirects)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with pytest.raises(urllib.error.URLError, match="isn't safe"):
            readers.open_checked(f"http://127.0.0.1:{server.server_port}/x", 5)
    finally:
        server.shutdown()


def test_export_paper(spark, bank):
    import io
    import zipfile

    png = b"\x89PNG rest"
    with_images = bank.withColumn("question_img", F.when(F.col("id") == 9, "https://a.org/x.png").when(F.col("id") == 3, "https://a.org/gone.png").when(F.col("id") == 4, "http://localhost/x.png"))

    def fetch(urls):
        assert {r.url for r in urls.collect()} <= {"https://a.org/x.png", "https://a.org/gone.png"}
        return urls.withColumn("bytes", F.when(F.col("url").endswith("x.png"), F.lit(png)))

    name, file = paper.export_paper(with_images, "a 卷", "B", [9, 3, 999999, 4], NOW, fetch)
    held = zipfile.ZipFile(io.BytesIO(file))
    text = held.read("word/document.xml").decode()
    assert name == "a%20%E5%8D%B7.docx" and held.read("word/media/image1.png") == png and text.count("<w:drawing>") == 1
    assert 'Target="media/image1.png"' in held.read("word/_rels/document.xml.rels").decode() and f'cx="{300 * 9525}" cy="{200 * 9525}"' in text
    rows = {r.id: r.question_text for r in bank.collect()}
    # As listed, with the gap of the id that isn't there.
    assert text.index("第 1 題. [") < text.index("第 2 題. [") < text.index("第 4 題. [") and "第 3 題. [" not in text
    assert text.index(rows[9].split(" ")[0]) < text.index(rows[3].split(" ")[0]) < text.index(rows[4].split(" ")[0])
    assert "gone" not in text and "localhost" not in text
    for nothing in ([], None, "1"):
        with pytest.raises(paper.Refused) as e:
            paper.export_paper(bank, "t", "s", nothing, NOW)
        assert e.value.code == "no_questions"


def test_extract_questions(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    found = paper.extract_questions(readers.read_files(spark, str(tmp_path)), lambda content: '[{"subject":"物理"}]')
    assert [r.subject for r in found.collect()] == ["物理"]
    with pytest.raises(paper.Refused):
        paper.extract_questions(readers.read_files(spark, str(tmp_path), max_bytes=1))


def test_reports(spark, bank):
    from quillbank.functions import latex, rules

    asked = bank.withColumn("question_text", F.when(F.col("id") == 2, "a < b $").otherwise(F.col("question_text")))
    page = "".join(document.report_document(rules.audit(asked, converts=latex.converts), asked))
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>") and "總題數：<b>30</b>" in page and "嚴重：<b>1</b>" in page and "a &lt; b $" in page
    assert document.NOTHING_FOUND in "".join(document.report_document(rules.audit(bank.filter("id = 3")), bank.filter("id = 3")))
    fixed = asked.withColumn("question_text", F.when(F.col("id") == 3, "[FRAC:1|2]").otherwise(F.col("question_text")))
    page = "".join(document.preview_document(rules.classify(fixed)))
    assert "將自動修復（1）" in page and "需人工處理（1）" in page and page.index("[FRAC:1|2]") < page.index("a &lt; b $")
