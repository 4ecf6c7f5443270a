"""Named queries over the driver's tables and the SQL that each must agree with.

The bank's tables are played by the star schema: ``part`` are the questions (type as
subject, brand as chapter, size as difficulty), ``orders`` with ``lineitem`` the history
of what a student has seen, ``events`` the stream of requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions import latex, rules
from quillbank.functions import scalars as S
from quillbank.operators import document, fairness, limiter, mutate, relational
from quillbank.sources import model, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STUDENT, SEED = 7, 20260801

# Questions of the star schema.
PARTS = "SELECT p_partkey AS id, p_type AS subject, p_brand AS chapter, p_size AS difficulty, p_name AS question_text FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("subject"), F.col("p_brand").alias("chapter"), F.col("p_size").alias("difficulty"), F.col("p_name").alias("question_text"))


HISTORY = "SELECT o_custkey AS student, l_partkey AS question_id, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("student"), F.col("l_partkey").alias("question_id"), F.to_date("o_orderdate").alias("day"))


# Questions with Chinese labels, so that the whitelist and the rules have work to do.
TYPE_SQL = "['單選', '多選', '填空', '計算', '證明', '其他'][p_size % 6 + 1]"
# What a question ends in, so that every repair has something to do: old markers, stray dollars, a known damaged formula, scripts after names, wide spaces.
ENDS = (
    " [SUPER:x|2]", " [SUB:a|n]", " $x$_{1}", r" $\frac{T}{2}$^{[SUPER:R|3}]=K", " ${a$}", r" \theta^2", r" \alpha _1", " \\beta\u3000/\u30003", " x\u3000/\u3000y", " x^{2}", "",
)
ENDS_SQL = "[" + ", ".join(f"'{e}'" for e in ENDS) + "][p_size % 11 + 1]"
BANK = f"""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '數學' ELSE '物理' END AS subject,
CASE WHEN p_size % 3 = 0 THEN '實數' WHEN p_size % 3 = 1 THEN '電流與電路' ELSE '排列 ' END AS chapter,
{TYPE_SQL} AS question_type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 8 END AS difficulty,
'[FRAC:' || p_size || '|' || p_partkey || '] and $x$^{{2}}, ' || p_name || CASE WHEN p_size % 5 = 0 THEN ' × \\pi / 2' WHEN p_size % 5 = 1 THEN ' [SQRT:3]$' WHEN p_size % 5 = 2 THEN ' $a×b$ \\theta' ELSE ' 3/4 {{{{}}' END || {ENDS_SQL} AS question_text,
CASE WHEN p_size % 4 = 0 THEN '略' WHEN p_size % 4 = 1 THEN '' WHEN p_size % 4 = 2 THEN NULL ELSE '$\\frac{{1}}{{2}}$ ≤ x_1' END AS answer_text FROM part"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    types = F.array(*[F.lit(t) for t in ("單選", "多選", "填空", "計算", "證明", "其他")])
    tail = F.when(size % 5 == 0, F.lit(" × \\pi / 2")).when(size % 5 == 1, F.lit(" [SQRT:3]$")).when(size % 5 == 2, F.lit(" $a×b$ \\theta")).otherwise(F.lit(" 3/4 {{}"))
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDS]), size % 11 + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(size % 2 == 0, "數學").otherwise("物理").alias("subject"),
        F.when(size % 3 == 0, "實數").when(size % 3 == 1, "電流與電路").otherwise("排列 ").alias("chapter"),
        F.element_at(types, size % 6 + 1).alias("question_type"),
        F.when(size % 7 != 0, size % 8).alias("difficulty"),
        F.concat(F.lit("[FRAC:"), size.cast("string"), F.lit("|"), key, F.lit("] and $x$^{2}, "), F.col("p_name"), tail, ends).alias("question_text"),
        F.when(size % 4 == 0, "略").when(size % 4 == 1, "").when(size % 4 == 3, F.lit("$\\frac{1}{2}$ ≤ x_1")).alias("answer_text"),
    )


# ---- drawing and reading -------------------------------------------------------------


@query(f"""
WITH seen AS (SELECT question_id FROM ({HISTORY}) WHERE student = 7),
pool AS (SELECT * FROM ({PARTS}) q WHERE subject = (SELECT min(p_type) FROM part) AND NOT EXISTS (SELECT 1 FROM seen WHERE question_id = q.id)),
drawn AS (SELECT * FROM pool ORDER BY md5('{SEED}|' || id), id LIMIT 5)
SELECT id, difficulty, question_text, row_number() OVER (ORDER BY difficulty, id) AS pos FROM drawn
""")
def draw_unseen(spark, sf_dir):
    """Five unseen questions of one subject, in paper order."""
    q = parts(spark, sf_dir)
    subject = q.agg(F.min("subject").alias("subject"))
    pool = relational.anti_seen(q.join(subject, "subject", "left_semi"), history(spark, sf_dir), STUDENT)
    drawn = relational.sample_k(pool, 5, SEED)
    return drawn.select("id", "difficulty", "question_text", F.row_number().over(ordered_by("difficulty", "id")).alias("pos"))


def ordered_by(*keys):  # noqa: N802  a window over a drawn paper, which is of bounded size
    from pyspark.sql.window import Window

    return Window.orderBy(*keys)


@query("SELECT id, difficulty FROM (" + PARTS + ") WHERE subject = 'STANDARD' AND chapter = 'Brand#11'")
def scan_eq(spark, sf_dir):
    return relational.scan_eq(parts(spark, sf_dir), subject="STANDARD", chapter="Brand#11").select("id", "difficulty")


@query("SELECT id, subject, chapter FROM (" + PARTS + ") ORDER BY id")
def scan_ordered(spark, sf_dir):
    return relational.scan(parts(spark, sf_dir), ["id", "subject", "chapter"], "id")


@query("SELECT id, question_text FROM (" + PARTS + ") WHERE id IN (9, 3, 999999999, 17)")
def multi_get(spark, sf_dir):
    return relational.multi_get(parts(spark, sf_dir), [9, 3, 999_999_999, 17]).select("id", "question_text")


@query("SELECT p_partkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS \"exists\" FROM part")
def existence(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return relational.existing(sold, parts(spark, sf_dir).select("id"), "id")


@query("SELECT id FROM (" + PARTS + ") WHERE difficulty = 7 AND chapter = 'Brand#23'")
def dyn_filter(spark, sf_dir):
    return relational.filter_bank(parts(spark, sf_dir), {"subject": None, "difficulty": 7, "chapter": "Brand#23", "question_type": ""}).select("id")


@query("SELECT id FROM (" + PARTS + ") WHERE question_text LIKE '%a_e%' OR subject LIKE '%a_e%'")
def search_or_like(spark, sf_dir):
    return relational.filter_bank(parts(spark, sf_dir), {}, "a_e", ("question_text", "subject")).select("id")


@query("SELECT id, answer_text FROM (" + BANK + ") WHERE answer_text IS NOT NULL AND answer_text <> ''")
def nonblank(spark, sf_dir):
    return bank(spark, sf_dir).filter(S.nonblank(F.col("answer_text"))).select("id", "answer_text")


@query("SELECT id FROM (" + BANK + ") WHERE answer_text NOT IN ('略', '') OR answer_text IS NULL")
def notin_or_null(spark, sf_dir):
    return bank(spark, sf_dir).filter(S.not_in_or_null(F.col("answer_text"), ["略", ""])).select("id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE NOT json_exists(props, '$.j')")
def map_key_absent(spark, sf_dir):
    held = table(spark, sf_dir, "events").filter(S.unseen(F.col("props"), F.lit("j")))
    return held.select("event_id", S.history(F.col("props"))["k"].alias("k"))


@query("SELECT p_partkey AS id FROM part WHERE p_name IS DISTINCT FROM replace(p_name, 'a', 'b')")
def changed_rows(spark, sf_dir):
    q = parts(spark, sf_dir)
    return q.filter(S.changed(F.col("question_text"), F.replace("question_text", F.lit("a"), F.lit("b")))).select("id")


# The chapters of the syllabus, written out so that the SQL tells a wrong table from a right one.
WHITELIST = """(SELECT * FROM (VALUES
('數學', '實數', 1), ('數學', '絕對值', 2), ('數學', '指數與對數', 3), ('數學', '直線方程式', 4), ('數學', '圓方程式', 5),
('數學', '多項式除法', 6), ('數學', '三次函數', 7), ('數學', '數列與級數', 8), ('數學', '排列', 9), ('數學', '組合', 10),
('數學', '古典機率', 11), ('數學', '期望值', 12), ('數學', '一維數據分析', 13), ('數學', '二維數據分析', 14), ('數學', '三角函數的定義', 15),
('數學', '正弦與餘弦定理', 16), ('數學', '三角測量', 17), ('數學', '向量的加減與係數積', 18), ('數學', '向量內積', 19), ('數學', '面積與行列式', 20),
('數學', '空間概念與座標系', 21), ('數學', '空間向量內積', 22), ('數學', '外積', 23), ('數學', '平面方程式', 24), ('數學', '空間直線方程式', 25),
('數學', '矩陣的加減與乘法', 26), ('數學', '克拉瑪公式', 27), ('數學', '數列的極限', 28), ('數學', '函數的極限', 29), ('數學', '微分導函數', 30),
('數學', '函數圖形與極值', 31), ('數學', '定積分與面積', 32), ('數學', '隨機變數', 33), ('數學', '常態分配', 34),
('物理', '科學的態度與方法', 1), ('物理', '物質的組成（夸克與原子）', 2), ('物理', '物體的運動（速度與加速度）', 3), ('物理', '四大基本交互作用', 4), ('物理', '能量的形式與守恆', 5),
('物理', '量子現象（光電效應與波粒二象性）', 6), ('物理', '宇宙學簡介', 7), ('物理', '直線運動', 8), ('物理', '平面運動', 9), ('物理', '牛頓運動定律', 10),
('物理', '摩擦力與向心力', 11), ('物理', '動量與衝量', 12), ('物理', '動量守恆與碰撞', 13), ('物理', '功與動能', 14), ('物理', '位能與能量守恆', 15),
('物理', '重力場與重力位能', 16), ('物理', '剛體轉動與平衡', 17), ('物理', '簡諧運動(SHM)', 18), ('物理', '流體的壓力與浮力', 19), ('物理', '波動的性質', 20),
('物理', '聲波與交互作用', 21), ('物理', '幾何光學（反射折射）', 22), ('物理', '物理光學（干涉繞射）', 23), ('物理', '靜電學', 24), ('物理', '電場與電位', 25),
('物理', '電流與電路', 26), ('物理', '電流磁效應', 27), ('物理', '電磁感應', 28), ('物理', '交流電', 29), ('物理', '近代物理的序幕', 30),
('物理', '原子結構與光譜', 31), ('物理', '核物理與基本粒子', 32)
) AS t(subject, chapter, ord))"""


@query(f"SELECT id, subject, chapter FROM ({BANK}) q WHERE EXISTS (SELECT 1 FROM {WHITELIST} w WHERE w.subject = q.subject AND w.chapter = q.chapter)")
def whitelist_semi(spark, sf_dir):
    return relational.in_whitelist(bank(spark, sf_dir), model.chapters(spark), ["subject", "chapter"]).select("id", "subject", "chapter")


@query(f"SELECT id, subject, chapter FROM ({BANK}) q WHERE NOT EXISTS (SELECT 1 FROM {WHITELIST} w WHERE w.subject = q.subject AND w.chapter = q.chapter)")
def whitelist_violations(spark, sf_dir):
    return relational.in_whitelist(bank(spark, sf_dir), model.chapters(spark), ["subject", "chapter"], violations=True).select("id", "subject", "chapter")


@query(f"SELECT subject, chapter, ord FROM {WHITELIST}")
def whitelist(spark, sf_dir):
    return model.chapters(spark)


@query("""
WITH lists AS (SELECT l_orderkey AS list_id, l_linenumber, l_partkey AS id FROM lineitem)
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY l_linenumber, lists.id) - 1 AS INTEGER) AS pos, lists.id AS id, p_name AS question_text
FROM lists JOIN part ON p_partkey = lists.id
""")
def ordered_fetch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("list_id"))
    lists = li.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    return relational.ordered_fetch(lists, parts(spark, sf_dir).select("id", "question_text")).select("list_id", "pos", "id", "question_text")


WEIGHT_SQL = "CASE question_type WHEN '單選' THEN 1 WHEN '多選' THEN 2 WHEN '填空' THEN 3 WHEN '計算' THEN 4 WHEN '證明' THEN 5 ELSE 99 END"


@query(f"SELECT id, question_type, {WEIGHT_SQL} AS weight FROM ({BANK})")
def weight_lookup(spark, sf_dir):
    return bank(spark, sf_dir).select("id", "question_type", S.type_weight(F.col("question_type")).alias("weight"))


@query("SELECT DISTINCT subject, chapter FROM (" + PARTS + ") WHERE chapter IS NOT NULL AND chapter <> ''")
def distinct_pairs(spark, sf_dir):
    return relational.distinct_pairs(parts(spark, sf_dir))


@query("SELECT count(*) AS total FROM (" + PARTS + ") WHERE subject = 'STANDARD' AND question_text LIKE '%a%'")
def count_filtered(spark, sf_dir):
    found = relational.filter_bank(parts(spark, sf_dir), {"subject": "STANDARD"}, "a", ("question_text",))
    return found.agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT count(*) FILTER (WHERE subject = '數學') AS math, count(*) FILTER (WHERE subject = '物理') AS physics, count(*) FILTER (WHERE subject NOT IN ('數學', '物理') OR subject IS NULL) AS other FROM ({BANK})")
def cond_counts(spark, sf_dir):
    return relational.subject_counts(bank(spark, sf_dir), {"math": "數學", "physics": "物理"})


@query("SELECT subject, chapter, count(*) AS n FROM (" + PARTS + ") GROUP BY subject, chapter")
def group_count(spark, sf_dir):
    return relational.density(parts(spark, sf_dir), ["subject", "chapter"]).select("subject", "chapter", "n")


@query("SELECT chapter, difficulty, count(*) AS n, count(*) < 2 AS thin FROM (" + PARTS + ") GROUP BY chapter, difficulty HAVING count(*) < 2")
def density_check(spark, sf_dir):
    return relational.density(parts(spark, sf_dir), ["chapter", "difficulty"], 2).filter("thin")


@query("SELECT min(n) AS least, max(n) AS most, count(*) AS groups FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type)")
def group_minmax(spark, sf_dir):
    return relational.spread(relational.density(parts(spark, sf_dir), ["subject", "chapter"]))


@query(f"""
SELECT count(*) AS available, 50 AS wanted, count(*) >= 50 AS enough FROM ({PARTS}) q
WHERE chapter = 'Brand#11' AND id NOT IN (SELECT question_id FROM ({HISTORY}) WHERE student = 7)
""")
def shortage(spark, sf_dir):
    pool = relational.anti_seen(relational.scan_eq(parts(spark, sf_dir), chapter="Brand#11"), history(spark, sf_dir), STUDENT)
    return relational.shortage(pool, 50)


@query("SELECT id, question_text FROM (" + PARTS + ") ORDER BY id DESC LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return relational.page(parts(spark, sf_dir).select("id", "question_text"), "3", "x")[0]


@query("SELECT count(*) AS total, 1 AS page, 100 AS \"limit\", greatest(CAST(ceil(count(*) / 100) AS BIGINT), 1) AS \"totalPages\" FROM part WHERE p_type = 'STANDARD'")
def page_summary(spark, sf_dir):
    return relational.page(relational.scan_eq(parts(spark, sf_dir), subject="STANDARD"), -3, 1000)[1]


@query(f"""
WITH p AS (SELECT id, question_text FROM ({PARTS}) ORDER BY id DESC LIMIT 5), n AS (SELECT count(*) AS total FROM part)
SELECT '{{"total":' || total || ',"page":1,"limit":5,"totalPages":' || CAST(ceil(total / 5) AS BIGINT) || ',"questions":[' ||
(SELECT string_agg('{{"id":' || id || ',"question_text":"' || question_text || '"}}', ',' ORDER BY id DESC) FROM p) || ']}}' AS json FROM n
""")
def page_envelope(spark, sf_dir):
    rows, summary = relational.page(parts(spark, sf_dir).select("id", "question_text"), 1, 5)
    return relational.envelope(rows, summary)


@query(f"SELECT id, question_type, difficulty, row_number() OVER (ORDER BY {WEIGHT_SQL}, CASE WHEN difficulty IS NULL OR difficulty = 0 THEN 3 ELSE difficulty END, id) AS pos FROM ({BANK}) WHERE chapter = '實數'")
def weight_sort(spark, sf_dir):
    found = relational.scan_eq(bank(spark, sf_dir), chapter="實數")
    order = relational.paper_order(F.col("question_type"), F.col("difficulty"), F.col("id"))
    return found.select("id", "question_type", "difficulty", F.row_number().over(ordered_by(*order)).alias("pos"))


@query(f"SELECT id FROM ({PARTS}) WHERE chapter = 'Brand#11' ORDER BY md5('{SEED}|' || id), id LIMIT 10")
def sample_k(spark, sf_dir):
    return relational.sample_k(relational.scan_eq(parts(spark, sf_dir), chapter="Brand#11"), 10, SEED).select("id")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY md5('{SEED}|' || id), id) AS INTEGER) AS pos FROM ({PARTS}) WHERE chapter = 'Brand#11'")
def perm(spark, sf_dir):
    return relational.permute(relational.scan_eq(parts(spark, sf_dir), chapter="Brand#11"), SEED).select("id", "pos")


@query(f"SELECT id, subject FROM ({BANK}) WHERE subject = '物理'")
def view(spark, sf_dir):
    mutate.views(bank(spark, sf_dir).withColumns({"history_json": F.lit("{}"), "subject_name": F.col("subject")}), {"questions_math": "數學", "questions_physics": "物理"})
    return spark.table("questions_physics").select("id", F.lit("物理").alias("subject"))


# ---- changing ------------------------------------------------------------------------

INCOMING = "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, n_name FROM nation"


def incoming(spark, sf_dir) -> DataFrame:
    """A small batch: one row per nation, some with blanks and repeats."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").withColumn("idx", F.row_number().over(ordered_by("n_nationkey")) - 1)
    i = F.col("idx")
    return n.select(
        "idx", F.when(i % 5 == 4, "化學").otherwise("數學").alias("subject"), F.when(i % 7 == 6, "重力").otherwise(F.lit(" 實數\u3000")).alias("chapter"),
        F.when(i % 3 == 0, "").when(i % 11 == 1, "口試").otherwise("單選").alias("question_type"),
        F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 13 == 2, "9").otherwise("3abc").alias("difficulty"),
        F.when(i % 8 == 7, F.lit(" \u3000")).otherwise(F.concat(F.lit(" "), F.col("n_name"), (i % 6).cast("string"))).alias("question_text"),
        F.when(i % 2 == 0, "").otherwise(F.col("n_name")).alias("answer_text"),
    )


INCOMING_ROWS = f"""SELECT idx, CASE WHEN idx % 5 = 4 THEN '化學' ELSE '數學' END AS subject, CASE WHEN idx % 7 = 6 THEN '重力' ELSE '實數' END AS chapter,
CASE WHEN idx % 3 = 0 THEN '填空' WHEN idx % 11 = 1 THEN '口試' ELSE '單選' END AS question_type,
CASE WHEN idx % 4 = 0 THEN 3 WHEN idx % 13 = 2 THEN NULL ELSE 3 END AS difficulty,
CASE WHEN idx % 8 = 7 THEN '' ELSE n_name || (idx % 6) END AS question_text, CASE WHEN idx % 2 = 0 THEN '略' ELSE n_name END AS answer_text FROM ({INCOMING})"""


@query(f"SELECT idx, subject, chapter, question_type, difficulty, question_text, answer_text, '{{}}' AS history_json, (SELECT max(p_partkey) FROM part) + 1 + idx AS id FROM ({INCOMING_ROWS})")
def insert_defaults(spark, sf_dir):
    """What ``mutate.insert`` adds to the bank."""
    held = bank(spark, sf_dir).withColumn("history_json", F.lit("{}"))
    last = held.agg(F.max("id").alias("last"))
    added = mutate.insert(held, incoming(spark, sf_dir)).crossJoin(F.broadcast(last)).filter("id > last")
    return added.select((F.col("id") - F.col("last") - 1).cast("int").alias("idx"), "subject", "chapter", "question_type", "difficulty", "question_text", "answer_text", "history_json", "id")


@query("""
WITH rows AS (SELECT o_orderkey, o_orderstatus || (o_custkey % 60) AS question_text FROM orders),
held AS (SELECT o_orderstatus || (o_custkey % 60) AS question_text FROM orders WHERE o_custkey % 3 = 0)
SELECT question_text, min(o_orderkey) AS idx FROM rows WHERE question_text NOT IN (SELECT question_text FROM held) GROUP BY question_text
""")
def seed_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat("o_orderstatus", (F.col("o_custkey") % 60).cast("string")).alias("question_text")
    return mutate.new_rows(o.filter("o_custkey % 3 = 0").select(text), o.select(F.col("o_orderkey").alias("idx"), text))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2026-01-01' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN '2026-01-01' END AS amy FROM events")
def json_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    who = F.when(F.col("event_id") % 3 == 0, "k").otherwise("amy")
    new = F.when(F.col("event_id") % 3 < 2, S.record(F.col("props"), who, F.lit("2026-01-01"))).otherwise(F.col("props"))
    after = S.history(new)
    return e.select("event_id", after["k"].alias("k"), after["amy"].alias("amy"))


@query(f"""
WITH patches AS (SELECT p_partkey AS id, '計算' AS question_type, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 'new' END AS answer_text FROM part WHERE p_size < 10)
SELECT q.id, q.chapter, coalesce(p.question_type, q.question_type) AS question_type,
CASE WHEN p.id IS NOT NULL THEN coalesce(nullif(trim(p.answer_text), ''), '略') ELSE q.answer_text END AS answer_text
FROM ({BANK}) q LEFT JOIN patches p ON p.id = q.id
""")
def patch_update(spark, sf_dir):
    q = bank(spark, sf_dir)
    p = table(spark, sf_dir, "part").filter("p_size < 10")
    patches = p.select(F.col("p_partkey").alias("id"), F.lit("計算").alias("question_type"), F.when(F.col("p_size") % 2 == 0, " ").otherwise("new").alias("answer_text"))
    return mutate.patch(q, patches, ["question_type", "answer_text"])[0].select("id", "chapter", "question_type", "answer_text")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    return mutate.remove(parts(spark, sf_dir).select("id"), gone)[0]


@query("SELECT p_partkey AS id, replace(p_name, 'a', 'b') AS question_text, p_name <> replace(p_name, 'a', 'b') AS changed FROM part")
def changed_only(spark, sf_dir):
    q = parts(spark, sf_dir).select("id", "question_text")
    return mutate.update_changed(q, {"question_text": F.replace("question_text", F.lit("a"), F.lit("b"))})


@query("SELECT count(*) FILTER (WHERE p_name <> replace(p_name, 'a', 'b')) AS updated, count(*) FILTER (WHERE p_name = replace(p_name, 'a', 'b')) AS untouched FROM part")
def change_counts(spark, sf_dir):
    q = parts(spark, sf_dir).withColumn("new", F.replace("question_text", F.lit("a"), F.lit("b")))
    return relational.change_counts(q, "question_text", "new")


# ---- rules ---------------------------------------------------------------------------

_PLACED = f"""WHEN subject NOT IN ('數學', '物理') THEN 'subject'
WHEN NOT EXISTS (SELECT 1 FROM {WHITELIST} w WHERE w.subject = r.subject AND w.chapter = trim(r.chapter)) THEN 'chapter'
WHEN question_type NOT IN ('單選', '多選', '填空', '計算', '證明') THEN 'question_type' WHEN difficulty IS NULL OR difficulty NOT BETWEEN 1 AND 5 THEN 'difficulty'"""


@query(f"SELECT idx, CASE {_PLACED} WHEN question_text = '' THEN 'question_text' END AS error_code FROM ({INCOMING_ROWS}) r")
def validate_batch(spark, sf_dir):
    return rules.validate_batch(incoming(spark, sf_dir)).select("idx", "error_code")


@query(f"""
WITH r AS (SELECT idx, CASE {_PLACED} WHEN question_text = '' THEN 'question_text' END AS error_code FROM ({INCOMING_ROWS}) r)
SELECT count(error_code) AS n_errors, coalesce(string_agg('第 ' || (idx + 1) || ' 題：' || error_code, chr(10) ORDER BY idx) FILTER (WHERE error_code IS NOT NULL), '') AS message FROM r
""")
def batch_errors(spark, sf_dir):
    return rules.batch_errors(rules.validate_batch(incoming(spark, sf_dir)))


_BANK_ROWS = f"SELECT id, subject, chapter, question_type, coalesce(difficulty, 3) AS difficulty, question_text, answer_text FROM ({BANK})"


@query(f"SELECT id, CASE WHEN answer_text IS NULL OR answer_text = '' THEN 'required' {_PLACED} END AS error_code FROM ({_BANK_ROWS}) r")
def validate_create(spark, sf_dir):
    return rules.validate_create(bank(spark, sf_dir)).select("id", "error_code")


@query(f"SELECT id, CASE {_PLACED} END AS error_code FROM ({_BANK_ROWS}) r")
def validate_update(spark, sf_dir):
    return rules.validate_update(bank(spark, sf_dir)).select("id", "error_code")


@query(f"SELECT id, difficulty FROM ({BANK}) WHERE difficulty IS NULL OR difficulty NOT BETWEEN 1 AND 5 OR question_type NOT IN ('單選', '多選', '填空', '計算', '證明')")
def constraint_violations(spark, sf_dir):
    return rules.check_constraints(bank(spark, sf_dir)).select("id", "difficulty")


# Fixed values, written out once more for the SQL.
_COMMANDS = "frac|sqrt|int|sum|prod|lim|vec|hat|bar|times|div|leq|geq|neq|approx|infty|pm|cdot|alpha|beta|gamma|delta|theta|pi|sigma|omega|lambda|mu|phi|sin|cos|tan|log|ln"
_UNICODE_MATH = "[×÷≤≥≠±√∞∑∫∏∂∇αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ°·∈∉⊂⊆∪∩→←⇒⇔]"
_SPACE = "[\\s\\x{A0}\\x{3000}]"


def _issues_sql(field: str, column: str) -> str:
    n = f"(length({column}) - length(replace({column}, '$', '')))"
    tests = [
        ("error", "odd_dollars", f"{n} % 2 <> 0"),
        ("error", "unbalanced_braces", f"length(replace({column}, '{{', '')) <> length(replace({column}, '}}', ''))"),
        ("warn", "slash_fraction", f"regexp_matches({column}, '[0-9a-zA-Zπ]{_SPACE}*/{_SPACE}*[0-9a-zA-Zπ]') AND NOT regexp_matches({column}, 'https?://')"),
        ("warn", "unicode_math", f"regexp_matches({column}, '{_UNICODE_MATH}')"),
        ("info", "bare_latex", f"{n} < 2 AND (regexp_matches({column}, '\\\\({_COMMANDS})\\b') OR regexp_matches({column}, '[\\^_]'))"),
    ]
    return " UNION ALL ".join(f"SELECT id, '{field}' AS field, '{sev}' AS sev, '{code}' AS code FROM bank WHERE trim({column}) <> '' AND {test}" for sev, code, test in tests)


AUDIT = f"WITH bank AS ({BANK}) {_issues_sql('question', 'question_text')} UNION ALL {_issues_sql('answer', 'answer_text')} UNION ALL SELECT id, 'answer', 'info', 'no_answer' FROM bank WHERE answer_text IS NULL OR trim(answer_text) IN ('', '略')"


@query(AUDIT)
def audit(spark, sf_dir):
    return rules.audit(bank(spark, sf_dir))


@query(AUDIT)
def audit_converting(spark, sf_dir):
    """The audit that also has every text converted; none of these fails."""
    return rules.audit(bank(spark, sf_dir), converts=latex.converts)


@query(f"SELECT (SELECT count(*) FROM part) AS questions, count(DISTINCT id) AS flagged, count(*) FILTER (WHERE sev = 'error') AS error, count(*) FILTER (WHERE sev = 'warn') AS warn, count(*) FILTER (WHERE sev = 'info') AS info FROM ({AUDIT})")
def report_totals(spark, sf_dir):
    q = bank(spark, sf_dir)
    return document.report_totals(rules.audit(q), q)


@query(f"SELECT sev, count(*) AS issues, count(DISTINCT id) AS questions FROM ({AUDIT}) GROUP BY sev")
def severity_summary(spark, sf_dir):
    return rules.severity_summary(rules.audit(bank(spark, sf_dir)))


def _replaced(column: str, steps) -> str:
    for pattern, out in steps:
        column = f"regexp_replace({column}, '{pattern}', '{out}', 'g')"
    return column


_MARKERS = [
    (r"\[FRAC:([^|\]]*)\|([^\]]*)\]", r"\\frac{\1}{\2}"), (r"\[SUPER:([^|\]]*)\|([^\]]*)\]", r"\1^{\2}"), (r"\[SUB:([^|\]]*)\|([^\]]*)\]", r"\1_{\2}"),
    (r"\[SQRT:([^\]}]*)[}\]]", r"\\sqrt{\1}"), (r"\$(\^\{[^{}]*\})", r"\1$"), (r"\$(_\{[^{}]*\})", r"\1$"), *[(r"\$\}", "}$")] * 5,
]


def _fixed(column: str) -> str:
    return f"replace({column}, '$\\frac{{T}}{{2}}$^{{[SUPER:R|3}}]=K', '$\\frac{{T^2}}{{R^3}}=K$')"


@query(f"SELECT id, {_replaced(_fixed('question_text'), _MARKERS)} AS repaired FROM ({BANK})")
def repair_markers(spark, sf_dir):
    return bank(spark, sf_dir).select("id", rules.repair_markers(F.col("question_text")).alias("repaired"))


_GREEK = "pi|theta|alpha|beta|gamma|delta|omega|lambda|nu|sigma|phi|varphi|rho|tau|varepsilon|epsilon|psi|chi|mu"
_NAMES = (("×", "times"), ("÷", "div"), ("≤", "leq"), ("≥", "geq"), ("≠", "neq"), ("±", "pm"), ("≈", "approx"))


def _outside_sql(column: str) -> str:
    """Outside of dollars. RE2 can't look ahead, so names with a script after them are hidden first."""
    edited = "p"
    for char, name in _NAMES:
        edited = f"replace({edited}, '{char}', '$\\{name}$')"
    hidden = f"regexp_replace({edited}, '\\\\({_GREEK})({_SPACE}*[\\^_])', chr(1) || '\\1\\2', 'g')"
    spaced = f"regexp_replace({hidden}, '\\\\({_GREEK})\\b{_SPACE}*/{_SPACE}*([0-9]+)', '$\\\\\\1/\\2$', 'g')"
    bare = f"regexp_replace({spaced}, '(^|[^$])\\\\({_GREEK})\\b', '\\1$\\\\\\2$', 'g')"
    shown = f"replace({bare}, chr(1), '\\')"
    return f"array_to_string(list_transform(regexp_extract_all({column}, '(\\$[^$]*\\$|[^$]+|\\$)', 1), lambda p: CASE WHEN regexp_full_match(p, '\\$[^$]*\\$') THEN p ELSE {shown} END), '')"


@query(f"SELECT id, {_outside_sql('question_text')} AS repaired FROM ({BANK})")
def repair_outside(spark, sf_dir):
    return bank(spark, sf_dir).select("id", rules.repair_outside(F.col("question_text")).alias("repaired"))


def _clean_sql(c: str) -> str:
    spans = f"regexp_extract_all({c}, '(\\$[^$]*\\$)', 1)"
    return f"""coalesce(NOT (regexp_matches({c}, '\\[(FRAC|SUPER|SUB|SQRT):') OR regexp_matches({c}, '(^|[^\\\\A-Za-z])(frac|sqrt)([^A-Za-z]|$)')
OR regexp_matches({c}, '(^|[^A-Za-z\\\\])ell([^A-Za-z]|$)') OR regexp_matches({c}, '\\$\\^|\\$_|\\$\\}}') OR (length({c}) - length(replace({c}, '$', ''))) % 2 <> 0
OR len(list_filter({spans}, lambda p: length(replace(p, '{{', '')) <> length(replace(p, '}}', '')))) > 0), true)"""


@query(f"SELECT id, {_clean_sql('question_text')} AS question_clean, {_clean_sql('answer_text')} AS answer_clean FROM ({BANK})")
def is_clean(spark, sf_dir):
    return bank(spark, sf_dir).select("id", rules.is_clean(F.col("question_text")).alias("question_clean"), rules.is_clean(F.col("answer_text")).alias("answer_clean"))


CLASSIFIED = f"""WITH bank AS ({BANK}), marked AS (SELECT *, {_replaced(_fixed('question_text'), _MARKERS)} AS mq, {_replaced(_fixed('answer_text'), _MARKERS)} AS ma FROM bank),
new AS (SELECT *, {_outside_sql('mq')} AS nq, CASE WHEN ma IS NOT NULL THEN {_outside_sql('ma')} END AS na FROM marked)
SELECT id, question_text, answer_text, nq, na, CASE WHEN (nq IS DISTINCT FROM question_text OR na IS DISTINCT FROM answer_text) AND {_clean_sql('nq')} AND {_clean_sql('na')} THEN 'auto'
WHEN (nq IS DISTINCT FROM question_text OR na IS DISTINCT FROM answer_text) OR NOT ({_clean_sql('question_text')} AND {_clean_sql('answer_text')}) THEN 'manual' END AS bucket FROM new"""


@query(f"SELECT id, bucket FROM ({CLASSIFIED})")
def classify(spark, sf_dir):
    return rules.classify(bank(spark, sf_dir)).select("id", "bucket")


@query(f"SELECT id, nq AS new_question, na AS new_answer FROM ({CLASSIFIED})")
def repair(spark, sf_dir):
    return rules.classify(bank(spark, sf_dir)).select("id", "new_question", "new_answer")


@query(f"SELECT count(*) AS questions, count(*) FILTER (WHERE bucket = 'auto') AS auto, count(*) FILTER (WHERE bucket = 'manual') AS manual FROM ({CLASSIFIED})")
def preview_totals(spark, sf_dir):
    return document.preview_totals(rules.classify(bank(spark, sf_dir)))


_LEGACY = [
    (r"\x{200B}", ""), (r"\[FRAC:([^|]+)\|([^\]]+)\]", r"\\frac{\1}{\2}"), (r"\[SQRT:([^\]]+)\]", r"\\sqrt{\1}"),
    (r"\[SUPER:" + _SPACE + r"*\|([^\]]+)\]", r"^{\1}"), (r"\[SUPER:([^|]+)\|([^\]]+)\]", r"\1^{\2}"), (r"\[SUB:" + _SPACE + r"*\|([^\]]+)\]", r"_{\1}"), (r"\[SUB:([^|]+)\|([^\]]+)\]", r"\1_{\2}"),
    ("π", r"\\pi "), ("θ", r"\\theta "), ("ω", r"\\omega "), ("∝", r"\\propto "), (r"√\((.*?)\)", r"\\sqrt{\1}"), ("√([a-zA-Z0-9])", r"\\sqrt{\1}"),
    ("([a-zA-Z0-9])²", r"\1^{2}"), ("([a-zA-Z0-9])³", r"\1^{3}"), ("([a-zA-Z0-9])₁", r"\1_{1}"), ("([a-zA-Z0-9])₂", r"\1_{2}"),
    # RE2 can't look around, so the neighbours are matched and put back; no two formulas of these texts share one.
    (r"(^|[^$])(\\[a-zA-Z]+\{[^}]*\}(?:\{[^}]*\})?)($|[^$])", r"\1$\2$\3"), (r"(^|[^$])([a-zA-Z0-9]+[\^_]\{[^}]*\})($|[^$])", r"\1$\2$\3"),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""),
]


@query(f"SELECT id, trim({_replaced('question_text', _LEGACY)}) AS normal FROM ({BANK})")
def legacy_normalize(spark, sf_dir):
    return bank(spark, sf_dir).select("id", rules.legacy_normalize(F.col("question_text")).alias("normal"))


@query(f"SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM {WHITELIST} w WHERE w.subject = r.subject AND w.chapter = r.chapter) OR question_type NOT IN ('單選', '多選', '填空', '計算', '證明') OR difficulty IS NULL OR difficulty NOT BETWEEN 1 AND 5 THEN 'seed' END AS error_code FROM ({BANK}) r")
def validate_seed(spark, sf_dir):
    return rules.validate_seed(bank(spark, sf_dir)).select("id", "error_code")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 IN (1, 2) THEN 'id' END AS error_code FROM nation")
def check_id(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    given = F.when(k == 0, "99999999999ab").when(k == 1, "x1").when(k == 3, "\u3000-5")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), rules.check_id(given).alias("error_code"))


@query("SELECT c_custkey, ['required', 'required', 'not_positive', 'too_many', 'student_name', 'not_positive', NULL, NULL][c_custkey % 8 + 1] AS error_code FROM customer")
def check_request(spark, sf_dir):
    k = F.col("c_custkey") % 8
    asked = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 0, "").when(k == 4, '"\\').otherwise(F.col("c_name")).alias("student_name"), F.lit("數學").alias("subject"), F.lit("實數").alias("chapter"),
        F.when(k == 1, F.lit(None).cast("string")).when(k == 2, "0").when(k == 3, "99999999999").when(k == 5, "x").otherwise("50").alias("count"),
    )
    return rules.check_request(asked).select("c_custkey", "error_code")


# ---- scalars -------------------------------------------------------------------------


@query("SELECT c_custkey, nullif(regexp_replace(trim('  ' || c_name || '\"\\ '), '[\"\\\\]', '', 'g'), '') AS name FROM customer")
def sanitize_name(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit('"\\ '))
    return table(spark, sf_dir, "customer").select("c_custkey", F.rtrim(S.sanitize_name(raw)).alias("name"))


@query("SELECT doc_id, length(regexp_replace(regexp_replace('😀★' || chr(7) || text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F0FF}\\x{1F1E6}-\\x{1F1FF}\\x{FE0F}]', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS n FROM documents")
def strip_unsafe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(S.strip_unsafe(F.concat(F.lit("😀★\x07"), F.col("text")))).cast("long").alias("n"))


@query("SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(S.html_escape(F.col("html"))).alias("escaped"))


_URLS = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'ftp://h/x' WHEN 2 THEN 'http://10.0.0.1/a' WHEN 3 THEN 'http://172.32.0.1/a' WHEN 4 THEN 'https://a.local/x' ELSE 'HTTP://LocalHost/x' END"


@query(f"""
WITH u AS (SELECT page_id, {_URLS} AS u FROM pages), h AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS p, lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1)) AS h FROM u)
SELECT page_id, p IN ('http', 'https') AND h <> '' AND h NOT IN ('localhost', '0.0.0.0') AND NOT h LIKE '%.local' AND NOT regexp_matches(h, '^127\\.|^10\\.|^192\\.168\\.|^172\\.(1[6-9]|2[0-9]|3[0-1])\\.|^169\\.254\\.') AS safe FROM h
""")
def safe_url(spark, sf_dir):
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.col("url")).when(k == 1, "ftp://h/x").when(k == 2, "http://10.0.0.1/a").when(k == 3, "http://172.32.0.1/a").when(k == 4, "https://a.local/x").otherwise("HTTP://LocalHost/x")
    return table(spark, sf_dir, "pages").select("page_id", S.is_safe_url(url).alias("safe"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || upper(p_type) || ',', ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS items FROM part")
def list_parse(spark, sf_dir):
    raw = F.concat(F.col("p_name"), F.lit(", ,"), F.upper("p_type"), F.lit(","))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(S.csv_list(raw, lower=True), "|").alias("items"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fence_json(spark, sf_dir):
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", S.unfence_json(fence, "k bigint")["k"].alias("k"))


@query(f"SELECT id, '第 ' || id || ' 題. [' || question_type || '] (難度: ' || repeat('★', coalesce(difficulty, 3)) || ')' AS label FROM ({BANK})")
def labels(spark, sf_dir):
    return bank(spark, sf_dir).select("id", S.question_label(F.col("id"), F.col("question_type"), S.default_null(F.col("difficulty"), 3)).alias("label"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN CASE WHEN p_size % 10 BETWEEN 1 AND 5 THEN p_size % 10 END WHEN p_size % 4 = 2 THEN 2 END AS difficulty FROM part")
def difficulty_norm(spark, sf_dir):
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, "x1").when(size % 4 == 1, F.concat((size % 10).cast("string"), F.lit("abc"))).when(size % 4 == 2, " 2.9")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.normalize_difficulty(raw).alias("difficulty"))


@query(f"SELECT id, coalesce(difficulty, 3) AS difficulty, coalesce(nullif(answer_text, ''), '略') AS answer_text FROM ({BANK})")
def defaults(spark, sf_dir):
    return bank(spark, sf_dir).select("id", S.default_null(F.col("difficulty"), 3).alias("difficulty"), S.default_falsy(F.col("answer_text"), "略").alias("answer_text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y_%-m_%-d') AS title_date, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y/%-m/%-d') AS print_date FROM orders")
def dates(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.title_date(ts).alias("title_date"), S.day(ts).alias("day"), S.print_date(ts).alias("print_date"))


@query("SELECT event_id, CAST(epoch_us(TIMESTAMP '2030-01-01') // 1000 - epoch_us(ts) // 1000 AS BIGINT) AS age_ms FROM events")
def age_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.age_ms(F.col("ts"), F.to_timestamp(F.lit("2030-01-01"))).alias("age_ms"))


@query("SELECT l_orderkey, '[' || string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) || ']' AS ids, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def json_arrays(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("list"))
    coded = grouped.select("l_orderkey", S.ids_to_json(F.col("list")).alias("ids"))
    return coded.withColumn("total", F.aggregate(S.ids_from_json(F.col("ids")), F.lit(0).cast("long"), lambda a, x: a + x))


@query("SELECT l_orderkey, array_to_string(list_transform(list_sort(list(l_partkey)), lambda x: x * 2), ',') AS doubled, count(*) FILTER (WHERE l_partkey % 2 = 0) AS even, bool_or(l_partkey < 10) AS low FROM lineitem GROUP BY l_orderkey")
def array_hofs(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("ids"))
    return listed.select(
        "l_orderkey", F.array_join(F.transform("ids", lambda x: (x * 2).cast("string")), ",").alias("doubled"),
        F.size(F.filter("ids", lambda x: x % 2 == 0)).cast("long").alias("even"), F.exists("ids", lambda x: x < 10).alias("low"),
    )


@query("SELECT p_partkey AS id, substring(p_name, 1, 12) AS snippet, length(p_name) - length(replace(p_name, 'a', '')) AS n_a FROM part")
def snippets(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.first_line(name, 12).alias("snippet"), S.char_count(name, "a").cast("long").alias("n_a"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 60 = 0 THEN 'required' WHEN c_custkey % 60 < 3 THEN 'not_positive' WHEN c_custkey % 60 > 50 THEN 'too_many' END AS problem FROM customer")
def check_count(spark, sf_dir):
    k = F.col("c_custkey") % 60
    asked = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "0").when(k == 2, "x").otherwise(k.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.check_count(asked).alias("problem"))


@query("SELECT s_suppkey, 'a%20b(' || s_suppkey || ')%2F%E5%8D%B7.docx' AS filename FROM supplier")
def filename(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.filename(F.concat(F.lit("a b("), F.col("s_suppkey").cast("string"), F.lit(")/卷.docx"))).alias("filename"))


@query("SELECT p_partkey AS id, least(greatest(p_size, 10), 20) AS clamped FROM part")
def clamp(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.clamp(F.col("p_size"), 10, 20).alias("clamped"))


_BROKEN = "question_text || chr(13) || chr(10) || 'a' || chr(13) || 'b' || chr(7)"


@query(f"""
WITH t AS (SELECT id, {_BROKEN} AS c FROM ({BANK})), u AS (SELECT id, c, replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS unified FROM t)
SELECT id, unified, len(string_split(unified, chr(10))) AS n_lines, regexp_matches(c, '[\\x{{2E80}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}\\x{{3400}}-\\x{{4DBF}}]') AS cjk,
translate(c, '\\{{}}^_$', '') AS plain, replace(c, chr(7), '') AS clean FROM u
""")
def text_cleanup(spark, sf_dir):
    c = F.concat("question_text", F.lit("\r\na\rb\x07"))
    return bank(spark, sf_dir).select(
        "id", S.unify_newlines(c).alias("unified"), F.size(S.lines(c)).cast("long").alias("n_lines"), S.has_cjk(c).alias("cjk"), S.plain_fallback(c).alias("plain"), S.xml_safe_clean(c).alias("clean")
    )


@query(f"SELECT subject, chapter, ord FROM {WHITELIST} WHERE subject = '物理'")
def chapters_of(spark, sf_dir):
    return relational.chapters_of(model.chapters(spark), "物理")


@query(f"""
WITH each AS (SELECT subject, '"' || subject || '":[' || string_agg('"' || chapter || '"', ',' ORDER BY ord) || ']' AS part FROM {WHITELIST} GROUP BY subject)
SELECT '{{' || string_agg(part, ',' ORDER BY subject) || '}}' AS json FROM each
""")
def whitelist_map(spark, sf_dir):
    return relational.whitelist_map(model.chapters(spark)).select(F.to_json("whitelist").alias("json"))


@query("SELECT * FROM (VALUES (0, '數學', '實數', NULL, '3', 'q', NULL), (1, NULL, NULL, '單選', 'x', NULL, 'a')) AS t(idx, subject, chapter, question_type, difficulty, question_text, answer_text)")
def json_body(spark, sf_dir):
    return readers.read_batch(spark, '{"questions": [{"subject": "數學", "chapter": "實數", "difficulty": 3, "question_text": "q", "other": 1}, {"question_type": "單選", "difficulty": "x", "answer_text": "a"}]}')


@query("SELECT max(o_orderkey) + 1 AS id, 'one more' AS title, '7' AS student_name, '[3,1,2]' AS question_ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def add_paper(spark, sf_dir):
    return mutate.add_paper(_papers(spark, sf_dir), "one more", "7", [3, 1, 2]).filter("title = 'one more'").select("id", "title", "student_name", "question_ids")


@query("SELECT p_partkey AS id, base64(encode(p_name)) AS coded FROM part")
def base64(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.base64(F.col("p_name").cast("binary")).alias("coded"))


# ---- state, fairness, documents ------------------------------------------------------

DAY_MS = 86_400_000


@query(f"""
WITH RECURSIVE hits AS (
  SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS key, event_id AS seq, epoch_us(ts) // 1000 AS now, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events
), walk AS (
  SELECT key, seq, now, n, 1 AS hit_no, now + {DAY_MS} AS reset_ms FROM hits WHERE n = 1
  UNION ALL
  SELECT h.key, h.seq, h.now, h.n, CASE WHEN h.now >= w.reset_ms THEN 1 ELSE w.hit_no + 1 END, CASE WHEN h.now >= w.reset_ms THEN h.now + {DAY_MS} ELSE w.reset_ms END
  FROM walk w JOIN hits h ON h.key = w.key AND h.n = w.n + 1
)
SELECT key, seq, hit_no, hit_no <= 3 AS allowed, greatest(0, 3 - hit_no) AS remaining, reset_ms, CASE WHEN hit_no > 3 THEN CAST(ceil((reset_ms - now) / 1000) AS BIGINT) END AS retry_after_s FROM walk
""")
def rate_limit(spark, sf_dir):
    return limiter.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", DAY_MS, 3).drop("ts")


@query("SELECT user_id AS key, date_trunc('day', ts) AS start, count(*) AS hits FROM events GROUP BY ALL")
def tumbling_count(spark, sf_dir):
    return limiter.tumbling_count(table(spark, sf_dir, "events"), "user_id")


TRIALS = 10_000


def draws_sql(size: int) -> str:
    return f"""SELECT trial, value, CAST(row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|' || value), value) AS INTEGER) AS pos
FROM range({TRIALS}) AS t(trial), range({size}) AS v(value)"""


def draws(spark, size: int) -> DataFrame:
    from pyspark.sql.window import Window

    cells = spark.range(TRIALS * size).select(F.floor(F.col("id") / size).cast("long").alias("trial"), (F.col("id") % size).alias("value"))
    order = Window.partitionBy("trial").orderBy(F.md5(F.concat_ws("|", "trial", "value")), "value")
    return cells.withColumn("pos", F.row_number().over(order))


@query(f"SELECT pos, sum(n * n) * 5 / sum(n) - sum(n) AS chi2 FROM (SELECT pos, value, count(*) AS n FROM ({draws_sql(5)}) GROUP BY pos, value) GROUP BY pos")
def chi_square(spark, sf_dir):
    """Five items, so 4 degrees of freedom."""
    return fairness.position_chi2(draws(spark, 5), 5)


@query(f"""
SELECT count(*) AS distinct_orders, sum(n * n) * 24 / sum(n) - sum(n) AS chi2, max(n) / min(n) AS ratio
FROM (SELECT perm, count(*) AS n FROM (SELECT trial, string_agg(value, ',' ORDER BY pos) AS perm FROM ({draws_sql(4)}) GROUP BY trial) GROUP BY perm)
""")
def perm_ratio(spark, sf_dir):
    """Four items, so 24 orders."""
    return fairness.perm_stats(draws(spark, 4), 24)


@query()
def render_formulas(spark, sf_dir):
    return bank(spark, sf_dir).select("id", F.to_json(latex.render(F.col("question_text"))).alias("components"), latex.converts(F.col("question_text")).alias("converts"))


@query()
def tokenize_formulas(spark, sf_dir):
    latex.register(spark)
    bank(spark, sf_dir).createOrReplaceTempView("bank_texts")
    return spark.sql("SELECT id, t.pos, t.type, t.value FROM bank_texts, LATERAL tokenize(question_text) t")


def _papers(spark, sf_dir) -> DataFrame:
    """A paper per order: its parts in line order."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    # merge: the keys of orders alone look small enough for a broadcast up to millions of rows.
    o = table(spark, sf_dir, "orders").join(li.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("paper "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_custkey").cast("string").alias("student_name"), F.to_json("ids").alias("question_ids"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query()
def doc_plan(spark, sf_dir):
    asked = bank(spark, sf_dir).withColumn("question_img", F.lit(None).cast("string"))
    return document.doc_plan(_papers(spark, sf_dir), asked)


@query(f"""
WITH bank AS ({BANK}), l AS (SELECT l_orderkey AS paper_id, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
p AS (SELECT o_orderkey AS paper_id, o_custkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
q AS (SELECT l.paper_id, l.n, bank.* FROM l JOIN bank ON bank.id = l.id)
SELECT paper_id, 0 AS block_no, 'title' AS kind, 'paper ' || paper_id AS text FROM p
UNION ALL SELECT paper_id, 1, 'line', '學生姓名：' || o_custkey || '     |     得分：__________     |     列印日期：' || strftime(o_orderdate, '%Y/%-m/%-d') FROM p
UNION ALL SELECT paper_id, 2, 'line', repeat('=', 60) FROM p
UNION ALL SELECT paper_id, 3, 'heading', '一、 精選特訓試題區' FROM p
UNION ALL SELECT paper_id, 1099511627776, 'page_break', '' FROM p
UNION ALL SELECT paper_id, 1099511627777, 'heading', '🎯 參考答案區（解答邊界）' FROM p
UNION ALL SELECT paper_id, n * 8, 'question', '第 ' || n || ' 題. [' || question_type || '] (難度: ' || repeat('★', difficulty) || ')' FROM q
UNION ALL SELECT paper_id, n * 8 + 2199023255552, 'answer', '第 ' || n || ' 題答案：' FROM q
UNION ALL SELECT paper_id, n * 8 + 2, 'line', '' FROM q WHERE question_type IN ('計算', '證明')
UNION ALL SELECT paper_id, n * 8 + 3, 'line', '' FROM q WHERE question_type IN ('計算', '證明')
""")
def doc_blocks(spark, sf_dir):
    """The document plan without its formulas, which only a parser can give."""
    asked = bank(spark, sf_dir).withColumn("question_img", F.lit(None).cast("string"))
    return document.doc_plan(_papers(spark, sf_dir), asked, formulas=False)


def _escaped_sql(column: str) -> str:
    return f"replace(replace(replace(coalesce({column}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
SELECT id, string_agg('<tr><td>' || id || '</td><td>' || subject || '<br>' || chapter || '</td><td>' || CASE field WHEN 'question' THEN '題目' ELSE '答案' END || '</td><td>' ||
CASE sev WHEN 'error' THEN '嚴重' WHEN 'warn' THEN '警告' ELSE '提示' END || '</td><td>' || code || '</td><td><code>' ||
{_escaped_sql("substring(CASE field WHEN 'question' THEN question_text ELSE answer_text END, 1, 160)")} || '</code></td></tr>', '' ORDER BY field, sev, code) AS html
FROM ({AUDIT}) JOIN ({BANK}) q USING (id) GROUP BY id
""")
def audit_report(spark, sf_dir):
    q = bank(spark, sf_dir)
    return document.html_report(rules.audit(q), q)


_CELLS = " || '</td><td>' || ".join(_escaped_sql(c) for c in ("question_text", "nq", "answer_text", "na"))


@query(f"SELECT id, bucket, '<tr><td>' || id || '</td><td>' || {_CELLS} || '</td></tr>' AS html FROM ({CLASSIFIED}) WHERE bucket IS NOT NULL")
def repair_preview(spark, sf_dir):
    return document.html_preview(rules.classify(bank(spark, sf_dir)))
