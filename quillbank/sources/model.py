"""The data model: schemas, the two small dimensions, and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Subjects with their chapters in syllabus order, question types in paper order, defaults.
CHAPTERS = {
    "數學": [
        "實數", "絕對值", "指數與對數", "直線方程式", "圓方程式", "多項式除法", "三次函數",
        "數列與級數", "排列", "組合", "古典機率", "期望值", "一維數據分析", "二維數據分析",
        "三角函數的定義", "正弦與餘弦定理", "三角測量", "向量的加減與係數積", "向量內積", "面積與行列式",
        "空間概念與座標系", "空間向量內積", "外積", "平面方程式", "空間直線方程式", "矩陣的加減與乘法", "克拉瑪公式",
        "數列的極限", "函數的極限", "微分導函數", "函數圖形與極值", "定積分與面積", "隨機變數", "常態分配",
    ],
    "物理": [
        "科學的態度與方法", "物質的組成（夸克與原子）", "物體的運動（速度與加速度）", "四大基本交互作用", "能量的形式與守恆", "量子現象（光電效應與波粒二象性）", "宇宙學簡介",
        "直線運動", "平面運動", "牛頓運動定律", "摩擦力與向心力", "動量與衝量", "動量守恆與碰撞",
        "功與動能", "位能與能量守恆", "重力場與重力位能", "剛體轉動與平衡", "簡諧運動(SHM)", "流體的壓力與浮力",
        "波動的性質", "聲波與交互作用", "幾何光學（反射折射）", "物理光學（干涉繞射）",
        "靜電學", "電場與電位", "電流與電路", "電流磁效應", "電磁感應", "交流電",
        "近代物理的序幕", "原子結構與光譜", "核物理與基本粒子",
    ],
}
TYPE_WEIGHTS = {"單選": 1, "多選": 2, "填空": 3, "計算": 4, "證明": 5}
OTHER_WEIGHT = 99
DEFAULT_TYPE, DEFAULT_DIFFICULTY, DEFAULT_ANSWER = "填空", 3, "略"
MAX_DRAW, PAGE_SIZE, MAX_PAGE_SIZE = 50, 20, 100
MAX_PDF_BYTES, MAX_IMAGE_BYTES, MAX_JSON_BYTES = 15 << 20, 5 << 20, 2 << 20
WINDOW_MS, MAX_HITS = 60_000, 10

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("subject", T.StringType(), False), T.StructField("chapter", T.StringType(), False),
    T.StructField("question_type", T.StringType(), False), T.StructField("difficulty", T.IntegerType(), False),
    T.StructField("question_text", T.StringType()), T.StructField("question_img", T.StringType()), T.StructField("answer_text", T.StringType()),
    T.StructField("solution_img", T.StringType()), T.StructField("history_json", T.StringType()), T.StructField("created_at", T.TimestampType()),
])
PAPER_SCHEMA = "id long, title string, student_name string, question_ids string, created_at timestamp"
INCOMING_SCHEMA = "idx int, subject string, chapter string, question_type string, difficulty string, question_text string, answer_text string"
EXTRACTED_SCHEMA = "array<struct<subject:string,chapter:string,question_type:string,difficulty:string,question_text:string,answer_text:string>>"


def chapters(spark: SparkSession) -> DataFrame:
    """(subject, chapter, ord): 66 rows, so it may always be broadcast."""
    rows = [(s, c, i) for s, names in CHAPTERS.items() for i, c in enumerate(names, 1)]
    return spark.createDataFrame(rows, "subject string, chapter string, ord int")


def question_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPE_WEIGHTS.items()), "question_type string, weight int")
