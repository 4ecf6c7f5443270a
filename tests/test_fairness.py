"""Draws are fair, and the test can tell: a biased shuffle must fail it."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbank.operators import fairness, relational

TRIALS = 10_000
# Chi-square limits at p = 0.001 for 4 and 23 degrees of freedom.
POSITION_LIMIT, ORDER_LIMIT = 18.467, 49.728


def draws(spark, size):
    cells = spark.range(TRIALS * size).select(F.floor(F.col("id") / size).alias("trial"), (F.col("id") % size).alias("value"))
    key = F.md5(F.concat(F.lit("20260801|"), F.col("trial").cast("string"), F.lit("|"), F.col("value").cast("string")))
    return cells.withColumn("pos", F.row_number().over(Window.partitionBy("trial").orderBy(key, "value")))


def biased(spark, size):
    rng, rows = random.Random(5), []
    for t in range(TRIALS):
        order = []
        for v in range(size):
            # Insertion with a coin for each comparison, as sorting by a random comparator does.
            at = len(order)
            while at and rng.random() < 0.5:
                at -= 1
            order.insert(at, v)
        rows += [(t, v, p + 1) for p, v in enumerate(order)]
    return spark.createDataFrame(rows, "trial long, value long, pos int")


def test_positions(spark):
    fair = [r.chi2 for r in fairness.position_chi2(draws(spark, 5), 5).collect()]
    assert len(fair) == 5 and max(fair) < POSITION_LIMIT
    assert max(r.chi2 for r in fairness.position_chi2(biased(spark, 5), 5).collect()) > 100


def test_orders(spark):
    fair = fairness.perm_stats(draws(spark, 4), 24).first()
    assert fair.distinct_orders == 24 and fair.chi2 < ORDER_LIMIT and fair.ratio < 1.5
    unfair = fairness.perm_stats(biased(spark, 4), 24).first()
    assert unfair.chi2 > 500 and unfair.ratio > 3


def test_sampling_is_a_permutations_prefix(spark):
    bank = spark.range(50)
    order = [r.id for r in relational.permute(bank, "s").orderBy("pos").collect()]
    assert sorted(order) == list(range(50)) and order != list(range(50))
    assert {r.id for r in relational.sample_k(bank.repartition(4), 7, "s").collect()} == set(order[:7])
    assert relational.permute(bank.limit(0), "s").count() == 0
