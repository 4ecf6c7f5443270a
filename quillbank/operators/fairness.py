"""Is a draw fair? Chi-square over positions and over permutations.

draws: (trial, value, pos). All figures are grouped counts; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position_chi2(draws: DataFrame, size: int) -> DataFrame:
    """(pos, chi2) of how often each of ``size`` values stands at each position."""
    cells = draws.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("o"))
    per = cells.groupBy("pos").agg(F.sum("o").alias("total"), F.sum(F.col("o") * F.col("o")).alias("squares"))
    # Sum of (o - e)^2 / e with e = total / size, cells that never occur included.
    return per.select("pos", (F.col("squares") * size / F.col("total") - F.col("total")).alias("chi2"))


def permutations(draws: DataFrame) -> DataFrame:
    """(perm, n): how often each order occurs. A trial has few values, so its order fits a row."""
    orders = draws.groupBy("trial").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"].cast("string")), ",").alias("perm"))
    return orders.groupBy("perm").agg(F.count(F.lit(1)).alias("n"))


def perm_stats(draws: DataFrame, orders: int) -> DataFrame:
    """One row: orders that occur, chi-square against ``orders`` equally likely ones, and most over least frequent."""
    tally = permutations(draws)
    total, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return tally.agg(F.count(F.lit(1)).alias("distinct_orders"), (squares * orders / total - total).alias("chi2"), (F.max("n") / F.min("n")).alias("ratio"))
