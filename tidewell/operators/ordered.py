"""Analytics along an order: ordinals, latest values, streaks, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(by: list[str], order: list) -> Column:
    """0, 1, ... in each group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, by: list[str], at: Column, *values: str) -> DataFrame:
    """Each value at the highest place; a combinable aggregate, so nothing is sorted."""
    return df.groupBy(*by).agg(*(F.max_by(v, at).alias(v) for v in values))


def merged(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """Several entries of a key as one: of each value the last that isn't null."""
    return df.groupBy(*by).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def moving_average(value: str, by: list[str], order: list, width: int = 5) -> Column:
    """The mean of the width values around each; beyond the ends the first and last value go on."""
    side = width // 2
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(value).over(w.rowsBetween(-side, side))
    at, n = F.row_number().over(w), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), side + 1 - at), F.greatest(F.lit(0), at + side - n)
    return (total + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / width


def streaks(df: DataFrame, by: list[str], order: list, failed: Column) -> DataFrame:
    """df with streak: how many failures in a row end here."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_f", failed).withColumn("_block", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    run = F.count_if("_f").over(Window.partitionBy(*by, "_block").orderBy(*order))
    return out.withColumn("streak", F.when(F.col("_f"), run).otherwise(0)).drop("_f", "_block")


def one_of_each_half(df: DataFrame, by: list[str], order: list, pick: list) -> DataFrame:
    """From the first and the second half of each group the row that comes first by pick."""
    w = Window.partitionBy(*by)
    out = df.withColumn("_half", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) / 2))
    return top(out, [*by, "_half"], pick, 1).drop("_half")


def inner_windows(df: DataFrame, by: list[str], at: str, n: int = 12) -> DataFrame:
    """n evenly spaced windows of each recording. Recordings scanned in full (they have window 0) lose their first and last; those with fewer than n left go."""
    w = Window.partitionBy(*by)
    low, high = F.min(at).over(w), F.max(at).over(w)
    inner = df.withColumn("_low", low).withColumn("_high", high).where((F.col("_low") != 0) | ((F.col(at) != F.col("_low")) & (F.col(at) != F.col("_high"))))
    ranked = inner.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(at)) - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1)).cast("int"))
    return ranked.where((F.col("_n") >= n) & F.array_contains(picks, F.col("_at"))).drop("_low", "_high", "_n", "_at")


def average_rank(by: list[str], value: str) -> Column:
    """The rank of a value from 1 on; equal ones share the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def first_where(df: DataFrame, by: list[str], order: list, test: Column) -> DataFrame:
    """The first row of each group that passes the test; groups without one are absent."""
    return top(df.where(test), by, order, 1)


def first_only(df: DataFrame, by: list[str], order: list, column: str) -> DataFrame:
    """df with the column blank in all rows of a group but the first."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn(column, F.when(first, F.col(column)).otherwise(F.lit("")))


def marked(df: DataFrame, by: list[str], at: str, score: str) -> DataFrame:
    """df with best (the highest score, the earliest of equal ones) and last, for the checkpoints of each run."""
    ends = df.groupBy(*by).agg(F.max(at).alias("_last"), F.max_by(at, F.struct(F.col(score), -F.col(at))).alias("_best"))
    return df.join(ends, by).withColumn("best", F.col(at) == F.col("_best")).withColumn("last", F.col(at) == F.col("_last")).drop("_best", "_last")
