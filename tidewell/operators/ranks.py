"""Ranks and running sums in groups that may hold most of a table.

The order is cut into buckets that follow it; sums of whole buckets are a small table, and only a bucket's rows are sorted in one
task. Hash orders are cut by the hash's first digits, so buckets are even whatever the keys are. Other orders are cut by Spark's
range partitioning, whose cut points are a sample's: buckets are even and keep ties together, whatever the values are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.folders import saved


ROWS = 400_000  # rows that a task sorts
FEW = 10  # parts of a table that is left to Spark


def dealt(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """df, of about `rows` rows, dealt by key into parts of ROWS, shuffles' partitions at least, so that a task's share doesn't grow with the table; a small table stays as it is."""
    parts = -(-rows // ROWS)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key) if parts > FEW else df


def shuffled(seed, *key: Column) -> Column:
    """A value to order by, like a shuffle that is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))


def hash_bucket(h: Column) -> Column:
    """4096 buckets in the order of an md5."""
    return F.substring(h, 1, 3)


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of the same names, nulls equal."""
    if not by:
        return left.join(F.broadcast(right), how="cross")  # right: one row
    named = right.select(*(F.col(c).alias(f"_on_{c}") for c in by), *(c for c in right.columns if c not in by))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by))
    return left.join(named, met, how).drop(*(f"_on_{c}" for c in by))


def placed(df: DataFrame, by: list[str], bucket: Column, order: list, at: str = "_at", n: str = "_n", size: Column | None = None) -> DataFrame:
    """df with `at`, how many rows of the group come before each (or with size, their sum), and `n`, the group's rows (or sum).

    bucket must not decrease along order; order must leave no ties.
    """
    value = F.lit(1).cast("long") if size is None else size
    marked = df.withColumn("_bucket", bucket)
    sums = marked.groupBy(*by, "_bucket").agg(F.sum(value).alias("_own"))
    group = Window.partitionBy(*(F.col(c) for c in by)) if by else Window.partitionBy(F.lit(0))  # of the small table
    before = F.coalesce(F.sum("_own").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = sums.select(*by, "_bucket", before.alias("_before"), F.sum("_own").over(group).alias(n))
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return matched(marked.withColumn("_inside", inside), table, [*by, "_bucket"]).withColumn(at, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def ranged(df: DataFrame, by: list[str], order: list, parts: int | None = None) -> DataFrame:
    """df with _bucket, the number of the range of (by, order) that it lies in; written once, so that every reader sees the same cuts."""
    keys = [F.col(c) for c in by] + order
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return saved(dealt.withColumn("_bucket", F.spark_partition_id()), "ranges")


def evenly(df: DataFrame, by: list[str], order: list, at: str = "_at", n: str = "_n", size: Column | None = None, parts: int | None = None) -> DataFrame:
    """placed() in any order; order must leave no ties."""
    return placed(ranged(df, by, order, parts), by, F.col("_bucket"), order, at, n, size)


def by_hash(df: DataFrame, by: list[str], key: list[Column], seed=0, at: str = "_at", n: str = "_n", size: Column | None = None) -> DataFrame:
    """placed() in the order of hashes of the key."""
    marked = df.withColumn("_hash", shuffled(seed, *key))
    return placed(marked, by, hash_bucket(F.col("_hash")), ["_hash", *key], at, n, size).drop("_hash")


def first_by_hash(df: DataFrame, by: list[str], key: list[Column], n: int, seed=0, at: str = "_at") -> DataFrame:
    """The first n rows of each group of by_hash(), with `at`. Buckets are counted first, so only rows of those that hold the first n move; groups are few."""
    marked = df.withColumn("_hash", shuffled(seed, *key)).withColumn("_bucket", hash_bucket(F.col("_hash")))
    sums = marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_own"))
    group = Window.partitionBy(*(F.col(c) for c in by))
    before = F.coalesce(F.sum("_own").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = sums.withColumn("_before", before).where(F.col("_before") < n).select(*by, "_bucket")
    few = matched(marked, F.broadcast(table), [*by, "_bucket"])
    rank = F.row_number().over(group.orderBy("_hash", *key)) - 1
    return few.withColumn(at, rank).where(F.col(at) < n).drop("_hash", "_bucket")
