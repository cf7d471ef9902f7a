"""Duplicates: first and last rows of a key, groups of equal content, and the patients that these tie together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.folders import saved


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; order must leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return first_of(df, key, [o.desc() for o in order])


def groups(df: DataFrame, content: str, owner: str) -> DataFrame:
    """Contents that several rows have: n rows, owners, and whether they cross owners."""
    return df.groupBy(content).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners")).where("n > 1").withColumn("crosses", F.col("owners") > 1)


def conflicting(df: DataFrame, content: str, labels: str) -> DataFrame:
    """Contents whose rows don't all have the same labels."""
    return df.groupBy(content).agg(F.count_distinct(labels).alias("answers")).where("answers > 1")


def later_copies(df: DataFrame, text: str, order: list) -> DataFrame:
    """Rows whose text an earlier row has."""
    rank = F.row_number().over(Window.partitionBy(text).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank > 1").drop("_rank")


def merged_owners(df: DataFrame, content: str, owner: str) -> DataFrame:
    """(owner, canonical): owners that share content, through any chain, with the smallest of them. Owners alone are absent.

    Least labels travel from owners to contents and back, and each label is replaced by its own label's label, until nothing
    changes; a round is two groupings with partial minima.
    """
    pairs = df.select(F.col(content).alias("c"), F.col(owner).alias("o")).distinct()
    shared = pairs.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    pairs = saved(pairs.join(shared, "c", "left_semi"))
    label = saved(pairs.select("o").distinct().withColumn("l", F.col("o")))
    while True:
        of_content = pairs.join(label, "o").groupBy("c").agg(F.min("l").alias("l"))
        least = pairs.join(of_content, "c").groupBy("o").agg(F.min("l").alias("l"))
        jump = label.select(F.col("o").alias("l"), F.col("l").alias("l2"))
        new = saved(least.join(jump, "l", "left").select("o", F.least("l", F.coalesce("l2", "l")).alias("l")))
        same = new.alias("a").join(label.alias("b"), (F.col("a.o") == F.col("b.o")) & (F.col("a.l") != F.col("b.l"))).isEmpty()
        label = new
        if same:
            return label.select(F.col("o").alias("owner"), F.col("l").alias("canonical"))
