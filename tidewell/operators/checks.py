"""Gates and comparisons of two relations: what is missing, extra, doubled or not as expected.

Each gives rows; leakage.gate() raises on them where a run must stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(left: DataFrame, right: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """by, both, missing (keys of left that right hasn't) and extra (of right that left hasn't)."""
    by = by or []
    a = left.select(*by, *key).distinct().withColumn("_a", F.lit(True))
    b = right.select(*by, *key).distinct().withColumn("_b", F.lit(True))
    met = a.join(b, [*by, *key], "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return met.groupBy(*by).agg(F.count_if(has("_a") & has("_b")).alias("both"), F.count_if(has("_a") & ~has("_b")).alias("missing"), F.count_if(~has("_a") & has("_b")).alias("extra"))


def missing_of(wanted: DataFrame, found: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by, wanted, missing: how many of the wanted keys weren't found."""
    marked = wanted.join(found.select(*key).distinct().withColumn("_f", F.lit(True)), key, "left")
    return marked.groupBy(*by).agg(F.count("*").alias("wanted"), F.count_if(F.col("_f").isNull()).alias("missing"))


def excluded(df: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(df without the listed keys, the listed keys that df doesn't have: an exclusion list must apply in full)."""
    own = listed.select(key).distinct()
    return df.join(own, key, "left_anti"), own.join(df.select(key), key, "left_anti")


def changed(shipped: DataFrame, again: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """by, rows, changed: of keys in both, how many have another value when it is computed again. Nulls are equal."""
    met = shipped.select(*dict.fromkeys([*key, *by]), F.col(value).alias("_s")).join(again.select(*key, F.col(value).alias("_v")), key)
    return met.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(~F.col("_s").eqNullSafe(F.col("_v"))).alias("changed"))


def one_value(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Groups whose column doesn't have exactly one value: by, values."""
    return df.groupBy(*by).agg(F.count_distinct(column).alias("values")).where("values <> 1")


def expected(df: DataFrame, by: list[str], counts: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """by, the counts, and as_expected: whether they are those of wanted (by, the same names). Groups that only one side has aren't."""
    own = df.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    met = own.join(wanted.select(*by, *(F.col(n).alias(f"_{n}") for n in counts)), by, "full_outer")
    same = F.lit(True)
    for n in counts:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return met.select(*by, *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), same.alias("as_expected"))


def validity(rows: DataFrame, listing: DataFrame, key: str, size: str, least: int, by: list[str]) -> DataFrame:
    """by, rows, absent (not listed) and small (listed, under `least`)."""
    met = rows.join(listing.select(key, F.col(size).alias("_size")), key, "left")
    return met.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("_size").isNull()).alias("absent"), F.count_if(F.col("_size") < least).alias("small"))


def imported(old: DataFrame, known: DataFrame, present: DataFrame, key: list[str], control: Column) -> DataFrame:
    """old with reason: why a legacy row isn't taken over (control, orphan, duplicate, present), or null. Of several rows of a key the first by `ord` counts."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    out = old.join(known.select(key[0]).distinct().withColumn("_k", F.lit(True)), key[0], "left").join(present.select(*key).distinct().withColumn("_p", F.lit(True)), key, "left")
    reason = F.when(control, "control").when(F.col("_k").isNull(), "orphan").when(F.col("_p"), "present").when(rank > 1, "duplicate")
    return out.withColumn("reason", reason).drop("_k", "_p")


def backfilled(df: DataFrame, sources: DataFrame, key: str, text: str, priority: str) -> DataFrame:
    """df with blank texts filled from the first source by priority that has one."""
    best = sources.where(F.trim(text) != "").groupBy(key).agg(F.min_by(text, priority).alias("_best"))
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return df.join(best, key, "left").withColumn(text, F.when(blank, F.coalesce("_best", F.lit(""))).otherwise(F.col(text))).drop("_best")


def last_by_name(df: DataFrame, replies: DataFrame, path: str, text: str, order: str) -> DataFrame:
    """df with the text whose file has the same name, whatever its folder; the last by `order` wins."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    best = replies.groupBy(name(path).alias("_name")).agg(F.max_by(text, order).alias(text))
    return df.withColumn("_name", name(path)).join(best, "_name", "left").drop("_name")


def first_or_default(df: DataFrame, table: DataFrame, key: list[str], order: str, defaults: dict[str, object]) -> DataFrame:
    """df with the values of table's first row for its key, or the defaults."""
    own = table.groupBy(*key).agg(*(F.min_by(c, order).alias(f"_{c}") for c in defaults))
    return df.join(own, key, "left").select(*df.columns, *(F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()))


def same_prompt(replies: DataFrame, wanted: DataFrame, key: list[str], prompt: str) -> DataFrame:
    """Replies to exactly the prompt that is asked now."""
    return replies.join(wanted.select(*key, F.col(prompt).alias("_p")), key).where(F.col(prompt) == F.col("_p")).drop("_p")


def arms(models: DataFrame, datasets: DataFrame, questions: DataFrame, seeds: DataFrame, overrides: Column) -> DataFrame:
    """Every combination of four short lists as an arm with its name; overrides: the steps of an arm. The result is as long as the product."""
    out = models.join(datasets, how="cross").join(questions, how="cross").join(seeds, how="cross")
    name = F.concat_ws("-", "model", "dataset", "question", F.concat(F.lit("s"), F.col("seed").cast("string")))
    return out.select(name.alias("arm"), "model", "dataset", "question", "seed", overrides.alias("steps"))


def described(arm: Column) -> list[Column]:
    """model, dataset, question and seed from an arm's name."""
    part = lambda k: F.regexp_extract(arm, r"^(.+)-([^-]+)-([^-]+)-s(\d+)$", k)
    return [part(1).alias("model"), part(2).alias("dataset"), part(3).alias("question"), part(4).cast("int").alias("seed")]
