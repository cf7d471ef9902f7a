"""Plans of work: shards, groups of like tasks, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shards(todo: DataFrame, by: list[str], size: int = 1500) -> DataFrame:
    """A row for each shard of ceil(n / size): by, shard, shards."""
    n = todo.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("shards"))
    return n.select(*by, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "shards")


def grouped(tasks: DataFrame, needs: list[str], *fields: str) -> DataFrame:
    """Tasks with the same needs as one array, in order."""
    return tasks.groupBy(*needs).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tasks"), F.count("*").alias("n"))


def hours(steps: Column, per_step: Column, windows: Column, per_window: Column, gb: Column, startup: float = 0.4, per_gb: float = 0.015, train_margin: float = 1.5, score_margin: float = 1.25) -> list[Column]:
    """Hours of training and of scoring, loading included."""
    load = startup + per_gb * gb
    return [(load + steps * per_step / 3600 * train_margin).alias("train_h"), (load + windows * per_window / 3600 * score_margin).alias("score_h")]


def estimate(rows: Column, val_rows: Column, windows: Column, tokens: Column, per_step: Column, gb: Column, probe_step: Column, probe_window: Column, prefill: float, per_token: Column, reference: float, most_tokens: int, batch: int = 8, eval_steps: int = 100, epochs: int = 2,
             eval_row: float = 0.03, startup: float = 0.4, per_gb: float = 0.015, train_margin: float = 1.5, score_margin: float = 1.25) -> list[Column]:
    """steps, train_h, score_h and hours (with margins and loading) of a fine-tune.

    A probe's seconds, where there are any, stand for the base's; a window's seconds then follow from the answer's length against the
    longest. Without a probe they follow from the base's speed against a reference.
    """
    steps = epochs * F.ceil(rows / batch)
    evals = F.floor(steps / eval_steps) + 1
    step = F.coalesce(probe_step, per_step)
    window = F.when(probe_step.isNotNull(), probe_window * (0.1 + 0.9 * tokens / most_tokens)).otherwise(per_step / reference * (prefill + tokens * per_token))
    train = (steps * step + evals * val_rows * eval_row * step) / 3600
    score = windows * window / 3600
    return [steps.cast("long").alias("steps"), train.alias("train_h"), score.alias("score_h"), (startup + per_gb * gb + train_margin * train + score_margin * score).alias("hours")]


def multiplicity(gpus: Column) -> Column:
    """How many GPUs a request counts as: a slice ('3g.20gb:1') as one, else the number."""
    return F.when(F.contains(gpus, F.lit("g.")), 1).otherwise(gpus.cast("int"))


def gpu_hours(jobs: DataFrame, by: list[str], hours: str, gpus: str) -> DataFrame:
    """GPU hours by group; gpus as text."""
    return jobs.groupBy(*by).agg(F.sum(F.col(hours) * multiplicity(F.col(gpus))).alias("gpu_hours"))


def in_order(plan: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """plan with place, from 1 on, in one order of all rows."""
    from tidewell.operators.ranks import evenly

    return evenly(plan, [], order).withColumn(place, F.col("_at") + 1).drop("_at", "_n")


def staged(models: DataFrame, listing: DataFrame, key: str = "model") -> tuple[DataFrame, DataFrame]:
    """(models whose weights are there, those whose aren't)."""
    return models.join(listing.select(key).distinct(), key, "left_semi"), models.join(listing.select(key).distinct(), key, "left_anti")


def peak_fits(a: Column, b: Column, limit: float) -> list[Column]:
    """The greater of two peaks, and whether it is under the limit."""
    peak = F.greatest(a, b)
    return [peak, peak < limit]


def largest_first(groups: DataFrame, size: str, key: str) -> DataFrame:
    """groups with place: the largest first, ties by key. groups is a small table, such as one of jobs."""
    from pyspark.sql import Window

    return groups.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(size), key)))
