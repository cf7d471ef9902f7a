"""Intervals in time: overlap with windows, the nearest event, runs of seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a_start, a_stop, b_start, b_stop) -> Column:
    """Strict at both ends: intervals that touch don't overlap."""
    return (a_start < b_stop) & (a_stop > b_start)


def window_labels(windows: DataFrame, annotations: DataFrame, key: str, length: float, default: str | None = None) -> DataFrame:
    """windows (key, index) with labels: the sorted labels of the annotations (key, start_time, stop_time, label) that overlap [index * length, (index + 1) * length).

    Each annotation is dealt to the windows that it may touch, so the join is by equality however many annotations a key has.
    """
    first, last = F.floor(F.col("start_time") / length).cast("int"), F.floor(F.col("stop_time") / length).cast("int")
    dealt = annotations.where("start_time < stop_time").select(key, "label", "start_time", "stop_time", F.explode(F.sequence(first, last)).alias("index"))
    touched = dealt.where(overlap(F.col("start_time"), F.col("stop_time"), F.col("index") * length, (F.col("index") + 1) * length))
    sets = touched.groupBy(key, "index").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    none = F.array(F.lit(default)) if default else F.array().cast("array<string>")
    return windows.join(sets, [key, "index"], "left").withColumn("labels", F.coalesce("labels", none))


def touched_windows(windows: DataFrame, annotations: DataFrame, key: str, length: float) -> DataFrame:
    """Windows with any annotation."""
    return window_labels(windows, annotations, key, length).where(F.size("labels") > 0).drop("labels")


def clipped(start: Column, stop: Column, window_start: Column, window_stop: Column) -> list[Column]:
    """An interval inside a window, in the window's own time."""
    return [(F.greatest(start, window_start) - window_start).alias("start"), (F.least(stop, window_stop) - window_start).alias("stop")]


def nearest_event(df: DataFrame, by: list[str], at: str, event: Column) -> DataFrame:
    """df with distance: how far the nearest event of the group is, to either side; 0 at an event, null without one."""
    w = Window.partitionBy(*by).orderBy(at)
    own = F.when(event, F.col(at))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("distance", F.least(F.col(at) - before, after - F.col(at)))


def islands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive integers: by, first, last."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return df.select(*by, at).distinct().withColumn("_run", F.col(at) - rank).groupBy(*by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_run")


def seconds_touched(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """A row for each whole second that an interval touches: by, second."""
    return df.where(F.col(stop) > F.col(start)).select(*by, F.explode(F.sequence(F.floor(start).cast("int"), F.ceil(stop).cast("int") - 1)).alias("second")).distinct()


def ranges_text(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, ranges: '1-3, 5', from islands()."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", one.alias("t")))).alias("r")).select(*by, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("ranges"))


def same_members(df: DataFrame, by: list[str], member: str, item: str) -> DataFrame:
    """Members of a group that have identical sets of items, together: by, items, members."""
    sets = df.groupBy(*by, member).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.groupBy(*by, "items").agg(F.array_sort(F.collect_list(member)).alias("members"))
