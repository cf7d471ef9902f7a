"""Scores of probabilities: AUROC with ties, threshold rates, and roll-ups from windows to recordings to patients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import divide
from tidewell.operators.bootstrap import interval, weighted
from tidewell.operators.ranks import dealt, evenly
from tidewell.sources.folders import saved

def auroc_of_counts(each: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, score, p, n) rows, one for each distinct score -> by, positives, negatives, auroc."""
    below = evenly(each, by, [score], at="_below", n="_all", size=F.col("n"))
    won = F.col("p") * (F.col("_below") + F.col("n") / 2)
    sums = below.withColumn("won", won).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return sums.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("won") / (F.col("positives") * F.col("negatives"))).alias("auroc"))


def counted(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Positives p and negatives n of each distinct score; NaN and null scores are left out."""
    real = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return real.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))


def auroc(df: DataFrame, by: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """The probability that a positive scores above a negative, ties counted half; null with one class only.

    Rows are first counted by distinct score, and scores are sorted in even ranges, so no task holds all scores of a group.
    """
    return auroc_of_counts(counted(df, by, score, positive), by, score)


def auroc_interval(df: DataFrame, cluster: str, by: list[str], score: str = "score", positive: str = "positive", replicates: int = 1000) -> DataFrame:
    """by, low, high of the AUROC, by resampling clusters: a replicate weighs each cluster's counts by score."""
    again = weighted(counted(df, [*by, cluster], score, positive), cluster, [*by, score], ["p", "n"], replicates)
    return interval(auroc_of_counts(again, [*by, "replicate"], score), by, "auroc")


def balanced_accuracy_interval(df: DataFrame, cluster: str, by: list[str], score: str = "score", positive: str = "positive", threshold: float = 0.5, replicates: int = 1000) -> DataFrame:
    """by, low, high of the balanced accuracy at a threshold, by resampling clusters."""
    p, y = F.col(score) >= threshold, F.col(positive)
    counts = df.groupBy(*by, cluster).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    again = weighted(counts, cluster, by, ["tp", "fp", "fn", "tn"], replicates)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return interval(again.withColumn("ba", (divide(tp, tp + fn) + divide(tn, tn + fp)) / 2), by, "ba")


def auroc_against(df: DataFrame, by: list[str], against: str, kinds: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """The AUROC of the positives against each kind of negatives (the values of `against`): by, against, positives, negatives, auroc."""
    both = df.withColumn("_k", F.when(F.col(positive), F.array(*map(F.lit, kinds))).otherwise(F.array(F.col(against)))).withColumn("_k", F.explode("_k"))
    return auroc(both.where(F.col("_k").isin(kinds)).drop(against).withColumnRenamed("_k", against), [*by, against], score, positive)


def within_positive_groups(df: DataFrame, group: list[str], positive: str = "positive") -> DataFrame:
    """Rows of the groups that have a positive one."""
    return df.join(df.where(positive).select(*group).distinct(), group, "left_semi")


def at_threshold(df: DataFrame, by: list[str], score: str = "score", positive: str = "positive", threshold: float = 0.5) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy, precision, F1 and the share predicted positive."""
    p, y = F.col(score) >= threshold, F.col(positive)
    n = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    return n.select(*by, *threshold_figures())


def threshold_figures() -> list[Column]:
    """The rates that follow from tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sens, spec = divide(tp, tp + fn), divide(tn, tn + fp)
    return [
        ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), divide(tp, tp + fp).alias("precision"),
        divide(2 * tp, 2 * tp + fp + fn).alias("f1"), divide(tp + fp, tp + fp + fn + tn).alias("predicted_positive"),
    ]


def top_sums(df: DataFrame, by: list[str], order: list[Column], score: str = "score", k: int = 5) -> DataFrame:
    """by, total and n: the sum of each group's k highest scores, and how many they are; order breaks ties."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy(*by).agg(F.sum(score).alias("total"), F.count("*").alias("n"))


def top_mean(df: DataFrame, by: list[str], order: list[Column], score: str = "score", k: int = 5) -> DataFrame:
    """The mean of each group's k highest scores."""
    return top_sums(df, by, order, score, k).select(*by, (F.col("total") / F.col("n")).alias(score))


def mean_of_means(sums: DataFrame, by: list[str], k: int, score: str = "score", *flags: str) -> DataFrame:
    """The mean over rows of total / n, with n up to k, and whether each flag holds in any row. Totals are brought to one denominator, so whole numbers stay exact up to one division."""
    whole = math.lcm(*range(1, k + 1))
    parts = F.sum(F.col("total") * (F.lit(whole) / F.col("n")).cast("long"))
    return sums.groupBy(*by).agg((parts / (whole * F.count("*"))).alias(score), *(F.bool_or(f).alias(f) for f in flags))


def bucket(distance: Column) -> Column:
    """The band of a distance in windows to the nearest event."""
    return F.when(distance.isNull(), "none").when(distance <= 2, "1-2").when(distance <= 10, "3-10").otherwise(">10")


def specificity_by(df: DataFrame, by: list[str], score: str = "score", threshold: float = 0.5) -> DataFrame:
    """The share of (negative) rows below the threshold."""
    return df.groupBy(*by).agg(F.count("*").alias("windows"), F.avg((F.col(score) < threshold).cast("double")).alias("specificity"))


def same_everywhere(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Groups whose scores are one value, rounded to 6 places: by, n. A gate fails on rows in it."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(F.round(score, 6)).alias("values")).where("values = 1").drop("values")


def stays_blind(checks: DataFrame, by: list[str], order: list, flag: str = "blind", first: int = 2) -> DataFrame:
    """by, stop: whether a run was blind at each of its first checks; false with fewer."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    early = checks.withColumn("_r", rank).where(F.col("_r") <= first)
    return early.groupBy(*by).agg((F.bool_and(flag) & (F.count("*") == first)).alias("stop"))


def blind(df: DataFrame, by: list[str], score: str = "score", positive: str = "positive", spread: float = 0.1, least: float = 0.6, enough: int = 3) -> DataFrame:
    """Whether a model's scores hardly follow its input: little spread and a poor AUROC. Groups with fewer than `enough` of either class aren't judged."""
    std = df.groupBy(*by).agg(F.stddev_pop(score).alias("spread"))
    return auroc(df, by, score, positive).where((F.col("positives") >= enough) & (F.col("negatives") >= enough)).join(std, by).withColumn("blind", (F.col("spread") < spread) & (F.col("auroc") < least))


def arm_figures(df: DataFrame, by: list[str], group: list[str], subset: Column, score: str = "score", positive: str = "positive", threshold: float = 0.5) -> DataFrame:
    """by, windows, auroc, auroc_within (groups with a positive), auroc_subset and the rates at the threshold, all from one table of counts by score."""
    each = df.withColumn("_sub", subset).groupBy(*by, *group, score, "_sub").agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    busy = F.sum("p").over(Window.partitionBy(*by, *group)) > 0
    counts = saved(each.withColumn("_busy", busy).groupBy(*by, score, "_busy", "_sub").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "counts by score")
    kinds = F.array_compact(F.array(F.lit("auroc"), F.when(F.col("_busy"), "auroc_within"), F.when(F.col("_sub"), "auroc_subset")))
    real = counts.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    parts = real.withColumn("_kind", F.explode(kinds)).groupBy(*by, "_kind", score).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    areas = auroc_of_counts(parts, [*by, "_kind"], score).groupBy(*by).agg(*(F.max(F.when(F.col("_kind") == k, F.col("auroc"))).alias(k) for k in ("auroc", "auroc_within", "auroc_subset")))
    high = F.col(score) >= threshold
    n = counts.groupBy(*by).agg(F.sum(F.col("p") + F.col("n")).alias("windows"), *(F.sum(F.when(test, F.col(c)).otherwise(0)).alias(name) for name, test, c in (("tp", high, "p"), ("fp", high, "n"), ("fn", ~high, "p"), ("tn", ~high, "n"))))
    return n.join(areas, by, "left").select(*by, "windows", "auroc", "auroc_within", "auroc_subset", *threshold_figures())


def background_figures(scored: DataFrame, new: DataFrame, meta: DataFrame, by: list[str], threshold: float = 0.5, rows: int = 0) -> DataFrame:
    """by, and the figures of an arm's windows with an event against its old background and against a new one.

    scored: by, path, score, positive; new: by, path, score, at (of several the last counts); meta: path, quiet (whether its recording
    has no event), distance (windows to the nearest). New windows without metadata count in what needs none. AUROCs are null, rates
    0.0, where there is nothing to divide. rows: about how many new windows there are, so that tasks' shares don't grow with them.
    """
    from tidewell.operators.dedup import last_of

    fresh = last_of(dealt(new, ["path"], rows), [*by, "path"], [F.col("at")]).join(meta, "path", "left")
    low, d = F.col("score") < threshold, F.col("distance")
    rate = lambda test, among: divide(F.count_if(test & among), F.count_if(among))
    own = scored.groupBy(*by).agg(F.count_if("positive").alias("event_windows"), rate(~low, F.col("positive")).alias("sensitivity"), rate(low, ~F.col("positive")).alias("specificity_old"))
    bands = {"specificity_quiet": F.coalesce("quiet", F.lit(False)), "specificity_1_2": F.coalesce(d.between(1, 2), F.lit(False)), "specificity_3_10": F.coalesce(d.between(3, 10), F.lit(False)), "specificity_over_10": F.coalesce(d > 10, F.lit(False))}
    found = fresh.groupBy(*by).agg(F.count("*").alias("new_windows"), rate(low, F.lit(True)).alias("specificity_new"), *(rate(low, test).alias(n) for n, test in bands.items()))
    events = scored.where("positive").select(*by, "score", "positive")
    a = auroc(events.unionByName(fresh.select(*by, "score", F.lit(False).alias("positive"))), by).select(*by, F.col("auroc").alias("auroc_new"))
    b = auroc(scored, by).select(*by, F.col("auroc").alias("auroc_old"))
    out = own.join(found, by).join(a, by).join(b, by)
    return out.withColumn("balanced_accuracy_new", (F.col("sensitivity") + F.col("specificity_new")) / 2)
