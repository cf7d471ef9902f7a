"""Samples without random numbers: even spacing, turns, running totals, quotas, and ranks of md5 hashes.

Groups that are small by nature (recordings, the classes of a patient) are sorted in one task each; where a whole class or table is
one group, ranks come from buckets of the order (see ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import divide, spaced
from tidewell.operators.ranks import by_hash, evenly, hash_bucket, matched, placed
from tidewell.sources.folders import saved


MOST_CLASSES = 10_000


def spread(df: DataFrame, by: list[str], order: list, cap: Column | int | None) -> DataFrame:
    """At most cap rows of each group, evenly spaced in the order; all for a cap that is null, 0 or less, or not below their number."""
    return _numbered(df, by, order).where(_stays(cap if isinstance(cap, Column) else F.lit(cap).cast("int"))).drop("_n", "_at")


def spread_by_caps(df: DataFrame, by: list[str], order: list, caps: list[int | None], cap: str = "cap") -> DataFrame:
    """spread() for each of several caps: df with cap. Groups are sorted once, whatever the number of caps."""
    each = (F.lit(c).cast("int") for c in caps)
    kept = F.array_compact(F.array(*(F.when(_stays(c), F.struct(c.alias(cap))) for c in each)))
    return _numbered(df, by, order).select(*df.columns, F.inline(kept))


def _numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df with _n, the rows of each group, and _at, the place of each; both from one sort."""
    own = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_at", F.row_number().over(own) - 1)


def _stays(cap: Column) -> Column:
    return cap.isNull() | (cap <= 0) | (cap >= F.col("_n")) | F.array_contains(spaced(F.col("_n"), cap), F.col("_at"))


def round_robin(df: DataFrame, by: list[str], group: str, order: list, budget: str | int) -> DataFrame:
    """The first `budget` rows of each by, one of each group a turn, groups in order."""
    turn = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    # a group's turns beyond the budget can't be reached
    ranked = df.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    return evenly(saved(ranked, "turns"), by, ["_turn", group]).where(F.col("_at") < limit).drop("_turn", "_at", "_n")


def running_split(units: DataFrame, size: str, key: list[Column], share: float, by: list[str] | None = None, seed=0) -> DataFrame:
    """units with split: in the order of the keys' hashes, test for those that begin before the test's share of all sizes, rounded to even, is reached, train for others."""
    out = by_hash(units, by or [], key, seed, size=F.col(size))
    return out.withColumn("split", F.when(F.col("_at") < F.bround(share * F.col("_n")), "test").otherwise("train")).drop("_at", "_n")


def cut_in_three(units: DataFrame, size: str, key: list[Column], test: float, val: float, seed=0) -> DataFrame:
    """units with split, in the order of hashes: test until its share of all sizes is reached, then val until both shares are, then train."""
    out = by_hash(units, [], key, seed, size=F.col(size))
    split = F.when(F.col("_at") < test * F.col("_n"), "test").when(F.col("_at") < (test + val) * F.col("_n"), "val").otherwise("train")
    return out.withColumn("split", split).drop("_at", "_n")


def systematic(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """Every k-th row, k = n div most, and of these the first `most`."""
    ranked = evenly(df, by, order)
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    return ranked.where((F.col("_at") % step == 0) & (F.col("_at") / step < most)).drop("_n", "_at")


def sharded(df: DataFrame, by: list[str], order: list, shards: Column | int, shard: str = "shard") -> DataFrame:
    """df with the shard of each row when rows are dealt in turn."""
    return evenly(df, by, order).withColumn(shard, F.col("_at") % shards).drop("_n", "_at")


def stratified(df: DataFrame, by: list[str], key: list[Column], most: Column | int, seed=0) -> DataFrame:
    """At most `most` rows of each stratum, by the rank of their hashes; a smaller `most` takes a subset."""
    return by_hash(df, by, key, seed).where(F.col("_at") < most).drop("_n", "_at")


def nested_fraction(df: DataFrame, by: list[str], key: list[Column], fraction: Column | float, seed=0) -> DataFrame:
    """The first round(fraction * n) of each stratum by hash rank; fractions nest."""
    return by_hash(df, by, key, seed).where(F.col("_at") < F.bround(fraction * F.col("_n"))).drop("_n", "_at")


def largest_remainder(strata: DataFrame, size: str, key: str, seats: int) -> DataFrame:
    """strata with quota: seats in proportion to size, remainders to the largest fractions, ties by key. strata is a small table."""
    whole = Window.partitionBy(F.lit(0))
    exact = seats * F.col(size) / F.sum(size).over(whole)
    out = strata.withColumn("_exact", exact).withColumn("_low", F.floor("_exact").cast("long"))
    left = seats - F.sum("_low").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("_low") - F.col("_exact"), key))
    return out.withColumn("_left", left).withColumn("_rank", rank).withColumn("quota", F.col("_low") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_exact", "_low", "_left", "_rank")


def proportional(pool: DataFrame, stratum: str, key: list[Column], need: int, seed=0) -> DataFrame:
    """`need` rows of the pool (all, if it has fewer), from each stratum in proportion to it by largest remainders, there by the rank of their hashes. Strata are a small table."""
    sizes = pool.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    quotas = largest_remainder(sizes, "_size", stratum, min(need, total)).select(stratum, "quota")
    return matched(by_hash(pool, [stratum], key, seed), quotas, [stratum]).where(F.col("_at") < F.col("quota")).drop("_at", "_n", "quota")


def rate_balance(df: DataFrame, pattern: str, positive: str, key: list[Column], seed=0) -> DataFrame:
    """Rows whose pattern's share of positives is trimmed to that of all rows; the empty pattern stays."""
    total = df.agg(F.avg(F.col(positive).cast("double")).alias("rate"))
    stats = df.groupBy(pattern).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    r, p, q = F.col("rate"), F.col("_p"), F.col("_q")
    above = p > r * (p + q)
    quota = F.when(above, F.bround(divide(q * r, 1 - r))).otherwise(F.least(q, F.bround(divide(p * (1 - r), r))))
    limits = stats.join(F.broadcast(total), how="cross").select(pattern, above.alias("_above"), quota.alias("_quota"), ((r > 0) & (r < 1) & (F.col(pattern) != "")).alias("_trim"))  # total: one row
    ranked = by_hash(matched(df, limits, [pattern]), [pattern, positive], key, seed)
    return ranked.where(~F.col("_trim") | (F.col("_above") != F.col(positive)) | (F.col("_at") < F.col("_quota"))).drop("_above", "_quota", "_trim", "_at", "_n")


def validation_patients(members: DataFrame, patient: str, cls: str, fraction: float = 0.05, least: int = 10) -> DataFrame:
    """(patient, class) rows -> the chosen patients: a count of min(max(ceil(n * fraction), least), n div 2), the first of each class in hash order, rarest class first unless one of it is chosen, then by hash order.

    Classes are a registry's, MOST_CLASSES at most: a class's first patient and the other classes that this patient has come to
    the driver, a row for each class. Patients are ranked in buckets of their hashes.
    """
    every = members.select(patient, cls).distinct()
    hashed = F.md5(F.col(patient).cast("string").cast("binary"))
    ranked = every.groupBy(patient).agg(F.collect_set(cls).alias("classes")).withColumn("h", hashed)
    n = ranked.count()
    wanted = min(max(-int(-n * fraction // 1), least), n // 2)
    own = F.struct("h", F.col(patient).alias("p"), "classes")
    by_class = ranked.select(F.explode("classes").alias("c"), own.alias("own")).groupBy("c").agg(F.count("*").alias("n"), F.min("own").alias("first")).where("n >= 2").orderBy("n", "c")
    chosen, covered = [], set()
    found = by_class.limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes are no registry of classes")
    for row in found:
        if len(chosen) >= wanted:
            break
        if row["c"] not in covered:
            chosen.append(row["first"]["p"])
            covered |= set(row["first"]["classes"])
    mine = F.col(patient).isin(chosen) if chosen else F.lit(False)
    rest = placed(ranked.where(~mine), [], hash_bucket(F.col("h")), ["h", patient]).where(F.col("_at") < max(0, wanted - len(chosen))).select(patient)
    return ranked.where(mine).select(patient).unionByName(rest)


def rate_report(before: DataFrame, after: DataFrame, pattern: str, positive: str) -> DataFrame:
    """pattern, rows and positives before and after rate_balance()."""
    count = lambda df, when: df.groupBy(pattern).agg(F.count("*").alias(f"rows_{when}"), F.count_if(positive).alias(f"positives_{when}"))
    return matched(count(before, "before"), count(after, "after"), [pattern], "left").select(pattern, "rows_before", "positives_before", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_after", "positives_after")))
