"""What splits have in common. Reports are DataFrames; a gate fails on rows in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeakageError(ValueError):
    pass


def overlaps(splits: DataFrame, split: str, keys: dict[str, str]) -> DataFrame:
    """key, left, right, n: how many values of each key two splits share. One pass over the splits a key."""

    def one(name: str, column: str) -> DataFrame:
        each = splits.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
        pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
        return each.select(F.explode(pairs).alias("p")).groupBy(F.lit(name).alias("key"), F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.count("*").alias("n"))

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in keys.items()])


def with_tests(rows: DataFrame, everywhere: bool = True) -> DataFrame:
    """dataset, check, n: what a set's train and val share (patient, token, recording, image), and what either shares with tests.

    rows: dataset, split, and the four keys; patient is the merged one. Test images are those of all sets, test patients too, or
    those of the own set. Checks without a value are absent.
    """
    keys = ("patient", "token", "recording", "image")
    long = rows.select("dataset", "split", F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).cast("string").alias("v")) for k in keys)))).where("v is not null")
    one = lambda s: F.bool_or(F.col("split") == s)
    own = long.where(F.col("split").isin("train", "val")).groupBy("dataset", "check", "v").agg(one("train").alias("t"), one("val").alias("l"))
    tests = long.where((F.col("split") == "test") & F.col("check").isin("patient", "image"))
    near = tests.where("check = 'patient'").select("dataset", "check", "v").distinct()
    far = tests.where(F.lit(everywhere) | (F.col("check") == "image")).select("check", "v").distinct()
    met = own.join(far, ["check", "v"], "left_semi")
    if not everywhere:
        met = met.unionByName(own.join(near, ["dataset", "check", "v"], "left_semi").select(met.columns))
    count = lambda df, name: df.groupBy("dataset", name.alias("check")).agg(F.count("*").alias("n"))
    return count(own.where("t and l"), F.col("check")).unionByName(count(met, F.concat(F.lit("test "), "check")))


def in_several(splits: DataFrame, split: str, key: str) -> DataFrame:
    """Values of key that lie in more than one split."""
    return splits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n")).where("n > 1")


def gate(report: DataFrame, what: str) -> None:
    """Raises if the report has rows, and tells some."""
    if rows := report.limit(5).collect():
        raise LeakageError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def contained(texts: DataFrame, needles: DataFrame, size: int = 8) -> DataFrame:
    """(doc, item) whose text holds the item's words as a whole run: an equi-join on a hash of the item's first `size` words, then the check.

    texts: doc, text; needles: item, text. Needles of fewer words are joined by all of theirs. Only documents and 64-bit hashes go
    into the join, and texts only meet the pairs that it finds.
    """
    from tidewell.functions.text import let, words

    def hashes(w, k: int):
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))

    items = needles.select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(size)).alias("k"))
    widths = sorted(r["k"] for r in items.select("k").distinct().collect())  # `size` rows at most
    if not widths:
        return texts.select("doc").join(needles.select("item"), how="cross").limit(0)
    start = F.coalesce(*(F.when(F.col("k") == k, hashes(F.slice("w", 1, k), k)[0]) for k in widths))
    items = items.select("item", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("whole"), "k", start.alias("start"))
    of = lambda w: F.flatten(F.array(*(F.when(F.size(w) >= k, F.transform(F.array_distinct(hashes(w, k)), lambda h: F.struct(F.lit(k).alias("k"), h.alias("start")))).otherwise(F.array().cast("array<struct<k:int,start:bigint>>")) for k in widths)))
    grams = texts.select("doc", F.explode(let(words(F.col("text")), of)).alias("g")).select("doc", "g.k", "g.start")
    met = grams.join(items.select("item", "k", "start"), ["k", "start"]).select("doc", "item").distinct()
    whole = texts.join(met, "doc").join(items.select("item", "whole"), "item")
    held = let(F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")), lambda t: F.contains(t, F.col("whole")))
    return whole.where(held).select("doc", "item").distinct()
