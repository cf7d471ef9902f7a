"""Label sets: wide booleans, sorted arrays, and answers.

Text booleans are true if they read 'true' after trimming and lower-casing, and false otherwise, nulls and blanks included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))


def positives(classes: dict[str, Column], ordered: bool = False) -> Column:
    """The labels whose columns hold, sorted (so that sets can be grouped by), or with ordered in the given order."""
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in classes.items())), lambda x: x.isNotNull())
    return found if ordered else F.array_sort(found)


def has_labels(classes: dict[str, Column]) -> Column:
    return F.size(positives(classes)) > 0


def shown(labels: Column) -> Column:
    """'a, b', or '(nothing)'."""
    return F.when(F.size(labels) == 0, "(nothing)").otherwise(F.array_join(labels, ", "))


def pair_of(answer: Column, positive: str, negative: str) -> list[Column]:
    """A binary answer as its two complementary classes."""
    return [answer.alias(positive), (~answer).alias(negative)]


def same(left: list[Column], right: list[Column]) -> Column:
    """Whether all labels agree; nulls agree with nulls."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def any_of(labels: Column, subset: list[str]) -> Column:
    """The truth of a question: whether one of the subset's labels holds."""
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, subset))), F.lit(False))


def foreground(labels: Column, background: list[str]) -> Column:
    return F.array_except(labels, F.array(*map(F.lit, background)))


def long(df: DataFrame, keys: list[str], classes: list[str], name: str = "class", value: str = "holds") -> DataFrame:
    """A row for each key and class."""
    return df.unpivot(keys, classes, name, value)


def wide(df: DataFrame, labels: str, classes: list[str]) -> DataFrame:
    """A boolean column for each class from an array of labels."""
    return df.select(*(c for c in df.columns if c != labels), *(F.array_contains(labels, c).alias(c) for c in classes))


def literal_set(value: Column) -> Column:
    """The items of a set as Python prints it; an empty array for anything else."""
    return F.when(value.rlike(r"^\s*\{.*\}\s*$"), F.array_sort(F.regexp_extract_all(value, F.lit(r"'([^']*)'"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
