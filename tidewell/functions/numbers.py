"""Small arithmetic whose edges matter: division, rounding, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b, and 0.0 for b = 0 or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def spaced(n: Column, cap: Column) -> Column:
    """cap indexes spaced evenly over 0..n-1, halves to the even neighbour; n div 2 alone for a cap of 1."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(cap, F.lit(2)) - 1), lambda i: F.bround(i * (n - 1) / (F.greatest(cap, F.lit(2)) - 1)).cast("int"))
    return F.array_distinct(F.when(cap == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(each))


def scan_indexes(n: Column, most: int = 24) -> Column:
    """At most `most` windows of n, spread evenly, the first and the last left out; all where n is no more than most + 2."""
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(1 + k * (n - 3) / (most - 1)).cast("int"))
    return F.when(n < 1, F.array().cast("array<int>")).when(n <= most + 2, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array_distinct(even))


def seconds(limit: Column) -> Column:
    """Seconds of 'D-HH:MM:SS', 'D-HH', 'HH:MM:SS', 'MM:SS' or minutes alone."""
    days = F.when(F.contains(limit, F.lit("-")), F.substring_index(limit, "-", 1).cast("long")).otherwise(0)
    parts = F.transform(F.split(F.substring_index(limit, "-", -1), ":"), lambda x: x.cast("long"))
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(0))
    of_day = at(0) * 3600 + at(1) * 60 + at(2)
    short = F.when(F.size(parts) == 3, of_day).when(F.size(parts) == 2, at(0) * 60 + at(1)).otherwise(at(0) * 60)
    return F.when(F.contains(limit, F.lit("-")), days * 86400 + of_day).otherwise(short)


def clock(minutes: Column) -> Column:
    """'HH:MM:00'."""
    return F.format_string("%02d:%02d:00", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def scaled_time(configured: Column, pending: Column, full: Column, floor: int = 20, load: int = 10, headroom: float = 2.0) -> Column:
    """The wall time 'HH:MM:SS' for pending of full items: in proportion, with headroom and loading time, floor at least, configured at most; seconds are ignored."""
    parts = F.transform(F.split(configured, ":"), lambda x: x.cast("int"))
    most = F.get(parts, F.lit(0)) * 60 + F.get(parts, F.lit(1))
    need = F.ceil(most * pending / F.greatest(full, F.lit(1)) * headroom) + load
    return clock(F.least(F.greatest(need, F.lit(floor)), most))


def walltime(hours: Column, least: int = 2, most: int = 71) -> Column:
    """'D-HH:00:00' of hours rounded up."""
    whole = F.least(F.greatest(F.ceil(hours), F.lit(least)), F.lit(most))
    return F.format_string("%d-%02d:00:00", F.floor(whole / 24).cast("int"), (whole % 24).cast("int"))


def windows_in(duration: Column, length: int = 20) -> Column:
    """Indexes of a recording's windows: the tail is dropped, but one stays."""
    return F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(duration / length).cast("int")) - 1)
