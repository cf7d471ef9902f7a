"""Columns from window paths such as <split>/<patient>_<scan>_<window>.png, and other names.

A patient's token may itself hold underscores, so names are read from the right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"([^/]+)_([^_/]+)_(\d+)\.[^./]+$"


def patient(path: Column) -> Column:
    return F.regexp_extract(path, NAME, 1)


def recording(path: Column) -> Column:
    """patient and scan."""
    return F.concat_ws("_", F.regexp_extract(path, NAME, 1), F.regexp_extract(path, NAME, 2))


def window_index(path: Column) -> Column:
    """Null for a path that isn't a window's."""
    return F.nullif(F.regexp_extract(path, NAME, 3), F.lit("")).cast("int")


def split_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def without_first(path: Column) -> Column:
    """path without its first folder."""
    return F.regexp_replace(path, "^[^/]+/", "")


def without_prefix(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, f"^(?:{pattern})", "")


def slug(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def flat(value: Column) -> Column:
    """For file names: no colons."""
    return F.translate(value, ":", "-")


def last_part(value: Column, by: str = "_") -> Column:
    return F.substring_index(value, by, -1)


#: How electrodes are written (a fixed value): EEG F8-REF, EEG F8-LE.
ELECTRODE = r"^EEG (\w+)-(?:REF|LE)$"


def electrode(name: Column) -> Column:
    """F8 of 'EEG F8-REF' or 'EEG F8-LE'; empty for other channels."""
    return F.regexp_extract(F.upper(name), ELECTRODE, 1)


def excerpt(token: Column) -> Column:
    """Whether a patient token is just a number, which names an excerpt and no person."""
    return token.rlike("^[0-9]+$")


def listed(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'; empty for an empty array."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def without_tags(channel: Column, tags: list[str]) -> Column:
    """Whether a channel's name has none of the tags."""
    return ~F.exists(F.array(*map(F.lit, tags)), lambda t: F.contains(F.upper(channel), t))
