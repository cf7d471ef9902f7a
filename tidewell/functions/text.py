"""Screens and rewriting of rationale texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of doubt, end marks, least sizes and negative labels (fixed values).
HEDGE = (
    r"(?i)\b(cannot (be )?(determine|confirm|identify|verify|assess)|can't (determine|confirm|identify)|unable to|not possible to"
    r"|difficult to (identify|determine|discern|confirm)|as an ai|i (cannot|can't|am unable)|without (more|additional|further) (information|context|data))\b"
)
END_MARKS = [".", "!", "?", '"', ")"]
MIN_CHARS, MIN_WORDS, MIN_DISTINCT_CHARS, MIN_DISTINCT_SHARE = 40, 8, 12, 0.2
NEGATIVES = ["normal", "no_epilepsy", "bckg"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def few_characters(text: Column, least: int = MIN_DISTINCT_CHARS, first: int = 256) -> Column:
    """Whether a text has fewer distinct characters than `least`. The first ones mostly tell; if they don't, all are counted."""
    distinct = lambda t: F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
    return F.when(distinct(F.substring(text, 1, first)) >= least, False).otherwise(distinct(text) < least)


def degenerate(text: Column) -> Column:
    """Too short, too few words, too few distinct characters or too repetitive; null counts as empty. Blanks at the ends count."""
    t = F.coalesce(text, F.lit(""))
    poor = lambda w: F.when(F.size(w) < MIN_WORDS, True).otherwise(F.size(F.array_distinct(w)) / F.size(w) < MIN_DISTINCT_SHARE)
    return F.when(F.length(t) < MIN_CHARS, True).when(few_characters(t), True).otherwise(let(words(t), poor))


def truncated(text: Column) -> Column:
    return ~F.right(F.coalesce(text, F.lit("")), F.lit(1)).isin(END_MARKS)


def hedged(text: Column) -> Column:
    return F.coalesce(text.rlike(HEDGE), F.lit(False))


def problems(text: Column, labels: Column) -> Column:
    """The names of what is wrong with a rationale, none for a blank one; doubt is wrong only where labels beyond the negative ones hold."""
    beyond = F.size(F.array_except(labels, F.array(*map(F.lit, NEGATIVES)))) > 0

    def tags(t: Column) -> Column:
        found = F.array(F.when(degenerate(t), "degenerate"), F.when(truncated(t), "truncated"), F.when(beyond & hedged(t), "hedge"))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.isNotNull()))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), tags)


#: Where sentences and channels begin and end (fixed values).
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
CHANNEL = r"\b(?:EEG\s+)?([A-Za-z0-9]+)-(?:REF|LE)\b"


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def without_sentences(text: Column, pattern: str) -> Column:
    """The text without the sentences that match."""
    return F.array_join(F.filter(sentences(text), lambda s: ~F.lower(s).rlike(pattern)), " ")


def renamed(text: Column, names: dict[str, str]) -> Column:
    """Codes, in any case, replaced by plain names: left out with their brackets where they stand in such, named in quotes and as whole words; white space collapsed. No name may hold another code."""
    codes = "|".join(names)
    text = F.regexp_replace(text, rf'(?i)\s*\(\s*\\?"?(?:{codes})\\?"?\s*\)', "")
    for pattern in (r'(?i)\\?"{}\\?"', r"(?i)\b{}\b"):
        for code, name in names.items():
            text = F.regexp_replace(text, pattern.format(code), name)
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def plain_channels(text: Column) -> Column:
    """F8 for 'EEG F8-REF' and the like."""
    return F.regexp_replace(text, CHANNEL, "$1")


def one_line(text: Column, most: int = 500) -> Column:
    """White space collapsed, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def filled(template: str, **fields: Column) -> Column:
    """A prompt: {name} replaced by the field."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
