"""Small documents with every edge: nulls, empty and very long texts, ties, repeated rows and ids, other columns with clashing names."""

from __future__ import annotations

import random

WORDS = "the of and rend threlyes Überall niño été ofthst nor ouble edoution when onharent A wh x1 don't we'll".split()


def texts(n: int = 60, seed: int = 0) -> list[str | None]:
    draw = random.Random(seed)
    prose = lambda k: " ".join(draw.choice(WORDS) for _ in range(k)).capitalize() + "."
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c", "\x00nul \x1c sep", "日本語 😀 text", "\r\n".join(["same line here."] * 5)]
    base = [prose(draw.randint(30, 120)) + "\n" + prose(40) for _ in range(n // 3)]
    out += base
    for t in base[: n // 3]:
        w = t.split(" ")
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = draw.choice(WORDS)
        out.append(" ".join(w))
    out += [base[0], base[0], base[1] + " " + base[2], base[3].upper()]
    out.append(" ".join(prose(50) for _ in range(400)))  # long
    out.append("x" * 5000 + " " + "1" * 3000)
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own results.
CLASHES = "tid string, kept string, size string, quality string, shard string, row string, n string, word string, ids string, pair string"


def rows(seed: int = 0) -> list[tuple]:
    draw = random.Random(seed + 1)
    return [(k * 3 + 1, t, draw.choice(["en", "de", None]), draw.choice(["a", "a", "a", "b", "é", None]), None if t is None else len(t)) for k, t in enumerate(texts(seed=seed))]


def documents(spark, seed: int = 0, clash: bool = True):
    """Rows with unique ids and further columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(seed), SCHEMA)
    if clash:
        df = df.select("*", *(F.lit("mine").alias(c.split()[0]) for c in CLASHES.split(", ")))
    return df.repartition(3)


def odd(spark):
    """A row without an id, and repeated rows."""
    extra = [(None, "no id but some words that are here", None, None, None), (1, None, "en", "a", None), (4, "", "en", "a", 0)]
    return spark.createDataFrame(rows() + extra + rows()[10:12], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
