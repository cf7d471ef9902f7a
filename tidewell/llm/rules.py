"""Quality rules, line first, with DataFrame functions only.

Every line is judged by itself: its punctuation, navigation bars, symbols, shouting, repetition and boilerplate phrases. Failed
lines go; a document is rejected if that loses more than half of its word characters, or if it fails the base (too few words,
or too many words in windows of eight that occur twice).

Null and empty texts have no words and are rejected by the base. Lines without words are dropped from the cleaned text and
count for nothing. Each row is judged by itself, so repeated rows give repeated results; nothing is shuffled. Windows are
compared within one document by 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, WORD, documents, let

MIN_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
MOST_LOST = 50  # percent of word characters in failed lines
SYMBOLS = r"[#*$%&|<>]"
END = r"[.!?:;…。！？»”\"')\]][\x20\x09-\x0D]*\z"
BARS = r"[|»›•·]"
SHOUT = r"!!+"
BOILERPLATE = r"(?i)(lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|cookie policy|(use|uses|accept|enable) cookies|(enable|requires) javascript|click here|read more\b|skip to (main )?content|subscribe to our|sign up for our|powered by wordpress)"
#: A line's rules in order; the first that holds is its reason.
RULES = ("boilerplate", "navigation", "symbols", "shouting", "repetition", "punctuation")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def reason(line: Column, words: Column) -> Column:
    """The first rule that a line with words fails, or null."""
    n = F.size(words)
    tests = {
        "boilerplate": (n < 40) & line.rlike(BOILERPLATE),
        "navigation": (count(line, BARS) >= 3) & (count(line, BARS) * 5 >= n),
        "symbols": (count(line, SYMBOLS) >= 3) & (count(line, SYMBOLS) * 3 >= n),
        "shouting": (count(line, SHOUT) >= 3) & (count(line, SHOUT) * 3 >= n),
        "repetition": (n >= 12) & (F.size(F.array_distinct(words)) * 3 <= n),
        "punctuation": (n < 10) & ~line.rlike(END),
    }
    return F.coalesce(*(F.when(tests[k], F.lit(k)) for k in RULES))


def repeated_words(words: Column, size: int = 8) -> Column:
    """How many words lie in windows of `size` words that occur at least twice in words."""

    def covered(at: Column) -> Column:
        """at: sorted starts of repeated windows."""
        gaps = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0), lambda s, k: s + F.least(F.lit(size), F.get(at, k) - F.get(at, k - 1)))
        return F.when(F.size(at) == 0, 0).when(F.size(at) == 1, size).otherwise(gaps + size)

    def starts(windows: Column) -> Column:
        """Starts of the windows that aren't alone: after sorting, equal ones are neighbours."""
        ordered = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def alone(s: Column) -> Column:
            own = lambda j: F.get(s, j)
            near = F.transform(s, lambda x, j: F.when((own(j - 1)["h"] == x["h"]) | (own(j + 1)["h"] == x["h"]), x["k"]))
            return F.sort_array(F.filter(near, lambda k: k.isNotNull()))

        return let(ordered, alone)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(starts(windows), covered))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda k: F.xxhash64(*(F.get(h, k + j) for j in range(size))))
        return F.when(F.size(h) <= size, 0).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def judged(text: Column) -> Column:
    """A struct of all counts, the verdict and the cleaned text."""
    text = F.coalesce(text, F.lit(""))

    def line(l: Column) -> Column:
        parts = F.filter(F.split(l, SPACE), lambda w: w != "")
        return let(parts, lambda w: F.struct(l.alias("line"), w.alias("words"), F.length(F.array_join(w, "")).alias("chars"), F.when(F.size(w) > 0, reason(l, w)).alias("reason")))

    def document(lines: Column) -> Column:
        real = F.filter(lines, lambda x: F.size(x["words"]) > 0)

        def whole(real: Column) -> Column:
            words = F.flatten(F.transform(real, lambda x: x["words"]))
            plain = F.transform(real, lambda x: x["line"])
            good = F.filter(real, lambda x: x["reason"].isNull())
            total = lambda rows: F.aggregate(rows, F.lit(0), lambda s, x: s + x["chars"])
            return F.struct(
                F.aggregate(real, F.lit(0), lambda s, x: s + F.size(x["words"])).cast("long").alias("n_words"),
                total(real).cast("long").alias("word_chars"),
                count(text, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(real) - F.size(F.array_distinct(plain))).cast("long").alias("n_dup_lines"),
                let(words, lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
                total(good).cast("long").alias("good_chars"),
                F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean"),
                F.filter(F.transform(real, lambda x: x["reason"]), lambda x: x.isNotNull()).alias("reasons"),
            )

        return let(real, whole)

    return let(F.transform(F.split(text, "\n"), line), document)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def kept(q: Column) -> Column:
    return ~base_failed(q) & (100 * (q["word_chars"] - q["good_chars"]) <= MOST_LOST * q["word_chars"])


def decided(q: Column) -> Column:
    """q with its verdicts."""
    return q.withField("base_failed", base_failed(q)).withField("kept", kept(q))


def quality(df: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """df with the struct column `out`: the counts, good_chars, clean (the text without failed lines), reasons of failed lines, base_failed and kept."""
    return df.withColumn(out, let(judged(F.col(text_col)), decided))


def cleaned(df: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with their text without failed lines in the column `out`. A generator drops the others, since a filter would judge each text again."""
    clean = let(judged(F.col(text_col)), lambda q: F.when(kept(q), q["clean"]))
    return df.select("*", F.explode(F.filter(F.array(clean), lambda t: t.isNotNull())).alias(out))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *(q[n].alias(n) for n in names))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    n = lambda p: f"len(regexp_extract_all(line, {quoted(p)}))"
    bad = [
        f"(n < 40 AND regexp_matches(line, {quoted(BOILERPLATE)}))",
        f"({n(BARS)} >= 3 AND {n(BARS)} * 5 >= n)",
        f"({n(SYMBOLS)} >= 3 AND {n(SYMBOLS)} * 3 >= n)",
        f"({n(SHOUT)} >= 3 AND {n(SHOUT)} * 3 >= n)",
        "(n >= 12 AND len(list_distinct(words)) * 3 <= n)",
        f"(n < 10 AND NOT regexp_matches(line, {quoted(END)}))",
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(8) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, line, words, len(words) AS n, len(array_to_string(words, '')) AS chars
  FROM (SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(words) > 0),
sums AS (SELECT doc_id, sum(chars) AS chars, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN {' OR '.join(bad)} THEN chars ELSE 0 END) AS lost FROM lines GROUP BY doc_id),
q AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, {quoted(SYMBOLS)})) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MOST_LOST} * word_chars AS kept FROM b"""


OP3_SQL = _sql()
