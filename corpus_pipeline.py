"""A corpus pipeline over documents: quality rules, near duplicates, personal data, source mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows to the checkpoint folder, so that a lost executor costs one stage at most.

Rows that share an id stay if one of them stays. Null texts count as empty and are rejected by the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, mixing, neardup, pii, rules
from tidewell.llm.common import durable

RANKS = "byte_bpe_multi_50k.tiktoken"


def _own(docs: DataFrame, base: str) -> str:
    """A column name that docs doesn't have."""
    while base in docs.columns:
        base += "_"
    return base


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars after it."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the lines that fail go."""
    clean = _own(docs, "clean")
    return _with_text(rules.cleaned(docs, clean), F.col(clean)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: words of five, a similarity of 0.8."""
    own = _own(docs, "kept")
    kept = neardup.near_duplicates(docs, size=5).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken over its size, the fraction rounded by a hash of the id so that a source keeps its share."""
    key, share, times, copy = (_own(docs, c) for c in ("key", "share", "times", "copy"))
    taken = mixing.mix(docs).taken.groupBy(F.col("doc_id").alias(key)).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias(share))
    coin = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor(share)
    taken = taken.select(key, (whole + (coin < F.col(share) - whole).cast("int")).cast("int").alias(times)).where(F.col(times) > 0)
    found = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and ids and offsets as little-endian 32-bit integers."""
    from public_tokenizers import path

    return bpe.encode(docs, path(RANKS), arrays=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("tokens", tokens),
]
#: The personal data model has no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline {name}")
    return STAGES[-1][1](spark, docs, sf_dir)
