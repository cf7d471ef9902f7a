"""Judges' verdicts: pairs to judge, controls, agreement, preferences; and tables of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ranks import by_hash, hash_bucket, matched, shuffled


def pairs(answers: DataFrame, truth: DataFrame, done: DataFrame, key: list[str], text: str) -> DataFrame:
    """Answers with their truth's text, where that isn't blank, that haven't been judged."""
    reference = truth.where(F.trim(text) != "").select("path", F.col(text).alias("reference"))
    return answers.join(reference, "path").join(done.select(*key), key, "left_anti")


def controls(df: DataFrame, key: str, label: str, share: float = 0.1, seed=0) -> DataFrame:
    """(key, other): a share of the rows, each with another row of the same label: the next in the order of hashes, the first after the last."""
    marked = df.select(key, label, shuffled(seed, F.col(key)).alias("_hash")).withColumn("_bucket", hash_bucket(F.col("_hash")))
    # the first key of each bucket and of the label, so that a bucket's last row knows what follows it
    heads = marked.groupBy(label, "_bucket").agg(F.min_by(key, F.struct("_hash", key)).alias("_head"))
    w = Window.partitionBy(label).orderBy("_bucket")
    heads = heads.withColumn("_next", F.coalesce(F.lead("_head").over(w), F.first("_head").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("_head")
    inner = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    ranked = by_hash(matched(marked.withColumn("_lead", F.lead(key).over(inner)), heads, [label, "_bucket"]).drop("_bucket", "_hash"), [label], [F.col(key)], seed)
    ranked = ranked.withColumn("other", F.coalesce("_lead", "_next"))
    return ranked.where((F.col("_at") < F.ceil(F.col("_n") * share)) & (F.col("other") != F.col(key))).select(key, label, "other")


def agreement(verdicts: DataFrame, by: list[str], label: str = "label", control: str = "control", conclusion: str = "same_conclusion", evidence: str = "same_evidence") -> DataFrame:
    """Shares of own and control pairs with the same conclusion, evidence, and both, for all labels together and each."""
    c, e = F.col(conclusion), F.col(evidence)

    def rate(x: Column, own: Column, name: str) -> Column:
        return F.round(F.avg(F.when(own, x.cast("double"))), 4).alias(name)

    spread = verdicts.select(*by, F.explode(F.array(F.lit("all"), F.col(label).cast("string"))).alias("group"), c, e, F.col(control).alias("_control"))
    k = F.col("_control")
    return spread.groupBy(*by, "group").agg(*(rate(x, k if who == "control" else ~k, f"{who}_{what}") for who in ("own", "control") for what, x in (("conclusion", c), ("evidence", e), ("both", c & e))))


def short_circuit(text: Column, verdict: Column) -> Column:
    """No text, no agreement: false without asking."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(False)).otherwise(verdict)


def preference_rows(df: DataFrame, key: str, a: str, b: str, seed=0) -> DataFrame:
    """rationale_a, rationale_b and a_source, the sides dealt by a coin from the key's hash."""
    heads = F.conv(F.substring(shuffled(seed, F.col(key)), 1, 1), 16, 10).cast("int") < 8
    return df.select(key, F.when(heads, F.col(a)).otherwise(F.col(b)).alias("rationale_a"), F.when(heads, F.col(b)).otherwise(F.col(a)).alias("rationale_b"), F.when(heads, a).otherwise(b).alias("a_source"))


def deltas(scores: DataFrame, key: list[str], kind: str, value: str, base: str = "zero-shot", tuned: str = "tuned") -> DataFrame:
    """A row for each tuned score, with its base score (null if there is none) and the difference."""
    left = scores.where(F.col(kind) == tuned).select(*key, F.col(value).alias("tuned"))
    right = scores.where(F.col(kind) == base).select(*key, F.col(value).alias("base"))
    return left.join(right, key, "left").withColumn("delta", F.col("tuned") - F.col("base"))


def side_by_side(scores: DataFrame, key: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """A column for each kind; any may be missing."""
    return scores.groupBy(*key).pivot(kind, kinds).agg(F.first(value))


def markdown(df: DataFrame, columns: list[str], order: list) -> DataFrame:
    """One row, table: a small result as a Markdown table. Sorted as a whole, so for results of a page or two."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    numbered = df.select(line.alias("l"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("k"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return numbered.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda x: x["l"]), "\n")).alias("table"))


def verdict(candidate: Column, reply: Column) -> list[Column]:
    """correct_predictions, correct_rationale and reason from a judge's reply; an empty candidate is wrong without being asked about. Null where the reply can't be read."""
    from tidewell.functions import answers

    empty = F.trim(F.coalesce(candidate, F.lit(""))) == ""
    got = answers.parsed(reply, {"correct_predictions": "boolean", "correct_rationale": "boolean", "reason": "string"})
    flag = lambda n: F.when(empty, F.lit(False)).otherwise(got[n]).alias(n)
    return [flag("correct_predictions"), flag("correct_rationale"), F.when(empty, "empty answer").otherwise(got["reason"]).alias("reason")]
