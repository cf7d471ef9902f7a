"""A quality classifier: the perplexity of an interpolated modified Kneser-Ney trigram model of trusted text.

The model is trained on a bounded sample of labelled documents (MOST_DOCUMENTS is its documented bound), on the whole text of each.
N-grams are counted in Spark, sharded by their keys; discounts, continuation counts and back-off weights come from further groupings
of the same keys. That gives three tables, cut into SHARDS by key range. Scoring joins all words of all documents to the shards by
binary search; as the tables are bounded by the sample, they go to the tasks. Every whole text is scored.

Trusted documents outside the training sample give a threshold for each language: a high quantile of their perplexities (by
Spark's approximate percentile, to a ten-thousandth of the ranks), times a margin; languages with too few use the quantile of all. Texts without words, null ones included, have no perplexity and aren't
kept. Null languages are a language of their own. Without trusted text nothing can be told apart: all texts with words are kept.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, durable, slices, utf8

MOST_DOCUMENTS = 4000
SHARDS = 16
QUANTILE, MARGIN, ENOUGH = 0.99, 1.5, 50
UNKNOWN, END, BEGIN = 0, 1, 2


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def ids_of(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Two begin marks, the words' numbers, the end."""
    return np.concatenate([[BEGIN, BEGIN], np.fromiter(map(number.get, words, repeat(UNKNOWN)), np.int64, len(words)), [END]])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(text) -> w: the distinct words, cut and lower-cased as for scoring."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, own in slices(batch, 0):
                found: set[bytes] = set()
                for text in own:
                    found.update(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["w"])

    return texts.mapInArrow(run, "w binary").distinct()


def count(texts: DataFrame, number: dict[bytes, int], size: int) -> DataFrame:
    """(text) -> context, w, n for each trigram; context holds the two words before w. Both fit 64 bits up to three thousand million words."""
    shared = texts.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, own in slices(batch, 0):
                found = [ids_of(words_of(text), shared.value) for text in own]
                context = np.concatenate([x[:-2] * size + x[1:-1] for x in found])
                w = np.concatenate([x[2:] for x in found])
                order = np.lexsort((w, context))
                context, w = context[order], w[order]
                first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context[first]), pa.array(w[first]), pa.array(np.diff(np.append(first, len(w))))], ["context", "w", "n"])

    return texts.mapInArrow(run, "context bigint, w bigint, n bigint").groupBy("context", "w").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of one, two, and three or more, from how many n-grams have counts of one to four."""
    row = counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 4 * y)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def discounted(counts: DataFrame):
    """(context, w, n) -> (context, w, p): the discounted share in its context; (context, back): what the discounts free."""
    d = discounts(counts)
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    context = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("free"))
    share = counts.join(context, "context").select("context", "w", ((F.col("n") - off) / F.col("total")).alias("p"))
    return share, context.select("context", (F.col("free") / F.col("total")).alias("back"))


class Shards:
    """A table of key -> value in ranges of keys; get() joins an array of keys, shard by shard."""

    def __init__(self, key: np.ndarray, value: np.ndarray, shards: int = SHARDS):
        order = np.argsort(key)
        self.key, self.value = np.array_split(key[order], shards), np.array_split(value[order].astype(np.float32), shards)
        self.first = np.array([k[0] if len(k) else np.iinfo(np.int64).max for k in self.key])

    def get(self, key: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(key), default)
        order = np.argsort(key)
        cuts = np.append(np.searchsorted(key[order], self.first), len(key))
        for k, (own, value) in enumerate(zip(self.key, self.value, strict=True)):
            rows = order[cuts[k] : cuts[k + 1]] if k + 1 < len(self.key) else order[cuts[k] :]
            if len(own) and len(rows):
                at = np.minimum(np.searchsorted(own, key[rows]), len(own) - 1)
                hit = own[at] == key[rows]
                out[rows[hit]] = value[at[hit]]
        return out


class Model:
    """Tables of the trusted sample; texts: a bounded DataFrame of (text)."""

    def __init__(self, texts: DataFrame):
        self.number = {w: k + 3 for k, w in enumerate(utf8(vocabulary(texts).orderBy("w").toArrow().column(0)))}  # bounded by the sample
        size = self.size = len(self.number) + 3
        three = durable(count(texts, self.number, size), "trigrams")
        # a bigram counts by the words it follows; at the begin of a text it follows none, and counts by itself
        after = F.expr(f"context % {size}").alias("context")
        two = durable(three.groupBy(after, "w").agg(F.count("*").alias("types"), F.sum("n").alias("n")).select("context", "w", F.when(F.col("context") == BEGIN, F.col("n")).otherwise(F.col("types")).alias("n")), "bigrams")
        one = two.groupBy("w").agg(F.count("*").alias("n"))
        p3, back3 = discounted(three)
        p2, back2 = discounted(two)
        table = lambda df, v: [c.to_numpy() for c in df.select(*df.columns[:-1], F.col(v).cast("float")).toArrow().columns]
        unigram, n = table(one, "n")
        self.p1 = np.full(size, 0.0)
        total = max(1.0, n.sum())
        off = np.array((0.0, *discounts(one)))[np.minimum(n, 3).astype(np.int64)]
        self.p1[unigram] = (n - off) / total
        self.p1 += (off.sum() / total if len(n) else 1.0) / size  # unknown words, too
        self.back2 = np.ones(size)
        context, back = table(back2, "back")
        self.back2[context] = back
        context, back = table(back3, "back")
        order = np.argsort(context)
        self.contexts, self.back3 = context[order], back[order].astype(np.float32)
        context, w, p = table(p2, "p")
        self.p2 = Shards(context * size + w, p)
        context, w, p = table(p3, "p")
        self.p3 = Shards(np.searchsorted(self.contexts, context) * size + w, p)  # a context by its place among those of the sample: no key beyond 64 bits

    def log10(self, ids: np.ndarray) -> np.ndarray:
        """log10 P of each id but the first two, after the two before it; ids may hold several texts, each as ids_of() gives them."""
        size, w = self.size, ids[2:]
        two = ids[1:-1] * size + w
        before = ids[:-2] * size + ids[1:-1]
        p2 = self.p2.get(two, 0.0) + self.back2[ids[1:-1]] * self.p1[w]
        if not len(self.contexts):
            return np.log10(p2)
        place = np.minimum(np.searchsorted(self.contexts, before), len(self.contexts) - 1)
        known = self.contexts[place] == before
        p3 = self.p3.get(np.where(known, place * size + w, -1), 0.0) + np.where(known, self.back3[place], 1.0) * p2
        return np.log10(p3)


def perplexities(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, perplexity (null without words) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for part, texts in slices(batch, 1, 1 << 20):
                ids = [ids_of(words_of(t), model.number) for t in texts]
                sizes = np.array([len(x) for x in ids])
                own = np.concatenate([np.zeros(2), model.log10(np.concatenate(ids))])
                ends = np.cumsum(sizes)
                sums = np.add.reduceat(own, np.stack([ends - sizes + 2, ends], 1).ravel()[:-1])[::2]
                n = sizes - 3
                ppl = [float(10 ** min(300.0, -s / (k + 1))) if k else None for s, k in zip(sums.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ppl, pa.float64())], ["doc_id", "n_words", "perplexity"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words bigint, perplexity double")


def classify(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and kept for each row of df; trusted: the ids (doc_id) of trusted rows."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ids = trusted.select(F.col(trusted.columns[0]).alias("doc_id")).where("doc_id is not null").distinct()
    spread = F.xxhash64("doc_id", F.lit("sample"))
    train = F.pmod(spread, F.lit(5)) > 0
    picked = ids.where(train).orderBy(spread, "doc_id").limit(MOST_DOCUMENTS)
    some = docs.join(picked, "doc_id", "left_semi").select("text").where("text is not null")
    model = Model(durable(some, "trusted sample"))
    scored = durable(perplexities(docs.select(F.struct("doc_id", "lang").alias("row"), "text"), model, "row").select("doc_id.*", "n_words", "perplexity"), "perplexities")
    held = scored.join(ids.where(~train), "doc_id", "left_semi").where("perplexity is not null")
    quantile = F.percentile_approx("perplexity", QUANTILE, 10000)
    whole = held.agg(quantile.alias("all"), F.count("*").alias("n")).first()
    limit = whole["all"] * MARGIN if whole["n"] else float("inf")
    by_lang = held.groupBy("lang").agg(quantile.alias("q"), F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select(F.col("lang").alias("l"), (F.col("q") * MARGIN).alias("own"))
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("own", F.lit(limit)))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    return classify(documents(spark, sf_dir), trusted)
