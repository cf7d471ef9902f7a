"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. The output is dealt in shards of
slots; every shard draws how many of its slots each source gets, from a multinomial conditioned on the totals (so that a source
comes near its target) at any size, by halving the range of shards: a shard's draw needs only the seeds on its way down, no other shard.
A source's slots are mapped to its blocks by a pseudorandom permutation of block indexes, computed per index, and joined to the
blocks by that index.

Up to MOST_SOURCES sources, one row each (name and size) goes to the driver and to the tasks, since each shard draws from all of them.
Beyond that (ManySources) sources stay a table: targets come from a few rounds of sums, and the slots of all sources, laid end to end,
go to the output's places by one pseudorandom permutation, which gives each shard the same kind of draw. Null sources form one source,
last in order. Null and empty texts have size 0 and are never taken. Rows with the same id are kept apart only by their size; equal
rows share what they get.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, documents, durable
from tidewell.operators.ranks import evenly

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST = 3
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Words of each source: all words shared by weight, none above `most` times its source, the excess shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        above = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not above:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in above:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in above)
        open_ -= above
    return out


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def picked(draw: np.random.Generator, counts: np.ndarray, some: int) -> np.ndarray:
    """How many of `some` items, drawn without replacement, are of each kind. Works with any number of items; costs as `some` does."""
    total = int(counts.sum())
    if 2 * some > total:
        return counts - picked(draw, counts, total - some)
    found = np.zeros(0, np.int64)
    while len(found) < some:
        found = np.unique(np.concatenate([found, draw.integers(0, total, some - len(found) + 8)]))
    found = draw.permutation(found)[:some]
    return np.bincount(np.searchsorted(np.cumsum(counts), found, side="right"), minlength=len(counts))


def halved(own: np.ndarray, left: int, seed: int) -> np.ndarray:
    """How many of each source's slots lie in the left half of `left` slots: a draw without replacement.

    Each slot falls to the left by itself; as many as are then too many or too few, drawn among those on that side, change sides.
    That leaves each set of `left` slots as likely, whatever their number.
    """
    draw, total = np.random.default_rng(seed), int(own.sum())
    part = draw.binomial(own, left / total) if total else own.copy()
    over = int(part.sum()) - left
    return part - picked(draw, part, over) if over > 0 else part + picked(draw, own - part, -over)


def draw(quota: np.ndarray, shards: int, shard: int, slots: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each source, its number of slots) in one shard.

    The quotas are split between the halves of the range of shards, again and again; each node's generator is seeded by the node, so
    that all shards see the same splits. known keeps splits for the shards that are drawn next.
    """
    low, high, own, before, total = 0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64), int(quota.sum())
    known = {} if known is None else known
    while high - low > 1:
        mid = (low + high) // 2
        if (part := known.get((low, high))) is None:
            if len(known) > 256:
                known.clear()
            part = known[low, high] = halved(own, min(mid * slots, total) - low * slots, seed_of(seed, low, high))
        if shard < mid:
            high, own = mid, part
        else:
            low, before, own = mid, before + part, own - part
    return before, own


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given indexes: a Feistel network over the next even power of two, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            x = (b + np.uint64((key + turn * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((x >> np.uint64(32)) & mask)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """sizes: a row for each document with its place in its source; slots: the blocks drawn, shard by shard."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, source_col: str, weights=(1.0, 2.0, 3.0), block: int = BLOCK_WORDS, seed: int = 0):
        spark = df.sparkSession
        sized = sizes_of(df, id_col, text_col, source_col)
        found = sources_of(sized).collect()
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.names = [r["source"] for r in found]
        self.totals = [r["size"] for r in found]
        self.targets = targets(self.totals, [weights[k % len(weights)] for k in range(len(found))])
        self.block = block
        table = spark.createDataFrame(
            [(k, r["source"], r["size"], t) for k, (r, t) in enumerate(zip(found, self.targets, strict=True))], "source_no int, source string, source_size long, target double"
        )
        rows = sum(r["n"] for r in found)
        named = sized.join(F.broadcast(table.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))  # a row for each source
        self.sizes = begun(named, rows)
        blocks = [-(-n // block) for n in self.totals]
        # whole passes over a source and the blocks of the last, partial one
        quota = []
        for n, count, t in zip(self.totals, blocks, self.targets, strict=True):
            passes = min(MOST, int(t // n)) if n else 0
            more = min(count, round((t - passes * n) / block)) if n else 0
            quota.append(passes * count + (more if passes < MOST else 0))
        self.quota, self.blocks = np.array(quota, np.int64), blocks
        self.shards = max(1, math.ceil(int(self.quota.sum()) / SHARD_SLOTS))
        self.seed = seed
        self.spark = spark

    @property
    def slots(self) -> DataFrame:
        """shard, slot, source_no, block: each output block and the source block that fills it."""
        quota, blocks, shards, seed = self.quota, self.blocks, self.shards, self.seed

        def run(batches):
            import pyarrow as pa

            known: dict = {}
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    first, count = draw(quota, shards, shard, SHARD_SLOTS, seed, known)
                    source = np.repeat(np.arange(len(quota)), count)
                    index = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)]) if len(source) else np.zeros(0, np.int64)
                    block = np.zeros(len(source), np.int64)
                    for k in np.unique(source).tolist():
                        own = source == k
                        block[own] = permuted(index[own] % blocks[k], blocks[k], seed_of(seed, "source", k))
                    place = np.random.default_rng(seed_of(seed, "order", shard)).permutation(len(source))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(place), pa.array(source.astype(np.int32)), pa.array(block)], ["shard", "slot", "source_no", "block"])

        parts = max(1, min(self.shards, self.spark.sparkContext.defaultParallelism * 4 if self.shards < 10_000 else self.shards // 100))
        return self.spark.range(0, self.shards, 1, parts).mapInArrow(run, "shard bigint, slot bigint, source_no int, block bigint")

    @property
    def pieces(self) -> DataFrame:
        """Each document's words by block: doc_id, source_no, block, words."""
        end = F.col("first") + F.col("size")
        cut = self.sizes.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {self.block}"), F.expr(f"(first + size - 1) div {self.block}"))))
        words = F.least(end, (F.col("block") + 1) * self.block) - F.greatest(F.col("first"), F.col("block") * self.block)
        return cut.select("doc_id", "size", "first", "source_no", "source_size", "target", "block", words.alias("words"))

    @property
    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken, the words that the mix takes of it, repeats counted."""
        drawn = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        # as many drawn blocks as the corpus has: never a broadcast
        sums = self.pieces.join(drawn.hint("merge"), ["source_no", "block"], "left").groupBy("doc_id", "source_no", "size", "first", "source_size", "target")
        some = sums.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(columns).unionByName(self.sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


CHUNK = 1 << 16  # slots of a source that a task maps together


class ManySources(Mix):
    """A mix whose sources are a table."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1.0, 2.0, 3.0), block: int = BLOCK_WORDS, seed: int = 0):
        self.block, self.seed, self.spark = block, seed, df.sparkSession
        sized = sizes_of(df, id_col, text_col, source_col)
        numbered = evenly(durable(sources_of(sized), "sources"), [], [F.col("source").asc_nulls_last()], at="source_no")
        named = durable(numbered.select(F.col("source_no").cast("int").alias("source_no"), F.col("source").alias("name"), F.col("size").alias("source_size"), "n"), "numbered sources")
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int") + 1)
        table = self.with_targets(named.withColumn("weight", weight))
        blocks, size, target = F.ceil(F.col("source_size") / block), F.col("source_size"), F.col("target")
        passes = F.when(size > 0, F.least(F.lit(MOST), F.floor(target / F.greatest(size, F.lit(1))))).otherwise(0)
        more = F.when(size > 0, F.least(blocks, F.bround((target - passes * size) / block))).otherwise(0)
        table = table.withColumn("blocks", blocks).withColumn("quota", (passes * blocks + F.when(passes < MOST, more).otherwise(0)).cast("long"))
        self.table = durable(evenly(table, [], ["source_no"], at="offset", n="slots", size=F.col("quota")), "quotas")
        self.total = self.table.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
        self.shards = max(1, math.ceil(self.total / SHARD_SLOTS))
        rows = sized.count()
        self.sizes = begun(sized.join(self.table.select("name", "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))), rows)

    @staticmethod
    def with_targets(table: DataFrame) -> DataFrame:
        """table with target, as targets() gives it: each round closes the sources that their share would lift above the most."""
        table = table.withColumn("target", F.lit(None).cast("double"))
        left = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
        while True:
            total = table.where("target is null").agg(F.sum("weight")).first()[0]
            if total is None:
                return table
            share, most = F.lit(left) * F.col("weight") / F.lit(total), F.lit(float(MOST)) * F.col("source_size")
            above = F.col("target").isNull() & (share > most)
            closed = table.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most)).alias("words")).first()
            if not closed["n"]:
                return table.withColumn("target", F.coalesce("target", share))
            table, left = durable(table.withColumn("target", F.when(above, most).otherwise(F.col("target"))), "targets"), left - closed["words"]

    @property
    def slots(self) -> DataFrame:
        total, seed = self.total, self.seed

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k, quota, blocks, offset, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    index = np.arange(chunk * CHUNK, min(quota, (chunk + 1) * CHUNK))
                    place = permuted(offset + index, total, seed_of(seed, "order"))
                    block = permuted(index % blocks, blocks, seed_of(seed, "source", k))
                    yield pa.RecordBatch.from_arrays([pa.array(place // SHARD_SLOTS), pa.array(place % SHARD_SLOTS), pa.array(np.full(len(index), k, np.int32)), pa.array(block)], ["shard", "slot", "source_no", "block"])

        chunks = self.table.where("quota > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(quota - 1) div {CHUNK}"))))
        return chunks.select("source_no", "quota", "blocks", "offset", "chunk").repartition("source_no", "chunk").mapInArrow(run, "shard bigint, slot bigint, source_no int, block bigint")


def sizes_of(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return durable(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix sizes")


def sources_of(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def begun(named: DataFrame, rows: int) -> DataFrame:
    """named (doc_id, source_no, size, source_size, target) with first, where a document begins in its source: sums within buckets, and sums of the buckets before; both about the root of all rows."""
    buckets = max(1, math.isqrt(rows))
    own = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).select("doc_id", "source_no", "size", "source_size", "target", "bucket")
    before = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(whole), F.lit(0)))
    inner = placed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inner.join(before, ["source_no", "bucket"]).select("doc_id", "source_no", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("first"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> Mix:
    many = df.select(source_col).distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES
    return (ManySources if many else Mix)(df, id_col, text_col, source_col, **options)


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).taken
