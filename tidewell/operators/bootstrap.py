"""Confidence intervals by resampling clusters.

Rows are first summed up by cluster. A cluster's weights in all replicates follow from its key alone, so each task adds up arrays of
replicates for its own rows; what is shuffled is one array for each task and key. The portable form draws Poisson(1) weights from
hashes, which any SQL engine can repeat. The exact form draws multinomial counts: the range of all clusters is halved again and
again, each half gets a binomial part of the draws of the whole, and every node has a generator of its own, so a task that owns a
block of clusters finds its draws by itself and the draws of a replicate always sum to the clusters.
"""

from __future__ import annotations

import math
import zlib
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import divide
from tidewell.operators.ranks import by_hash

#: Cumulative Poisson(1) probabilities for 0 to 5.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
HELD = 4_000_000  # numbers that a task holds before it passes its sums on
BLOCK = 1 << 16  # clusters whose draws are made together


def weights_of(cluster: str, replicates: int) -> np.ndarray:
    """0 to 6 for each replicate: each md5(cluster:k) gives the four from 4k on, 32 bits each."""
    return drawn_for([cluster], replicates)[0]


def drawn_for(clusters: list[str], replicates: int) -> np.ndarray:
    """weights_of() each, a row a cluster. Whole numbers of 32 bits meet the same bounds as their fractions do."""
    ends = [f":{k}".encode() for k in range(-(-replicates // 4))]
    own = b"".join([md5(c + e, usedforsecurity=False).digest() for c in (c.encode() for c in clusters) for e in ends])
    u = np.frombuffer(own, ">u4").reshape(len(clusters), 4 * len(ends))[:, :replicates].astype(np.uint32)
    out = np.zeros(u.shape, np.int8)
    for p in POISSON:
        out += u >= np.uint32(math.ceil(p * 4294967296))
    return out


def weighted(counts: DataFrame, cluster: str, by: list[str], sums: list[str], replicates: int = 1000) -> DataFrame:
    """The weighted sums of each replicate: by, replicate, sums. sums are whole numbers; a replicate in which all of them are 0 is left out."""
    shape = (len(sums), replicates)
    names = [f"_k{i}" for i in range(len(by))]
    dealt = counts.select(F.col(cluster).cast("string").alias("_cluster"), *(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), *(F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(sums)))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "_cluster").sortWithinPartitions("_cluster")  # a cluster's weights are drawn once
    keys = dealt.select(*names).schema

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}

        def passed_on():
            sums_ = pa.array([x.astype(np.int64).ravel() for x in held.values()], pa.list_(pa.int64()))
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, sums_], [*names, "sums"])

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(1 + i).type for i in range(len(names))]
            own, at = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            value = np.stack([batch.column(1 + len(names) + i).to_numpy(zero_copy_only=False) for i in range(len(sums))], 1)
            index: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(1 + i).to_pylist() for i in range(len(names))), strict=True) if names else [()] * len(at)):
                index.setdefault(key, []).append(r)
            drawn = drawn_for(list(own), replicates)
            for key, rows in index.items():
                new = value[rows].T @ drawn[at[rows]].astype(np.float64)
                held[key] = held[key] + new if key in held else new
                if len(held) * shape[0] * shape[1] > HELD:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    each = dealt.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), "sums array<bigint>"]))
    apart = each.select(*names, F.expr("sequence(0, " + str(replicates - 1) + ")").alias("_r"), *(F.slice("sums", i * replicates + 1, replicates).alias(f"_s{i}") for i in range(len(sums))))
    rows = apart.select(*names, F.inline(F.arrays_zip("_r", *(f"_s{i}" for i in range(len(sums))))))
    out = rows.groupBy(*names, "_r").agg(*(F.sum(f"_s{i}").alias(s) for i, s in enumerate(sums)))
    out = out.select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), F.col("_r").alias("replicate"), *sums)
    return out.where(" + ".join(f"abs(`{s}`)" for s in sums) + " > 0")


def interval(replicated: DataFrame, by: list[str], value: str) -> DataFrame:
    """The 2.5 and 97.5 percentiles, interpolated; NaN counts as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    return replicated.groupBy(*by).agg(F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high"))


def draws_of(total: int, block: int, size: int, iterations: int, seed: list[int]) -> np.ndarray:
    """How many of the `total` draws of each replicate fall into a block of `size` items; the same from whichever task."""
    low, high, m = 0, -(-total // size), np.full(iterations, total, np.int64)
    items = lambda a, b: min(total, b * size) - a * size
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(m, items(low, middle) / items(low, high))
        low, high, m = (low, middle, left) if block < middle else (middle, high, m - left)
    return m


def resampled(wide: DataFrame, by: list[str], sums: list[str], iterations: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(by, sums) rows, one for each cluster -> by, replicate, sums: those of as many clusters drawn with replacement.

    Clusters with the same sums are alike and are held as one row with their number; where they differ, each block of clusters is
    a task's.
    """
    alike = wide.groupBy(*by, *sums).agg(F.count("*").alias("_many"))
    placed = by_hash(alike, by, [F.col(s) for s in sums], seed, at="_at", n="_total", size=F.col("_many"))
    first, last = F.expr(f"_at div {block}"), F.expr(f"(_at + _many - 1) div {block}")
    cut = placed.withColumn("_block", F.explode(F.sequence(first, last)))
    own = F.least(F.col("_at") + F.col("_many"), (F.col("_block") + 1) * block) - F.greatest("_at", F.col("_block") * block)
    dealt = cut.withColumn("_own", own)
    names = [f"s{i}" for i in range(len(sums))]
    dealt = dealt.select(*by, "_block", "_total", "_own", *(F.col(s).cast("long").alias(n) for s, n in zip(sums, names, strict=True)))

    def run(key, table):
        import pyarrow as pa

        value = np.stack([table.column(n).to_numpy() for n in names], 1).astype(np.float64)
        order = np.lexsort(value.T[::-1])  # the draws don't depend on the rows' order
        value, own = value[order], table.column("_own").to_numpy()[order]
        group = [seed, zlib.crc32(repr([k.as_py() for k in key[:-1]]).encode())]
        m = draws_of(int(table.column("_total")[0].as_py()), key[-1].as_py(), block, iterations, group)
        draw, step, found = np.random.default_rng([*group, 1, key[-1].as_py()]), max(1, (1 << 21) // len(own)), []
        for a in range(0, iterations, step):
            found.append(draw.multinomial(m[a : a + step], own / own.sum()).astype(np.float64) @ value)
        out = np.concatenate(found).astype(np.int64)
        columns = {b: pa.array([key[i].as_py()] * iterations, table.schema.field(b).type) for i, b in enumerate(by)}
        return pa.table(columns | {"replicate": pa.array(np.arange(iterations, dtype=np.int32))} | {n: pa.array(out[:, i].copy()) for i, n in enumerate(names)})

    kinds = [f"{b} {wide.schema[b].dataType.simpleString()}" for b in by] + ["replicate int"] + [f"{n} bigint" for n in names]
    each = dealt.groupBy(*by, "_block").applyInArrow(run, ", ".join(kinds))
    return each.groupBy(*by, "replicate").agg(*(F.sum(n).alias(s) for s, n in zip(sums, names, strict=True)))


def macro_f1_interval(counts: DataFrame, cluster: str, by: list[str], classes: list[str], cls: str = "class", iterations: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """low and high of macro-F1 over `classes` from (by, cluster, class, tp, fp, fn) rows, by multinomial resampling of clusters."""
    sums = {(c, x): f"{x}_{k}" for k, c in enumerate(classes) for x in ("tp", "fp", "fn")}
    one = lambda c, x: F.coalesce(F.sum(F.when(F.col(cls) == c, F.col(x))), F.lit(0))
    wide = counts.groupBy(*by, cluster).agg(*(one(c, x).alias(n) for (c, x), n in sums.items())).drop(cluster)
    again = resampled(wide, by, list(sums.values()), iterations, seed, block)
    return interval(again.withColumn("f1", mean_f1([tuple(F.col(sums[c, x]) for x in ("tp", "fp", "fn")) for c in classes])), by, "f1")


def mean_f1(counted: list[tuple[Column, Column, Column]]) -> Column:
    """The mean of the classes' F1 from (tp, fp, fn) of each."""
    return sum((divide(2 * tp, 2 * tp + fp + fn) for tp, fp, fn in counted), F.lit(0.0)) / len(counted)
