"""A table that is kept, not recomputed: rows are merged into it by key, and only the buckets that a change touches are rewritten.

Rows lie in folders by a hash of their key. What a merge will write is staged as a table of its own, then a journal names it, then
the folders are replaced; a merge that breaks off after the journal is done again by whoever opens the table next, so that it
happened whole or not at all. Columns that come later are null, or a default, in earlier rows. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators.ranks import matched
from tidewell.sources.folders import saved
from tidewell.sources.readers import exists

BUCKETS = 64


class Stored:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.rows, self.journal, self.kinds = f"{path}/rows", f"{path}/journal", f"{path}/schema"
        self.recover()

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def read(self, touched: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first merge."""
        if not exists(self.spark, f"{self.rows}/_bucket=*"):
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(self.spark.read.text(self.kinds).first()[0]))) if exists(self.spark, self.kinds) else None
        df = self.spark.read.option("mergeSchema", True).parquet(self.rows)
        return (df if touched is None else df.where(F.col("_bucket").isin(touched))).drop("_bucket")

    def merge(self, changes: DataFrame, gone: DataFrame | None = None, defaults: dict | None = None) -> None:
        """Inserts or updates the rows of changes, one for each key, and deletes the keys of gone.

        A row that is updated keeps its value in columns that changes hasn't; one that is inserted has null or the default there, as
        earlier rows have in columns that are new.
        """
        changes = saved(changes, "changes")
        gone = saved((changes.limit(0) if gone is None else gone).select(*self.key).distinct(), "gone")
        touched = sorted(r[0] for r in changes.select(self.bucket()).unionByName(gone.select(self.bucket())).distinct().collect())  # BUCKETS at most
        if not touched:
            return
        old = self.read(touched)
        if old is None:
            old = changes.limit(0)
        new = [c for c in changes.columns if c not in self.key]
        kept = [c for c in old.columns if c not in self.key]
        marked = changes.select(*self.key, *(F.col(c).alias(f"_new_{c}") for c in new), F.lit(True).alias("_changed"))
        left = matched(old.withColumn("_old", F.lit(True)), gone.withColumn("_gone", F.lit(True)), self.key, "left").where("_gone is null").drop("_gone")
        both = left.join(marked, self.key, "full")
        absent = {c: F.lit((defaults or {}).get(c)) for c in {*new, *kept}}
        out = []
        for c in new + [c for c in kept if c not in new]:
            if c not in new:
                x = F.when(F.col("_old"), F.col(c)).otherwise(absent[c])
            else:
                x = F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in kept else absent[c])
            out.append(x.alias(c))
        staged = saved(both.select(*self.key, *out, self.bucket()), "staged")
        full = {r[0] for r in staged.select("_bucket").distinct().collect()}
        place = staged.inputFiles()[0].rsplit("/", 1)[0] if full else ""
        self.spark.createDataFrame([(staged.drop("_bucket").schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(self.kinds)
        note = json.dumps({"staged": place, "emptied": sorted(set(touched) - full)})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(self.journal)
        self.recover()

    def recover(self) -> None:
        """Does what the journal says, and removes it; nothing without one."""
        if not exists(self.spark, f"{self.journal}/_SUCCESS"):
            return
        note = json.loads(self.spark.read.text(self.journal).first()[0])
        if note["staged"]:
            self.spark.read.parquet(note["staged"]).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.rows)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(self.rows).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in note["emptied"]:
            fs.delete(jvm.Path(f"{self.rows}/_bucket={b}"), True)
        fs.delete(jvm.Path(self.journal), True)

    def follow(self, target: DataFrame, defaults: dict | None = None) -> None:
        """Makes the table equal to target: new and changed rows are merged, keys that target hasn't are deleted. Rows that are the same aren't rewritten, unless they share a bucket with such."""
        now = self.read()
        if now is None:
            return self.merge(target, None, defaults)
        same = [c for c in target.columns if c in now.columns and c not in self.key]
        before = now.select(*self.key, F.struct(*same).alias("_before"), F.lit(True).alias("_had"))
        met = matched(target, before, self.key, "left")
        more = [c for c in target.columns if c not in now.columns]
        changed = met.where(F.col("_had").isNull() | ~F.struct(*same).eqNullSafe(F.col("_before")) | F.lit(bool(more))).drop("_before", "_had")
        gone = matched(now.select(*self.key), target.select(*self.key).withColumn("_there", F.lit(True)), self.key, "left").where("_there is null").select(*self.key)
        return self.merge(changed, gone, defaults)
