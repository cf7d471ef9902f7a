"""Streams of results: once per key, tumbling and session windows, streaks of failures, tasks that don't end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewell.sources.folders import new_folder, saved
from tidewell.sources.readers import exists


def events(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as a stream, `files` of them a trigger; ts as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, length: str, late: str, by: list[str], at: str = "ts") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, length: str, every: str, late: str, by: list[str], at: str = "ts") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, length, every), *by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str, late: str, by: list[str], at: str = "ts") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: list[str], late: str, at: str = "ts") -> DataFrame:
    """The first row of each key, while the watermark remembers it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


BUCKETS = 256


def append_once(path: str, key: list[str], buckets: int = BUCKETS):
    """For foreachBatch: appends rows whose key path doesn't have; safe to repeat after a failure.

    Rows lie in folders by a hash of their key, so a batch reads the folders that it touches, and of these the keys alone. A batch
    that is known to be written, by its query's number and its own, is left out without reading any.
    """

    def write(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        ledger, rows = f"{path}/_batches/{run}-{k}", f"{path}/rows"
        if run and exists(spark, ledger):
            return
        new = saved(batch.dropDuplicates(key).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` numbers at most
        if exists(spark, rows) and touched:
            new = saved(new.join(earlier(spark, rows, key, touched), key, "left_anti"))
        new.write.mode("append").partitionBy("_bucket").parquet(rows)
        spark.createDataFrame([(run, k)], "query string, batch bigint").coalesce(1).write.mode("overwrite").json(ledger)

    return write


def earlier(spark: SparkSession, rows: str, key: list[str], touched: list[int]) -> DataFrame:
    """The keys that lie in the folders of these buckets."""
    return spark.read.parquet(rows).where(F.col("_bucket").isin(touched)).select(*key)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """What append_once() has written."""
    return spark.read.parquet(f"{path}/rows").drop("_bucket")


def with_end(stream: DataFrame, at: str, end, values: dict) -> DataFrame:
    """stream with one row more: `values`, and `at` = end. When it is read, the watermark passes all that came before, so that what is still open is told.

    Join keys need a value that no real row has: a filter against nulls, also one that follows from a join, goes below the
    watermark and would take the row away. Leave it out after the stream.
    """
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, "end")
    row = spark.range(1).select(*(F.lit(end if f.name == at else values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema))
    row.coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(row.schema).parquet(path))


def open_tasks(starts: DataFrame, ends: DataFrame, key: str, late: str, within: str) -> DataFrame:
    """Starts with their end, or null if none came in time: a stream-stream outer join. Open ones come when the watermark has passed them."""
    s = starts.withWatermark("started", late).alias("s")
    e = ends.withWatermark("ended", late).alias("e")
    met = (F.col(f"s.{key}") == F.col(f"e.{key}")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return s.join(e, met, "leftOuter")


def breaker(stream: DataFrame, by: str, item: str, outcome: str, limit: int, at: str = "ts") -> DataFrame:
    """by, item, outcome, streak, stopped of what a run tries until `limit` degenerate outcomes in a row.

    outcome is 'ok', 'error' or 'degenerate'; the first two end a streak. The row that reaches the limit is the run's last: it has
    stopped, and what would come later is left untried, in this trigger, in later ones and after a restart. State: a run's streak
    and whether it has stopped. Rows of a trigger are taken in the order of (at, item).
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (by, item, outcome)}

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, stopped = state.get if state.exists else (0, False)
        whole = pd.concat(list(rows)).sort_values([at, item])
        if stopped:
            whole = whole[:0]
        bad = (whole[outcome] == "degenerate").to_numpy(bool)
        place = np.arange(len(bad))
        good = np.maximum.accumulate(np.where(bad, -1, place)) if len(bad) else place
        streak = np.where(bad, np.where(good < 0, n + place + 1, place - good), 0)
        full = np.nonzero(streak >= limit)[0]
        last = int(full[0]) + 1 if len(full) else len(bad)
        state.update((int(streak[last - 1]) if last else n, bool(stopped or len(full))))
        tried = whole[:last]
        yield pd.DataFrame({by: [key[0]] * last, item: tried[item].to_numpy(), outcome: tried[outcome].to_numpy(), "streak": streak[:last].astype(np.int32), "stopped": streak[:last] >= limit})

    out = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", streak int, stopped boolean"
    return stream.groupBy(by).applyInPandasWithState(run, out, "n int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


class Stopped(Exception):
    """A run ends itself."""


def run_until(stream: DataFrame, path: str, flag: str, times: int = 1) -> bool:
    """Writes the stream's triggers to path until `times` rows in all have the flag; whether that came.

    The count is kept beside the rows, written after them, by trigger. The trigger that reaches it is the last: the query ends
    itself there, and a restart with the same path does nothing.
    """
    spark = stream.sparkSession
    state = "trigger bigint, flagged bigint"

    def so_far(k: int | None = None) -> int:
        found = spark.read.schema(state).json(f"{path}/flags/*") if exists(spark, f"{path}/flags/*") else spark.createDataFrame([], state)
        return found.where(F.lit(True) if k is None else F.col("trigger") < k).agg(F.coalesce(F.sum("flagged"), F.lit(0))).first()[0]

    def write(batch: DataFrame, k: int) -> None:
        if so_far(k) >= times:
            raise Stopped
        batch.write.mode("overwrite").parquet(f"{path}/rows/{k}")
        n = spark.read.schema(batch.schema).parquet(f"{path}/rows/{k}").where(flag).count()
        spark.createDataFrame([(k, n)], state).coalesce(1).write.mode("overwrite").json(f"{path}/flags/{k}")
        if so_far() >= times:
            raise Stopped

    if so_far() < times:
        query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if so_far() < times:  # it didn't end itself
                raise
    return so_far() >= times


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that run_until() has written."""
    return spark.read.schema(schema).parquet(f"{path}/rows/*") if exists(spark, f"{path}/rows/*") else spark.createDataFrame([], schema)


def streaks(stream: DataFrame, by: str, failed: str, limit: int, at: str = "ts") -> DataFrame:
    """by, at, streak: each time that a key's failures in a row reach the limit. State: a number for each key. Rows of a trigger are taken in the order of `at`."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[by].dataType.simpleString()

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        whole = pd.concat(list(rows)).sort_values(at)
        bad = whole[failed].to_numpy(bool)
        place = np.arange(len(bad))
        good = np.maximum.accumulate(np.where(bad, -1, place))
        run = np.where(bad, np.where(good < 0, n + place + 1, place - good), 0)
        state.update((int(run[-1]) if len(run) else n,))
        hit = whole[run == limit]
        yield pd.DataFrame({by: [key[0]] * len(hit), at: hit[at].to_numpy(), "streak": limit})

    return stream.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {at} timestamp, streak int", "n int", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, run through the stream into Parquet below the checkpoint folder, and read back. In complete mode each trigger replaces the table."""
    spark = stream.sparkSession
    path = new_folder(spark)

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/{k}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], stream.schema)


def in_scope(stream: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a stream that today's scope still has; late rows of an older one are left out. scope is read anew by each trigger."""
    return stream.join(scope.select(*key).distinct(), key, "left_semi")


class Progress(StreamingQueryListener):
    """Keeps the rows that each trigger took, and tells every `every` rows."""

    def __init__(self, every: int = 25, tell=print):
        self.every, self.tell, self.rows, self.triggers = every, tell, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        before, self.rows = self.rows, self.rows + int(event.progress.numInputRows)
        self.triggers += 1
        if self.rows // self.every > before // self.every:
            self.tell(f"{self.rows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
