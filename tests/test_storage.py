"""Tables that are kept and published, recordings, and streams over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.stored import Stored
from tidewell.sources import publish, recordings
from tidewell.streaming import streams


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_merges(spark, tmp_path):
    """Inserts, updates, deletes and new columns, by hand."""
    draw, want = random.Random(5), {}
    table = Stored(spark, str(tmp_path), ["k"], 5)
    assert table.read() is None
    for turn in range(4):
        changes = {draw.choice([*range(12), None]): draw.choice(["x", None, f"v{turn}"]) for _ in range(6)}
        gone = {draw.randrange(12) for _ in range(3)} - set(changes)
        schema = "k int, a string" if turn < 2 else "k int, a string, b int"
        rows = [(k, v) if turn < 2 else (k, v, turn) for k, v in changes.items()]
        table.merge(spark.createDataFrame(rows, schema), spark.createDataFrame([(k,) for k in gone], "k int"), {"b": -1})
        for k, v in changes.items():
            want[k] = (v, turn if turn >= 2 else None)
        want = {k: v for k, v in want.items() if k not in gone}
    null_b = {k: (a, b) for k, (a, b) in want.items()}
    got = {r["k"]: (r["a"], r["b"]) for r in table.read().collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in null_b.items()}
    assert all(got[k][1] == b if b is not None else got[k][1] in (None, -1) for k, (_, b) in null_b.items())


def test_follow_and_empty(spark, tmp_path):
    table = Stored(spark, str(tmp_path), ["k"], 3)
    for rows in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (3, "c"), (4, "d")], [], [(9, "z")]):
        table.follow(spark.createDataFrame(rows, "k int, v string"))
        assert values(table.read()) == rows


def test_merge_that_broke_off(spark, tmp_path):
    """The journal is there, the rows aren't replaced yet: whoever opens the table next finishes."""
    table = Stored(spark, str(tmp_path), ["k"], 2)
    table.merge(spark.createDataFrame([(k, "old") for k in range(8)], "k int, v string"))
    real, Stored.recover = Stored.recover, lambda self: None
    try:
        table.merge(spark.createDataFrame([(3, "new")], "k int, v string"), spark.createDataFrame([(4,)], "k int"))
    finally:
        Stored.recover = real
    again = Stored(spark, str(tmp_path), ["k"], 2)
    assert dict(values(again.read())) == {k: "new" if k == 3 else "old" for k in range(8) if k != 4}


def test_untouched_buckets_stay(spark, tmp_path):
    table = Stored(spark, str(tmp_path), ["k"], 8)
    table.merge(spark.createDataFrame([(k, 0) for k in range(40)], "k int, v int"))
    before = {(p.parent.name, p.name) for p in tmp_path.glob("rows/_bucket=*/part-*.parquet")}
    table.merge(spark.createDataFrame([(7, 1)], "k int, v int"))
    after = {(p.parent.name, p.name) for p in tmp_path.glob("rows/_bucket=*/part-*.parquet")}
    assert len({b for b, _ in before - after}) == 1 and len(before) == 8


def test_all_or_nothing(spark, tmp_path):
    root, a, b = str(tmp_path), spark.range(3), spark.range(5)
    first = publish.publish(spark, root, {"a": (a, None), "b": (b, b.where("id > 9"))})
    for bad in ({"a": (spark.range(7), None), "b": (b, b)}, {"a": (spark.range(7), None), "b": (b.limit(0), None)}):
        with pytest.raises(publish.NotPublished):
            publish.publish(spark, root, bad)
        assert publish.published(spark, root, "a", check=True).count() == 3
    publish.publish(spark, root, {"a": (spark.range(7), None), "b": (b, None)})
    assert publish.published(spark, root, "a").count() == 7 and publish.published(spark, root, "a", "first").count() == 3
    now = publish.pointer(spark, root)
    assert now["first"] == now["before"] == first
    spark.range(7, 8).write.mode("append").parquet(f"{root}/versions/{now['version']}/a")
    with pytest.raises(publish.NotPublished):
        publish.published(spark, root, "a", check=True)


def test_recordings(spark, tmp_path):
    """Written, read whole, by time and by channel; the plan has the asked records alone."""
    spark.dataSource.register(recordings.Recordings)
    rows = [(f"p{r}_s", k, [float(r * 100 + k + x) for x in range(8)]) for r in range(3) for k in range(25)]
    df = spark.createDataFrame(rows, "recording string, record bigint, samples array<double>")
    df.repartition("recording").sortWithinPartitions("recording", "record").write.format("recordings").mode("append").option("duration", 2).save(f"{tmp_path}/r")
    back = spark.read.format("recordings").load(f"{tmp_path}/r")
    assert sorted((r["path"].rsplit("/", 1)[1][:-4], r["record"], r["samples"]) for r in back.collect()) == rows
    part = spark.read.format("recordings").option("start", 7).option("stop", 12).option("channels", "EEG").load(f"{tmp_path}/r").collect()
    assert {r["record"] for r in part} == {3, 4, 5} and {(r["rate"], r["start_time"]) for r in part} == {(4.0, 6.0), (4.0, 8.0), (4.0, 10.0)}
    assert spark.read.format("recordings").option("channels", "ECG").load(f"{tmp_path}/r").count() == 0
    reader = recordings.Reader({"path": f"{tmp_path}/r", "start": "10", "stop": "30", "records": "4"})
    assert [(p.first, p.last) for p in reader.partitions()] == [(5, 9), (9, 13), (13, 15)] * 3


def test_two_signals(tmp_path):
    """A file with signals of different rates and ranges."""
    import numpy as np

    head = recordings.written_header(["A", "B"], [2, 4], -100, 100, 3, 1, "p")
    data = np.arange(18).astype("<i2").tobytes()
    (tmp_path / "x.edf").write_bytes(head + data)
    reader = recordings.Reader({"path": str(tmp_path), "start": "1", "stop": "2"})
    (part,) = reader.partitions()
    a, b = reader.read(part)
    scale = 200 / 65535
    assert a["samples"][0].as_py() == pytest.approx([(v + 32768) * scale - 100 for v in (6, 7)]) and b["samples"][0].as_py() == pytest.approx([(v + 32768) * scale - 100 for v in (8, 9, 10, 11)])
    assert a["rate"][0].as_py() == 2.0 and b["channel"][0].as_py() == "B"


def files(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_breaker(spark, tmp_path):
    """Errors end a streak; the limit ends the run in the middle of a trigger, for later triggers and a restart, too."""
    d, e, o = "degenerate", "error", "ok"
    kinds = [[d, d, e, d], [d, o, d, d], [d, d, o], [o, o]]
    parts, at = [], 0
    for own in kinds:
        parts.append([("run", at + k, x) for k, x in enumerate(own)] + [("quiet", at + k, o) for k in range(2)])
        at += len(own)
    stream = files(spark, tmp_path, parts, "run string, at int, outcome string")
    tried = streams.breaker(stream, "run", "at", "outcome", 3, "at")
    assert streams.run_until(tried, f"{tmp_path}/out", "stopped", 1)
    got = values(streams.written(spark, f"{tmp_path}/out", tried.schema).where("run = 'run'").select("at", "outcome", "streak", "stopped"))
    flat = [x for own in kinds for x in own]
    assert got == [(k, flat[k], s, k == 8) for k, s in enumerate([1, 2, 0, 1, 2, 0, 1, 2, 3])]
    spark.createDataFrame([("run", 99, o)], "run string, at int, outcome string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert streams.run_until(tried, f"{tmp_path}/out", "stopped", 1)
    assert len(values(streams.written(spark, f"{tmp_path}/out", tried.schema).where("run = 'run'"))) == 9
    # a run of its own keeps its state over a restart, and what it tries after the stop is nothing
    both = f"{tmp_path}/other"
    assert not streams.run_until(tried, both, "stopped", 2)
    assert max(r["at"] for r in streams.written(spark, both, tried.schema).where("run = 'run'").collect()) == 8
    spark.createDataFrame([("run", 100, o), ("quiet", 100, d)], "run string, at int, outcome string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert not streams.run_until(tried, both, "stopped", 2)
    assert values(streams.written(spark, both, tried.schema).where("at >= 99").select("run", "at")) == [("quiet", 100)]


def test_run_that_ends_itself(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1, False)], [(2, True)], [(3, False)], [(4, True)], [(5, False)]], "k int, bad boolean")
    assert streams.run_until(stream, f"{tmp_path}/out", "bad", 2)
    assert streams.run_until(stream, f"{tmp_path}/out", "bad", 2)
    assert values(streams.written(spark, f"{tmp_path}/out", stream.schema).select("k")) == [(1,), (2,), (3,), (4,)]
    assert sorted(p.name for p in (tmp_path / "out" / "rows").iterdir()) == ["0", "1", "2", "3"]  # the fifth trigger didn't run


def test_append_once(spark, tmp_path):
    """Replayed batches add nothing, and a batch reads the folders of its own keys."""
    path, df = f"{tmp_path}/sink", spark.createDataFrame([(k % 30, k) for k in range(90)], "k int, v int")
    for part in (df.where("v < 40"), df, df.where("v < 40")):
        streams.append_once(path, ["k"], 16)(part, 0)
    assert sorted(r["k"] for r in streams.appended(spark, path).collect()) == list(range(30))
    plan = streams.earlier(spark, f"{path}/rows", ["k"], [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "ReadSchema: struct<k:int>" in plan
    stream = files(spark, tmp_path, [[(1, 1)], [(1, 2), (2, 2)]], "k int, v int")
    for turn in range(2):  # the second has lost its checkpoint
        q = stream.writeStream.foreachBatch(streams.append_once(f"{tmp_path}/s", ["k"])).option("checkpointLocation", f"{tmp_path}/c{turn}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert values(streams.appended(spark, f"{tmp_path}/s").select("k")) == [(1,), (2,)]
    assert len(list((tmp_path / "s" / "_batches").iterdir())) == 4  # two triggers of two queries


def test_open_tasks_of_a_table_that_ends(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1, "2024-01-01 00:00:00", "start"), (1, "2024-01-01 00:30:00", "end"), (2, "2024-01-01 00:10:00", "start")], [(2, "2024-01-01 02:30:00", "end"), (3, "2024-01-01 02:40:00", "start")]], "task int, ts string, kind string")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    s, e = (stream.where(F.col("kind") == k).select("task", F.col("ts").alias(n)) for k, n in (("start", "started"), ("end", "ended")))
    end = spark.sql("SELECT timestamp'2024-01-03 00:00:00' AS t").first()["t"]
    met = streams.open_tasks(streams.with_end(s, "started", end, {"task": -1}), streams.with_end(e, "ended", end, {"task": -2}), "task", "1 hour", "1 hour")
    got = streams.finished(met.select(F.col("s.task").alias("task"), "ended"), "append").where("task >= 0")
    assert sorted((r["task"], r["ended"] is not None) for r in got.collect()) == [(1, True), (2, False), (3, False)]
