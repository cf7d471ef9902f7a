"""Queries that write and read files of the checkpoint folder: each goes through a sink and its reader, and must come back as it was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions import names
from tidewell.operators import judging, ordered, ranks
from tidewell.operators.stored import Stored
from tidewell.sources.folders import new_folder
from tidewell.plans.catalogue import _stream, query, r6, read
from tidewell.sources import publish, readers, writers
from tidewell.sources import recordings as edf
from tidewell.streaming import streams


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 5 > 0 THEN 'a \"b\", ' || p_brand || chr(10) || 'c' END AS note FROM part")
def csv_round_trip(spark, d):
    path = new_folder(spark)
    note = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit('a "b", '), "p_brand", F.lit("\nc")))
    writers.csv(read(spark, d, "part").withColumn("note", note), path, ["p_partkey", "p_name", "note"])
    return readers.csv(spark, path, "p_partkey bigint, p_name string, note string").unionByName(readers.csv(spark, f"{path}-absent", "p_partkey bigint, p_name string, note string"))


@query("SELECT DISTINCT p_brand AS path, p_type AS model FROM part")
def key_pairs(spark, d):
    path = new_folder(spark)
    writers.append(read(spark, d, "part"), path, ["p_brand", "p_type", "p_partkey"], ["p_type"])
    return readers.pairs(spark.read.parquet(path), "p_brand", "p_type").select(F.col("p_brand").alias("path"), F.col("p_type").alias("model"))


@query("SELECT doc_id, source, lang AS target, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, n_chars AS size FROM documents")
def jsonl_round_trip(spark, d):
    path = new_folder(spark)
    inner = F.to_json(F.struct(F.col("n_chars").alias("size")))
    rows = read(spark, d, "documents").select("doc_id", "source", inner.alias("output"), F.col("lang").alias("target"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    writers.jsonl(rows, path, ["target", "split"])
    back = readers.nested_json(readers.jsonl(spark, path, "doc_id bigint, source string, output string, target string, split string"), "output", "size bigint")
    return back.select("doc_id", "source", "target", "split", "output.size")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def rewritten_table(spark, d):
    path = new_folder(spark)
    writers.append(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), path, ["o_orderkey", "status"])
    writers.replace(spark.read.parquet(path).withColumn("status", F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise(F.col("status"))), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS ground_truth_rationale FROM part")
def manifest_rewrite(spark, d):
    p = read(spark, d, "part")
    return writers.manifest(p.select(F.col("p_partkey").alias("path")), p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("ground_truth_rationale")), "path")


@query("SELECT event_id, substr('E: ' || event_type || ' ' || repeat('x', 600), 1, 500) AS error FROM events")
def failure_log(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("E:  \n"), "event_type", F.lit("\t"), F.repeat(F.lit("x"), 600)).alias("error"))
    path = new_folder(spark)
    writers.append(writers.failures(e, "error"), path, ["event_id", "error", "time"])
    return spark.read.parquet(path).where("time is not null").select("event_id", "error")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_outputs(spark, d):
    return writers.missing(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query(
    """WITH h AS (SELECT o_orderstatus AS status, ('0x' || substr(md5('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}'), 1, 15))::BIGINT AS h FROM orders)
 SELECT status, count(*) AS rows, md5(CAST(sum(h) AS VARCHAR)) AS md5 FROM h GROUP BY status"""
)
def table_fingerprint(spark, d):
    """A digest of the orders of each status, whatever their order and partitions."""
    return writers.fingerprint(read(spark, d, "orders").repartition(7).withColumn("status", F.col("o_orderstatus")), ["o_orderkey", "o_orderpriority"], ["status"])


@query("WITH t AS (SELECT r_regionkey, r_name FROM region) SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS \"table\" FROM t")
def markdown_table(spark, d):
    return judging.markdown(read(spark, d, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])


@query("SELECT 'metrics' AS name, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'predictions', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders UNION ALL SELECT 'rationales', CAST(doc_id AS VARCHAR), CAST(quality AS VARCHAR) FROM labels")
def bundle_export(spark, d):
    path = new_folder(spark)
    tables = {"metrics": ("part", ["p_partkey", "p_size"]), "predictions": ("orders", ["o_orderkey", "o_orderstatus"]), "rationales": ("labels", ["doc_id", "quality"])}
    writers.bundle({n: (read(spark, d, t), fields) for n, (t, fields) in tables.items()}, path)
    one = lambda n, fields: readers.csv(spark, f"{path}/{n}", f"{fields[0]} string, {fields[1]} string").select(F.lit(n).alias("name"), F.col(fields[0]).alias("key"), F.col(fields[1]).alias("value"))
    a, b, c = (one(n, fields) for n, (_, fields) in tables.items())
    return a.unionByName(b).unionByName(c)


@query("SELECT DISTINCT 'r' || user_id % 24 AS recording, round(value, 2) AS start_time, unnest(string_split(event_type || '_seiz', '_')) AS label FROM events WHERE event_type <> 'view' UNION SELECT DISTINCT 'r' || user_id % 24, round(value, 2), 'seiz' FROM events")
def annotation_files(spark, d):
    """A file for each of 24 recordings, with a comment and a header."""
    path = new_folder(spark)
    line = F.concat_ws(",", F.lit("F8"), F.round("value", 2).cast("string"), F.lit("99"), F.concat("event_type", F.lit("_seiz")))
    rows = read(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 24).cast("string"), F.lit("_seiz")).alias("name"), F.col("event_id").alias("at"), line.alias("value"))
    heads = spark.range(24).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit("_seiz")).alias("name"), F.inline(F.array(F.struct(F.lit(-2).alias("at"), F.lit("# made for this query").alias("value")), F.struct(F.lit(-1).alias("at"), F.lit("channel,start_time,stop_time,label").alias("value")))))
    writers.named_files(rows.unionByName(heads.withColumn("at", F.col("at").cast("long"))), f"{path}/parts", "name", ["at"], "value", f"{path}/files", ".csv")
    out = readers.annotations(spark, f"{path}/files/*.csv", ["seiz", "click", "purchase", "error", "signup"])
    return out.select("recording", "start_time", "label").distinct()


@query("SELECT event_id AS start_time, CASE WHEN event_id % 2 = 0 THEN 'spsw' ELSE 'gped' END AS label FROM events WHERE event_id % 3 > 0")
def coded_files(spark, d):
    path = new_folder(spark)
    k = F.col("event_id")
    code = F.when(k % 3 == 0, "9").when(k % 2 == 0, "1").otherwise("2")
    read(spark, d, "events").select(F.concat_ws(",", F.lit("3"), k.cast("string"), F.lit("5"), code).alias("value")).unionByName(spark.createDataFrame([("only,three,fields",)], "value string")).write.text(path)
    return readers.coded_lines(spark, path, {"1": "spsw", "2": "gped"}).select(F.col("start_time").cast("long").alias("start_time"), "label")


@query("WITH g AS (SELECT user_id % 16 AS k, string_agg(event_id || ':' || event_type || chr(10), '' ORDER BY event_id) AS t FROM events GROUP BY 1) SELECT 'h' || k AS name, strlen(t) AS length, md5(t) AS md5 FROM g")
def file_hashes(spark, d):
    """Sixteen files, listed and hashed, and a table of their hashes read back."""
    path, e = new_folder(spark), read(spark, d, "events")
    lines = e.select(F.concat(F.lit("h"), (F.col("user_id") % 16).cast("string")).alias("name"), "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("value"))
    writers.named_files(lines, f"{path}/parts", "name", ["event_id"], "value", f"{path}/files", ".txt")
    writers.csv(readers.hashes(spark, f"{path}/files", "*.txt"), f"{path}/hashes", ["path", "md5"])
    known = readers.csv(spark, f"{path}/hashes", "path string, md5 string")
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return readers.listing(spark, f"{path}/files", "*.txt").join(known, "path").select(name.alias("name"), "length", "md5")


@query("SELECT p_partkey AS k, p_size AS a, p_brand AS b FROM part UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def union_of_files(spark, d):
    path = new_folder(spark)
    writers.csv(read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"), F.col("p_brand").alias("b")), f"{path}/one", ["k", "a", "b"])
    writers.csv(read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("b")), f"{path}/two", ["k", "b"])
    writers.csv(read(spark, d, "region"), f"{path}/three", ["r_name"])
    out = readers.union_by_schema(spark, [f"{path}/one", f"{path}/two", f"{path}/three"], ["k", "b"])
    return out.select(F.col("k").cast("long").alias("k"), F.col("a").cast("int").alias("a"), "b")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality = 1 ELSE toxic = 1 END AS label FROM labels WHERE doc_id % 3 < 2")
def two_shapes(spark, d):
    path, l = new_folder(spark), read(spark, d, "labels")
    l.where("doc_id % 3 = 0").select("doc_id", F.to_json(F.struct((F.col("quality") == 1).alias("label"))).alias("output")).write.json(f"{path}/a")
    l.where("doc_id % 3 = 1").select("doc_id", (F.col("toxic") == 1).alias("epilepsy")).write.json(f"{path}/b")
    l.where("doc_id % 3 = 2").select("doc_id").write.json(f"{path}/c")
    rows = readers.jsonl(spark, f"{path}/*", "doc_id bigint, output string, epilepsy boolean")
    label = F.coalesce(F.from_json("output", "label boolean")["label"], F.col("epilepsy"))
    return rows.select("doc_id", label.alias("label")).where("label is not null")


@query("WITH e AS (SELECT user_id % 7 AS run, event_id AS step, value FROM events) SELECT 'run' || run AS run, max(step) AS step, round(max_by(value, step), 6) AS loss FROM e GROUP BY run")
def training_states(spark, d):
    """Each run's last state of its first and last step, in <run>/checkpoint-<step> folders that one job writes."""
    path = new_folder(spark)
    e = read(spark, d, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run"), F.col("event_id").alias("step"), "value")
    few = e.groupBy("run").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("loss"), F.min("step").alias("first"))
    states = few.select("run", F.inline(F.array(F.struct(F.col("first").alias("step"), F.lit(0.5).alias("loss")), F.struct("step", "loss"))))
    lines = states.select(F.concat_ws("-", "run", F.lit("checkpoint"), F.col("step").cast("string")).alias("name"), F.to_json(F.struct("loss")).alias("value"), F.lit(0).alias("at"))
    folder = lambda n: "/".join(n.split("-", 1)) + "/trainer_state"
    writers.named_files(lines, f"{path}/parts", "name", ["at"], "value", f"{path}/files", ".json", folder)
    out = readers.latest_states(spark, f"{path}/files/*/*", "loss double")
    return out.select("run", "step", r6("loss").alias("loss"))


@query("SELECT event_id // 100 AS step, round(max_by(value, event_id) FILTER (event_type = 'view'), 6) AS loss, round(max_by(value, event_id) FILTER (event_type = 'click'), 6) AS score FROM events GROUP BY 1")
def merged_log(spark, d):
    e = read(spark, d, "events").select(F.expr("event_id div 100").alias("step"), "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("loss"), F.when(F.col("event_type") == "click", F.col("value")).alias("score"))
    out = ordered.merged(e, ["step"], "event_id", "loss", "score")
    return out.select("step", r6("loss").alias("loss"), r6("score").alias("score"))


@query("SELECT coalesce(x.s_name, n.n_name) AS model, CASE WHEN x.s_name IS NULL THEN 'derived' ELSE 'explicit' END AS backend, coalesce(x.s_acctbal, n.n_nationkey) AS hours FROM (SELECT n_name AS s_name, max(s_acctbal) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 3 > 0 GROUP BY 1) x FULL JOIN nation n ON x.s_name = n.n_name")
def model_registry(spark, d):
    """Models of a configuration and those derived from another; explicit entries win."""
    nations = read(spark, d, "nation")
    own = read(spark, d, "supplier").where("s_nationkey % 3 > 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("model")).agg(F.lit("explicit").alias("backend"), F.max("s_acctbal").alias("hours"))
    return readers.registry(own, nations.select(F.col("n_name").alias("model"), F.lit("derived").alias("backend"), F.col("n_nationkey").cast("double").alias("hours")))


@query("SELECT DISTINCT source AS class, count(*) OVER (PARTITION BY source) AS files FROM documents")
def classes_from_folders(spark, d):
    t = read(spark, d, "documents").select(F.concat_ws("/", F.lit("data"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".edf"))).alias("path"))
    return t.groupBy(readers.from_folder(F.col("path")).alias("class")).agg(F.count("*").alias("files"))


@query("SELECT regexp_extract(f, '^(.*)-[^-]+$', 1) AS model, regexp_extract(f, '([^-]+)$', 1) AS dataset, count(*) AS n FROM (SELECT replace(p_brand, '#', '-') || '-' || replace(p_type, ' ', '_') AS f FROM part) GROUP BY ALL")
def names_from_files(spark, d):
    f = F.concat_ws("-", F.replace("p_brand", F.lit("#"), F.lit("-")), F.replace("p_type", F.lit(" "), F.lit("_")))
    p = read(spark, d, "part").select(f.alias("f"))
    return p.groupBy(F.regexp_extract("f", "^(.*)-[^-]+$", 1).alias("model"), names.last_part(F.col("f"), "-").alias("dataset")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'all+' || event_type END AS labels FROM events")
def literal_sets(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, "nothing").otherwise(F.concat(F.lit("{'"), "event_type", F.lit("', 'all'}")))
    own = L.literal_set(v)
    return read(spark, d, "events").select("event_id", F.when(F.size(own) == 0, "").otherwise(F.concat(F.lit("all+"), F.array_join(F.array_remove(own, "all"), ""))).alias("labels"))


@query("SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm_sliding(spark, d):
    out = streams.finished(streams.sliding(_stream(spark, d), "1 day", "12 hours", "1 hour", ["event_type"]), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stm_append_once(spark, d):
    path = new_folder(spark)
    for _ in range(2):  # a restart that has lost its checkpoint takes all rows again
        started = _stream(spark, d).select("user_id", "event_type").writeStream.foreachBatch(streams.append_once(path, ["user_id", "event_type"])).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start()
        started.awaitTermination()
    return streams.appended(spark, path)


def _parts(spark, d, n: int = 4) -> DataFrame:
    """The events as a stream of parts in order of their ids, one a trigger."""
    path, e = new_folder(spark), read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    for r in range(n):  # files are taken in the order of their times
        part = F.expr(f"(event_id - {low}) * {n} div ({high} - {low} + 1) = {r}")
        e.where(part).coalesce(1).write.mode("append").parquet(path)
    return streams.events(spark, path, e.schema, "part-*", 1)


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL '6 hours', min(ts)) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)")
def stm_whole_windows(spark, d):
    """Windows that have ended; the last, incomplete one isn't told."""
    out = streams.finished(streams.tumbling(_stream(spark, d), "6 hours", "0 seconds", []), "append")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def stm_stored(spark, d):
    """A kept table that each trigger brings up to date; only the buckets of its keys are rewritten."""
    table, e = Stored(spark, new_folder(spark), ["user_id"], 16), _parts(spark, d)

    def follow(batch: DataFrame, k: int) -> None:
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.count("*").alias("n"))
        before = table.read()
        # a trigger that is repeated after a failure finds its own rows, and adds none
        old = before.select("user_id", F.col("event_id").alias("_last"), F.col("n").alias("_n")) if before is not None else new.select("user_id", F.lit(None).cast("long").alias("_last"), F.lit(0).cast("long").alias("_n"))
        fresh = new.join(old, "user_id", "left").where("_last is null or event_id > _last")
        table.merge(fresh.select("user_id", "event_id", "event_type", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))

    started = e.writeStream.foreachBatch(follow).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start()
    started.awaitTermination()
    return table.read()


OUTCOMES = """o AS (SELECT user_id % 5 AS run, event_id, CASE WHEN value > 15 AND event_id % 11 > 0 THEN 'degenerate' WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM events),
 b AS (SELECT *, sum(CASE WHEN outcome = 'degenerate' THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY event_id) AS block FROM o),
 s AS (SELECT *, CASE WHEN outcome = 'degenerate' THEN count(*) FILTER (outcome = 'degenerate') OVER (PARTITION BY run, block ORDER BY event_id) ELSE 0 END AS streak FROM b),
 f AS (SELECT run, min(event_id) FILTER (streak >= 3) AS last FROM s GROUP BY run)"""


@query(f"WITH {OUTCOMES} SELECT s.run, event_id, outcome, CAST(streak AS INTEGER) AS streak, streak >= 3 AS stopped FROM s JOIN f ON s.run = f.run WHERE last IS NULL OR event_id <= last")
def stm_breaker(spark, d):
    """Five runs, each ended by its third degenerate answer in a row; over a restart, too."""
    e, k = _parts(spark, d), F.col("event_id")
    outcome = F.when((F.col("value") > 15) & (k % 11 > 0), "degenerate").when(k % 11 == 0, "error").otherwise("ok")
    tried = streams.breaker(e.select((F.col("user_id") % 5).alias("run"), "event_id", outcome.alias("outcome"), k.alias("at")), "run", "event_id", "outcome", 3, "at")
    path = new_folder(spark)
    for _ in range(2):
        streams.run_until(tried, path, "stopped", 5)
    return streams.written(spark, path, tried.schema)


@query(
    """WITH p AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // (count(*) OVER () // 8) AS part, value FROM events), c AS (SELECT part, avg(value) AS loss FROM p GROUP BY part), m AS (SELECT *, loss > (SELECT median(loss) FROM c) AS bad FROM c),
 s AS (SELECT *, coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT CAST(part AS INTEGER) AS part, bad FROM s WHERE before < 2"""
)
def stm_early_stop(spark, d):
    """Evaluations, one a trigger; the second bad one is the last that is run."""
    e = read(spark, d, "events").select("event_id", "value")
    n = e.count()
    part = ranks.evenly(e, [], ["event_id"]).select(F.expr(f"_at div {n // 8}").cast("int").alias("part"), "value")
    c = part.groupBy("part").agg(F.avg("value").alias("loss"))
    middle = c.agg(F.percentile("loss", 0.5).alias("middle"))
    checks, path = c.join(F.broadcast(middle), how="cross").select("part", (F.col("loss") > F.col("middle")).alias("bad")), new_folder(spark)  # one row
    for r in range(n // (n // 8) + 1):  # a file a check, in their order
        checks.where(F.col("part") == r).coalesce(1).write.parquet(f"{path}/in/{r}")
    stream = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    for _ in range(2):
        streams.run_until(stream.select("part", "bad"), f"{path}/out", "bad", 2)
    return streams.written(spark, f"{path}/out", checks.schema)


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY 1")
def stm_in_scope(spark, d):
    scope = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return streams.finished(streams.in_scope(_stream(spark, d), scope, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT count(*) AS rows, count(*) // 25 > 0 AS told FROM events")
def stm_progress(spark, d):
    import time

    told: list[str] = []
    seen = streams.Progress(25, told.append)
    spark.streams.addListener(seen)
    try:
        streams.finished(_stream(spark, d).select("event_id"), "append").count()
        until = time.time() + 30
        while not seen.rows and time.time() < until:  # events arrive a moment later
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    return spark.createDataFrame([(seen.rows, bool(told))], "rows bigint, told boolean")


@query("WITH s AS (SELECT event_id AS task, ts AS started FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id - 1 AS task, ts AS ended FROM events WHERE event_id % 4 = 1) SELECT s.task, s.started, e.ended FROM s LEFT JOIN e ON s.task = e.task AND ended >= started AND ended <= started + INTERVAL '1 hour'")
def stm_open_tasks(spark, d):
    """Tasks with their end, or without one: those that take longer than an hour, and the last ones of the table, too."""
    end = read(spark, d, "events").agg((F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("t")).first()["t"]
    s = _stream(spark, d).where("event_id % 2 = 0").select(F.col("event_id").alias("task"), F.col("ts").alias("started"))
    e = _stream(spark, d).where("event_id % 4 = 1").select((F.col("event_id") - 1).alias("task"), F.col("ts").alias("ended"))
    met = streams.open_tasks(streams.with_end(s, "started", end, {"task": -1}), streams.with_end(e, "ended", end, {"task": -2}), "task", "1 hour", "1 hour").select(F.col("s.task").alias("task"), "started", "ended")
    return streams.finished(met, "append").where("task >= 0").select("task", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"))


@query("SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS record, round(list_sum(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))), 3) AS total FROM embeddings QUALIFY record BETWEEN 20 AND 29")
def recordings(spark, d):
    """A recording for each label, a second for each vector; ten seconds of each are read back."""
    spark.dataSource.register(edf.Recordings)
    path = new_folder(spark)
    e = read(spark, d, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("recording"), ordered.ordinal(["label"], ["vec_id"]).cast("long").alias("record"), F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("double")).alias("samples"))
    e.repartition("recording").sortWithinPartitions("recording", "record").write.format("recordings").mode("append").save(path)
    back = spark.read.format("recordings").option("start", 20).option("stop", 30).load(path)
    return back.select(F.regexp_extract("path", r"r(\d+)\.edf$", 1).cast("int").alias("recording"), "record", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


CHANGES = """o AS (SELECT o_orderkey AS path, o_custkey % 7 AS model, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders)"""


@query(f"WITH {CHANGES} SELECT path, CAST(model AS INTEGER) AS model, CASE WHEN path % 5 = 0 THEN 'new' ELSE status END AS status, price, path % 5 = 0 AS judged FROM o WHERE path % 3 > 0 AND model <> 2")
def stored_state(spark, d):
    """A table after three changes: all rows; a third of the paths gone; a model closed, a column more and some rows updated."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 7).cast("int").alias("model"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))
    table = Stored(spark, new_folder(spark), ["path", "model"], 16)
    table.follow(o)
    table.follow(o.where("path % 3 > 0"))
    fifth = F.col("path") % 5 == 0
    table.follow(o.where("path % 3 > 0 and model <> 2").withColumn("status", F.when(fifth, "new").otherwise(F.col("status"))).withColumn("judged", fifth), {"judged": False})
    return table.read()


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 2 = 0 GROUP BY lang")
def publish_sets(spark, d):
    """A set for each language, published together; a later attempt in which one set leaks leaves all as they were."""
    root, docs = new_folder(spark), read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    langs = [r[0] for r in docs.groupBy("lang").count().orderBy("lang").collect()]  # four languages
    held = docs.where("doc_id % 2 = 1").select("doc_id")
    sets = lambda rows: {x: (part := rows.where(F.col("lang") == x), part.join(held, "doc_id", "left_semi")) for x in langs}
    publish.publish(spark, root, sets(docs.where("doc_id % 2 = 0")))
    try:
        publish.publish(spark, root, sets(docs.where(F.expr(f"doc_id % 2 = 0 or lang = '{langs[-1]}'"))))
    except publish.NotPublished:
        pass
    frames = [publish.published(spark, root, x, check=True) for x in langs]
    return reduce(lambda a, b: a.unionByName(b), frames).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
