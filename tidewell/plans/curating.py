"""Queries of curation: what is sampled, imported, filled in, left out and checked before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions import names, numbers
from tidewell.functions import text as texts
from tidewell.operators import checks, curation, intervals, judging, ordered, planning, sampling, state
from tidewell.plans.catalogue import DISTANCE, KEY, LABELLED, RANKED, STATE, W, _distances, _labelled, _state, _texts, query, r6, read, windows


@query(
    """WITH u AS (SELECT o_orderkey AS recording, o_custkey AS patient, CAST(floor(o_totalprice / 50000) AS BIGINT) + 1 AS n FROM orders), r AS (SELECT *, sum(n) OVER (ORDER BY md5('0|' || recording), recording ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER () AS total FROM u)
 SELECT recording, CASE WHEN before < 0.2 * total THEN 'test' WHEN before < (0.2 + 0.1) * total THEN 'val' ELSE 'train' END AS split FROM r"""
)
def random_split(spark, d):
    u = read(spark, d, "orders").select(F.col("o_orderkey").alias("recording"), (F.floor(F.col("o_totalprice") / 50000) + 1).cast("long").alias("n"))
    return sampling.cut_in_three(u, "n", [F.col("recording")], 0.2, 0.1).select("recording", "split")


@query(
    """WITH u AS (SELECT o_orderkey AS recording, o_custkey AS patient FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || recording), recording) - 1 AS before, count(*) OVER () AS total FROM u),
 s AS (SELECT patient, CASE WHEN before < 0.2 * total THEN 'test' WHEN before < (0.2 + 0.1) * total THEN 'val' ELSE 'train' END AS split FROM r), p AS (SELECT DISTINCT patient FROM s WHERE split = 'test')
 SELECT count(*) AS test_patients, count(*) FILTER (patient IN (SELECT patient FROM s WHERE split = 'train')) AS seen FROM p"""
)
def random_split_leak(spark, d):
    u = read(spark, d, "orders").select(F.col("o_orderkey").alias("recording"), F.col("o_custkey").alias("patient"), F.lit(1).cast("long").alias("n"))
    s = sampling.cut_in_three(u, "n", [F.col("recording")], 0.2, 0.1)
    test = s.where("split = 'test'").select("patient").distinct()
    return state.with_bit(test, s.where("split = 'train'"), ["patient"], "seen").agg(F.count("*").alias("test_patients"), F.count_if("seen").alias("seen"))


@query()
def preference_windows(spark, d):
    w = windows(spark, d).select(*KEY, (F.col("truth") == "R").alias("returned"), (F.col("pred") == "R").alias("predicted"), (F.col("quantity") > 40).alias("many"))
    return curation.preference_windows(w, ["returned", "predicted", "many"], [F.col(k) for k in KEY])


@query(
    f"""{DISTANCE}, i AS (SELECT n.*, w.part, w.supp, w.line FROM n JOIN (SELECT recording, line, part, supp, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS idx FROM w) w USING (recording, idx)),
 b AS (SELECT *, min(idx) OVER (PARTITION BY recording) AS low, max(idx) OVER (PARTITION BY recording) AS high FROM i), l AS (SELECT * FROM b WHERE NOT positive AND idx > low AND idx < high AND (recording, idx) NOT IN (SELECT recording, idx FROM i WHERE part % 5 = 0)),
 h AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY idx) <= count(*) OVER (PARTITION BY recording) // 2 AS half FROM l)
 SELECT recording, idx, distance FROM h QUALIFY row_number() OVER (PARTITION BY recording, half ORDER BY md5('0|' || recording || '|' || idx), recording, idx) = 1"""
)
def background_windows(spark, d):
    k = windows(spark, d).withColumn("idx", ordered.ordinal(["recording"], ["line", "part", "supp"]).cast("long"))
    out = curation.background_windows(k, k.where("part % 5 = 0"), ["recording"], ["recording", "idx"], "idx", "positive")
    return out.select("recording", "idx", "distance")


@query(f"WITH {W} SELECT recording, line, part, supp FROM w WHERE patient NOT IN (SELECT patient FROM w WHERE supp % 7 = 0)")
def heldout_rows(spark, d):
    w = windows(spark, d)
    return curation.held_out(w, w.where("supp % 7 = 0"), "patient").select(*KEY)


HALVED = f"""s AS (SELECT *, CASE WHEN positive THEN 'p' WHEN truth = 'A' THEN 'o' ELSE 'c' END AS side FROM w), n AS (SELECT dataset, count(*) FILTER (side = 'p') AS ps, count(*) FILTER (side = 'o') AS os, count(*) FILTER (side = 'c') AS cs FROM s GROUP BY dataset),
 q AS (SELECT *, least(os, greatest(ps // 2, ps - cs)) AS others FROM n), k AS (SELECT s.*, ps, others, row_number() OVER (PARTITION BY s.dataset, side ORDER BY {RANKED}, recording, line, part, supp) AS r FROM s JOIN q ON s.dataset = q.dataset)"""


@query(f"WITH {W}, {HALVED} SELECT dataset, recording, line, part, supp, side FROM k WHERE side = 'p' OR r <= CASE WHEN side = 'o' THEN others ELSE ps - others END")
def halved_negatives(spark, d):
    w = windows(spark, d).withColumn("other", F.col("truth") == "A")
    side = F.when(F.col("positive"), "p").when(F.col("other"), "o").otherwise("c")
    return curation.halved_negatives(w, "dataset", "positive", "other", [F.col(k) for k in KEY]).select("dataset", *KEY, side.alias("side"))


@query(f"WITH {W}, u AS (SELECT dataset, recording, line, positive AS explain FROM w UNION ALL SELECT dataset, recording, line, false FROM w WHERE quantity > 25) SELECT dataset, recording, line, bool_or(explain) AS explain, count(*) AS lists FROM u GROUP BY ALL")
def merged_lines(spark, d):
    w = windows(spark, d)
    return curation.merged_lines([w.select("dataset", "recording", "line", F.col("positive").alias("explain")), w.where("quantity > 25").select("dataset", "recording", "line")], ["dataset", "recording", "line"], "explain")


@query(
    f"""WITH {W}, x AS (SELECT *, count(*) FILTER (positive) OVER (PARTITION BY dataset) // 2 AS n FROM w WHERE NOT positive OR true), f AS (SELECT * FROM x WHERE NOT positive AND part % 10 = 0), g AS (SELECT * FROM x WHERE NOT positive AND part % 10 <> 0),
 c AS (SELECT dataset, count(*) AS c FROM f GROUP BY dataset), k AS (SELECT g.*, coalesce(c, 0) + row_number() OVER (PARTITION BY g.dataset ORDER BY {RANKED}, recording, line, part, supp) AS place FROM g LEFT JOIN c ON g.dataset = c.dataset)
 SELECT dataset, recording, line, part, supp FROM f UNION ALL SELECT dataset, recording, line, part, supp FROM k WHERE place <= n"""
)
def more_set(spark, d):
    w = windows(spark, d)
    n = w.groupBy("dataset").agg(F.floor(F.count_if("positive") / 2).alias("n"))
    quiet = w.where(~F.col("positive")).join(n, "dataset")
    return curation.extended(quiet.where("part % 10 = 0"), quiet.where("part % 10 <> 0"), ["dataset"], [F.col(k) for k in KEY], "n").select("dataset", *KEY)


@query(f"WITH {W} SELECT recording, line, part, supp FROM w WHERE truth = 'R' AND quantity > 30 QUALIFY row_number() OVER (ORDER BY {RANKED}, recording, line, part, supp) <= 20")
def smoke_windows(spark, d):
    return sampling.stratified(windows(spark, d).where("truth = 'R' and quantity > 30"), [], [F.col(k) for k in KEY], 20).select(*KEY)


@query(f"WITH {W} SELECT dataset, recording, line, part, supp FROM w QUALIFY row_number() OVER (PARTITION BY dataset, positive ORDER BY {RANKED}, recording, line, part, supp) <= 150")
def stratified_windows(spark, d):
    return sampling.stratified(windows(spark, d), ["dataset", "positive"], [F.col(k) for k in KEY], 150).select("dataset", *KEY)


@query(f"WITH {W} SELECT recording, line, part, supp, question, CASE question WHEN 'returned' THEN truth = 'R' WHEN 'many' THEN quantity > 40 ELSE truth = 'A' OR quantity > 40 END AS answer FROM w, (VALUES ('returned'), ('many'), ('any')) AS q(question)")
def class_questions(spark, d):
    w = windows(spark, d)
    labels = L.positives({"returned": F.col("truth") == "R", "many": F.col("quantity") > 40, "added": F.col("truth") == "A"})
    wide = w.select(*KEY, L.any_of(labels, ["returned"]).alias("returned"), L.any_of(labels, ["many"]).alias("many"), L.any_of(labels, ["added", "many"]).alias("any"))
    return L.long(wide, KEY, ["returned", "many", "any"], "question", "answer")


@query(
    """WITH e AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + user_id % 2 AS idx FROM events), b AS (SELECT *, min(idx) OVER (PARTITION BY recording) AS low, max(idx) OVER (PARTITION BY recording) AS high FROM e),
 i AS (SELECT recording, idx, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY idx) - 1 AS pos FROM b WHERE low <> 0 OR (idx <> low AND idx <> high))
 SELECT recording, idx FROM i WHERE n >= 12 AND list_contains(list_transform(range(12), lambda k: CAST(round_even(k * (n - 1) / 11.0, 0) AS BIGINT)), pos)"""
)
def scan_windows(spark, d):
    e = read(spark, d, "events")
    k = e.select(F.col("user_id").alias("recording"), (ordered.ordinal(["user_id"], ["event_id"]) + F.col("user_id") % 2).alias("idx"))
    return ordered.inner_windows(k, ["recording"], "idx").select("recording", "idx")


@query(f"WITH {STATE}, r AS (SELECT dataset, model, CASE WHEN split = 'test' AND path % 4 = 0 THEN 'full' WHEN split = 'train' AND sampled AND labelled THEN 'rationale' ELSE 'none' END AS scope FROM st) SELECT dataset, model, scope, count(*) AS n FROM r GROUP BY ALL")
def resampled_state(spark, d):
    s = _state(spark, d).withColumn("sampled", F.when(F.col("split") == "test", F.col("path") % 4 == 0).otherwise(F.col("sampled")))
    return s.withColumn("scope", state.scope_of(F.col("split"), F.col("sampled"), F.col("labelled"))).groupBy("dataset", "model", "scope").agg(F.count("*").alias("n"))


@query(f"WITH {W}, {LABELLED}, p AS (SELECT count(*) AS most FROM l GROUP BY patient), c AS (SELECT class, count(*) AS n FROM (SELECT unnest(labels) AS class FROM l) GROUP BY class) SELECT CAST((SELECT sum(most) FROM p) AS BIGINT) AS rows, (SELECT count(*) FROM p) AS patients, (SELECT max(most) FROM p) AS most, (SELECT string_agg(class || '=' || n, ',' ORDER BY class) FROM c) AS classes")
def described_rows(spark, d):
    return curation.described(_labelled(spark, d), "patient", "labels")


@query(
    f"""WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang = 'fr' THEN 'french' END, CASE WHEN source = 'src3' THEN 'source' END], lambda x: x IS NOT NULL)) AS reason FROM documents),
 k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS p FROM r) SELECT reason, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (p <= 5) AS examples FROM k GROUP BY reason"""
)
def drop_reasons(spark, d):
    t = read(spark, d, "documents").withColumn("reasons", L.positives({"short": F.col("n_chars") < 200, "french": F.col("lang") == "fr", "source": F.col("source") == "src3"}))
    return curation.reasons(t, "doc_id")


@query(
    """WITH old AS (SELECT event_id AS ord, user_id * 3 AS path, event_type AS model, value > 19.9 AS control FROM events), p AS (SELECT o_custkey AS path, 'view' AS model FROM orders WHERE o_orderkey % 3 = 0),
 r AS (SELECT *, CASE WHEN control THEN 'control' WHEN path NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) THEN 'orphan' WHEN (path, model) IN (SELECT * FROM p) THEN 'present' WHEN row_number() OVER (PARTITION BY path, model ORDER BY ord) > 1 THEN 'duplicate' ELSE 'taken' END AS reason FROM old) SELECT model, reason, count(*) AS n FROM r GROUP BY ALL"""
)
def legacy_import(spark, d):
    old = read(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") * 3).alias("path"), F.col("event_type").alias("model"), (F.col("value") > 19.9).alias("control"))
    known = read(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("path"))
    present = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("path"), F.lit("view").alias("model"))
    out = checks.imported(old, known, present, ["path", "model"], F.col("control"))
    return out.groupBy("model", F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH old AS (SELECT event_id AS path, '{''' || event_type || ''', ''all''}' AS labels FROM events) SELECT path, contains(labels, '''view''') AS view, contains(labels, '''click''') AS click, contains(labels, '''all''') AS every FROM old WHERE path NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)"""
)
def legacy_answers(spark, d):
    """Answers of an older run, kept as literals of sets, for paths that the new run hasn't."""
    written = F.concat(F.lit("{'"), "event_type", F.lit("', 'all'}"))
    new = read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("path"))
    old = read(spark, d, "events").select(F.col("event_id").alias("path"), L.literal_set(written).alias("labels")).join(new, "path", "left_anti")
    return L.wide(old, "labels", ["view", "click", "all"]).withColumnRenamed("all", "every")


@query(
    """WITH t AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN source ELSE ' ' END AS rationale FROM documents), s AS (SELECT doc_id AS path, lang || quality AS rationale, quality AS priority FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, 5 FROM documents),
 b AS (SELECT path, min_by(rationale, priority) AS best FROM s WHERE trim(rationale) <> '' GROUP BY path) SELECT path, CASE WHEN trim(rationale) = '' THEN coalesce(best, '') ELSE rationale END AS rationale FROM t LEFT JOIN b USING (path)"""
)
def rationale_backfill(spark, d):
    docs = read(spark, d, "documents")
    t = docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" ").alias("rationale"))
    first = docs.join(read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("path"), F.concat("lang", F.col("quality").cast("string")).alias("rationale"), F.col("quality").alias("priority"))
    second = docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("rationale"), F.lit(5).alias("priority"))
    return checks.backfilled(t, first.unionByName(second), "path", "rationale", "priority").select("path", "rationale")


@query("WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 5 > 0), r AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL) AS \"both\", count(*) FILTER (r.k IS NULL) AS missing, count(*) FILTER (l.k IS NULL) AS extra FROM l FULL JOIN r ON l.k = r.k")
def coverage_both_ways(spark, d):
    return checks.both_ways(read(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_mktsegment AS segment, count(*) AS wanted, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM customer GROUP BY 1")
def missing_by_segment(spark, d):
    wanted = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return checks.missing_of(wanted, read(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"], ["segment"])


@query("WITH l AS (SELECT unnest([1, 2, 3, 5, 8, -1, -2]) AS k) SELECT (SELECT count(*) FROM orders) AS before, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM l)) AS after, (SELECT count(*) FROM l WHERE k NOT IN (SELECT o_custkey FROM orders)) AS absent")
def exclusion_lists(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    listed = spark.range(1).select(F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 5, 8, -1, -2)))).alias("k"))
    left, absent = checks.excluded(rows, listed, "k")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(rows, "before").join(F.broadcast(n(left, "after")), how="cross").join(F.broadcast(n(absent, "absent")), how="cross")  # one row each


@query("WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS v FROM orders), b AS (SELECT l_orderkey AS k, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS v FROM lineitem GROUP BY 1) SELECT p, count(*) AS rows, count(*) FILTER (a.v <> b.v) AS changed FROM a JOIN b USING (k) GROUP BY p")
def label_check(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("v"))
    all_ = lambda s: F.bool_and(F.col("l_linestatus") == s)
    b = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(all_("F"), "F").when(all_("O"), "O").otherwise("P").alias("v"))
    return checks.changed(a, b, ["k"], "v", ["p"])


@query("SELECT p_type, count(DISTINCT p_brand) AS \"values\" FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) <> 1")
def one_prompt(spark, d):
    return checks.one_value(read(spark, d, "part"), ["p_type"], "p_brand")


@query("WITH c AS (SELECT event_type, count(*) FILTER (value > 10) AS answers, count(*) FILTER (event_id % 4 = 0) AS explains FROM events GROUP BY 1), x AS (SELECT event_type, count(*) FILTER (value > 10) AS a, count(*) FILTER (event_id % 2 = 0) AS e FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT event_type, answers, explains, a IS NOT NULL AND answers = a AND explains = e AS as_expected FROM c LEFT JOIN x USING (event_type)")
def expected_counts(spark, d):
    e = read(spark, d, "events")
    wanted = e.where("event_type <> 'view'").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("answers"), F.count_if(F.col("event_id") % 2 == 0).alias("explains"))
    return checks.expected(e, ["event_type"], {"answers": F.col("value") > 10, "explains": F.col("event_id") % 4 == 0}, wanted)


@query("WITH l AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0) SELECT source, count(*) AS rows, count(*) FILTER (l.doc_id IS NULL) AS absent, count(*) FILTER (l.n_chars < 300) AS small FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY source")
def row_validity(spark, d):
    docs = read(spark, d, "documents")
    return checks.validity(docs.select("doc_id", "source"), docs.where("doc_id % 7 <> 0").select("doc_id", "n_chars"), "doc_id", "n_chars", 300, ["source"])


@query("WITH r AS (SELECT event_type || '/' || user_id || '.png' AS path, 'x' || event_id AS text, event_id FROM events), b AS (SELECT split_part(path, '/', 2) AS name, max_by(text, event_id) AS text FROM r GROUP BY 1) SELECT 'train/' || c_custkey || '.png' AS path, text FROM customer LEFT JOIN b ON name = c_custkey || '.png'")
def teacher_text(spark, d):
    r = read(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("text"), "event_id")
    c = read(spark, d, "customer").select(F.concat(F.lit("train/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("path"))
    return checks.last_by_name(c, r, "path", "text", "event_id").select("path", "text")


@query("WITH t AS (SELECT p_brand AS base, p_type AS dataset, min_by(p_size, p_partkey) AS ram FROM part WHERE p_size > 25 GROUP BY ALL) SELECT p_partkey, coalesce(ram, 64) AS ram FROM part LEFT JOIN t ON p_brand = base AND p_type = dataset")
def resource_lookup(spark, d):
    p = read(spark, d, "part")
    table = p.where("p_size > 25").select("p_brand", "p_type", F.col("p_size").alias("ram"), "p_partkey")
    return checks.first_or_default(p.select("p_partkey", "p_brand", "p_type"), table, ["p_brand", "p_type"], "p_partkey", {"ram": 64}).select("p_partkey", "ram")


@query("SELECT e.event_id FROM events e JOIN part p ON p.p_partkey = e.user_id WHERE e.event_type = CASE WHEN p.p_size % 2 = 0 THEN 'view' ELSE 'click' END")
def exact_prompts(spark, d):
    wanted = read(spark, d, "part").select(F.col("p_partkey").alias("user_id"), F.when(F.col("p_size") % 2 == 0, "view").otherwise("click").alias("event_type"))
    return checks.same_prompt(read(spark, d, "events"), wanted, ["user_id"], "event_type").select("event_id")


@query(
    """WITH a AS (SELECT n_name AS model, r_name AS dataset, question, seed FROM nation, region, (VALUES ('all'), ('one')) AS q(question), (VALUES (0), (1)) AS s(seed))
 SELECT model || '-' || dataset || '-' || question || '-s' || seed AS arm, model, dataset, question, CAST(seed AS INTEGER) AS seed, CASE WHEN dataset = 'ASIA' THEN 200 WHEN question = 'one' THEN 50 ELSE 100 END AS steps FROM a"""
)
def arm_registry(spark, d):
    one = lambda values, name: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    steps = F.when(F.col("dataset") == "ASIA", 200).when(F.col("question") == "one", 50).otherwise(100)
    out = checks.arms(read(spark, d, "nation").select(F.col("n_name").alias("model")), read(spark, d, "region").select(F.col("r_name").alias("dataset")), one(["all", "one"], "question"), one([0, 1], "seed"), steps)
    return out.select("arm", *checks.described(F.col("arm")), "steps")


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 19)")
def active_tasks(spark, d):
    e = read(spark, d, "events")
    return state.open_failures(e.select("user_id", "event_type").distinct(), e.where("value > 19"), ["user_id", "event_type"])


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN event_type || '/' || user_id ELSE event_type || '/' || user_id || '/' || event_id % 3 END AS key FROM events")
def failure_keys(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", state.failure_key(F.col("event_type"), [F.col("event_type"), F.col("user_id")], [F.col("event_id") % 3], "view").alias("key"))


@query(f"WITH {STATE}, t AS (SELECT model, dataset, path FROM st WHERE NOT done) SELECT model, dataset, count(*) AS pending, count(*) FILTER (path % 11 = 0) AS failed, count(*) FILTER (path % 11 <> 0) AS untried FROM t GROUP BY ALL")
def pending_report(spark, d):
    todo = _state(spark, d).where("not done")
    return state.pending_report(todo, todo.where("path % 11 = 0"), ["path", "model"], ["model", "dataset"])


@query(f"WITH {STATE} SELECT path, model, bool_or(judged) OVER (PARTITION BY path) AS judged FROM st")
def flags_everywhere(spark, d):
    return state.everywhere(_state(spark, d), ["path"], "judged").select("path", "model", "judged")


@query("SELECT o_orderkey AS path, o_orderstatus <> 'P' AS labelled, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '(nothing)' END AS shown, o_orderstatus = 'F' AS yes, o_orderstatus <> 'F' AS no, o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' OR o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' AS correct, regexp_replace(o_orderpriority, '^[0-9]-', '') AS plain FROM orders")
def label_answers(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    classes = {"done": s == "F", "open": s == "O"}
    yes, no = L.pair_of(s == "F", "yes", "no")
    shown = L.shown(L.positives(classes, ordered=True))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), L.has_labels(classes).alias("labelled"), shown.alias("shown"), yes, no, L.same([s == "F"], [p == "1-URGENT"]).alias("correct"), names.without_prefix(p, "[0-9]-").alias("plain"))


@query("WITH p AS (SELECT p_partkey, 'EEG F' || p_size || CASE WHEN p_size % 3 = 0 THEN '-REF' WHEN p_size % 3 = 1 THEN '-LE' ELSE '-EKG' END AS name FROM part) SELECT p_partkey, regexp_extract(name, '^EEG ([A-Za-z0-9_]+)-(?:REF|LE)$', 1) AS electrode, NOT contains(name, 'EKG') AS picked, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN 'a and b' ELSE 'a, b and c' END AS listed, replace('x:' || name, ':', '-') AS file FROM p")
def channel_names(spark, d):
    k = F.col("p_size") % 3
    name = F.concat(F.lit("EEG F"), F.col("p_size").cast("string"), F.when(k == 0, "-REF").when(k == 1, "-LE").otherwise("-EKG"))
    some = F.slice(F.array(*map(F.lit, "abc")), 1, (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", names.electrode(name).alias("electrode"), names.without_tags(name, ["EKG", "ECG"]).alias("picked"), names.listed(some).alias("listed"), names.flat(F.concat(F.lit("x:"), name)).alias("file"))


@query("SELECT o_custkey AS patient, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-LOW', '5-NONE'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x))), '+') AS missing FROM orders GROUP BY 1")
def missing_electrodes(spark, d):
    needed = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-NONE")))
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.array_join(F.array_sort(F.array_except(needed, F.collect_set("o_orderpriority"))), "+").alias("missing"))


def _spans(spark, d) -> DataFrame:
    a = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 600
    return read(spark, d, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), a.alias("a"), (a + 5 + F.col("event_id") % 20).alias("b"), "event_id")


@query("WITH s AS (SELECT event_id, epoch(ts) % 600 AS a, epoch(ts) % 600 + 5 + event_id % 20 AS b FROM events) SELECT event_id, round(greatest(a, 300) - 300, 4) AS start, round(least(b, 320) - 300, 4) AS stop FROM s WHERE a < 320 AND b > 300")
def clipped_spans(spark, d):
    low, high = F.lit(300), F.lit(320)
    s = _spans(spark, d).where(intervals.overlap(F.col("a"), F.col("b"), low, high))
    return s.select("event_id", *(F.round(c, 4).alias(n) for c, n in zip(intervals.clipped(F.col("a"), F.col("b"), low, high), ("start", "stop"), strict=True)))


TOUCHED = "s AS (SELECT user_id AS recording, event_type AS channel, epoch(ts) % 600 AS a, epoch(ts) % 600 + 5 + event_id % 20 AS b FROM events), t AS (SELECT DISTINCT recording, channel, unnest(range(CAST(floor(a) AS INTEGER), CAST(ceil(b) AS INTEGER))) AS second FROM s)"


@query(f"WITH {TOUCHED}, r AS (SELECT recording, channel, second, second - row_number() OVER (PARTITION BY recording, channel ORDER BY second) AS run FROM t), g AS (SELECT recording, channel, min(second) AS x, max(second) AS y FROM r GROUP BY recording, channel, run) SELECT recording, channel, string_agg(CASE WHEN x = y THEN CAST(x AS VARCHAR) ELSE x || '-' || y END, ', ' ORDER BY x) AS ranges FROM g GROUP BY ALL")
def touched_seconds(spark, d):
    t = intervals.seconds_touched(_spans(spark, d), ["recording", "channel"], "a", "b")
    return intervals.ranges_text(intervals.islands(t, ["recording", "channel"], "second"), ["recording", "channel"])


@query(f"WITH s AS (SELECT user_id % 2000 AS recording, event_type AS channel, CAST(floor(value) AS INTEGER) % 4 AS second FROM events), g AS (SELECT recording, channel, list_sort(list(DISTINCT second)) AS items FROM s GROUP BY ALL), m AS (SELECT recording, items, list_sort(list(channel)) AS members FROM g GROUP BY ALL) SELECT recording, array_to_string(items, ',') AS items, CASE WHEN len(members) = (SELECT count(DISTINCT event_type) FROM events) THEN 'all channels' ELSE array_to_string(members, ', ') END AS channels FROM m")
def shared_locations(spark, d):
    s = read(spark, d, "events").select((F.col("user_id") % 2000).alias("recording"), F.col("event_type").alias("channel"), (F.floor("value").cast("int") % 4).alias("second"))
    montage = s.agg(F.count_distinct("channel").alias("montage"))  # one row
    m = intervals.same_members(s, ["recording"], "channel", "second").join(F.broadcast(montage), how="cross")
    named = F.when(F.size("members") == F.col("montage"), "all channels").otherwise(F.array_join("members", ", "))
    return m.select("recording", F.array_join("items", ",").alias("items"), named.alias("channels"))


@query("WITH w AS (SELECT DISTINCT user_id AS recording, CAST(i AS INTEGER) AS idx FROM events, range(30) AS t(i)), s AS (SELECT user_id AS recording, epoch(ts) % 600 AS a, epoch(ts) % 600 + 5 + event_id % 20 AS b FROM events) SELECT recording, idx FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.recording = w.recording AND a < (idx + 1) * 20 AND b > idx * 20)")
def annotated_windows(spark, d):
    s = _spans(spark, d).select("recording", F.col("a").alias("start_time"), F.col("b").alias("stop_time"), F.col("channel").alias("label"))
    own = s.select("recording").distinct().select("recording", F.explode(numbers.windows_in(F.lit(600.0))).alias("index"))
    return intervals.touched_windows(own, s, "recording", 20.0).select("recording", F.col("index").alias("idx"))


PLAN = "p AS (SELECT p_partkey, p_brand AS base, p_type AS dataset, p_size AS gb, 0.4 + 0.015 * p_size + 500 * (p_size / 10.0) / 3600 * 1.5 AS train_h, 0.4 + 0.015 * p_size + p_partkey * 0.6 / 3600 * 1.25 AS score_h, p_size % 2 + 1 AS gpus FROM part)"


def _plan(spark, d) -> DataFrame:
    train, score = planning.hours(F.lit(500), F.col("p_size") / 10.0, F.col("p_partkey"), F.lit(0.6), F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("base"), F.col("p_type").alias("dataset"), F.col("p_size").alias("gb"), train, score, (F.col("p_size") % 2 + 1).alias("gpus"))


@query(f"WITH {PLAN} SELECT p_partkey, base, dataset, round(train_h, 6) AS train_h, round(score_h, 6) AS score_h, gpus FROM p")
def resource_plan(spark, d):
    return _plan(spark, d).select("p_partkey", "base", "dataset", r6("train_h").alias("train_h"), r6("score_h").alias("score_h"), "gpus")


@query(f"WITH {PLAN} SELECT base, round(sum((train_h + score_h) * CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE gpus END), 2) AS gpu_hours FROM p GROUP BY base")
def gpu_hours(spark, d):
    """Slices of a GPU count as one."""
    p = _plan(spark, d).withColumn("hours", F.col("train_h") + F.col("score_h")).withColumn("gpus", F.when(F.col("p_partkey") % 3 == 0, "a100_3g.20gb:1").otherwise(F.col("gpus").cast("string")))
    return planning.gpu_hours(p, ["base"], "hours", "gpus").withColumn("gpu_hours", F.round("gpu_hours", 2))


@query(f"WITH {PLAN} SELECT gpus, dataset, count(*) AS n, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS tasks FROM p GROUP BY ALL")
def task_groups(spark, d):
    g = planning.grouped(_plan(spark, d), ["gpus", "dataset"], "p_partkey")
    return g.select("gpus", "dataset", "n", F.md5(F.array_join(F.transform("tasks", lambda t: t["p_partkey"].cast("string")), ",").cast("binary")).alias("tasks"))


@query("SELECT DISTINCT p_brand AS model, p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) AS staged FROM part")
def staged_models(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("model"), "p_size")
    there, gone = planning.staged(p.select("model").distinct(), p.where("p_size > 48"))
    return there.withColumn("staged", F.lit(True)).unionByName(gone.withColumn("staged", F.lit(False)))


@query("SELECT p_partkey, greatest(p_size / 3.0, p_retailprice / 100) AS peak, greatest(p_size / 3.0, p_retailprice / 100) < 17 AS fits FROM part WHERE p_type NOT LIKE 'SMALL%'")
def memory_peaks(spark, d):
    peak, fits = planning.peak_fits(F.col("p_size") / 3.0, F.col("p_retailprice") / 100, 17)
    return read(spark, d, "part").where("p_type not like 'SMALL%'").select("p_partkey", peak.alias("peak"), fits.alias("fits"))


@query(f"WITH {STATE} SELECT dataset, CAST(row_number() OVER (ORDER BY n DESC, dataset) AS INTEGER) AS place FROM (SELECT dataset, count(*) AS n FROM st WHERE NOT done GROUP BY dataset)")
def largest_first(spark, d):
    n = _state(spark, d).where("not done").groupBy("dataset").agg(F.count("*").alias("n"))
    return planning.largest_first(n, "n", "dataset").select("dataset", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, p_type, p_brand, p_partkey) AS place FROM part")
def plan_order(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("nice"), F.col("p_type").alias("dataset"), F.col("p_brand").alias("base"))
    return planning.in_order(p, ["nice", "dataset", "base", "p_partkey"]).select("p_partkey", "place")


@query(f"WITH {W}, {LABELLED} SELECT array_to_string(labels, '+') AS signature, count(*) AS n, CAST(row_number() OVER (ORDER BY labels) AS INTEGER) AS place FROM l GROUP BY labels")
def signature_order(spark, d):
    from pyspark.sql import Window

    g = _labelled(spark, d).groupBy("labels").agg(F.count("*").alias("n"))  # a row for each label set
    return g.select(F.array_join("labels", "+").alias("signature"), "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("labels")).alias("place"))


@query("SELECT event_type AS stage, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM events WHERE value > 20 GROUP BY 1")
def failure_groups(spark, d):
    n = read(spark, d, "events").where("value > 20").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return planning.largest_first(n, "n", "stage")


@query(f"WITH {W}, {LABELLED}, s AS (SELECT patient, recording, CASE WHEN patient % 10 < 7 THEN 'train' WHEN patient % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM w) SELECT split, count(DISTINCT patient) AS patients, count(DISTINCT recording) AS recordings, count(DISTINCT CASE WHEN regexp_matches(CAST(patient AS VARCHAR), '^[0-9]+$') THEN patient END) AS excerpts FROM s GROUP BY split")
def split_report(spark, d):
    k = F.col("patient") % 10
    s = windows(spark, d).select("patient", "recording", F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"))
    return s.groupBy("split").agg(F.count_distinct("patient").alias("patients"), F.count_distinct("recording").alias("recordings"), F.count_distinct(F.when(names.excerpt(F.col("patient").cast("string")), F.col("patient"))).alias("excerpts"))


@query("WITH a AS (SELECT doc_id AS path, lang AS rationale FROM documents), t AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS truth FROM documents) SELECT path, rationale, truth AS reference FROM a JOIN t USING (path) WHERE trim(truth) <> '' AND path NOT IN (SELECT doc_id FROM labels)")
def judge_pairs(spark, d):
    docs = read(spark, d, "documents")
    truth = docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias("truth"))
    return judging.pairs(docs.select(F.col("doc_id").alias("path"), F.col("lang").alias("rationale")), truth, read(spark, d, "labels").select(F.col("doc_id").alias("path")), ["path"], "truth")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('0|' || doc_id), 1, 1))::INTEGER < 8 THEN source ELSE lang END AS rationale_a, CASE WHEN ('0x' || substr(md5('0|' || doc_id), 1, 1))::INTEGER < 8 THEN lang ELSE source END AS rationale_b, CASE WHEN ('0x' || substr(md5('0|' || doc_id), 1, 1))::INTEGER < 8 THEN 'source' ELSE 'lang' END AS a_source FROM documents")
def preference_records(spark, d):
    return judging.preference_rows(read(spark, d, "documents"), "doc_id", "source", "lang")


@query("SELECT doc_id, trim(text) <> '' AND quality = 1 AS verdict FROM documents JOIN labels USING (doc_id)")
def short_circuits(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", judging.short_circuit(F.col("text"), F.col("quality") == 1).alias("verdict"))


@query("SELECT doc_id, replace('Say {what} of x', '{what}', lang) AS prompt, trim(regexp_replace(source || '  \t b', '\\s+', ' ', 'g')) AS line, substr(trim(text), 1, 3000) AS cut, to_base64(encode(lang)) AS packed FROM documents")
def prompts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", texts.filled("Say {what} of x", what=F.col("lang")).alias("prompt"), texts.one_line(F.concat("source", F.lit("  \t b"))).alias("line"), F.substring(F.trim(t), 1, 3000).alias("cut"), F.base64(F.encode("lang", "UTF-8")).alias("packed"))


@query("SELECT event_id, event_type AS label, 'checked' AS state, CAST(user_id + 1 AS BIGINT) AS owner FROM events")
def struct_updates(spark, d):
    row = F.struct(F.col("event_type").alias("label"), F.lit("new").alias("state"), F.col("user_id").alias("owner"))
    return read(spark, d, "events").select("event_id", row.withField("state", F.lit("checked")).withField("owner", F.col("user_id") + 1).alias("r")).select("event_id", "r.*")


@query(f"WITH {STATE} SELECT model, count(*) FILTER (evaled AND model <> 'm3') AS zero_shot FROM st GROUP BY model")
def zero_shot_rows(spark, d):
    models = spark.createDataFrame([("m1", "hosted"), ("m2", "hosted"), ("m3", "hf")], "model string, backend string")
    flagged = state.with_backend(_state(spark, d), models)
    return flagged.groupBy("model").agg(F.count_if(F.col("evaled") & F.col("zero_shot")).alias("zero_shot"))
