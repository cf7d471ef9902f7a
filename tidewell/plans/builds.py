"""Queries of whole builds: scans, leaks against every set's tests, balanced questions, preference pairs, plans, backgrounds, files of several runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import answers, numbers
from tidewell.functions import labels as L
from tidewell.functions import text as texts
from tidewell.operators import curation, dedup, judging, leakage, planning, ranking, sampling
from tidewell.plans.catalogue import AUROC, DISTANCE, KEY, LABELLED, RANKED, W, _distances, _labelled, query, r6, read
from tidewell.plans.curating import _spans
from tidewell.sources import readers, writers
from tidewell.sources.folders import new_folder


@query("SELECT p_partkey AS recording, CAST(idx AS INTEGER) AS idx FROM (SELECT DISTINCT p_partkey, unnest(CASE WHEN p_size <= 26 THEN range(p_size) ELSE list_transform(range(24), lambda k: CAST(round_even(1 + k * (p_size - 3) / 23.0, 0) AS BIGINT)) END) AS idx FROM part)")
def even_scan(spark, d):
    """At most 24 windows of each recording, its first and last left out."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("recording"), F.explode(numbers.scan_indexes(F.col("p_size"))).alias("idx"))


MERGED = """WITH RECURSIVE d AS (SELECT doc_id, lang AS dataset, source || '/' || (doc_id % 97) AS token, md5(text) AS image, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents),
 p AS (SELECT DISTINCT image AS c, token AS o FROM d), s AS (SELECT * FROM p WHERE c IN (SELECT c FROM p GROUP BY c HAVING count(*) > 1)), e AS (SELECT DISTINCT a.o AS x, b.o AS y FROM s a JOIN s b USING (c)),
 r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), m AS (SELECT x AS owner, min(y) AS canonical FROM r GROUP BY x),
 k AS (SELECT dataset, split, unnest(['patient', 'token', 'recording', 'image']) AS c, unnest([coalesce(canonical, token), token, token || '_' || (doc_id % 11), image]) AS v FROM d LEFT JOIN m ON token = owner),
 o AS (SELECT dataset, c, v, bool_or(split = 'train') AS t, bool_or(split = 'val') AS l FROM k WHERE split <> 'test' GROUP BY ALL)"""


@query(
    f"""{MERGED} SELECT dataset, c AS "check", count(*) AS n FROM o WHERE t AND l GROUP BY ALL UNION ALL
 SELECT dataset, 'test ' || c, count(*) FROM o WHERE c IN ('patient', 'image') AND (c, v) IN (SELECT c, v FROM k WHERE split = 'test') GROUP BY ALL"""
)
def leakage_with_tests(spark, d):
    """Every set's train and val against each other and against all sets' tests, by patients merged where they share an image."""
    k = F.col("doc_id") % 10
    rows = read(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset"), F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("token"), F.md5(F.col("text").cast("binary")).alias("image"), F.when(k < 6, "train").when(k < 8, "val").otherwise("test").alias("split"))
    named = rows.join(dedup.merged_owners(rows, "image", "token").withColumnRenamed("owner", "token"), "token", "left")
    return leakage.with_tests(named.withColumn("patient", F.coalesce("canonical", "token")).withColumn("recording", F.concat_ws("_", "token", (F.col("doc_id") % 11).cast("string"))))


BASES = """b AS (SELECT p_partkey, p_size * 37 AS rows, p_size * 5 AS val_rows, p_partkey % 1000 AS windows, 10 + p_size AS tokens, p_retailprice / 50 AS step, p_size / 2.0 AS gb, CASE WHEN p_partkey % 4 = 0 THEN p_size / 3.0 END AS probe FROM part),
 s AS (SELECT *, CAST(2 * ceil(rows / 8.0) AS BIGINT) AS steps FROM b), t AS (SELECT *, coalesce(probe, step) AS own, steps // 100 + 1 AS evals FROM s),
 h AS (SELECT *, (steps * own + evals * val_rows * 0.03::DOUBLE * own) / 3600 AS train_h, windows * CASE WHEN probe IS NULL THEN step / 36.8::DOUBLE * (0.5 + tokens * 0.06::DOUBLE) ELSE probe / 4 * (0.1::DOUBLE + 0.9::DOUBLE * tokens / 60) END / 3600 AS score_h FROM t)"""


@query(f"WITH {BASES} SELECT p_partkey, steps, round(train_h, 3) AS train_h, round(score_h, 3) AS score_h, round(0.4 + 0.015 * gb + 1.5 * train_h + 1.25 * score_h, 3) AS hours FROM h")
def fine_tune_plan(spark, d):
    """Steps, evaluations and hours from numbers of rows; a probe's times win."""
    c, size = F.col, F.col("p_size")
    probe = F.when(c("p_partkey") % 4 == 0, size / 3.0)
    out = planning.estimate(size * 37, size * 5, c("p_partkey") % 1000, 10 + size, c("p_retailprice") / 50, size / 2.0, probe, probe / 4, 0.5, F.lit(0.06), 36.8, 60)
    return read(spark, d, "part").select("p_partkey", *out).select("p_partkey", "steps", *(F.round(x, 3).alias(x) for x in ("train_h", "score_h", "hours")))


@query(
    f"""WITH {W}, {LABELLED}, p AS (SELECT recording, line, part, supp, array_to_string(labels, '+') AS stratum FROM l WHERE quantity > 5), n AS (SELECT stratum, count(*) AS size FROM p GROUP BY 1), e AS (SELECT *, 700 * size / sum(size) OVER () AS exact FROM n),
 q AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, stratum) <= 700 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM e)
 SELECT stratum, recording, line, part, supp FROM p JOIN q USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {RANKED}, recording, line, part, supp) <= quota"""
)
def stratified_addition(spark, d):
    """700 windows more, drawn from strata of answers in proportion to them."""
    pool = _labelled(spark, d).where("quantity > 5").withColumn("stratum", F.array_join("labels", "+"))
    return sampling.proportional(pool, "stratum", [F.col(k) for k in KEY], 700).select("stratum", *KEY)


def _balanced(src: str, part: str, order: str) -> str:
    """Tables t, s, k, b by `part`: src (part, pattern, pos, and what order has) with its patterns' rates trimmed to the part's; b has keep."""
    return f"""t AS (SELECT {part}, avg(CASE WHEN pos THEN 1.0 ELSE 0.0 END) AS r FROM {src} GROUP BY 1), s AS (SELECT {part}, pattern, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM {src} GROUP BY ALL),
 k AS (SELECT {part}, pattern, p > r * (p + q) AS above, r, CASE WHEN p > r * (p + q) THEN round_even(q * r / (1 - r), 0) ELSE least(q, round_even(p * (1 - r) / r, 0)) END AS quota FROM s JOIN t USING ({part})),
 b AS (SELECT x.*, x.pattern = '' OR r <= 0 OR r >= 1 OR above <> pos OR row_number() OVER (PARTITION BY x.{part}, x.pattern, pos ORDER BY {order}) <= quota AS keep FROM {src} x JOIN k ON x.{part} = k.{part} AND x.pattern = k.pattern)"""


@query(
    f"""WITH a AS (SELECT doc_id, md5(text) AS content, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, CASE WHEN lang = 'en' THEN '' ELSE lang END AS pattern, n_chars > 900 AS pos FROM documents),
 l AS (SELECT doc_id FROM a WHERE split <> 'test' AND content IN (SELECT content FROM a WHERE split = 'test')), y AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM l)), z AS (SELECT * FROM y WHERE split <> 'test'),
 {_balanced('z', 'split', "md5('0|' || x.doc_id), x.doc_id")} SELECT doc_id, split FROM b WHERE keep UNION ALL SELECT doc_id, split FROM y WHERE split = 'test'"""
)
def core_build(spark, d):
    """Documents without those that share a text with test, past a gate, train and val balanced within languages."""
    k, lang = F.col("doc_id") % 10, F.col("lang")
    rows = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content"), F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"), F.when(lang == "en", "").otherwise(lang).alias("pattern"), (F.col("n_chars") > 900).alias("pos"))
    listed = rows.where("split <> 'test'").join(rows.where("split = 'test'").select("content").distinct(), "content", "left_semi").select("doc_id")
    return curation.core_build(rows, listed, "doc_id", "split", "content", "pattern", "pos", [F.col("doc_id")]).select("doc_id", "split")


@query(
    f"""WITH e AS (SELECT user_id AS recording, event_type AS label, epoch(ts) % 600 AS a, epoch(ts) % 600 + 5 + event_id % 20 AS b FROM events), w AS (SELECT DISTINCT recording, CAST(i AS INTEGER) AS idx, CASE recording % 3 WHEN 0 THEN '' WHEN 1 THEN 'EKG' ELSE 'Fz' END AS pattern FROM e, range(30) AS g(i)),
 j AS (SELECT recording, idx, pattern, list(DISTINCT label) AS labels FROM w JOIN e USING (recording) WHERE a < (idx + 1) * 20 AND b > idx * 20 GROUP BY ALL), x AS (SELECT recording, idx, pattern, question, list_contains(labels, question) AS pos FROM j, (VALUES ('click'), ('view'), ('error')) AS q(question)),
 {_balanced('x', 'question', "md5('0|' || x.recording || '|' || x.idx), x.recording, x.idx")} SELECT question, recording, idx, pos AS present FROM b WHERE keep"""
)
def window_questions(spark, d):
    """Three questions about every window that an annotation touches, each balanced within what its recordings lack."""
    s = _spans(spark, d).select("recording", F.col("a").alias("start_time"), F.col("b").alias("stop_time"), F.col("channel").alias("label"))
    r = F.col("recording") % 3
    own = s.select("recording").distinct().select("recording", F.explode(numbers.windows_in(F.lit(600.0))).alias("index"), F.when(r == 0, "").when(r == 1, "EKG").otherwise("Fz").alias("pattern"))
    out = curation.window_questions(own, s, "recording", 20.0, ["click", "view", "error"], "pattern", [F.col("recording"), F.col("index")])
    return out.select("question", "recording", F.col("index").alias("idx"), "present")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN source ELSE lang END AS chosen, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS rejected FROM documents WHERE doc_id % 4 < 2 AND doc_id % 7 <> 0 AND doc_id % 3 = 1")
def preference_pairs(spark, d):
    """What one model's reviewer preferred, of training windows alone."""
    k = F.col("doc_id")
    answers = read(spark, d, "documents").where(k % 7 != 0).select(k.alias("path"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), F.col("source").alias("rationale_a"), F.col("lang").alias("rationale_b"), F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "tie").alias("preference"))
    return curation.preference_pairs(answers, answers.select("path"), "m1")


@query(
    f"""{DISTANCE}, o AS (SELECT n.*, recording % 3 AS arm, recording || '/' || idx AS path, bool_or(positive) OVER (PARTITION BY recording) AS busy FROM n), m AS (SELECT path, NOT busy AS quiet, distance FROM o WHERE (recording + idx) % 17 > 0),
 f AS (SELECT arm, path, CASE WHEN recording % 2 = 0 THEN score / 2 ELSE score END AS score, quiet, m.distance FROM o LEFT JOIN m USING (path) WHERE NOT positive AND idx % 2 = 0),
 ow AS (SELECT arm, count(*) FILTER (positive) AS event_windows, avg(CASE WHEN score >= 0.05 THEN 1.0 ELSE 0 END) FILTER (positive) AS sensitivity, avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0 END) FILTER (NOT positive) AS specificity_old FROM o GROUP BY arm),
 fw AS (SELECT arm, count(*) AS new_windows, avg(g) AS specificity_new, coalesce(avg(g) FILTER (quiet), 0) AS specificity_quiet, coalesce(avg(g) FILTER (distance BETWEEN 1 AND 2), 0) AS specificity_1_2, coalesce(avg(g) FILTER (distance BETWEEN 3 AND 10), 0) AS specificity_3_10, coalesce(avg(g) FILTER (distance > 10), 0) AS specificity_over_10 FROM (SELECT *, CASE WHEN score < 0.05 THEN 1.0 ELSE 0 END AS g FROM f) GROUP BY arm),
 v AS (SELECT arm, score, true AS positive, 'new' AS which FROM o WHERE positive UNION ALL SELECT arm, score, false, 'new' FROM f UNION ALL SELECT arm, score, positive, 'old' FROM o), u AS (SELECT arm || which AS key, score, positive FROM v){AUROC.format(by='key', src='u').replace(', f AS', ', ff AS').replace('FROM f GROUP', 'FROM ff GROUP').replace(' f AS (SELECT *, p', ' ff AS (SELECT *, p')}
 SELECT CAST(ow.arm AS BIGINT) AS arm, event_windows, new_windows, (SELECT auroc FROM a WHERE key = ow.arm || 'new') AS auroc_new, (SELECT auroc FROM a WHERE key = ow.arm || 'old') AS auroc_old, {', '.join(f'round({x}, 6) AS {x}' for x in ('sensitivity', 'specificity_old', 'specificity_new', 'specificity_quiet', 'specificity_1_2', 'specificity_3_10', 'specificity_over_10'))}, round((sensitivity + specificity_new) / 2, 6) AS balanced_accuracy_new FROM ow JOIN fw ON ow.arm = fw.arm"""
)
def background_report(spark, d):
    """Three arms: events against the old background and against a new one, whose windows' places come from metadata, some without."""
    o = _distances(spark, d).withColumn("arm", F.col("recording") % 3).withColumn("path", F.concat_ws("/", F.col("recording").cast("string"), F.col("idx").cast("string")))
    busy = o.where("positive").select("recording").distinct().withColumn("busy", F.lit(True))
    meta = o.join(busy, "recording", "left").where("(recording + idx) % 17 > 0").select("path", F.col("busy").isNull().alias("quiet"), "distance")
    later = F.when(F.col("recording") % 2 == 0, F.col("score") / 2).otherwise(F.col("score"))
    fresh = o.where(~F.col("positive") & (F.col("idx") % 2 == 0))
    new = fresh.select("arm", "path", F.lit(0.5).alias("score"), F.lit(0).alias("at")).unionByName(fresh.select("arm", "path", later.alias("score"), F.lit(1).alias("at")))
    out = ranking.background_figures(o.select("arm", "path", "score", "positive"), new, meta, ["arm"], 0.05, rows=read(spark, d, "lineitem").count())
    return out.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query("SELECT l_orderkey AS path, l_linenumber AS model, CAST(arg_min(l_partkey, (l_suppkey % 5, l_partkey, l_suppkey)) AS VARCHAR) AS answer FROM lineitem GROUP BY ALL")
def eval_union(spark, d):
    """Five tables of answers in numbered files, some to the same windows: the first by file and line counts."""
    path, l = new_folder(spark), read(spark, d, "lineitem")
    n, file = l.count(), F.concat(F.lit("eval-"), (F.col("l_suppkey") % 5).cast("string"))  # counting reads footers alone
    lines = l.select(file.alias("name"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("model"), F.col("l_partkey").alias("answer"), "l_suppkey")
    writers.numbered_files(lines, f"{path}/parts", "name", ["answer", "l_suppkey", "path", "model"], ["path", "model", "answer"], f"{path}/files", n)
    return readers.first_rows(spark, f"{path}/files/eval-*.csv", "path bigint, model int, answer string", ["path", "model"], n)


def _nation_files(spark, d, name, where: str, value) -> str:
    """A small CSV file for each nation that `where` takes."""
    path = new_folder(spark)
    n = read(spark, d, "nation").where(where)
    lines = n.select(name.alias("name"), F.inline(F.array(F.struct(F.lit(0).alias("at"), F.lit("region,key").alias("value")), F.struct(F.lit(1).alias("at"), value.alias("value")))))
    writers.named_files(lines, f"{path}/parts", "name", ["at"], "value", f"{path}/files", ".csv")
    return f"{path}/files/*.csv"


@query("SELECT n_name AS arm, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS region, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS key FROM nation")
def arm_summaries(spark, d):
    """Summaries of one row; arms without a file are there, too."""
    path = _nation_files(spark, d, F.concat(F.lit("summary-"), "n_name"), "n_nationkey % 3 > 0", F.concat_ws(",", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    return readers.summaries(spark, path, "region int, key int", read(spark, d, "nation").select(F.col("n_name").alias("arm")))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS model, 'D' || n_regionkey AS dataset, n_regionkey AS region, n_nationkey AS key FROM nation")
def legacy_files(spark, d):
    """Runs of an older tree: model and dataset from the file's name, the model by the registry's slug."""
    slug = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    path = _nation_files(spark, d, F.concat(slug, F.lit("-D"), F.col("n_regionkey").cast("string")), "true", F.concat_ws(",", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    models = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(slug.alias("slug"), F.col("n_name").alias("model"))
    return readers.by_file_name(spark, path, "region int, key int", models).select("model", "dataset", "region", "key")


@query(
    """SELECT event_id, CASE WHEN k IN (0, 1, 2) THEN event_type END AS label, CASE k WHEN 3 THEN 'a field is missing' WHEN 4 THEN 'degenerate text' WHEN 5 THEN 'no JSON object in reply' END AS error, CAST(CASE WHEN k IN (0, 5) THEN 1 ELSE 2 END AS INTEGER) AS attempts FROM (SELECT *, event_id % 6 AS k FROM events)"""
)
def retried_answers(spark, d):
    """A greedy reply and, where it failed, a sampled one: what counts, why not, and how many were asked for."""
    k, label = F.col("event_id") % 6, F.col("event_type")
    why = F.lit("slow waves over the left temporal chain, then a clear buildup in amplitude")
    good = answers.target({"label": label, "why": why})
    loop = answers.target({"label": label, "why": F.repeat(F.lit("the same "), 40)})
    greedy = F.when(k == 0, good).when(k.isin(1, 5), "I can't say").otherwise(loop)
    sampled = F.when(k.isin(1, 2), F.concat(F.lit("Now: "), good)).when(k == 3, '{"label": "x"}').when(k == 4, loop)
    out = read(spark, d, "events").select("event_id", answers.attempted([greedy, sampled], {"label": "string", "why": "string"}, "why", texts.degenerate).alias("r"))
    return out.select("event_id", "r.value.label", "r.error", "r.attempts")


@query(
    """SELECT doc_id, CASE WHEN e THEN false WHEN k = 3 THEN NULL ELSE k = 1 END AS correct_predictions, CASE WHEN e THEN false WHEN k = 3 THEN NULL ELSE n_chars > 500 END AS correct_rationale, CASE WHEN e THEN 'empty answer' WHEN k <> 3 THEN 'since "' || source || '"' END AS reason
 FROM (SELECT *, doc_id % 4 AS k, doc_id % 5 = 0 AS e FROM documents)"""
)
def judge_replies(spark, d):
    """A judge's verdicts; empty answers aren't shown to it."""
    k = F.col("doc_id") % 4
    told = answers.target({"correct_predictions": k == 1, "correct_rationale": F.col("n_chars") > 500, "reason": F.concat(F.lit('since "'), "source", F.lit('"'))})
    reply = F.when(k == 3, "unsure").when(k == 2, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).otherwise(told)
    candidate = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang"))
    return read(spark, d, "documents").select("doc_id", *judging.verdict(candidate, reply))


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderstatus = 'F'")
def scope_table(spark, d):
    """A scope kept in a table, and one that isn't there yet."""
    read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split")).createOrReplaceTempView("tidewell_scope")
    there = readers.table_or_empty(spark, "tidewell_scope", "path bigint, o_orderstatus string, split string").where("o_orderstatus = 'F'").select("path", "split")
    return there.unionByName(readers.table_or_empty(spark, "tidewell_absent_scope", "path bigint, split string"))


@query("SELECT event_id, event_id % 5 IN (0, 1) AS labelled FROM events")
def truth_flags(spark, d):
    """Whether a row's text booleans hold a label, however they are written."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, " True ").when(k == 1, "TRUE").when(k == 2, "yes").when(k == 3, "")
    return read(spark, d, "events").select("event_id", L.has_labels({"a": L.truth(text), "b": L.truth(F.lit("false"))}).alias("labelled"))
