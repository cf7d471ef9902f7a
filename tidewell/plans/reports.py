"""Queries of whole reports: one arm, a background, results of several sets, leaks by every key, the state of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import answers as replies
from tidewell.functions import text as texts
from tidewell.operators import judging, leakage, ordered, ranking, sampling, state
from tidewell.plans.catalogue import AUROC, DISTANCE, KEY, STATE, W, _distances, _state, query, r6, read, windows


def _auroc(name: str, src: str, by: str = "dataset") -> str:
    """AUROC's tables under names of their own."""
    out = AUROC.format(by=by, src=src)
    for t in "efa":
        out = out.replace(f", {t} AS (", f", {t}_{name} AS (").replace(f"\n {t} AS (", f"\n {t}_{name} AS (").replace(f"FROM {t} ", f"FROM {t}_{name} ").replace(f"FROM {t})", f"FROM {t}_{name})")
    return out


@query(
    f"""WITH {W}, v AS (SELECT * FROM w WHERE recording IN (SELECT recording FROM w WHERE positive)), u AS (SELECT * FROM w WHERE recording % 4 = 0){_auroc('all', 'w')}{_auroc('in', 'v')}{_auroc('sub', 'u')},
 n AS (SELECT dataset, count(*) AS windows, count(*) FILTER (score >= 0.05 AND positive) AS tp, count(*) FILTER (score >= 0.05 AND NOT positive) AS fp, count(*) FILTER (score < 0.05 AND positive) AS fn, count(*) FILTER (score < 0.05 AND NOT positive) AS tn FROM w GROUP BY dataset)
 SELECT dataset, windows, a_all.auroc AS auroc, a_in.auroc AS auroc_within, a_sub.auroc AS auroc_subset, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM n JOIN a_all USING (dataset) JOIN a_in USING (dataset) JOIN a_sub USING (dataset)"""
)
def arm_summary(spark, d):
    out = ranking.arm_figures(windows(spark, d), ["dataset"], ["recording"], F.col("recording") % 4 == 0, threshold=0.05)
    return out.select("dataset", "windows", *(r6(c).alias(c) for c in ("auroc", "auroc_within", "auroc_subset", "balanced_accuracy")))


@query(
    f"""{DISTANCE}, b AS (SELECT CASE WHEN distance IS NULL THEN 'none' WHEN distance <= 2 THEN '1-2' WHEN distance <= 10 THEN '3-10' ELSE '>10' END AS bucket, score FROM n WHERE NOT positive)
 SELECT count(*) AS windows, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS specificity, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (bucket = '1-2'), 6) AS near, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (bucket = '3-10'), 6) AS middle, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (bucket = 'none'), 6) AS quiet FROM b"""
)
def background_summary(spark, d):
    b = _distances(spark, d).where(~F.col("positive")).withColumn("bucket", ranking.bucket(F.col("distance")))
    of = lambda name, test: r6(F.avg(F.when(test, (F.col("score") < 0.05).cast("double")))).alias(name)
    return b.agg(F.count("*").alias("windows"), of("specificity", F.lit(True)), *(of(n, F.col("bucket") == k) for n, k in (("near", "1-2"), ("middle", "3-10"), ("quiet", "none"))))


@query(
    f"""WITH {W}, s AS (SELECT *, 'all' AS set FROM w UNION ALL SELECT *, 'urgent' FROM w WHERE recording IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT *, 'many' FROM w WHERE quantity > 25),
 n AS (SELECT dataset, set, count(*) FILTER (score >= 0.05 AND positive) AS tp, count(*) FILTER (score >= 0.05 AND NOT positive) AS fp, count(*) FILTER (score < 0.05 AND positive) AS fn, count(*) FILTER (score < 0.05 AND NOT positive) AS tn FROM s GROUP BY ALL)
 SELECT dataset, set, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity FROM n"""
)
def results_export(spark, d):
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("recording"))
    w = state.with_bit(windows(spark, d), urgent, ["recording"], "urgent")
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("urgent"), "urgent"), F.when(F.col("quantity") > 25, "many")))
    out = ranking.at_threshold(w.select("dataset", "score", "positive", F.explode(sets).alias("set")), ["dataset", "set"], threshold=0.05)
    return out.select("dataset", "set", *(r6(x).alias(x) for x in ("balanced_accuracy", "sensitivity", "specificity")))


GRID = "s AS (SELECT p_brand AS base, CASE WHEN p_size % 3 = 0 THEN 'small' WHEN p_size % 3 = 1 THEN 'middle' ELSE 'large' END AS size, round(max(p_retailprice), 2) AS ba FROM part GROUP BY ALL)"


@query(f"WITH {GRID} SELECT base, max(ba) FILTER (size = 'small') AS small, max(ba) FILTER (size = 'middle') AS middle, max(ba) FILTER (size = 'large') AS large FROM s GROUP BY base")
def grid_table(spark, d):
    size = F.when(F.col("p_size") % 3 == 0, "small").when(F.col("p_size") % 3 == 1, "middle").otherwise("large")
    s = read(spark, d, "part").groupBy(F.col("p_brand").alias("base"), size.alias("size")).agg(F.round(F.max("p_retailprice"), 2).alias("ba"))
    return judging.side_by_side(s, ["base"], "size", "ba", ["small", "middle", "large"])


@query(
    f"""WITH {W}, s AS (SELECT patient, recording, dataset || line AS scan, part, CASE WHEN recording % 10 < 7 THEN 'train' WHEN recording % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM w),
 k AS (SELECT DISTINCT 'patient' AS key, CAST(patient AS VARCHAR) AS v, split FROM s UNION SELECT DISTINCT 'recording', CAST(recording AS VARCHAR), split FROM s UNION SELECT DISTINCT 'scan', scan, split FROM s UNION SELECT DISTINCT 'part', CAST(part AS VARCHAR), split FROM s)
 SELECT a.key AS key, a.split AS left, b.split AS right, count(*) AS n FROM k a JOIN k b ON a.key = b.key AND a.v = b.v AND a.split < b.split GROUP BY ALL"""
)
def leakage_by_key(spark, d):
    k = F.col("recording") % 10
    s = windows(spark, d).select("patient", "recording", F.concat("dataset", F.col("line").cast("string")).alias("scan"), "part", F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"))
    return leakage.overlaps(s, "split", {c: c for c in ("patient", "recording", "scan", "part")})


@query("SELECT count(*) AS keys FROM (SELECT md5(text) FROM documents WHERE doc_id % 10 = 9 UNION SELECT md5(text) FROM documents WHERE source = 'src3' UNION SELECT md5(text) FROM benchmark)")
def test_keys(spark, d):
    docs, md5 = read(spark, d, "documents"), F.md5(F.col("text").cast("binary")).alias("h")
    every = docs.where("doc_id % 10 = 9").select(md5).union(docs.where("source = 'src3'").select(md5)).union(read(spark, d, "benchmark").select(md5))
    return every.distinct().agg(F.count("*").alias("keys"))


@query(
    f"""WITH {STATE}, t AS (SELECT dataset, path FROM st WHERE NOT done), f AS (SELECT DISTINCT user_id AS path FROM events WHERE value > 20)
 SELECT dataset, count(*) AS pending, count(*) FILTER (path IN (SELECT path FROM f)) AS failed, count(*) FILTER (path NOT IN (SELECT path FROM f)) AS untried FROM t GROUP BY dataset"""
)
def status_report(spark, d):
    failed = read(spark, d, "events").where("value > 20").select(F.col("user_id").alias("path"))
    return state.pending_report(_state(spark, d).where("not done"), failed, ["path"], ["dataset"])


@query(f"WITH {W} SELECT recording, line, part, supp, rank() OVER (PARTITION BY recording ORDER BY score) + (count(*) OVER (PARTITION BY recording, score) - 1) / 2 AS rank FROM w")
def average_ranks(spark, d):
    return windows(spark, d).select(*KEY, ordered.average_rank(["recording"], "score").alias("rank"))


@query(f"WITH {W} SELECT dataset, recording, line, part, supp, CASE WHEN row_number() OVER (PARTITION BY dataset, patient ORDER BY recording, line, part, supp) = 1 THEN pred ELSE '' END AS explain FROM w")
def explained_once(spark, d):
    w = windows(spark, d).withColumn("explain", F.col("pred"))
    return ordered.first_only(w, ["dataset", "patient"], KEY, "explain").select("dataset", *KEY, "explain")


@query(f"WITH {W} SELECT recording, line, part, supp FROM w WHERE positive AND score BETWEEN 0.03 AND 0.07 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) = 1")
def first_qualifying(spark, d):
    return ordered.first_where(windows(spark, d), ["recording"], ["line", "part", "supp"], F.col("positive") & F.col("score").between(0.03, 0.07)).select(*KEY)


@query("SELECT user_id AS run, event_id AS step, event_id = max(event_id) OVER (PARTITION BY user_id) AS last, event_id = first_value(event_id) OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS best FROM events")
def checkpoint_marks(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    return ordered.marked(e, ["run"], "step", "value").select("run", "step", "last", "best")


def _named(x: str) -> str:
    """The codes de and fr by name, in SQL."""
    x = rf"""regexp_replace({x}, '\s*\(\s*\\?"?(de|fr)\\?"?\s*\)', '', 'gi')"""
    for pattern in (r'\\?"{}\\?"', r"\b{}\b"):
        for code, name in (("de", "German"), ("fr", "French")):
            x = f"regexp_replace({x}, '{pattern.format(code)}', '{name}', 'gi')"
    return rf"trim(regexp_replace({x}, '\s{{2,}}', ' ', 'g'))"


CODED = """'code ' || lang || ' of (' || upper(lang) || ')  ' || source || ' ( \\"' || lang || '\\" ), not ' || lang || 'x or "' || lang || '" (' || lang || ' )'"""


@query(f"SELECT doc_id, {_named(CODED)} AS text FROM documents")
def plain_names(spark, d):
    lang, more = F.col("lang"), F.lit
    code = F.concat(more("code "), lang, more(" of ("), F.upper("lang"), more(")  "), "source", more(' ( \\"'), lang, more('\\" ), not '), lang, more('x or "'), lang, more('" ('), lang, more(" )"))
    return read(spark, d, "documents").select("doc_id", texts.renamed(code, {"de": "German", "fr": "French"}).alias("text"))


@query("SELECT event_id, event_id % 7 > 3 AS valid FROM events")
def valid_answers(spark, d):
    k = F.col("event_id") % 7
    long = F.concat(F.lit('Answer {"label": "'), F.repeat(F.lit("y"), 4000), F.lit(r'\" {", "n": 7} {"n"'))
    bad = F.when(k == 0, 'So: {"label": "a"}').when(k == 1, "no object").when(k == 2, '["label", "n"]').when(k == 3, '{"label": "a", "n": "many"}')
    reply = bad.when(k == 4, '```json\n{"label": "x {y}", "n": 3, "more": {"a": {"b": 1}}}\n``` ok').when(k == 5, long).otherwise('{"n": 5, "label": "```"}')
    return read(spark, d, "events").select("event_id", replies.valid(reply, {"label": "string", "n": "int"}).alias("valid"))


@query(
    f"""WITH {W}, x AS (SELECT *, CASE WHEN dataset = 'BUILDING' THEN '' ELSE dataset END AS pattern FROM w), t AS (SELECT avg(CASE WHEN positive THEN 1.0 ELSE 0.0 END) AS r FROM x), s AS (SELECT pattern, count(*) AS n, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM x GROUP BY pattern)
 SELECT pattern, n AS rows_before, p AS positives_before, CAST(CASE WHEN pattern = '' THEN n WHEN p > r * n THEN q + round_even(q * r / (1 - r), 0) ELSE p + least(q, round_even(p * (1 - r) / r, 0)) END AS BIGINT) AS rows_after, CAST(CASE WHEN pattern <> '' AND p > r * n THEN round_even(q * r / (1 - r), 0) ELSE p END AS BIGINT) AS positives_after FROM s, t"""
)
def rate_report(spark, d):
    x = windows(spark, d).withColumn("pattern", F.when(F.col("dataset") == "BUILDING", "").otherwise(F.col("dataset")))
    return sampling.rate_report(x, sampling.rate_balance(x, "pattern", "positive", [F.col(k) for k in KEY]), "pattern", "positive")
