"""All queries by name, each a function of (spark, sf_dir), and their SQL.

The tables stand for the curation world: customer, order and line item are patient, recording and window; market segments are
datasets; return flags are true labels and a rule on status and quantity gives answers; discounts are scores with many ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import answers as replies
from tidewell.functions import labels as L
from tidewell.functions import names, numbers
from tidewell.functions import text as texts
from tidewell.operators import bootstrap, clients, curation, dedup, intervals, judging, leakage, metrics, ordered, planning, ranking, ranks, sampling, state
from tidewell.sources import writers
from tidewell.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["recording", "line", "part", "supp"]
W = """w AS (SELECT o_custkey AS patient, l_orderkey AS recording, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, c_mktsegment AS dataset,
 l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity < 25 THEN 'A' ELSE 'R' END AS pred, l_discount AS score, l_returnflag = 'R' AS positive, l_quantity AS quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Line items move once, by recording, and orders, by patient, into parts that don't grow with the table; what groups by recording then moves nothing."""
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")  # counting them reads footers alone
    heads = ranks.dealt(orders, ["o_custkey"], orders.count()).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment")
    joined = ranks.dealt(lines, ["l_orderkey"], lines.count()).join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    pred = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") < 25, "A").otherwise("R")
    c = F.col
    return joined.select(
        c("o_custkey").alias("patient"), c("l_orderkey").alias("recording"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), c("c_mktsegment").alias("dataset"),
        c("l_returnflag").alias("truth"), pred.alias("pred"), c("l_discount").alias("score"), (c("l_returnflag") == "R").alias("positive"), c("l_quantity").alias("quantity"),
    )


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def by_class(w: DataFrame, by: list[str]) -> DataFrame:
    long = w.select(*by, "truth", "pred", F.explode(F.array(*map(F.lit, "ANR"))).alias("class"))
    return long.select(*by, "class", (F.col("truth") == F.col("class")).alias("truth"), (F.col("pred") == F.col("class")).alias("pred"))


COUNTS = f"""WITH {W}, c AS (SELECT dataset, class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (truth <> class AND pred = class) AS fp,
 count(*) FILTER (truth = class AND pred <> class) AS fn, count(*) FILTER (truth <> class AND pred <> class) AS tn FROM w, (VALUES ('A'), ('N'), ('R')) AS k(class) GROUP BY ALL),
 s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0.0) AS specificity,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, tp + fn AS support FROM c)"""


@query(f"{COUNTS} SELECT dataset, class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s")
def confusion_prf(spark, d):
    s = metrics.rates(metrics.confusion(by_class(windows(spark, d), ["dataset"]), ["dataset", "class"]))
    return s.select("dataset", "class", "tp", "fp", "fn", "tn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


AUROC = """, e AS (SELECT {by}, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM {src} GROUP BY ALL),
 f AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won FROM e),
 a AS (SELECT {by}, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(won) / (sum(p) * sum(n)), 6) END AS auroc FROM f GROUP BY ALL)"""


@query(
    f"""{COUNTS}, m AS (SELECT dataset, round(coalesce(avg(CASE WHEN support >= 20 THEN f1 END), 0), 6) AS macro_f1, round(coalesce(avg(CASE WHEN support >= 20 THEN (recall + specificity) / 2 END), 0), 6) AS balanced_accuracy,
 count(*) FILTER (support >= 20) AS scored_classes FROM s GROUP BY dataset){AUROC.format(by="dataset", src="w")} SELECT dataset, macro_f1, balanced_accuracy, scored_classes, positives, negatives, auroc FROM m JOIN a USING (dataset)"""
)
def segment_scores(spark, d):
    w = windows(spark, d)
    m = metrics.macro(metrics.rates(metrics.confusion(by_class(w, ["dataset"]), ["dataset", "class"])), ["dataset"])
    a = ranking.auroc(w, ["dataset"])
    return m.join(a, "dataset").select("dataset", r6("macro_f1").alias("macro_f1"), r6("balanced_accuracy").alias("balanced_accuracy"), "scored_classes", "positives", "negatives", r6("auroc").alias("auroc"))


@query(f"WITH {W}{AUROC.format(by='dataset', src='w')} SELECT * FROM a")
def auroc(spark, d):
    return ranking.auroc(windows(spark, d), ["dataset"]).withColumn("auroc", r6("auroc"))


@query(f"WITH {W}, v AS (SELECT * FROM w WHERE recording IN (SELECT recording FROM w WHERE positive)){AUROC.format(by='dataset', src='v')} SELECT * FROM a")
def auroc_within(spark, d):
    return ranking.auroc(ranking.within_positive_groups(windows(spark, d), ["recording"]), ["dataset"]).withColumn("auroc", r6("auroc"))


@query(
    f"""WITH {W}, n AS (SELECT dataset, count(*) FILTER (p AND positive) AS tp, count(*) FILTER (p AND NOT positive) AS fp, count(*) FILTER (NOT p AND positive) AS fn, count(*) FILTER (NOT p AND NOT positive) AS tn
 FROM (SELECT *, score >= 0.05 AS p FROM w) GROUP BY dataset), r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0.0) AS se, coalesce(tn / nullif(tn + fp, 0), 0.0) AS sp FROM n)
 SELECT dataset, round((se + sp) / 2, 6) AS balanced_accuracy, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_positive FROM r"""
)
def threshold_rates(spark, d):
    out = ranking.at_threshold(windows(spark, d), ["dataset"], threshold=0.05)
    return out.select("dataset", *(r6(c).alias(c) for c in out.columns[1:]))


VOTES = f"""WITH {W}, o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) AS ord FROM w), e AS (SELECT recording, pred, count(*) AS n, min(ord) AS first FROM o GROUP BY ALL)"""


def _ordered(w: DataFrame) -> DataFrame:
    return w.withColumn("ord", ordered.ordinal(["recording"], ["line", "part", "supp"]))


@query(f"{VOTES} SELECT recording, pred FROM e QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, first) = 1")
def majority_vote(spark, d):
    return metrics.vote(_ordered(windows(spark, d)), ["recording"], "pred", "ord")


@query(f"WITH {W} SELECT recording, bool_or(truth = 'R') AS returned, bool_or(pred = 'R') AS predicted FROM w GROUP BY recording")
def any_positive(spark, d):
    w = windows(spark, d).select("recording", (F.col("truth") == "R").alias("returned"), (F.col("pred") == "R").alias("predicted"))
    return metrics.any_positive(w, ["recording"], "returned", "predicted")


@query(f"WITH {W} SELECT recording, string_agg(DISTINCT truth, '+' ORDER BY truth) AS labels FROM w GROUP BY recording")
def label_sets(spark, d):
    w = windows(spark, d).select("recording", L.positives({k: F.col("truth") == k for k in "ANR"}).alias("labels"))
    return metrics.union_of_sets(w, ["recording"], "labels").select("recording", F.array_join("labels", "+").alias("labels"))


@query(
    f"""WITH {W}, e AS (SELECT dataset, pred AS answer, count(*) AS n, min((recording, line, part, supp)) AS first FROM w GROUP BY ALL)
 SELECT dataset, count(*) AS distinct_answers, first(answer ORDER BY n DESC, first) AS top_answer, round(max(n) / sum(n), 6) AS top_answer_fraction, max(n) / sum(n) >= 0.95 AS degenerate FROM e GROUP BY dataset"""
)
def answer_distribution(spark, d):
    w = windows(spark, d).withColumn("ord", F.struct(*KEY))
    return metrics.answers(w, ["dataset"], F.array("pred"), "ord").withColumn("top_answer_fraction", r6("top_answer_fraction"))


@query(f"WITH {W} SELECT dataset, count(*) FILTER (score > 0.02) AS windows, round(count(*) FILTER (score > 0.02) / count(*), 4) AS coverage FROM w GROUP BY dataset")
def coverage(spark, d):
    w = windows(spark, d)
    return metrics.coverage(w, w.where("score > 0.02"), KEY, ["dataset"], rows=read(spark, d, "lineitem").count())


SETS = """l AS (SELECT dataset, recording, bool_or(truth = 'A') AS a, bool_or(truth = 'N') AS n, bool_or(truth = 'R') AS r, max(quantity) > 48 AS q FROM w GROUP BY ALL)"""


@query(
    f"""WITH {W}, {SETS}, g(guess, ga, gn, gr, gq) AS (VALUES ('a', 1, 0, 0, 0), ('n', 0, 1, 0, 0), ('r', 0, 0, 1, 0), ('q', 0, 0, 0, 1), ('all', 1, 1, 1, 1), ('none', 0, 0, 0, 0)),
 k AS (SELECT dataset, guess, class, h, p FROM (SELECT dataset, guess, unnest(['a', 'n', 'r', 'q']) AS class, unnest([a, n, r, q]) AS h, unnest([ga, gn, gr, gq]) = 1 AS p FROM l, g)),
 f AS (SELECT dataset, guess, class, coalesce(2 * count(*) FILTER (h AND p) / nullif(2 * count(*) FILTER (h AND p) + count(*) FILTER (h <> p), 0), 0.0) AS f1, count(*) FILTER (h) AS support FROM k GROUP BY ALL),
 m AS (SELECT dataset, guess, avg(f1) AS macro FROM f WHERE support >= 20 GROUP BY ALL) SELECT dataset, round(max(macro), 6) AS floor, round(max(macro) FILTER (guess NOT IN ('all', 'none')), 6) AS single_floor FROM m GROUP BY dataset"""
)
def constant_floor(spark, d):
    """Of recordings' label sets: the best constant set, and the best constant class."""
    w = windows(spark, d)
    sets = w.groupBy("dataset", "recording").agg(*(F.bool_or(F.col("truth") == c.upper()).alias(c) for c in "anr"), (F.max("quantity") > 48).alias("q"))
    long = sets.select("dataset", F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("holds")) for c in "anrq"))))
    one = metrics.constant_floor(long, ["dataset"], binary=True).select("dataset", r6("floor").alias("single_floor"))
    return metrics.constant_floor(long, ["dataset"]).withColumn("floor", r6("floor")).join(one, "dataset")


TOP = """t AS (SELECT dataset, patient, recording, sum(hundredths) AS total, count(*) AS n, bool_or(positive) AS positive FROM (SELECT dataset, patient, recording, CAST(round(score * 100) AS BIGINT) AS hundredths, bool_or(positive) OVER (PARTITION BY recording) AS positive
 FROM w QUALIFY row_number() OVER (PARTITION BY recording ORDER BY score DESC, line, part, supp) <= 3) GROUP BY ALL),
 u AS (SELECT dataset, patient, CAST(sum(total * (6 // n)) AS BIGINT) / (6 * count(*)) / 100 AS score, bool_or(positive) AS positive FROM t GROUP BY ALL)"""


def _patients(spark, d) -> DataFrame:
    """Patients' scores from hundredths, so that sums are exact."""
    w = windows(spark, d).withColumn("positive", F.bool_or("positive").over(Window.partitionBy("recording"))).withColumn("hundredths", F.round(F.col("score") * 100).cast("long"))
    sums = ranking.top_sums(w, ["dataset", "patient", "recording", "positive"], ["line", "part", "supp"], score="hundredths", k=3)
    return ranking.mean_of_means(sums, ["dataset", "patient"], 3, "score", "positive").withColumn("score", F.col("score") / 100)


@query(f"WITH {W}, {TOP} SELECT dataset, patient, floor(score * 1000000 + 0.5) / 1000000 AS score, positive FROM u")
def topk_rollup(spark, d):
    return _patients(spark, d).withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000)


DISTANCE = f"""WITH {W}, k AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS idx, positive, score FROM w),
 n AS (SELECT *, least(idx - max(CASE WHEN positive THEN idx END) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 min(CASE WHEN positive THEN idx END) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx) AS distance FROM k)"""


def _distances(spark, d) -> DataFrame:
    k = windows(spark, d).withColumn("idx", ordered.ordinal(["recording"], ["line", "part", "supp"]).cast("long"))
    return intervals.nearest_event(k, ["recording"], "idx", F.col("positive"))


@query(f"{DISTANCE} SELECT recording, idx, distance FROM n")
def nearest_event_distance(spark, d):
    return _distances(spark, d).select("recording", "idx", "distance")


@query(f"{DISTANCE} SELECT CASE WHEN distance IS NULL THEN 'none' WHEN distance <= 2 THEN '1-2' WHEN distance <= 10 THEN '3-10' ELSE '>10' END AS bucket, count(*) AS windows, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS specificity FROM n WHERE NOT positive GROUP BY 1")
def bucketed_specificity(spark, d):
    quiet = _distances(spark, d).where(~F.col("positive")).withColumn("bucket", ranking.bucket(F.col("distance")))
    return ranking.specificity_by(quiet, ["bucket"], threshold=0.05).withColumn("specificity", r6("specificity"))


REPLICATES = 1000


def weights_sql(clusters: str, replicates: int = REPLICATES) -> str:
    """A table x (cluster, replicate, k) of the weights, from a query of the clusters."""
    cuts = " ".join(f"WHEN u < {p} THEN {k}" for k, p in enumerate(bootstrap.POISSON))
    return f"""h AS (SELECT cluster, r, md5(cluster || ':' || r) AS h FROM (SELECT DISTINCT cluster FROM ({clusters})), range({-(-replicates // 4)}) AS t(r)),
 g AS (SELECT cluster, CAST(r * 4 + i AS INTEGER) AS replicate, ('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8))::BIGINT / 4294967296.0 AS u FROM h, range(4) AS t(i)),
 x AS (SELECT * FROM (SELECT cluster, replicate, CASE {cuts} ELSE 6 END AS k FROM g) WHERE k > 0)"""


@query(
    f"""WITH {W}, c AS (SELECT dataset, patient, count(*) FILTER (pred = 'R' AND truth = 'R') AS tp, count(*) FILTER (pred = 'R' AND truth <> 'R') AS fp, count(*) FILTER (pred <> 'R' AND truth = 'R') AS fn FROM w GROUP BY ALL),
 {weights_sql("SELECT patient AS cluster FROM w")}, s AS (SELECT dataset, replicate, 2 * sum(tp * k) / nullif(2 * sum(tp * k) + sum(fp * k) + sum(fn * k), 0) AS f1 FROM c JOIN x ON patient = cluster GROUP BY ALL)
 SELECT dataset, round(quantile_cont(CAST(f1 AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST(f1 AS DOUBLE), 0.975), 6) AS high FROM s GROUP BY dataset"""
)
def bootstrap_ci_poisson(spark, d):
    w = windows(spark, d)
    t, p = F.col("truth") == "R", F.col("pred") == "R"
    counts = w.groupBy("dataset", "patient").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    again = bootstrap.weighted(counts, "patient", ["dataset"], ["tp", "fp", "fn"], REPLICATES)
    f1 = again.withColumn("f1", F.expr("2 * tp / nullif(2 * tp + fp + fn, 0)"))
    return bootstrap.interval(f1, ["dataset"], "f1").select("dataset", r6("low").alias("low"), r6("high").alias("high"))


@query()
def bootstrap_ci_exact(spark, d):
    counts = metrics.confusion(by_class(windows(spark, d), ["dataset", "patient"]), ["dataset", "patient", "class"])
    return bootstrap.macro_f1_interval(counts, "patient", ["dataset"], list("ANR"))


PATHS = "p AS (SELECT 'train/' || replace(c_name, '#', '_') || '_s' || (o_orderkey % 7) || '_' || (o_orderkey % 50) || '.png' AS path FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {PATHS} SELECT path, regexp_extract(path, '([^/]+)_([^_/]+)_(\\d+)\\.[^./]+$', 1) AS patient, regexp_extract(path, '([^/]+_[^_/]+)_(\\d+)\\.[^./]+$', 1) AS recording, CAST(regexp_extract(path, '_(\\d+)\\.[^./]+$', 1) AS INTEGER) AS idx, split_part(path, '/', 1) AS split, regexp_replace(path, '^[^/]+/', '') AS rest FROM p")
def parse_names(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat(F.lit("train/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("_s"), (F.col("o_orderkey") % 7).cast("string"), F.lit("_"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".png"))
    p = F.col("path")
    return o.select(path.alias("path")).select(p, names.patient(p).alias("patient"), names.recording(p).alias("recording"), names.window_index(p).alias("idx"), names.split_of(p).alias("split"), names.without_first(p).alias("rest"))


@query(
    """WITH a AS (SELECT user_id AS recording, epoch(ts) % 3600 AS s, epoch(ts) % 3600 + 45 AS e, event_type AS label FROM events), w AS (SELECT DISTINCT user_id AS recording, CAST(i AS INTEGER) AS idx FROM events, range(180) AS t(i)),
 m AS (SELECT recording, idx, string_agg(DISTINCT label, '+' ORDER BY label) AS labels FROM w JOIN a USING (recording) WHERE s < (idx + 1) * 20 AND e > idx * 20 GROUP BY ALL)
 SELECT recording, idx, coalesce(labels, 'bckg') AS labels FROM w LEFT JOIN m USING (recording, idx)"""
)
def window_labels(spark, d):
    e = read(spark, d, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 3600
    notes = e.select(F.col("user_id").alias("recording"), s.alias("start_time"), (s + 45).alias("stop_time"), F.col("event_type").alias("label"))
    own = e.select(F.col("user_id").alias("recording")).distinct().select("recording", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("index"))
    out = intervals.window_labels(own, notes, "recording", 20.0, default="bckg")
    return out.select("recording", F.col("index").alias("idx"), F.array_join("labels", "+").alias("labels"))


@query("WITH s AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS k FROM events), r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM s) SELECT user_id, min(k) AS first, max(k) AS last FROM r GROUP BY user_id, run")
def event_islands(spark, d):
    s = read(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("k")).distinct()
    return intervals.islands(s, ["user_id"], "k")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS ordinal FROM orders")
def ordinal_names(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", ordered.ordinal(["o_custkey"], [F.col("o_orderkey").cast("string")]).cast("long").alias("ordinal"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) <= 5")
def top_per_class(spark, d):
    return ordered.top(read(spark, d, "part"), ["p_brand"], ["p_name", "p_partkey"], 5).select("p_brand", "p_partkey")


SPREAD = "list_contains(list_transform(range({cap}), lambda i: CAST(round_even(i * (n - 1) / ({cap} - 1.0), 0) AS BIGINT)), pos)"


@query(
    f"""WITH {W}, k AS (SELECT recording, line, part, supp, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS pos FROM w)
 SELECT cap, recording, line, part, supp FROM k, (VALUES (1), (2), (3), (8), (NULL)) AS c(cap) WHERE cap IS NULL OR cap >= n OR (cap = 1 AND pos = n // 2) OR (cap = 2 AND {SPREAD.format(cap=2)}) OR (cap = 3 AND {SPREAD.format(cap=3)}) OR (cap = 8 AND {SPREAD.format(cap=8)})"""
)
def spread_sample(spark, d):
    return sampling.spread_by_caps(windows(spark, d).select(*KEY), ["recording"], ["line", "part", "supp"], [1, 2, 3, 8, None]).select("cap", *KEY)


SPLIT = """u AS (SELECT o_custkey AS patient, count(*) AS n FROM orders GROUP BY 1),
 split AS (SELECT patient, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY md5('0|' || patient), patient ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round_even(0.3 * sum(n) OVER (), 0) THEN 'test' ELSE 'train' END AS split FROM u)"""


def _split(spark, d) -> DataFrame:
    u = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.count("*").alias("n"))
    return sampling.running_split(u, "n", [F.col("patient")], 0.3)


@query(f"WITH {SPLIT} SELECT patient, n, split FROM split")
def patient_split(spark, d):
    return _split(spark, d)


RANKED = "md5('0|' || recording || '|' || line || '|' || part || '|' || supp)"


@query(
    f"""WITH {W}, k AS (SELECT *, count(*) FILTER (positive) OVER (PARTITION BY recording) AS ne, count(*) FILTER (NOT positive) OVER (PARTITION BY recording) AS nb, row_number() OVER (PARTITION BY recording, positive ORDER BY {RANKED}, recording, line, part, supp) AS r FROM w),
 q AS (SELECT *, least(4 - least(2, ne), nb) AS quiet FROM k) SELECT recording, line, part, supp, positive FROM q WHERE r <= CASE WHEN positive THEN least(ne, 4 - quiet) ELSE quiet END"""
)
def pick_train(spark, d):
    return curation.pick_train(windows(spark, d), ["recording"], [F.col(k) for k in KEY], F.col("positive")).select(*KEY, "positive")


@query(f"WITH {W}, k AS (SELECT *, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS pos FROM w) SELECT recording, line, part, supp FROM k WHERE positive OR n <= 3 OR {SPREAD.format(cap=3)}")
def pick_test(spark, d):
    return curation.pick_test(windows(spark, d), ["recording"], ["line", "part", "supp"], F.col("positive"), 3).select(*KEY)


def _labelled(spark, d) -> DataFrame:
    """Windows whose label set follows from flag and quantity; some have none."""
    q = F.col("quantity")
    classes = {"bckg": F.col("truth") == "N", "seiz": (F.col("truth") == "R") & (q > 10), "slow": q > 40, "rare": (F.col("truth") == "A") & (q == 1)}
    return windows(spark, d).withColumn("labels", L.positives(classes))


LABELLED = """l AS (SELECT *, list_sort(list_filter([CASE WHEN truth = 'N' THEN 'bckg' END, CASE WHEN truth = 'R' AND quantity > 10 THEN 'seiz' END, CASE WHEN quantity > 40 THEN 'slow' END, CASE WHEN truth = 'A' AND quantity = 1 THEN 'rare' END], lambda x: x IS NOT NULL)) AS labels FROM w)"""


def _cap(n: int) -> str:
    return f"(n <= {n} OR {SPREAD.format(cap=n)})"


@query(
    f"""WITH {W}, {LABELLED}, v AS (SELECT * FROM l WHERE len(labels) > 0), r AS (SELECT DISTINCT patient, recording FROM v),
 rr AS (SELECT recording FROM (SELECT recording, count(*) OVER (PARTITION BY patient) AS n, row_number() OVER (PARTITION BY patient ORDER BY CAST(recording AS VARCHAR)) - 1 AS pos FROM r) WHERE {_cap(4)}),
 k AS (SELECT recording, line, part, supp, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS pos FROM v WHERE recording IN (SELECT recording FROM rr)) SELECT recording, line, part, supp FROM k WHERE {_cap(4)}"""
)
def test_select_binary(spark, d):
    w = _labelled(spark, d).withColumn("rec", F.col("recording").cast("string")).withColumn("at", F.struct("line", "part", "supp"))
    return curation.test_select_binary(w, "labels", "patient", "rec", "at", 4, 4).select(*KEY)


@query(
    f"""WITH {W}, {LABELLED}, v AS (SELECT * FROM l WHERE len(labels) > 0), c AS (SELECT class FROM (SELECT recording, unnest(labels) AS class FROM v) GROUP BY class HAVING count(DISTINCT recording) >= 200),
 t AS (SELECT *, list_filter(labels, lambda x: x <> 'bckg') AS fg, array_to_string(labels, '+') AS sig FROM v), m AS (SELECT *, len(list_filter(fg, lambda x: NOT list_contains(cs, x))) > 0 AS rare FROM t, (SELECT coalesce(list(class), []) AS cs FROM c)),
 k AS (SELECT *, count(*) OVER (PARTITION BY recording, sig) AS n, row_number() OVER (PARTITION BY recording, sig ORDER BY line, part, supp) - 1 AS pos FROM m)
 SELECT recording, line, part, supp, sig FROM k WHERE rare OR (len(fg) = 0 AND {_cap(2)}) OR (len(fg) > 0 AND {_cap(3)})"""
)
def test_select(spark, d):
    w = _labelled(spark, d).withColumn("at", F.struct("line", "part", "supp"))
    return curation.test_select(w, "labels", "recording", "at").select(*KEY, F.array_join("labels", "+").alias("sig"))


PROBLEMS = rf"""trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))"""
WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')"
DEGENERATE = f"(length(t) < 40 OR len({WORDS}) < 8 OR len(list_distinct(string_split(t, ''))) < 12 OR len(list_distinct({WORDS})) / len({WORDS}) < 0.2)"
TEXTS = rf"""x AS (SELECT d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic, regexp_replace(d.text, '^\s+|\s+$', '', 'g') AS t, list_sort(list_filter([CASE WHEN l.quality = 1 THEN 'bckg' END, CASE WHEN l.toxic = 1 THEN 'seiz' END], lambda z: z IS NOT NULL)) AS labels FROM documents d LEFT JOIN labels l USING (doc_id)),
 y AS (SELECT *, t <> '' AND {DEGENERATE} AS degenerate, t <> '' AND right(t, 1) NOT IN ('.', '!', '?', '"', ')') AS truncated, t <> '' AND list_contains(labels, 'seiz') AND regexp_matches(t, '{texts.HEDGE.replace("'", "''")}') AS hedge FROM x)"""


def _texts(spark, d) -> DataFrame:
    l = read(spark, d, "labels")
    return read(spark, d, "documents").join(l, "doc_id", "left").withColumn("labels", L.positives({"bckg": F.col("quality") == 1, "seiz": F.col("toxic") == 1}))


@query(f"WITH {TEXTS} SELECT doc_id, concat_ws('+', CASE WHEN degenerate THEN 'degenerate' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN hedge THEN 'hedge' END) AS problems FROM y")
def text_quality(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(texts.problems(F.col("text"), F.col("labels")), "+").alias("problems"))


@query(
    f"""WITH {TEXTS}, tp AS (SELECT DISTINCT source FROM documents WHERE source IN ('src3', 'src7')), th AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 31 = 0),
 f AS (SELECT *, CASE WHEN len(labels) = 0 THEN 'unlabelled' WHEN source IN (SELECT source FROM tp) THEN 'test patient' WHEN md5(text) IN (SELECT h FROM th) THEN 'test duplicate'
 WHEN min(array_to_string(labels, '+')) OVER (PARTITION BY md5(text)) <> max(array_to_string(labels, '+')) OVER (PARTITION BY md5(text)) THEN 'conflict' END AS first FROM y),
 g AS (SELECT *, first IS NULL AND trim(text) <> '' AND row_number() OVER (PARTITION BY text, first IS NULL AND trim(text) <> '' ORDER BY doc_id) > 1 AS again FROM f)
 SELECT doc_id, coalesce(first, concat_ws('+', CASE WHEN degenerate THEN 'degenerate' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN hedge THEN 'hedge' END, CASE WHEN again THEN 'duplicate' END)) AS reasons FROM g"""
)
def train_screen(spark, d):
    t = _texts(spark, d).withColumn("content", F.md5(F.col("text").cast("binary")))
    docs = read(spark, d, "documents")
    held = docs.where("doc_id % 31 = 0").select(F.md5(F.col("text").cast("binary")).alias("content"))
    out = curation.train_screen(t, "doc_id", "source", "content", "labels", "text", docs.where("source in ('src3', 'src7')").select("source"), held)
    return out.select("doc_id", F.array_join("reasons", "+").alias("reasons"))


@query(f"WITH {W}, k AS (SELECT *, row_number() OVER (PARTITION BY truth, patient ORDER BY recording, line, part, supp) AS turn FROM w) SELECT truth, recording, line, part, supp FROM k QUALIFY row_number() OVER (PARTITION BY truth ORDER BY turn, patient) <= 500")
def round_robin_budget(spark, d):
    return sampling.round_robin(windows(spark, d), ["truth"], "patient", KEY, 500).select("truth", *KEY)


@query(
    f"""WITH {W}, r AS (SELECT DISTINCT patient, recording FROM w), rr AS (SELECT recording FROM (SELECT recording, count(*) OVER (PARTITION BY patient) AS n, row_number() OVER (PARTITION BY patient ORDER BY recording) - 1 AS pos FROM r) WHERE {_cap(8)}),
 v AS (SELECT * FROM w WHERE recording IN (SELECT recording FROM rr)), b AS (SELECT CAST(floor(min(n) * 1.5) AS BIGINT) AS budget FROM (SELECT count(*) AS n FROM v GROUP BY positive)),
 k AS (SELECT *, row_number() OVER (PARTITION BY positive, patient ORDER BY recording, line, part, supp) AS turn FROM v), p AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY turn, patient) AS place FROM k) SELECT recording, line, part, supp, positive FROM p, b WHERE place <= budget"""
)
def select_binary(spark, d):
    w = windows(spark, d).withColumn("at", F.struct("line", "part", "supp"))
    return curation.select_binary(w, "patient", "recording", "at", "positive").select(*KEY, "positive")


@query(
    f"""WITH {W}, {LABELLED}, f AS (SELECT *, len(list_filter(labels, lambda x: x <> 'bckg')) > 0 AS ev FROM l), q1 AS (SELECT patient, recording, line, part, supp FROM (SELECT *, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY line, part, supp) - 1 AS pos FROM f WHERE NOT ev) WHERE pos = n // 2),
 rr AS (SELECT recording FROM (SELECT recording, count(*) OVER (PARTITION BY patient) AS n, row_number() OVER (PARTITION BY patient ORDER BY recording) - 1 AS pos FROM (SELECT DISTINCT patient, recording FROM q1)) WHERE {_cap(8)}),
 k AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY recording, line, part, supp) AS turn FROM q1 WHERE recording IN (SELECT recording FROM rr)), p AS (SELECT *, row_number() OVER (ORDER BY turn, patient) AS place FROM k)
 SELECT recording, line, part, supp FROM f WHERE ev UNION ALL SELECT recording, line, part, supp FROM p WHERE place <= (SELECT floor(count(*) * 1.5) FROM f WHERE ev)"""
)
def select_multilabel(spark, d):
    w = _labelled(spark, d).withColumn("at", F.struct("line", "part", "supp"))
    return curation.select_multilabel(w, "patient", "recording", "at", "labels").select(*KEY)


@query()
def val_patients(spark, d):
    w = windows(spark, d)
    return sampling.validation_patients(w.select("patient", F.concat("dataset", F.lit("/"), "truth").alias("class")).distinct(), "patient", "class")


@query(f"WITH {W}, k AS (SELECT *, count(*) FILTER (positive) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset, positive ORDER BY {RANKED}, recording, line, part, supp) AS r FROM w) SELECT dataset, recording, line, part, supp FROM k WHERE positive OR r <= n")
def balanced_questions(spark, d):
    return curation.balanced_questions(windows(spark, d), "dataset", "positive", [F.col(k) for k in KEY]).select("dataset", *KEY)


@query(
    f"""WITH {W}, x AS (SELECT *, CASE WHEN dataset = 'BUILDING' THEN '' ELSE dataset END AS pattern, truth = 'R' OR (dataset = 'MACHINERY' AND truth = 'A') AS pos FROM w), t AS (SELECT avg(CASE WHEN pos THEN 1.0 ELSE 0.0 END) AS r FROM x), s AS (SELECT pattern, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM x GROUP BY pattern),
 l AS (SELECT pattern, p > r * (p + q) AS above, CASE WHEN p > r * (p + q) THEN round_even(q * r / (1 - r), 0) ELSE least(q, round_even(p * (1 - r) / r, 0)) END AS quota FROM s, t),
 k AS (SELECT x.*, above, quota, row_number() OVER (PARTITION BY x.pattern, pos ORDER BY {RANKED}, recording, line, part, supp) AS rk FROM x JOIN l ON x.pattern = l.pattern) SELECT pattern, recording, line, part, supp, pos FROM k WHERE pattern = '' OR above <> pos OR rk <= quota"""
)
def rate_balance(spark, d):
    x = windows(spark, d).withColumn("pattern", F.when(F.col("dataset") == "BUILDING", "").otherwise(F.col("dataset"))).withColumn("pos", (F.col("truth") == "R") | ((F.col("dataset") == "MACHINERY") & (F.col("truth") == "A")))
    return sampling.rate_balance(x, "pattern", "pos", [F.col(k) for k in KEY]).select("pattern", *KEY, "pos")


@query("WITH k AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|' || c_custkey), c_custkey) AS r FROM customer), f AS (SELECT unnest([0.25, 0.5]) AS fraction) SELECT CAST(fraction AS DOUBLE) AS fraction, c_custkey FROM k, f WHERE r <= round_even(CAST(fraction AS DOUBLE) * n, 0)")
def nested_fraction(spark, d):
    c = read(spark, d, "customer").withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.5))))
    return sampling.nested_fraction(c, ["c_mktsegment", "fraction"], [F.col("c_custkey")], F.col("fraction")).select("fraction", "c_custkey")


@query("WITH s AS (SELECT n_name AS key, count(*) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), e AS (SELECT *, 100 * size / sum(size) OVER () AS exact FROM s), r AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, key) AS rk FROM e) SELECT key, size, CAST(low + CASE WHEN rk <= 100 - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def largest_remainder(spark, d):
    s = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("size"))
    return sampling.largest_remainder(s, "size", "key", 100).select("key", "size", "quota")


@query("SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 7 AS shard FROM customer")
def shard_rows(spark, d):
    c = read(spark, d, "customer")
    return sampling.sharded(c, ["c_mktsegment"], ["c_custkey"], 7).select("c_mktsegment", "c_custkey", "shard")


@query("WITH k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS pos, greatest(count(*) OVER (PARTITION BY c_mktsegment) // 50, 1) AS step FROM customer) SELECT c_mktsegment, c_custkey FROM k WHERE pos % step = 0 AND pos // step < 50")
def systematic_sample(spark, d):
    return sampling.systematic(read(spark, d, "customer"), ["c_mktsegment"], ["c_custkey"], 50).select("c_mktsegment", "c_custkey")


@query("SELECT md5(text) AS content, count(*) AS n, count(DISTINCT source) AS owners, count(DISTINCT source) > 1 AS crosses FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    return dedup.groups(read(spark, d, "documents").withColumn("content", F.md5(F.col("text").cast("binary"))), "content", "source")


@query("SELECT o_custkey AS content, count(DISTINCT o_orderstatus) AS answers FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def conflicting_labels(spark, d):
    return dedup.conflicting(read(spark, d, "orders").withColumnRenamed("o_custkey", "content"), "content", "o_orderstatus")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first(spark, d):
    return dedup.first_of(read(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_last(spark, d):
    return dedup.last_of(read(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def later_copies(spark, d):
    return dedup.later_copies(read(spark, d, "documents"), "text", ["doc_id"]).select("doc_id")


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT md5(text) AS c, source || '/' || (doc_id % 97) AS o FROM documents), s AS (SELECT * FROM p WHERE c IN (SELECT c FROM p GROUP BY c HAVING count(*) > 1)),
 e AS (SELECT DISTINCT a.o AS x, b.o AS y FROM s a JOIN s b USING (c)), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS owner, min(y) AS canonical FROM r GROUP BY x"""
)
def patient_components(spark, d):
    t = read(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("c"), F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("o"))
    return dedup.merged_owners(t, "c", "o")


SPLITS = "s AS (SELECT doc_id, source, md5(text) AS content, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents)"


def _splits(spark, d) -> DataFrame:
    k = F.col("doc_id") % 10
    return read(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("content"), F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"))


@query(
    f"WITH {SPLITS}, k AS (SELECT DISTINCT 'content' AS key, content AS v, split FROM s UNION SELECT DISTINCT 'source', source, split FROM s) SELECT a.key AS key, a.split AS left, b.split AS right, count(*) AS n FROM k a JOIN k b ON a.key = b.key AND a.v = b.v AND a.split < b.split GROUP BY ALL"
)
def leakage_report(spark, d):
    return leakage.overlaps(_splits(spark, d), "split", {"content": "content", "source": "source"})


@query(f"WITH {SPLITS} SELECT content, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n FROM s GROUP BY content HAVING count(DISTINCT split) > 1")
def split_gate(spark, d):
    return leakage.in_several(_splits(spark, d), "split", "content")


@query(
    r"""WITH t AS (SELECT doc_id AS doc, ' ' || array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents), b AS (SELECT item_id AS item, ' ' || array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') || ' ' AS t FROM benchmark)
 SELECT doc, item FROM t JOIN b ON contains(t.t, b.t)"""
)
def benchmark_contamination(spark, d):
    return leakage.contained(read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), read(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text"))


@query(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(30), 'g'), '\n+', chr(30), 'g'), chr(30)) AS s FROM documents)
 SELECT doc_id, array_to_string(list_filter(s, lambda x: x <> '' AND NOT regexp_matches(lower(x), 'licen[sc]ed under')), ' ') AS text FROM s"""
)
def strip_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", texts.without_sentences(F.col("text"), r"licen[sc]ed under").alias("text"))


@query(r"SELECT p_partkey, regexp_replace('EEG F' || p_size || '-REF and T' || p_size || '-LE', '\b(?:EEG\s+)?([A-Za-z0-9]+)-(?:REF|LE)\b', '\1', 'g') AS channels, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def normalise_channels(spark, d):
    size = F.col("p_size").cast("string")
    return read(spark, d, "part").select("p_partkey", texts.plain_channels(F.concat(F.lit("EEG F"), size, F.lit("-REF and T"), size, F.lit("-LE"))).alias("channels"), names.slug(F.col("p_name")).alias("slug"))


STATE = """i AS (SELECT o_orderkey AS path, o_orderpriority AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, o_orderkey % 2 = 0 AS sampled, o_orderstatus <> 'P' AS labelled FROM orders),
 m AS (SELECT * FROM (VALUES ('m1', NULL), ('m2', '1-URGENT'), ('m2', '2-HIGH'), ('m3', NULL)) AS v(model, d)),
 x AS (SELECT i.*, model FROM i JOIN m ON d IS NULL OR d = dataset),
 b AS (SELECT x.*, path % 5 < 3 AS rationale, (path + length(model)) % 4 < 3 AND model <> 'm3' AS evaled, path % 4 < 2 AND model = 'm1' AS judged, path % 8 = 0 AND model = 'm1' AS judged_gpt FROM x),
 sc AS (SELECT *, CASE WHEN split = 'test' AND sampled THEN 'full' WHEN split = 'train' AND sampled AND labelled THEN 'rationale' ELSE 'none' END AS scope FROM b),
 st AS (SELECT *, CASE scope WHEN 'full' THEN rationale AND evaled AND judged AND judged_gpt WHEN 'rationale' THEN rationale ELSE true END AS done FROM sc)"""


def _state(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    images = read(spark, d, "orders").select(k.alias("path"), F.col("o_orderpriority").alias("dataset"), F.when(k % 3 == 0, "test").otherwise("train").alias("split"), (k % 2 == 0).alias("sampled"), (F.col("o_orderstatus") != "P").alias("labelled"))
    models = spark.createDataFrame([("m1", None), ("m2", ["1-URGENT", "2-HIGH"]), ("m3", None)], "model string, datasets array<string>")
    of = lambda where, *names: (images.where(where).select("path", F.explode(F.array(*map(F.lit, names))).alias("model")), ["path", "model"])
    done = {"rationale": (images.where("path % 5 < 3"), ["path"]), "evaled": of("(path + 2) % 4 < 3", "m1", "m2"), "judged": of("path % 4 < 2", "m1"), "judged_gpt": of("path % 8 = 0", "m1")}
    return state.sync(images, models, done)


@query(f"WITH {STATE} SELECT path, model, dataset, split, rationale, evaled, judged, judged_gpt, scope, done FROM st")
def state_sync(spark, d):
    return _state(spark, d).select("path", "model", "dataset", "split", "rationale", "evaled", "judged", "judged_gpt", "scope", "done")


@query(
    f"""WITH {STATE} SELECT dataset, count(DISTINCT path) AS images, count(DISTINCT CASE WHEN sampled AND split = 'test' THEN path END) AS test, count(DISTINCT CASE WHEN sampled AND split = 'train' THEN path END) AS train, count(DISTINCT CASE WHEN rationale THEN path END) AS rationales,
 count(*) FILTER (evaled) AS evaled, count(*) FILTER (judged) AS judged, count(*) FILTER (judged_gpt) AS judged_gpt, count(*) FILTER (done) AS done, count(*) AS n FROM st GROUP BY dataset"""
)
def state_summary(spark, d):
    return state.summary(_state(spark, d))


@query(f"WITH {STATE} SELECT model, dataset, count(*) AS pending FROM st WHERE NOT done GROUP BY ALL")
def pending_by_model(spark, d):
    s = _state(spark, d)
    return state.pending(s, s.where("done"), ["path", "model"]).groupBy("model", "dataset").agg(F.count("*").alias("pending"))


@query(
    """WITH f AS (SELECT user_id AS unit, event_type AS stage, 'error ' || CAST(floor(value) % 7 AS INTEGER) AS e FROM events WHERE value > 20 AND user_id % 3 <> 0), n AS (SELECT stage, e, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY n DESC, e) AS r FROM n QUALIFY r <= 3)
 SELECT stage, attempts, units, errors FROM (SELECT stage, count(*) AS attempts, count(DISTINCT unit) AS units FROM f GROUP BY stage) JOIN (SELECT stage, string_agg(n || ' x ' || e, '; ' ORDER BY r) AS errors FROM b GROUP BY stage) USING (stage)"""
)
def failure_report(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("stage"), F.concat(F.lit("error "), (F.floor("value") % 7).cast("int").cast("string")).alias("e"), "value")
    todo = e.where("unit % 3 <> 0").select("unit")
    return state.failure_report(state.open_failures(e.where("value > 20"), todo, ["unit"]), ["stage"], "unit", "e")


@query(
    """WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 AND user_id % 4 > 0 THEN 'end' ELSE 'start' END AS kind, event_id AS pos, event_type FROM events),
 t AS (SELECT user_id, max(CASE WHEN kind = 'start' THEN pos END) AS started, max(CASE WHEN kind = 'end' THEN pos END) AS ended, max_by(event_type, CASE WHEN kind = 'end' THEN pos END) AS detail FROM e GROUP BY user_id) SELECT *, started IS NOT NULL AND ended IS NULL AS open FROM t"""
)
def task_pairs(spark, d):
    e = read(spark, d, "events").select("user_id", F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 4 > 0), "end").otherwise("start").alias("kind"), F.col("event_id").alias("at"), "event_type")
    return state.tasks(e, ["user_id"], "kind", "at", "event_type")


@query(
    """WITH v AS (SELECT l_shipmode_x AS label, c AS control, x AS conclusion, y AS evidence FROM (SELECT l_returnflag AS l_shipmode_x, l_orderkey % 10 = 0 AS c, l_discount > 0.03 AS x, l_tax > 0.03 AS y FROM lineitem)), g AS (SELECT 'all' AS grp, * FROM v UNION ALL SELECT label, * FROM v)
 SELECT grp AS "group", round(avg(CASE WHEN NOT control THEN conclusion::INT END), 4) AS own_conclusion, round(avg(CASE WHEN NOT control THEN evidence::INT END), 4) AS own_evidence, round(avg(CASE WHEN NOT control THEN (conclusion AND evidence)::INT END), 4) AS own_both,
 round(avg(CASE WHEN control THEN conclusion::INT END), 4) AS control_conclusion, round(avg(CASE WHEN control THEN evidence::INT END), 4) AS control_evidence, round(avg(CASE WHEN control THEN (conclusion AND evidence)::INT END), 4) AS control_both FROM g GROUP BY grp"""
)
def judge_agreement(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_orderkey") % 10 == 0).alias("control"), (F.col("l_discount") > 0.03).alias("same_conclusion"), (F.col("l_tax") > 0.03).alias("same_evidence"))
    return judging.agreement(l, [])


@query(
    """WITH k AS (SELECT c_custkey AS key, c_mktsegment AS label, lead(c_custkey) OVER w AS nx, first_value(c_custkey) OVER w AS f, row_number() OVER w AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY md5('0|' || c_custkey), c_custkey))
 SELECT key, label, coalesce(nx, f) AS other FROM k WHERE pos <= ceil(n * 0.1) AND coalesce(nx, f) <> key"""
)
def control_pairs(spark, d):
    return judging.controls(read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label")), "key", "label")


SCORES = "s AS (SELECT p_brand AS base, p_type AS dataset, CASE WHEN p_size % 3 = 0 THEN 'zero-shot' ELSE 'tuned' END AS kind, round(max(p_retailprice), 6) AS ba FROM part GROUP BY ALL)"


def _scores(spark, d) -> DataFrame:
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("base"), F.col("p_type").alias("dataset"), F.when(F.col("p_size") % 3 == 0, "zero-shot").otherwise("tuned").alias("kind")).agg(r6(F.max("p_retailprice")).alias("ba"))


@query(f"WITH {SCORES} SELECT a.base, a.dataset, a.ba AS tuned, z.ba AS base_score, round(a.ba - z.ba, 6) AS delta FROM s a LEFT JOIN s z ON a.base = z.base AND a.dataset = z.dataset AND z.kind = 'zero-shot' WHERE a.kind = 'tuned'")
def delta_table(spark, d):
    s = _scores(spark, d).withColumnRenamed("base", "model")
    return judging.deltas(s, ["model", "dataset"], "kind", "ba").select(F.col("model").alias("base"), "dataset", "tuned", F.col("base").alias("base_score"), r6("delta").alias("delta"))


@query(f"WITH {SCORES} SELECT base, dataset, max(CASE WHEN kind = 'zero-shot' THEN ba END) AS zero_shot, max(CASE WHEN kind = 'tuned' THEN ba END) AS tuned FROM s GROUP BY ALL")
def pivot_table(spark, d):
    return judging.side_by_side(_scores(spark, d), ["base", "dataset"], "kind", "ba", ["zero-shot", "tuned"]).withColumnRenamed("zero-shot", "zero_shot")


@query("SELECT conv_id, turn, kind, CASE WHEN kind = 'messages' THEN '' ELSE '<image>' || chr(10) END || md5(text) AS asked, role AS answered, 'i' || turn || '.png' AS image, CASE WHEN kind = 'minicpm' THEN CAST(conv_id AS VARCHAR) END AS id FROM conversations, (VALUES ('sharegpt'), ('minicpm'), ('messages')) AS f(kind)")
def chat_export(spark, d):
    """Lines of the three chat formats, read back."""
    c = read(spark, d, "conversations").withColumn("asked", F.md5(F.col("text").cast("binary"))).withColumn("image", F.concat(F.lit("i"), F.col("turn").cast("string"), F.lit(".png")))
    line = lambda kind: writers.chat(F.col("asked"), F.col("role"), F.col("image"), kind, F.col("conv_id"))
    a = F.from_json(line("sharegpt"), "conversations array<struct<`from`:string,value:string>>, images array<string>")
    b = F.from_json(line("minicpm"), "id string, image string, conversations array<struct<role:string,content:string>>")
    m = F.from_json(line("messages"), "messages array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>")
    turn, part = a["conversations"], m["messages"]
    rows = F.array(
        F.struct(F.lit("sharegpt").alias("kind"), turn[0]["value"].alias("asked"), turn[1]["value"].alias("answered"), a["images"][0].alias("image"), F.lit(None).cast("string").alias("id")),
        F.struct(F.lit("minicpm").alias("kind"), b["conversations"][0]["content"].alias("asked"), b["conversations"][1]["content"].alias("answered"), b["image"].alias("image"), b["id"].alias("id")),
        F.struct(F.lit("messages").alias("kind"), part[0]["content"][1]["text"].alias("asked"), part[1]["content"][0]["text"].alias("answered"), part[0]["content"][0]["image"].alias("image"), F.lit(None).cast("string").alias("id")),
    )
    return c.select("conv_id", "turn", F.inline(rows))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN NULL ELSE event_type END AS label, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'use ```json {here}' WHEN 2 THEN repeat('x', 5000) || '"' WHEN 3 THEN 'a } b' WHEN 4 THEN 'line' || chr(10) || '```'
 WHEN 5 THEN 'no object, ' || event_type ELSE 'So {"label": "' || event_type || '", "text"' END AS rationale FROM events"""
)
def json_fields(spark, d):
    """Replies in fences, plain ones with fences and braces in strings, long and quoted strings, tails, and what can't be read."""
    k, label = F.col("event_id") % 7, F.col("event_type")
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, "use ```json {here}").when(k == 2, F.concat(F.repeat(F.lit("x"), 5000), F.lit('"'))).when(k == 3, "a } b").otherwise("line\n```")
    own = replies.target({"label": label, "text": text})
    fenced, tailed = F.concat(F.lit("Sure:\n```json\n"), own, F.lit("\n``` done {")), F.concat(F.lit('He said "so": '), own, F.lit(' and "more" {}'))
    reply = F.when(k == 0, fenced).when(k == 5, F.concat(F.lit("no object, "), label)).when(k == 6, F.concat(F.lit('So {"label": "'), label, F.lit('", "text"'))).when(k.isin(1, 4), own).otherwise(tailed)
    e = read(spark, d, "events").select("event_id", reply.alias("reply"))
    e = e.select("event_id", "reply", replies.value(F.col("reply")).alias("v"))  # each reply is read once for both fields
    return e.select("event_id", replies.fields_of(F.col("v"), {"label": "string"})["label"].alias("label"), replies.field(F.col("reply"), "text", F.col("v")).alias("rationale"))


@query(
    """WITH p AS (SELECT p_partkey, p_size AS pending, 60 + p_size * 7 AS most FROM part), m AS (SELECT *, least(greatest(ceil(most * pending / 40.0 * 2.0) + 10, 20), most) AS minutes, least(greatest(ceil(p_retail), 2), 71) AS h FROM (SELECT p.*, p_retailprice / 30 AS p_retail FROM p JOIN part USING (p_partkey)))
 SELECT p_partkey, printf('%02d:%02d:00', CAST(floor(minutes / 60) AS INTEGER), CAST(minutes % 60 AS INTEGER)) AS walltime, printf('%d-%02d:00:00', CAST(floor(h / 24) AS INTEGER), CAST(h % 24 AS INTEGER)) AS plan, CAST(h * 3600 AS BIGINT) AS seconds FROM m"""
)
def walltime_plan(spark, d):
    p = read(spark, d, "part").withColumn("configured", numbers.clock(60 + F.col("p_size") * 7))
    out = p.select("p_partkey", numbers.scaled_time(F.col("configured"), F.col("p_size"), F.lit(40)).alias("walltime"), numbers.walltime(F.col("p_retailprice") / 30).alias("plan"))
    return out.withColumn("seconds", numbers.seconds(F.col("plan")))


@query(f"WITH {STATE}, n AS (SELECT model, dataset, CAST(ceil(count(*) / 500) AS INTEGER) AS shards FROM st WHERE NOT done GROUP BY ALL) SELECT model, dataset, CAST(s AS INTEGER) AS shard, shards FROM n, range(100) AS t(s) WHERE s < shards")
def pending_shards(spark, d):
    return planning.shards(_state(spark, d).where("not done"), ["model", "dataset"], 500)


@query(
    """WITH k AS (SELECT user_id, event_id, value, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, round((s + greatest(0, 3 - pos) * f + greatest(0, pos + 2 - n) * l) / 5, 6) AS smooth FROM k"""
)
def moving_average(spark, d):
    return read(spark, d, "events").select("event_id", r6(ordered.moving_average("value", ["user_id"], ["event_id"])).alias("smooth"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 6) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return ordered.latest(read(spark, d, "events"), ["user_id"], F.col("event_id"), "event_type", "value").withColumn("value", r6("value"))


@query(
    """WITH b AS (SELECT event_id, user_id, value > 10 AS f, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM events) SELECT event_id, CASE WHEN f THEN count(*) FILTER (f) OVER (PARTITION BY user_id, block ORDER BY event_id) ELSE 0 END AS streak FROM b"""
)
def failure_streaks(spark, d):
    return ordered.streaks(read(spark, d, "events"), ["user_id"], ["event_id"], F.col("value") > 10).select("event_id", F.col("streak").cast("long").alias("streak"))


@query("WITH h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS h FROM documents) SELECT doc_id, h % 2 = 1 AS positive, round(h / 4294967295.0, 6) AS score, true AS answered FROM h")
def model_stub_scores(spark, d):
    out = clients.answered(read(spark, d, "documents"), "doc_id", "text", lambda: clients.StubClient(fails=5))
    return out.select("doc_id", "positive", r6("score").alias("score"), (F.col("error").isNull() & (F.col("attempts") <= 2)).alias("answered"))


def _stream(spark, d) -> DataFrame:
    return streams.events(spark, d, read(spark, d, "events").schema)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_tumbling(spark, d):
    out = streams.finished(streams.tumbling(_stream(spark, d), "1 day", "1 hour", ["event_type"]), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stm_sessions(spark, d):
    out = streams.finished(streams.sessions(_stream(spark, d), "6 hours", "1 hour", ["user_id"]), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stm_once(spark, d):
    return streams.finished(streams.once(_stream(spark, d), ["user_id", "event_type"], "1 hour"), "append").select("user_id", "event_type")


@query(
    """WITH b AS (SELECT user_id, ts, value > 10 AS f, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS block FROM events),
 s AS (SELECT user_id, ts, f, count(*) FILTER (f) OVER (PARTITION BY user_id, block ORDER BY ts) AS streak FROM b) SELECT user_id, ts, CAST(4 AS INTEGER) AS streak FROM s WHERE f AND streak = 4"""
)
def stm_streaks(spark, d):
    s = _stream(spark, d).withColumn("failed", F.col("value") > 10)
    return streams.finished(streams.streaks(s, "user_id", "failed", 4), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
