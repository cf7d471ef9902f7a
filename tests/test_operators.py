"""Edges: nulls, ties, empty tables, perfect and constant answers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.functions import answers, labels, names, numbers, text
from tidewell.operators import clients, curation, dedup, intervals, judging, leakage, metrics, ordered, planning, ranking, sampling, state
from tidewell.sources import readers, writers
from tidewell.streaming import streams


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 12, 40])
@pytest.mark.parametrize("cap", [None, 0, -1, 1, 2, 3, 8, 11])
def test_spread(spark, n, cap):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    got = [r["id"] for r in sampling.spread(df, ["g"], ["id"], cap).orderBy("id").collect()]
    if cap is None or cap <= 0 or cap >= n:
        want = list(range(n))
    elif cap == 1:
        want = [n // 2]
    else:
        want = sorted({round(i * (n - 1) / (cap - 1)) for i in range(cap)})
    assert got == want


def test_round_robin_takes_turns(spark):
    rows = [("k", "a", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 1), ("k", "c", 1), ("k", "c", 2)]
    df = spark.createDataFrame(rows, "by string, g string, at int")
    assert values(sampling.round_robin(df, ["by"], "g", ["at"], 4)) == [("k", "a", 1), ("k", "a", 2), ("k", "b", 1), ("k", "c", 1)]


def test_running_split_and_permutation(spark):
    rows = [(f"p{k}", k % 4 + 1) for k in range(50)]
    a = values(sampling.running_split(spark.createDataFrame(rows, "p string, n int"), "n", [F.col("p")], 0.3))
    random.Random(1).shuffle(rows)
    assert a == values(sampling.running_split(spark.createDataFrame(rows, "p string, n int").repartition(3), "n", [F.col("p")], 0.3))
    share = sum(n for _, n, s in a if s == "test") / sum(n for _, n, s in a)
    assert 0.3 <= share < 0.36


def test_nested_fractions_nest(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("s"), "id")
    few, more = (set(values(sampling.nested_fraction(df, ["s"], [F.col("id")], f))) for f in (0.2, 0.6))
    assert few < more


def test_largest_remainder_fills_seats(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 4)], "k string, n int")
    assert sum(r["quota"] for r in sampling.largest_remainder(df, "n", "k", 7).collect()) == 7


def test_validation_patients(spark):
    rows = [(f"p{k:02d}", "common") for k in range(40)] + [("p01", "rare"), ("p02", "rare"), ("p03", "single")]
    got = [r[0] for r in sampling.validation_patients(spark.createDataFrame(rows, "patient string, class string"), "patient", "class").collect()]
    assert len(got) == len(set(got)) == 10
    assert {"p01", "p02"} & set(got)


def test_pick_train_quota(spark):
    rows = [(r, k, k < e) for r, (n, e) in enumerate([(10, 0), (10, 1), (10, 7), (10, 10), (2, 1), (5, 4)]) for k in range(n)]
    got = curation.pick_train(spark.createDataFrame(rows, "r int, k int, e boolean"), ["r"], [F.col("k")], F.col("e"))
    n = {(r["r"], r["e"]): r["n"] for r in got.groupBy("r", "e").agg(F.count("*").alias("n")).collect()}
    assert n == {(0, False): 4, (1, True): 1, (1, False): 3, (2, True): 2, (2, False): 2, (3, True): 4, (4, True): 1, (4, False): 1, (5, True): 3, (5, False): 1}


def test_votes_and_ties(spark):
    df = spark.createDataFrame([("r", "b", 0), ("r", "a", 1), ("r", "a", 2), ("r", "b", 3), ("s", "a", 0)], "r string, c string, o int")
    assert values(metrics.vote(df, ["r"], "c", "o")) == [("r", "b"), ("s", "a")]


def test_perfect_constant_and_empty(spark):
    def scores(pairs):
        df = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(pairs)], "k int, t string, p string")
        long = df.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("class"), "t", "p").select("class", (F.col("t") == F.col("class")).alias("truth"), (F.col("p") == F.col("class")).alias("pred"))
        return metrics.macro(metrics.rates(metrics.confusion(long, ["class"])), [], least=1).first()

    assert scores([("a", "a"), ("b", "b")])["macro_f1"] == 1.0
    assert scores([("a", "a"), ("b", "a")])["balanced_accuracy"] == 0.5
    none = spark.createDataFrame([], "class string, truth boolean, pred boolean")
    assert metrics.macro(metrics.rates(metrics.confusion(none, ["class"])), []).first()["macro_f1"] == 0.0


def test_auroc_against_pairs(spark):
    draw = random.Random(3)
    rows = [("g", draw.randint(0, 5) / 5, draw.random() < 0.4) for _ in range(300)] + [("one", 0.5, True), ("g", float("nan"), True), ("g", None, False)]
    got = {r["g"]: r["auroc"] for r in ranking.auroc(spark.createDataFrame(rows, "g string, score double, positive boolean"), ["g"]).collect()}
    p, n = ([s for g, s, y in rows if g == "g" and s is not None and s == s and y is k] for k in (True, False))
    assert abs(got["g"] - sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))) < 1e-9
    assert got["one"] is None


def test_intervals_touching(spark):
    w = spark.createDataFrame([("r", k) for k in range(4)], "recording string, index int")
    a = spark.createDataFrame([("r", 0.0, 20.0, "x"), ("r", 39.0, 61.0, "y"), ("r", 10.0, 10.0, "z")], "recording string, start_time double, stop_time double, label string")
    got = {r["index"]: r["labels"] for r in intervals.window_labels(w, a, "recording", 20.0, "bckg").collect()}
    assert got == {0: ["x"], 1: ["y"], 2: ["y"], 3: ["y"]}
    assert intervals.window_labels(w, a.limit(0), "recording", 20.0).where(F.size("labels") == 0).count() == 4


def test_islands_text_and_members(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 5, 7, 8, 3)] + [("b", 1)], "g string, k int")
    assert values(intervals.ranges_text(intervals.islands(df, ["g"], "k"), ["g"])) == [("a", "1-3, 5, 7-8"), ("b", "1")]
    assert intervals.same_members(df.withColumn("ds", F.lit("d")), ["ds"], "g", "k").count() == 2
    s = spark.createDataFrame([("a", 0.5, 2.1), ("a", 3.0, 3.0)], "g string, a double, b double")
    assert values(intervals.seconds_touched(s, ["g"], "a", "b")) == [("a", 0), ("a", 1), ("a", 2)]


def test_inner_windows_and_halves(spark):
    df = spark.createDataFrame([("full", k) for k in range(20)] + [("part", k) for k in range(5, 17)] + [("short", k) for k in range(12)], "r string, k int")
    got = ordered.inner_windows(df, ["r"], "k")
    assert {r["r"]: r["n"] for r in got.groupBy("r").agg(F.count("*").alias("n")).collect()} == {"full": 12, "part": 12}
    assert got.where("r = 'full' and (k = 0 or k = 19)").isEmpty()
    assert ordered.one_of_each_half(df, ["r"], ["k"], ["k"]).count() == 6


def test_streaks(spark):
    df = spark.createDataFrame([("a", k, bad) for k, bad in enumerate([1, 1, 0, 1, 1, 1])], "g string, k int, f int").withColumn("f", F.col("f") == 1)
    assert [r["streak"] for r in ordered.streaks(df, ["g"], ["k"], F.col("f")).orderBy("k").collect()] == [1, 2, 0, 1, 2, 3]


def test_merged_owners_chain(spark):
    df = spark.createDataFrame([("h1", "d"), ("h1", "c"), ("h2", "c"), ("h2", "b"), ("h3", "b"), ("h3", "a"), ("h4", "z"), ("h5", "x"), ("h5", "y")], "h string, p string")
    assert values(dedup.merged_owners(df, "h", "p")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert dedup.merged_owners(df.limit(0), "h", "p").isEmpty()


def test_first_last_conflicts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 3, "a")], "k string, o int, v string")
    assert values(dedup.first_of(df, ["k"], ["o"])) == [("k", 1, "a"), ("m", 3, "a")]
    assert values(dedup.last_of(df, ["k"], [F.col("o")])) == [("k", 2, "b"), ("m", 3, "a")]
    assert values(dedup.conflicting(df, "k", "v")) == [("k", 2)]


def test_gates(spark):
    df = spark.createDataFrame([("train", "p1"), ("test", "p1"), ("val", "p2"), ("val", None)], "split string, patient string")
    report = leakage.in_several(df, "split", "patient").where("patient is not null")
    with pytest.raises(leakage.LeakageError):
        leakage.gate(report, "patients")
    assert values(leakage.overlaps(df, "split", {"patient": "patient"})) == [("patient", "test", "train", 1)]


def test_text_screens(spark):
    good = "Rhythmic sharp waves build up over the left temporal leads and then spread."
    rows = [(good, ["seiz"]), (good[:-1], []), ("a b " * 20 + ".", []), ("", ["seiz"]), (None, []), (f"I am unable to see it. {good}", ["seiz"]), (f"I am unable to see it. {good}", ["bckg"])]
    df = spark.createDataFrame(rows, "t string, l array<string>")
    assert [r["p"] for r in df.select(text.problems(F.col("t"), F.col("l")).alias("p")).collect()] == [[], ["truncated"], ["degenerate"], [], [], ["hedge"], []]
    assert one(spark, text.without_sentences(F.lit("One is. The label is seizure. Two is!\nThree"), "label")) == "One is. Two is! Three"
    assert one(spark, text.filled("See {a} and {b}", a=F.lit("x"), b=F.lit("y"))) == "See x and y"
    assert one(spark, text.renamed(F.lit("seiz and seizure"), {"seiz": "ictal"})) == "ictal and seizure"


def test_names(spark):
    path = F.lit("train/aaaa_bb_s1_12.png")
    assert one(spark, F.struct(names.patient(path), names.recording(path), names.window_index(path), names.split_of(path))) == ("aaaa_bb", "aaaa_bb_s1", 12, "train")
    assert one(spark, names.window_index(F.lit("nothing"))) is None
    assert [one(spark, names.listed(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))) for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b and c"]
    assert one(spark, names.electrode(F.lit("EEG F8-REF"))) == "F8"
    assert one(spark, names.slug(F.lit("-a b/c:1-"))) == "a-b-c-1"


def test_labels(spark):
    assert [one(spark, labels.truth(F.lit(x).cast("string"))) for x in (" TRUE ", "false", "", None, "1")] == [True, False, False, False, False]
    assert one(spark, labels.literal_set(F.lit("{'b', 'a'}"))) == ["a", "b"]
    assert one(spark, labels.literal_set(F.lit("nonsense"))) == []
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "k int, l array<string>")
    assert values(labels.wide(df, "l", ["a", "b"])) == [(1, True, False), (2, False, False)]
    assert labels.long(labels.wide(df, "l", ["a", "b"]), ["k"], ["a", "b"]).count() == 4


def test_durations(spark):
    got = [one(spark, numbers.seconds(F.lit(x))) for x in ("1-02:03:04", "02:03:04", "02:03", "5", "2-03")]
    assert got == [93784, 7384, 123, 300, 183600]
    assert one(spark, numbers.scaled_time(F.lit("03:00:00"), F.lit(0), F.lit(0))) == "00:20:00"
    assert one(spark, numbers.scaled_time(F.lit("03:00:00"), F.lit(10), F.lit(10))) == "03:00:00"
    assert one(spark, numbers.walltime(F.lit(0.1))) == "0-02:00:00"
    assert one(spark, numbers.walltime(F.lit(500.0))) == "2-23:00:00"
    assert [len(one(spark, numbers.windows_in(F.lit(x)))) for x in (5.0, 40.0, 59.9)] == [1, 2, 2]


def test_answers(spark):
    reply = F.lit('text ```json\n{"a": true, "text_rationale": "x", "n": {"k": 1}}\n``` {"a": false}')
    assert one(spark, answers.parsed(reply, {"a": "boolean", "text_rationale": "string"}))["a"] is True
    assert one(spark, answers.parsed(F.lit("none"), {"a": "boolean"})) is None
    assert one(spark, answers.field(F.lit("plain"), "text_rationale")) == "plain"
    assert one(spark, answers.target({"b": F.lit(True), "a": F.lit("x")})) == '{"b":true,"a":"x"}'


def test_state(spark):
    images = spark.createDataFrame([("a", "D", "test", True, True), ("b", "E", "train", True, False)], "path string, dataset string, split string, sampled boolean, labelled boolean")
    models = spark.createDataFrame([("m", None), ("n", ["E"])], "model string, datasets array<string>")
    none = (images.select("path").limit(0), ["path"])
    got = state.sync(images, models, dict.fromkeys(("rationale", "evaled", "judged", "judged_gpt"), none))
    assert {(r["path"], r["model"], r["scope"], r["done"]) for r in got.collect()} == {("a", "m", "full", False), ("b", "m", "none", True), ("b", "n", "none", True)}
    assert state.pending_report(got.where("not done"), got.limit(0), ["path", "model"], ["dataset"]).first()["untried"] == 1
    assert planning.shards(spark.range(3001).withColumn("g", F.lit(1)), ["g"]).count() == 3


def test_judging(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)] + [(99, "alone")], "k int, l string")
    got = judging.controls(df, "k", "l", 0.5).collect()
    assert len(got) == 20
    assert all(r["k"] != r["other"] for r in got)
    assert judging.markdown(df.limit(2), ["k", "l"], ["k"]).first()["table"].startswith("| k | l |\n|---|---|\n| 0 | a |")
    assert judging.preference_rows(spark.createDataFrame([(k, "a", "b") for k in range(50)], "k int, x string, y string"), "k", "x", "y").groupBy("a_source").count().count() == 2


def test_clients_retry(spark):
    got = clients.answered(spark.createDataFrame([(k, f"t{k}") for k in range(40)], "k int, t string"), "k", "t", lambda: clients.StubClient(fails=3)).collect()
    assert Counter(r["attempts"] for r in got)[2] > 0
    assert all(r["error"] is None for r in got)
    assert all(r["error"] == "busy" for r in clients.answered(spark.createDataFrame([(1, "x")], "k int, t string"), "k", "t", lambda: clients.StubClient(fails=1), retries=0).collect())


def test_files(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([("a", 'said "x",\nthen y', ""), ("b", None, "z")], "path string, text string, more string")
    writers.csv(df, f"{d}/csv", ["path", "text", "more"], 1)
    assert values(readers.csv(spark, f"{d}/csv", "path string, text string, more string")) == [("a", 'said "x",\nthen y', None), ("b", None, "z")]
    assert readers.csv(spark, f"{d}/nowhere", "a string").isEmpty()
    assert readers.jsonl(spark, f"{d}/nowhere", "a string").isEmpty()
    writers.append(df, f"{d}/p", ["path", "text"])
    writers.append(df, f"{d}/p", ["path", "text"])
    old = spark.read.parquet(f"{d}/p")
    writers.replace(old.distinct(), f"{d}/p")
    assert spark.read.parquet(f"{d}/p").count() == 2
    (tmp_path / "r1.csv").write_text("channel,start_time,stop_time,label\n# note\nc,1.0,2.0,seiz_slow\nc,1.0,2.0,other\n")
    assert {(r["recording"], r["label"]) for r in readers.annotations(spark, f"{d}/r1.csv", ["seiz", "slow"]).collect()} == {("r1", "seiz"), ("r1", "slow")}
    (tmp_path / "r2.rec").write_text("1,0.5,1.5,6\n1,2\n2,3,4,9\n")
    assert readers.coded_lines(spark, f"{d}/r2.rec", {"6": "bckg"}).select("label", "start_time").collect() == [("bckg", 0.5)]
    assert readers.hashes(spark, d, "*.rec").first()["md5"]
    assert readers.listing(spark, d, "*.rec").first()["length"] == 24
    a, b = (writers.fingerprint(x, ["path", "text"]).first() for x in (df, df.orderBy(F.desc("path")).repartition(3)))
    assert a == b
    assert values(writers.manifest(df.select("path"), df.select("path", F.col("more").alias("ground_truth_rationale")))) == [("a", ""), ("b", "z")]
    assert readers.registry(spark.createDataFrame([("m", "hf")], "model string, backend string"), spark.createDataFrame([("m", "x"), ("n", "y")], "model string, backend string")).where("backend = 'x'").isEmpty()


def test_stream_appends_once(spark, tmp_path):
    path, batch = str(tmp_path / "out"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    write = streams.append_once(path, ["k"])
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == 2


def test_preference_windows(spark):
    from tidewell.operators import curation
    from tidewell.operators.ranks import shuffled

    rows = [(k, k % 2 == 0, k % 3 == 0, k % 50 == 0) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, a boolean, b boolean, c boolean")
    got = [(r["question"], r["has"], r["_k0"]) for r in curation.preference_windows(df, ["a", "b", "c"], [F.col("k")]).collect()]
    order = [r["k"] for r in df.orderBy(shuffled(0, F.col("k"))).select("k").collect()]
    taken, want = set(), []
    for j, q in enumerate("abc"):
        for has in (True, False):
            own = [k for k in order if rows[k][1 + j] == has and k not in taken][:15]
            taken |= set(own)
            want += [(q, has, k) for k in own]
    assert sorted(got) == sorted(want)


def test_ranks_in_buckets(spark):
    from tidewell.operators import ranks

    df = spark.createDataFrame([(k % 3 if k % 5 else None, k, k % 7) for k in range(500)], "g int, k int, size int")
    got = ranks.by_hash(df, ["g"], [F.col("k")], size=F.col("size")).withColumn("h", ranks.shuffled(0, F.col("k"))).collect()
    for g in (0, 1, 2, None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        before = 0
        for r in own:
            assert (r["_at"], r["_n"]) == (before, sum(x["size"] for x in own))
            before += r["size"]


def test_object_text(spark):
    from tidewell.functions import answers

    replies = ['x {"a": {"b": {"c": "}"}}} y {"d": 1}', '```json\n{"a": "{ \\" }"}\n``` {', "none", '{"a": 1', 'a " b {"k": "v"} "']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(replies)], "k int, t string")
    got = {r["k"]: r["o"] for r in df.select("k", answers.object_text(F.col("t")).alias("o")).collect()}
    assert got == {0: '{"a": {"b": {"c": "}"}}}', 1: '{"a": "{ \\" }"}', 2: None, 3: None, 4: '{"k": "v"}'}


def test_replies_of_any_length(spark):
    """Long strings, many escapes, fences in strings, whole JSON that is no object; by the rules of Python's decoder."""
    import json

    from tidewell.functions import answers

    def by_hand(reply):
        try:
            got = json.loads(reply)
        except ValueError:
            bare = re.sub(r"^\s*```(?:json)?|```\s*$", "", reply.strip(), flags=re.M)
            try:
                got = json.JSONDecoder().raw_decode(bare[bare.index("{") :])[0]
            except ValueError:
                return None
        return got.get("a") if isinstance(got, dict) else None

    big = json.dumps({"a": 'x"\\' * 200_000 + "}" * 1000})
    cases = [big, f"Well,\n```json\n{big}\n```\nDone.", '{"a": "use ```json here"}', 'No: {"a": "```json"} {', '```json\n{"a": "b"}```', '"{\\"a\\": 1}"', "[1]", '{"a": "x"', '{"a": "x",} {"a": "y"}', "", "{}", '{"b": 1, "a": "\\u00e9\\n"}', 'a {"a": "\\\\"} "', "```\n```", '{"a": {"a": "in"}} {"a": "out"}']
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["k"]: r["a"] for r in df.select("k", answers.parsed(F.col("t"), {"a": "string"})["a"].alias("a")).collect()}
    for k, t in enumerate(cases):
        want = by_hand(t)
        assert got[k] == (json.dumps(want, separators=(",", ":")) if isinstance(want, dict) else want), t[:80]
    assert spark.createDataFrame([(None,)], "t string").select(answers.valid(F.col("t"), {"a": "string"})).first()[0] is False


def test_evaluation_extremes(spark):
    from tidewell.operators import metrics

    rows = [(f"r{k // 4}/{k}", f"r{k // 4}", f"p{k // 40}", ["A", "B"][k // 4 % 2]) for k in range(400)]
    scope = spark.createDataFrame(rows, "path string, recording string, patient string, t string")
    truth = scope.select("path", F.array("t").alias("truth"))
    perfect = scope.select(F.lit("perfect").alias("model"), "path", F.lit(1).alias("ord"), F.array("t").alias("pred"))
    constant = scope.select(F.lit("constant").alias("model"), "path", F.lit(1).alias("ord"), F.array(F.lit("A")).alias("pred"))
    later = perfect.select("model", "path", F.lit(2).alias("ord"), F.array(F.lit("wrong")).alias("pred"))
    out = {r["model"]: r for r in metrics.evaluate(perfect.unionByName(constant).unionByName(later), truth, scope.select("path", "recording", "patient"), ["A", "B"]).collect()}
    assert (out["perfect"]["window_balanced_accuracy"], out["perfect"]["recording_macro_f1"], out["perfect"]["coverage"]) == (1.0, 1.0, 1.0)
    assert out["constant"]["window_balanced_accuracy"] == out["constant"]["recording_balanced_accuracy"] == 0.5
    assert out["constant"]["top_answer"] == "A" and out["constant"]["degenerate"] and not out["perfect"]["degenerate"] and out["perfect"]["few_patients"]
    both = perfect.unionByName(constant)
    ci = {r["model"]: r for r in metrics.evaluate(both, truth, scope.select("path", "recording", "patient"), ["A", "B"], iterations=100).collect()}
    assert ci["perfect"]["clears_baseline"] and ci["perfect"]["recording_ci_low"] == 1.0 and not ci["constant"]["clears_baseline"]
    none = metrics.evaluate(both, truth, scope.select("path", "recording", "patient"), ["A", "B"], least=1000, iterations=50).collect()
    assert all(r["scored_classes"] == 0 and r["baseline_macro_f1"] == r["recording_macro_f1"] == 0.0 and r["recording_ci_low"] is None and r["clears_baseline"] is None for r in none)


def test_floors_of_sets(spark):
    """Three classes, each in 90 % of rows: all of them at once is the best constant answer, but one class where answers are single."""
    df = spark.createDataFrame([(f"r{k}", c, k % 10 != i) for k in range(200) for i, c in enumerate("abc")] + [(f"r{k}", "rare", k < 19) for k in range(200)], "r string, class string, holds boolean")
    floor = lambda **o: metrics.constant_floor(df.withColumn("m", F.lit(1)), ["m"], **o).first()["floor"]
    assert floor() == pytest.approx(1.8 / 1.9) and floor(binary=True) == pytest.approx(1.8 / 1.9 / 3)
    assert floor(excluded=["a", "b"], binary=True) == pytest.approx(1.8 / 1.9) and floor(least=1000) == 0.0


def evaluation(spark, rows, classes, **options):
    """rows: (recording, true labels, answered labels) of windows."""
    df = spark.createDataFrame([(f"{r}/{k}", r, f"p{r}", k, t, p) for k, (r, t, p) in enumerate(rows)], "path string, recording string, patient string, ord int, truth array<string>, pred array<string>")
    return metrics.evaluate(df.select(F.lit("m").alias("model"), "path", "ord", "pred"), df.select("path", "truth"), df.select("path", "recording", "patient"), classes, **options).first()


def test_votes_and_unions(spark):
    rows = [(f"r{k}", ["a"], p) for k in range(30) for p in (["b"], ["a"], ["a"])] + [(f"s{k}", ["b"], p) for k in range(30) for p in (["b"], ["a"])] + [("t", ["b"], []), ("t", ["b"], [])]
    voted = evaluation(spark, rows, ["a", "b"], binary=True)
    assert voted["recording_macro_f1"] == pytest.approx((1 + 2 * 30 / 61) / 2)  # ties go to the first answer; no answer is no class
    united = evaluation(spark, rows, ["a", "b"])
    assert united["recording_macro_f1"] == pytest.approx((2 * 30 / 90 + 2 * 30 / 91) / 2) and united["recordings"] == 61


def test_interval_over_scored_classes(spark):
    """A class with one recording counts in neither the figure nor its interval."""
    rows = [(f"r{k}", ["a" if k % 2 else "b"], ["b" if k == 5 else "a" if k % 2 else "b"]) for k in range(120)] + [("odd", ["c"], [])]
    out = evaluation(spark, rows, ["a", "b", "c"], iterations=400)
    assert (out["scored_classes"], out["low_support_classes"]) == (2, 1)
    assert out["recording_ci_low"] <= out["recording_macro_f1"] <= out["recording_ci_high"] and out["recording_ci_low"] > 0.9


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_multinomial_by_halving(spark, block):
    """Each replicate draws as many clusters as there are, whatever the blocks; means and variances are the multinomial's."""
    from tidewell.operators import bootstrap

    df = spark.createDataFrame([(k % 2, 1, int(k == 1), k % 10) for k in range(600)], "g int, one int, single int, ten int")
    again = bootstrap.resampled(df, ["g"], ["one", "single", "ten"], 2000, block=block).collect()
    assert len(again) == 4000 and all(r["one"] == 300 for r in again)
    single = [r["single"] for r in again if r["g"] == 1]
    mean = sum(single) / 2000
    assert abs(mean - 1) < 0.1 and abs(sum((x - mean) ** 2 for x in single) / 2000 - (1 - 1 / 300)) < 0.2
    ten = [r["ten"] for r in again if r["g"] == 0]  # 0, 2, 4, 6, 8 in equal parts: variance 8 a draw
    assert abs(sum(ten) / 2000 - 1200) < 6 and abs(sum((x - 1200) ** 2 for x in ten) / 2000 / (300 * 8) - 1) < 0.15


def test_draws_of_blocks_sum_up():
    from tidewell.operators import bootstrap

    for total, size in ((1, 4), (10, 4), (1000, 7), (64, 64)):
        every = sum(bootstrap.draws_of(total, b, size, 50, [3]) for b in range(-(-total // size)))
        assert every.tolist() == [total] * 50


def test_weights_are_the_portable_ones(spark):
    from tidewell.operators import bootstrap

    df = spark.createDataFrame([(g, c, s, c % 3, 1) for g in ("x", None) for c in range(40) for s in (0.1, 0.2)], "g string, c int, s double, a int, b int")
    got = {(r["g"], r["s"], r["replicate"]): (r["a"], r["b"]) for r in bootstrap.weighted(df, "c", ["g", "s"], ["a", "b"], 10).collect()}
    w = {c: bootstrap.weights_of(str(c), 10) for c in range(40)}
    for g in ("x", None):
        for s in (0.1, 0.2):
            for r in range(10):
                assert got[g, s, r] == (sum(c % 3 * w[c][r] for c in range(40)), sum(w[c][r] for c in range(40)))


@pytest.mark.parametrize("kind", ["narrow", "logits", "turns"])
def test_ranges_are_even(spark, kind):
    from tidewell.operators import ranks

    n = 40_000
    draw = random.Random(kind)
    rows = {"narrow": lambda k: (draw.random() * 0.0002, k), "logits": lambda k: (draw.gauss(0, 30), k), "turns": lambda k: (1.0, k)}[kind]
    df = spark.createDataFrame([(0, *rows(k)) for k in range(n)], "g int, x double, k int").repartition(8)
    sizes = [r["count"] for r in ranks.ranged(df, ["g"], ["x", "k"], 16).groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16
    got = {r["k"]: r["_at"] for r in ranks.evenly(df, ["g"], ["x", "k"], parts=16).collect()}
    want = sorted((r["x"], r["k"]) for r in df.collect())
    assert [got[k] for _, k in want] == list(range(n))


def test_scan_indexes(spark):
    got = {r["n"]: r["x"] for r in spark.range(0, 80).select(F.col("id").cast("int").alias("n"), numbers.scan_indexes(F.col("id").cast("int")).alias("x")).collect()}
    for n in range(80):
        assert got[n] == (list(range(n)) if n <= 26 else sorted({round(1 + k * (n - 3) / 23) for k in range(24)})), n


def test_leaks_against_tests(spark):
    rows = [("A", "train", "p1", "t1", "r1", "i1"), ("A", "val", "p1", "t2", "r2", "i2"), ("A", "val", "p3", "t3", "r3", "i9"), ("A", "test", "p4", "t4", "r4", "i4"), ("B", "test", "p3", "t5", "r5", "i9"), ("B", "train", "p4", "t6", "r6", None)]
    df = spark.createDataFrame(rows, "dataset string, split string, patient string, token string, recording string, image string")
    assert values(leakage.with_tests(df)) == [("A", "patient", 1), ("A", "test image", 1), ("A", "test patient", 1), ("B", "test patient", 1)]
    assert values(leakage.with_tests(df, everywhere=False)) == [("A", "patient", 1), ("A", "test image", 1)]


def test_proportional(spark):
    df = spark.createDataFrame([(k, "a" if k < 70 else "b" if k < 95 else None) for k in range(100)], "k int, s string")
    assert Counter(r["s"] for r in sampling.proportional(df, "s", [F.col("k")], 20).collect()) == {"a": 14, "b": 5, None: 1}
    assert sampling.proportional(df, "s", [F.col("k")], 500).count() == 100 and sampling.proportional(df.limit(0), "s", [F.col("k")], 5).isEmpty()


def test_builds_stop_at_their_gates(spark):
    rows = spark.createDataFrame([(1, "train", "x", "", True), (2, "val", "y", "", False), (3, "test", "z", "", True)], "k int, split string, c string, pattern string, pos boolean")
    none = spark.createDataFrame([], "k int")
    build = lambda df, listed: curation.core_build(df, listed, "k", "split", "c", "pattern", "pos", [F.col("k")])
    assert values(build(rows, none).select("k")) == [(1,), (2,), (3,)]
    with pytest.raises(leakage.LeakageError):
        build(rows.unionByName(rows.limit(0)).withColumn("c", F.when(F.col("k") == 2, "z").otherwise(F.col("c"))), none)
    with pytest.raises(leakage.LeakageError):
        build(rows, spark.createDataFrame([(3,)], "k int"))
    answers_ = spark.createDataFrame([("m", "p1", "a", "b", "A"), ("m", "p2", "a", "b", "tie"), ("n", "p9", "a", "b", "B"), ("m", "p3", "a", "b", "B")], "model string, path string, rationale_a string, rationale_b string, preference string")
    training = spark.createDataFrame([("p1",), ("p3",)], "path string")
    assert values(curation.preference_pairs(answers_, training, "m")) == [("p1", "a", "b"), ("p3", "b", "a")]
    with pytest.raises(leakage.LeakageError):
        curation.preference_pairs(answers_, training, "n")


def test_many_models(spark):
    """Registries beyond the plan's own literals are joined, with the same rows."""
    images = spark.createDataFrame([(k, "d" if k % 2 else None if k % 3 else "e") for k in range(12)], "path int, dataset string")
    rows = [(f"m{k}", None if k % 5 == 0 else ["d"] if k % 2 else ["e", "e"]) for k in range(40)]
    models = spark.createDataFrame(rows, "model string, datasets array<string>")
    few = values(state.expanded(images, models).select("path", "model"))
    most, state.FEW_MODELS = state.FEW_MODELS, 10
    try:
        many = values(state.expanded(images, models).select("path", "model"))
    finally:
        state.FEW_MODELS = most
    open_to_all = {m for m, ds in rows if ds is None}
    want = sorted((r["path"], m) for r in images.collect() for m, ds in rows if m in open_to_all or r["dataset"] in (ds or []))
    assert many == want and few == sorted({*want})


def test_codes_in_brackets_and_quotes(spark):
    cases = {'the (fnsz) run': "the run", 'a "FNSZ" here': "a focal seizure here", r'b \"fnsz\" c': "b focal seizure c", "( \"gnsz\" )x": "x", "fnsz, fnszs": "focal seizure, fnszs", "  two   gaps ": "two gaps"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", text.renamed(F.col("t"), {"fnsz": "focal seizure", "gnsz": "generalized seizure"}).alias("x")).collect()}
    assert got == cases


def test_dealt_parts_follow_the_rows(spark):
    from tidewell.operators import ranks

    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert ranks.dealt(df, ["k"], 100 * ranks.ROWS).rdd.getNumPartitions() == 100
    assert ranks.dealt(df, ["k"], ranks.ROWS).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_orders_are_dealt_by_patient(spark, monkeypatch):
    """Parts of orders that meet customers follow the orders, too, not the session's partitions."""
    from tidewell.operators import ranks
    from tidewell.plans.catalogue import windows

    monkeypatch.setattr(ranks, "ROWS", 50)
    d = "/root/testdata/sf0.001"
    n = -(-spark.read.parquet(f"{d}/orders.parquet").count() // 50)
    plan = windows(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[o_custkey#\d+L?\], {n}\b", plan), plan


def test_background_windows_move_once(spark):
    """Windows that lie by recording stay there; scored ones leave, but for keys with a null, which are nobody's."""
    rows = [(r, i, i == 3) for r in (1, 2, None) for i in range(12)]
    df = spark.createDataFrame(rows, "rec int, idx int, pos boolean").repartition(7, "rec")
    out = curation.background_windows(df, df.where("idx NOT IN (5, 9)"), ["rec"], ["rec", "idx"], "idx", "pos")
    assert "Exchange hashpartitioning(rec" in (plan := out._jdf.queryExecution().executedPlan().toString()) and not re.search(r"Exchange hashpartitioning\(rec#\d+, idx", plan)
    got = sorted(((r["rec"], r["idx"], r["distance"]) for r in out.collect()), key=str)
    assert [g for g in got if g[0]] == [(1, 5, 2), (1, 9, 6), (2, 5, 2), (2, 9, 6)]
    quiet = [g for g in got if g[0] is None]
    assert len(quiet) == 2 and all(d == abs(i - 3) and 0 < i < 11 and i != 3 for _, i, d in quiet)


def test_a_long_table_of_answers_is_several_files_in_order(spark, tmp_path, monkeypatch):
    """No task sorts a whole name; lines keep their order over the files, and the first of a key still counts."""
    from tidewell.operators import ranks

    monkeypatch.setattr(ranks, "ROWS", 50)
    rows = [(f"eval-{i % 2}", i % 70, 1 + i % 3, f'{999 - i:03d}, "x"') for i in range(600)]
    df = spark.createDataFrame(rows, "name string, path long, model int, answer string")
    writers.numbered_files(df, f"{tmp_path}/parts", "name", ["answer", "path"], ["path", "model", "answer"], f"{tmp_path}/files", len(rows))
    files = {n: sorted((tmp_path / "files").glob(f"{n}-*.csv")) for n in ("eval-0", "eval-1")}
    assert all(len(own) > 3 for own in files.values())
    heads = {f.read_text().splitlines()[0] for own in files.values() for f in own}
    assert heads == {"path,model,answer"}
    for name, own in files.items():
        lines = [line.split(",", 2)[2] for f in own for line in f.read_text().splitlines()[1:]]
        assert len(lines) == 300 and lines == sorted(lines), name
    want = {}
    for name, path, model, answer in sorted(rows, key=lambda r: (r[0], r[3])):
        want.setdefault((path, model), answer)
    got = readers.first_rows(spark, f"{tmp_path}/files/eval-*.csv", "path bigint, model int, answer string", ["path", "model"], len(rows))
    assert values(got) == sorted((*k, v) for k, v in want.items())
    assert got.rdd.getNumPartitions() == 12


def test_answers_move_once_and_ties_go_to_the_first_path(spark):
    from tidewell.operators import ranks

    rows = [("m", "b", 1, ["B"]), ("m", "a", 1, ["A"]), ("m", "a", 2, ["B"]), ("m", "x", 0, ["B"])]
    answers = spark.createDataFrame(rows, "model string, path string, ord int, pred array<string>")
    scope = spark.createDataFrame([("a", "r", "p", ["A"]), ("b", "r", "p", ["A"])], "path string, recording string, patient string, truth array<string>")
    few, ranks.FEW = ranks.FEW, 0  # as of a large table
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        firsts = metrics.first_answers(answers, None, scope, 4)
        plan = firsts._jdf.queryExecution().executedPlan().toString()
        out = metrics.evaluate(answers, None, scope, ["A", "B"], binary=True, rows=4).first()
    finally:
        ranks.FEW = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("Exchange hashpartitioning") == 2  # answers and scope
    assert sorted((r["path"], r["ord"]) for r in firsts.collect()) == [("a", 1), ("b", 1)]
    assert (out["windows"], out["top_answer"], out["coverage"]) == (2, "A", 1.0)


def test_first_by_hash_is_the_begin_of_by_hash(spark):
    from tidewell.operators import ranks

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), "id")
    want = ranks.by_hash(df, ["g"], [F.col("id")], 1).where("_at < 20").select("g", "id", "_at").collect()
    first = ranks.first_by_hash(df, ["g"], [F.col("id")], 20, 1).select("g", "id", "_at")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 3  # counts twice, and the few
    assert sorted(map(str, map(tuple, first.collect()))) == sorted(map(str, map(tuple, want))) and len(want) == 60


def test_new_windows_move_once(spark):
    from tidewell.operators import ranks

    new = spark.range(20).select((F.col("id") % 2).alias("arm"), (F.col("id") % 7).cast("string").alias("path"), F.lit(0.5).alias("score"), F.col("id").alias("at"))
    meta = spark.range(5).select(F.col("id").cast("string").alias("path"), F.lit(True).alias("quiet"), F.lit(None).cast("long").alias("distance"))
    scored = spark.range(6).select((F.col("id") % 2).alias("arm"), F.col("id").cast("string").alias("path"), (F.col("id") / 10).alias("score"), (F.col("id") > 2).alias("positive"))
    want = values(ranking.background_figures(scored, new, meta, ["arm"]))
    few, ranks.FEW = ranks.FEW, 0  # as of a large table
    try:
        out = ranking.background_figures(scored, new, meta, ["arm"], rows=20)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert values(out) == want
    finally:
        ranks.FEW = few
    assert re.search(r"hashpartitioning\(path#\d+, \d+\), REPARTITION_BY_NUM", plan) and not re.search(r"hashpartitioning\(arm#\d+L, path", plan)


def test_coverage_deals_scope_and_done_alike(spark):
    from tidewell.operators import ranks

    scope = spark.range(40).select((F.col("id") % 3).alias("g"), "id")
    done = scope.where("id % 4 = 0").union(scope.where("id % 8 = 0"))
    want = values(metrics.coverage(scope, done, ["id"], ["g"]))
    few, ranks.FEW = ranks.FEW, 0  # as of a large table
    try:
        out = metrics.coverage(scope, done, ["id"], ["g"], rows=40)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert values(out) == want and sum(r[1] for r in want) == 10
    finally:
        ranks.FEW = few
    assert len(re.findall(r"hashpartitioning\(id#\d+L, \d+\), REPARTITION_BY_NUM", plan)) == 2


def test_weights_are_drawn_once_a_cluster(spark):
    import numpy as np
    from hashlib import md5

    from tidewell.operators import bootstrap

    df = spark.range(40).select((F.col("id") % 5).alias("c"), (F.col("id") % 7).alias("s"), F.lit(1).alias("a"))
    plan = bootstrap.weighted(df, "c", ["s"], ["a"], 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[_cluster#\d+ ASC", plan) and re.search(r"hashpartitioning\(_cluster#\d+, \d+\)", plan)
    fractions = [int.from_bytes(md5(b"7:%d" % (k // 4)).digest()[k % 4 * 4 :][:4], "big") / 4294967296 for k in range(10)]
    assert bootstrap.drawn_for(["x", "7"], 10)[1].tolist() == np.searchsorted(bootstrap.POISSON, fractions, side="right").tolist()
    assert bootstrap.drawn_for([], 10).shape == (0, 10)


def test_windows_move_line_items_once(spark):
    from tidewell.operators import ranks
    from tidewell.plans import catalogue

    few, ranks.FEW = ranks.FEW, 0  # as of a large table
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalogue.majority_vote(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        ranks.FEW = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4  # orders twice, customers and line items once


def test_spread_by_caps_is_spread_for_each(spark):
    df = spark.range(40).select((F.col("id") % 7 % 4).alias("g"), "id")
    caps = [0, 1, 2, 3, 8, None]
    want = [(c, *r) for c in caps for r in sampling.spread(df, ["g"], ["id"], c).collect()]
    got = sampling.spread_by_caps(df, ["g"], ["id"], caps).select("cap", "g", "id")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_reply_is_read_once(spark):
    from tidewell.plans import catalogue

    plan = catalogue.json_fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
