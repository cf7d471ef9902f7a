"""Which windows are kept for training and testing, and why others aren't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import problems
from tidewell.operators.ranks import by_hash, first_by_hash, matched, shuffled
from tidewell.operators.sampling import round_robin, spread

BACKGROUND = ["bckg"]


def pick_train(df: DataFrame, by: list[str], key: list[Column], event: Column, windows: int = 4, seed=0) -> DataFrame:
    """At most `windows` rows of each recording: up to half events, then background, then events again for what is missing; by hash rank."""
    w = Window.partitionBy(*by)
    out = df.withColumn("_e", event)
    out = out.withColumn("_ne", F.count_if("_e").over(w)).withColumn("_nb", F.count_if(~F.col("_e")).over(w))
    out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_e").orderBy(shuffled(seed, *key), *key)))
    first = F.least(F.lit(windows // 2), F.col("_ne"))
    quiet = F.least(windows - first, F.col("_nb"))
    loud = F.least(F.col("_ne"), windows - quiet)
    return out.where(F.col("_rank") <= F.when(F.col("_e"), loud).otherwise(quiet)).drop("_e", "_ne", "_nb", "_rank")


def pick_test(df: DataFrame, by: list[str], order: list, event: Column, windows: int = 10) -> DataFrame:
    """All events and `windows` evenly spaced rows of each recording."""
    own = Window.partitionBy(*by)
    ranked = df.withColumn("_n", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy(*order)) - 1)
    from tidewell.functions.numbers import spaced

    even = (F.col("_n") <= windows) | F.array_contains(spaced(F.col("_n"), F.lit(windows)), F.col("_at"))
    return ranked.where(event | even).drop("_n", "_at")


def abundant(df: DataFrame, labels: str, recording: str, threshold: int) -> DataFrame:
    """Classes that at least so many recordings have."""
    return df.select(recording, F.explode(labels).alias("class")).groupBy("class").agg(F.count_distinct(recording).alias("n")).where(F.col("n") >= threshold).select("class")


def test_select_binary(df: DataFrame, labels: str, patient: str, recording: str, window: str, per_recording: int = 4, recordings: int | None = None) -> DataFrame:
    """Labelled windows, evenly spaced in each recording; with `recordings` only so many evenly spaced recordings of each patient, in the order of their names as text."""
    rows = df.where(F.size(labels) > 0)
    if recordings:
        kept = spread(rows.select(patient, recording).distinct(), [patient], [recording], recordings)
        rows = rows.join(kept, [patient, recording], "left_semi")
    return spread(rows, [recording], [window], per_recording)


def test_select(df: DataFrame, labels: str, recording: str, window: str, threshold: int = 200, signature: int = 3, quiet: int = 2) -> DataFrame:
    """Of each recording and exact label set: all windows if a rare class is in it, `quiet` evenly spaced ones of pure background, `signature` of others."""
    rows = df.where(F.size(labels) > 0)
    common = abundant(rows, labels, recording, threshold).agg(F.collect_set("class").alias("_common"))  # one row; a name for each class at most
    tagged = rows.join(F.broadcast(common), how="cross")
    foreground = F.array_except(labels, F.array(*map(F.lit, BACKGROUND)))
    rare = F.size(F.array_except(foreground, F.col("_common"))) > 0
    cap = F.when(rare, F.lit(None).cast("int")).when(F.size(foreground) == 0, quiet).otherwise(signature)
    return spread(tagged.withColumn("_set", F.array_join(labels, "+")).withColumn("_cap", cap), [recording, "_set"], [window], F.col("_cap")).drop("_common", "_set", "_cap")


def train_screen(df: DataFrame, key: str, patient: str, content: str, labels: str, text: str, test_patients: DataFrame, test_contents: DataFrame) -> DataFrame:
    """df with reasons: why a row can't be trained on, empty for those that can.

    The first that holds: unlabelled, test patient, test duplicate, conflict (the same content with other labels, over all rows);
    else what is wrong with the text, and duplicate text for all but the first of the rows that came so far.
    """
    answers = df.groupBy(content).agg((F.count_distinct(labels) > 1).alias("_conflict"))
    out = df.join(answers, content, "left")
    out = out.join(test_patients.select(F.col(test_patients.columns[0]).alias(patient)).distinct().withColumn("_patient", F.lit(True)), patient, "left")
    out = out.join(test_contents.select(F.col(test_contents.columns[0]).alias(content)).distinct().withColumn("_test", F.lit(True)), content, "left")
    first = F.when(F.size(labels) == 0, "unlabelled").when(F.col("_patient"), "test patient").when(F.col("_test"), "test duplicate").when(F.col("_conflict"), "conflict")
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    again = F.row_number().over(Window.partitionBy(text, (F.col("_first").isNull() & ~blank).alias("_in")).orderBy(key)) > 1
    out = out.withColumn("_first", first).withColumn("_again", again & F.col("_first").isNull() & ~blank)
    wrong = F.concat(problems(F.col(text), F.col(labels)), F.when(F.col("_again"), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("reasons", F.when(F.col("_first").isNotNull(), F.array("_first")).otherwise(wrong)).drop("_conflict", "_patient", "_test", "_first", "_again")


def reasons(screened: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """reason, n and the first keys as examples; the unlabelled aren't told."""
    each = screened.select(key, F.explode("reasons").alias("reason")).where("reason <> 'unlabelled'")
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(key))
    few = each.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
    return each.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")


def select_binary(df: DataFrame, patient: str, recording: str, window: str, cls: str, recordings: int = 8, ratio: float = 1.5) -> DataFrame:
    """All windows of evenly spaced recordings; each class gets at most ratio times the smallest class, patients in turn."""
    kept = spread(df.select(patient, recording).distinct(), [patient], [recording], recordings)
    rows = df.join(kept, [patient, recording], "left_semi")
    sizes = rows.groupBy(cls).agg(F.count("*").alias("n"))
    budget = sizes.agg(F.when(F.count("*") >= 2, F.floor(F.min("n") * ratio)).otherwise(F.max("n")).alias("_budget"))  # one row
    return round_robin(rows.join(F.broadcast(budget), how="cross"), [cls], patient, [recording, window], "_budget").drop("_budget")


def select_multilabel(df: DataFrame, patient: str, recording: str, window: str, labels: str, recordings: int = 8, quiet: int = 1, ratio: float = 1.5) -> DataFrame:
    """All windows with events, and of the quiet ones at most ratio times as many, spread over recordings, patients in turn."""
    foreground = F.size(F.array_except(labels, F.array(*map(F.lit, BACKGROUND)))) > 0
    events, rest = df.where(foreground), df.where(~foreground)
    few = spread(rest, [recording], [window], quiet)
    kept = spread(few.select(patient, recording).distinct(), [patient], [recording], recordings)
    few = few.join(kept, [patient, recording], "left_semi")
    n = events.agg(F.count("*").alias("n"))
    budget = n.select(F.when(F.col("n") > 0, F.floor(F.col("n") * ratio)).otherwise(F.lit(2**62)).alias("_budget"))  # one row
    picked = round_robin(few.join(F.broadcast(budget), how="cross"), [], patient, [recording, window], "_budget").drop("_budget")
    return events.unionByName(picked)


def balanced_questions(df: DataFrame, question: str, positive: str, key: list[Column], seed=0) -> DataFrame:
    """As many negatives as positives of each question, by hash rank."""
    n = df.groupBy(question).agg(F.count_if(positive).alias("_positives"))
    ranked = by_hash(matched(df, n, [question]), [question, positive], key, seed)
    return ranked.where(F.col(positive) | (F.col("_at") < F.col("_positives"))).drop("_n", "_at", "_positives")


def halved_negatives(df: DataFrame, question: str, positive: str, other: str, key: list[Column], seed=0) -> DataFrame:
    """All positives of each question and as many negatives, half of them rows of another kind (`other` holds) and half calm ones, by hash rank; where one half is short, the other fills up."""
    sides = df.withColumn("_side", F.when(F.col(positive), "p").when(F.col(other), "o").otherwise("c"))
    n = sides.groupBy(question).agg(*(F.count_if(F.col("_side") == k).alias(f"_{k}s") for k in "poc"))
    ranked = by_hash(matched(sides, n, [question]), [question, "_side"], key, seed)
    want, o, c = F.col("_ps"), F.col("_os"), F.col("_cs")
    half = F.floor(want / 2)
    others = F.least(o, F.greatest(half, want - c))
    quota = F.when(F.col("_side") == "o", others).otherwise(want - others)
    return ranked.where(F.col(positive) | (F.col("_at") < quota)).drop("_side", "_n", "_at", "_ps", "_os", "_cs")


def preference_windows(df: DataFrame, questions: list[str], key: list[Column], most: int = 30, seed=0) -> DataFrame:
    """question and the key's columns: for each question, in turn, most / 2 rows that have it and most / 2 that don't, by hash rank, none that an earlier question took.

    A question can only lose a row to an earlier one, so the first most * (number of questions) ranks of each side hold all that it
    may take; those few are dealt in turn on the driver.
    """
    names = [f"_k{i}" for i in range(len(key))]
    each = df.select(*(k.alias(n) for k, n in zip(key, names, strict=True)), F.explode(F.array(*(F.struct(F.lit(q).alias("question"), F.col(q).alias("has")) for q in questions))).alias("_q"))
    each = each.select(*names, "_q.question", "_q.has")
    ranked = first_by_hash(each, ["question", "has"], [F.col(n) for n in names], most * len(questions), seed)
    rows = sorted(ranked.select(*names, "question", "has", "_at").collect(), key=lambda r: (questions.index(r["question"]), not r["has"], r["_at"]))
    taken, left, out = set(), {}, []
    for r in rows:
        k, side = tuple(r[n] for n in names), (r["question"], r["has"])
        if k not in taken and left.get(side, 0) < most // 2:
            taken.add(k)
            left[side] = left.get(side, 0) + 1
            out.append((r["question"], r["has"], *k))
    schema = "question string, has boolean, " + ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in names)
    return df.sparkSession.createDataFrame(out, schema)


def background_windows(df: DataFrame, scored: DataFrame, by: list[str], key: list[str], at: str, event: str, seed=0) -> DataFrame:
    """Quiet windows that were never scored, not the first or last of their recording: at most one from each half of what is left, by hash; with the distance to the nearest event, null without one."""
    from tidewell.operators.intervals import nearest_event
    from tidewell.operators.ordered import one_of_each_half

    w = Window.partitionBy(*by)
    inner = df.withColumn("_low", F.min(at).over(w)).withColumn("_high", F.max(at).over(w))
    near = nearest_event(inner, by, at, F.col(event)).where(~F.col(event) & (F.col(at) > F.col("_low")) & (F.col(at) < F.col("_high"))).drop("_low", "_high")
    # scored ones lie beside the others of their recording: a join by key would move all windows again
    both = near.withColumn("_scored", F.lit(False)).unionByName(scored.select(*key, F.lit(True).alias("_scored")), allowMissingColumns=True)
    seen = F.bool_or("_scored").over(Window.partitionBy(*key)) & ~F.array_contains(F.array(*(F.col(k).isNull() for k in key)), True)
    left = both.withColumn("_seen", seen).where(~F.col("_scored") & ~F.col("_seen")).drop("_scored", "_seen")
    return one_of_each_half(left.withColumn("_hash", shuffled(seed, *(F.col(k) for k in key))), by, [at, *key], ["_hash", *key]).drop("_hash")


def held_out(every: DataFrame, used: DataFrame, patient: str) -> DataFrame:
    """Rows of the patients that no split has used."""
    return every.join(used.select(patient).distinct(), patient, "left_anti")


def extended(first: DataFrame, more: DataFrame, by: list[str], key: list[Column], n: str, seed=0) -> DataFrame:
    """first, and rows of more up to `n` (a column of first and more) for each group: those that were shipped come first, then the others in hash order."""
    names = [c for c in first.columns if c != "_rest"]
    both = first.withColumn("_rest", F.lit(False)).unionByName(more.select(*names).withColumn("_rest", F.lit(True)))
    counts = first.groupBy(*by).agg(F.count("*").alias("_first"))
    ranked = by_hash(matched(both, counts, by, "left"), [*by, "_rest"], key, seed)
    return ranked.where(~F.col("_rest") | (F.col("_at") + F.coalesce("_first", F.lit(0)) < F.col(n))).drop("_rest", "_n", "_at", "_first")


def merged_lines(parts: list[DataFrame], key: list[str], flag: str) -> DataFrame:
    """One line for each window and question of several lists; the flag holds if it holds in any list."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(*key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias(flag), F.count("*").alias("lists"))


def described(df: DataFrame, patient: str, labels: str) -> DataFrame:
    """rows, patients, the most rows of a patient, and counts by class as 'class=n' in order."""
    each = df.groupBy(patient).agg(F.count("*").alias("n"))
    whole = each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("patients"), F.max("n").alias("most"))
    by_class = df.select(F.explode(labels).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    text = by_class.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "c", F.col("n").cast("string")))), ",").alias("classes"))  # a row a class
    return whole.join(F.broadcast(text), how="cross")  # one row each


def core_build(rows: DataFrame, listed: DataFrame, key: str, split: str, content: str, pattern: str, positive: str, order: list[Column]) -> DataFrame:
    """The training build: rows without the listed ones, then a gate, then each of train and val balanced within its patterns; test as it is.

    listed may only name train and val rows. The gate fails if train or val share content with test.
    """
    from tidewell.operators import leakage
    from tidewell.operators.sampling import rate_balance

    leakage.gate(rows.join(listed, key, "left_semi").where(~F.col(split).isin("train", "val")).select(key, split), "listed rows that are not train or val")
    left = rows.join(listed, key, "left_anti")
    test = left.where(F.col(split) == "test").select(content).distinct()
    leakage.gate(left.where(F.col(split) != "test").join(test, content, "left_semi").select(key, split), "content of test")
    out = left.where(F.col(split) == "test")
    for part in ("train", "val"):
        out = out.unionByName(rate_balance(left.where(F.col(split) == part), pattern, positive, order).select(left.columns))
    return out


def window_questions(windows: DataFrame, annotations: DataFrame, key: str, length: float, questions: list[str], pattern: str, order: list[Column]) -> DataFrame:
    """question, and the windows that any annotation touches, with present: whether one of the question's label does; each question balanced within the patterns.

    windows: key, index, pattern; annotations: key, start_time, stop_time, label.
    """
    from tidewell.operators.intervals import window_labels
    from tidewell.operators.sampling import rate_balance

    touched = window_labels(windows, annotations, key, length).where(F.size("labels") > 0)
    each = [rate_balance(touched.withColumn("present", F.array_contains("labels", q)), pattern, "present", order).select(F.lit(q).alias("question"), key, "index", "present") for q in questions]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def preference_pairs(answers: DataFrame, training: DataFrame, model: str) -> DataFrame:
    """path, chosen, rejected of a model's answers with a preference for A or B; a gate fails on pairs that aren't training windows.

    answers: model, path, rationale_a, rationale_b, preference; training: path.
    """
    from tidewell.operators import leakage

    own = answers.where((F.col("model") == model) & F.col("preference").isin("A", "B"))
    first = F.col("preference") == "A"
    pairs = own.select("path", F.when(first, F.col("rationale_a")).otherwise(F.col("rationale_b")).alias("chosen"), F.when(first, F.col("rationale_b")).otherwise(F.col("rationale_a")).alias("rejected"))
    leakage.gate(pairs.select("path").join(training.select("path"), "path", "left_anti"), "pairs that are not training windows")
    return pairs
