"""Scores of label sets: confusion counts, precision and recall, votes, floors.

Rows are windows or recordings with a key, a class, and whether truth and prediction have it; one long row each, so that any
number of classes is one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.labels import shown
from tidewell.functions.numbers import divide
from tidewell.operators.ranks import dealt
from tidewell.sources.folders import saved

MIN_SUPPORT, MIN_PATIENTS, DEGENERATE = 20, 20, 0.95


def confusion(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn for each group of by."""
    t, p = F.col(truth), F.col(pred)
    count = lambda c, n: F.count_if(c).alias(n)
    return df.groupBy(*by).agg(count(t & p, "tp"), count(~t & p, "fp"), count(t & ~p, "fn"), count(~t & ~p, "tn"))


def rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, specificity, f1 (each 0.0 where nothing is divided) and support."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", divide(tp, tp + fp).alias("precision"), divide(tp, tp + fn).alias("recall"), divide(tn, tn + fp).alias("specificity"), divide(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def macro(scored: DataFrame, by: list[str], least: int = MIN_SUPPORT, excluded: list[str] | None = None, cls: str = "class") -> DataFrame:
    """macro_f1 and balanced_accuracy over the classes with enough support; 0.0 if there is none."""
    kept = (F.col("support") >= least) & (~F.col(cls).isin(excluded) if excluded else F.lit(True))
    mean = lambda c: F.coalesce(F.avg(F.when(kept, c)), F.lit(0.0))
    return scored.groupBy(*by).agg(mean(F.col("f1")).alias("macro_f1"), mean((F.col("recall") + F.col("specificity")) / 2).alias("balanced_accuracy"), F.count_if(kept).alias("scored_classes"), F.count_if(~kept).alias("low_support_classes"))


def vote(df: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """The commonest answer of each group; of equally common ones the one that came first."""
    each = df.groupBy(*by, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return each.groupBy(*by).agg(F.min_by(answer, F.struct(-F.col("n"), F.col("first"))).alias(answer))


def union_of_sets(df: DataFrame, by: list[str], labels: str) -> DataFrame:
    """All labels that some row of the group has."""
    each = df.select(*by, F.explode_outer(labels).alias("l")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("l")).alias(labels))


def any_positive(df: DataFrame, by: list[str], *flags: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.bool_or(f).alias(f) for f in flags))


def answers(df: DataFrame, by: list[str], labels: Column, order: str) -> DataFrame:
    """distinct_answers, top_answer (of equally common ones the first), its share, and whether one answer is nearly all."""
    each = df.select(*by, shown(labels).alias("answer"), order).groupBy(*by, "answer").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    out = each.groupBy(*by).agg(F.count("*").alias("distinct_answers"), F.min_by("answer", F.struct(-F.col("n"), F.col("first"))).alias("top_answer"), (F.max("n") / F.sum("n")).alias("top_answer_fraction"))
    return out.withColumn("degenerate", F.col("top_answer_fraction") >= DEGENERATE)


def coverage(scope: DataFrame, done: DataFrame, key: list[str], by: list[str], rows: int = 0) -> DataFrame:
    """windows and the share of the whole scope that is done, rounded to 4 places. rows: about how large the scope is, so that tasks' shares don't grow with it."""
    own = dealt(done.select(*key), key, rows).distinct().withColumn("_done", F.lit(True))
    marked = dealt(scope.select(*dict.fromkeys([*key, *by])), key, rows).join(own, key, "left")
    return marked.groupBy(*by).agg(F.count_if("_done").alias("windows"), F.round(F.count_if("_done") / F.count("*"), 4).alias("coverage"))


def constant_floor(truth: DataFrame, by: list[str], cls: str = "class", binary: bool = False, least: int = MIN_SUPPORT, excluded: list[str] | None = None) -> DataFrame:
    """The best macro-F1 of an answer that never changes, from (by, class, holds) rows with one for each class of each item.

    Only classes with enough support count. A class that holds in a share s of the rows gives 2s / (1 + s) for itself and 0 for all
    others; where answers are sets (not binary), all classes at once and none are answers, too. 0.0 without such a class.
    """
    share = truth.groupBy(*by, cls).agg(F.avg(F.col("holds").cast("double")).alias("s"), F.count_if("holds").alias("n"))
    kept = (F.col("n") >= least) & (~F.col(cls).isin(excluded) if excluded else F.lit(True))
    f1 = F.when(kept, 2 * F.col("s") / (1 + F.col("s")))
    return share.groupBy(*by).agg(F.coalesce((F.max(f1) / F.count(f1)) if binary else F.avg(f1), F.lit(0.0)).alias("floor"))


def evaluate(answers: DataFrame, truth: DataFrame | None, scope: DataFrame, classes: list[str], binary: bool = False, excluded: list[str] | None = None, least: int = MIN_SUPPORT, iterations: int = 0, seed: int = 0, rows: int = 0) -> DataFrame:
    """A row for each model: how well its answers match the truth, over windows and over recordings.

    answers: model, path, ord, pred (labels); truth: path, truth (labels), None if the scope has it; scope: path, recording, patient.
    Of several answers to a path the first counts, of equal ord over several paths the first path; paths beyond the scope don't. A recording has the true labels that one of its windows has. Of a binary
    set it has the answer that most of its windows have (of equally many the one that came first), else every answer that one of
    them has. Means are over classes with enough support, those of recordings without the excluded ones; baseline_macro_f1 is the
    best constant answer's over the same classes. iterations > 0 adds the interval of the recordings' macro-F1; it and
    clears_baseline are null without such a class.

    First answers are written once, and so are the recordings' counts, from which all other figures follow. rows: about how many
    answers there are, so that tasks' shares don't grow with them.
    """
    w = saved(first_answers(answers, truth, scope, rows), "answers")
    each = saved(by_recording(w, classes, binary, w.count()), "recordings")  # counting reads footers alone
    out = figures(each, classes, binary, excluded, least).join(answers_of(w, "model"), "model")
    patients = each.groupBy("model").agg(F.count_distinct("patient").alias("patients"))
    total = scope.agg(F.count("*").alias("_all"))  # one row
    out = out.join(patients, "model").join(F.broadcast(total), how="cross").withColumn("coverage", F.round(F.col("windows") / F.col("_all"), 4)).withColumn("few_patients", F.col("patients") < MIN_PATIENTS).drop("_all")
    return with_interval(out, each, classes, excluded, least, iterations, seed) if iterations else out.drop("_kept")


def first_answers(answers: DataFrame, truth: DataFrame | None, scope: DataFrame, rows: int = 0) -> DataFrame:
    """model, path, ord, pred, truth, recording, patient of the first answer to each path of the scope. Answers move once, by path."""
    from tidewell.operators.dedup import first_of

    known = scope if truth is None else truth.join(scope, "path")
    return first_of(dealt(answers, ["path"], rows), ["model", "path"], ["ord"]).join(known, "path")


def by_recording(w: DataFrame, classes: list[str], binary: bool = False, rows: int = 0) -> DataFrame:
    """model, recording, patient, n (windows) and by class k: tp_k, fp_k, fn_k over windows; t_k and p_k, what the recording has and is given."""
    flags = [F.array_contains(c, label).alias(f"{n}{k}") for k, label in enumerate(classes) for c, n in (("truth", "_t"), ("pred", "_p"))]
    w = dealt(w.select("model", "recording", "patient", F.struct("ord", "path").alias("ord"), *flags), ["model", "recording"], rows)
    sums, votes = [], []
    for k in range(len(classes)):
        t, p = F.col(f"_t{k}"), F.col(f"_p{k}")
        sums += [F.count_if(t & p).alias(f"tp_{k}"), F.count_if(~t & p).alias(f"fp_{k}"), F.count_if(t & ~p).alias(f"fn_{k}"), F.bool_or(t).alias(f"t_{k}"), F.count_if(p).alias(f"votes_{k}"), F.min(F.when(p, F.col("ord"))).alias(f"first_{k}")]
        votes.append(F.when(F.col(f"votes_{k}") > 0, F.struct((-F.col(f"votes_{k}")).alias("votes"), F.col(f"first_{k}").alias("first"), F.lit(k).alias("k"))))
    out = w.groupBy("model", "recording").agg(F.min("patient").alias("patient"), F.count("*").alias("n"), *sums)
    if binary:
        out = out.withColumn("_won", F.array_min(F.array_compact(F.array(*votes)))["k"])
    given = [(F.coalesce(F.col("_won") == k, F.lit(False)) if binary else F.col(f"votes_{k}") > 0).alias(f"p_{k}") for k in range(len(classes))]
    return out.select("model", "recording", "patient", "n", *(f"{x}_{k}" for k in range(len(classes)) for x in ("tp", "fp", "fn", "t")), *given)


def recording_counts(classes: list[str]) -> dict[str, Column]:
    """0 or 1 for tp, fp and fn of each class of a recording."""
    out = {}
    for k in range(len(classes)):
        t, p = F.col(f"t_{k}"), F.col(f"p_{k}")
        out |= {f"rtp_{k}": t & p, f"rfp_{k}": ~t & p, f"rfn_{k}": t & ~p}
    return {n: c.cast("int") for n, c in out.items()}


def figures(each: DataFrame, classes: list[str], binary: bool, excluded: list[str] | None, least: int) -> DataFrame:
    """by_recording() -> a row for each model; _kept: the classes that recordings are scored by."""
    counts = recording_counts(classes)
    names = [f"{x}_{k}" for k in range(len(classes)) for x in ("tp", "fp", "fn")]
    total = each.groupBy("model").agg(F.sum("n").alias("windows"), F.count("*").alias("recordings"), *(F.sum(n).alias(n) for n in names), *(F.sum(c).alias(n) for n, c in counts.items()))

    def level(kind: str, n: Column, out: list[str]):
        """(kept, F1, balanced accuracy, share that holds) of each class."""
        found = []
        for k, c in enumerate(classes):
            tp, fp, fn = (F.col(f"{kind}{x}_{k}") for x in ("tp", "fp", "fn"))
            tn, s = n - tp - fp - fn, (tp + fn) / n
            found.append(((tp + fn >= least) & F.lit(c not in out), divide(2 * tp, 2 * tp + fp + fn), (divide(tp, tp + fn) + divide(tn, tn + fp)) / 2, 2 * s / (1 + s)))
        return found

    def mean(found, i: int):
        return divide(sum((F.when(f[0], f[i]).otherwise(0.0) for f in found), F.lit(0.0)), kept(found))

    kept = lambda found: sum((f[0].cast("int") for f in found), F.lit(0))
    window, recording = level("", F.col("windows"), []), level("r", F.col("recordings"), excluded or [])
    best = divide(F.array_max(F.array(*(F.when(f[0], f[3]).otherwise(0.0) for f in recording))), kept(recording)) if binary else mean(recording, 3)
    return total.select(
        "model", "windows", "recordings", mean(window, 1).alias("window_macro_f1"), mean(window, 2).alias("window_balanced_accuracy"), mean(recording, 1).alias("recording_macro_f1"), mean(recording, 2).alias("recording_balanced_accuracy"),
        best.alias("baseline_macro_f1"), kept(recording).alias("scored_classes"), (len(classes) - kept(recording)).alias("low_support_classes"), F.array(*(f[0] for f in recording)).alias("_kept"),
    )


def with_interval(out: DataFrame, each: DataFrame, classes: list[str], excluded: list[str] | None, least: int, iterations: int, seed: int) -> DataFrame:
    """out with recording_ci_low, recording_ci_high and clears_baseline, from resampled recordings."""
    from tidewell.operators.bootstrap import interval, resampled

    counts = recording_counts(classes)
    again = resampled(each.select("model", *(c.alias(n) for n, c in counts.items())), ["model"], list(counts), iterations, seed)
    kept = lambda k: F.get("_kept", F.lit(k))
    f1 = [divide(2 * F.col(f"rtp_{k}"), 2 * F.col(f"rtp_{k}") + F.col(f"rfp_{k}") + F.col(f"rfn_{k}")) for k in range(len(classes))]
    n = sum((kept(k).cast("int") for k in range(len(classes))), F.lit(0))
    f1 = F.when(n > 0, sum((F.when(kept(k), x).otherwise(0.0) for k, x in enumerate(f1)), F.lit(0.0)) / n)
    found = interval(again.join(out.select("model", "_kept"), "model").withColumn("f1", f1), ["model"], "f1")
    return out.drop("_kept").join(found.select("model", F.col("low").alias("recording_ci_low"), F.col("high").alias("recording_ci_high")), "model").withColumn("clears_baseline", F.col("recording_ci_low") > F.col("baseline_macro_f1"))


def class_figures(each: DataFrame, classes: list[str], excluded: list[str] | None = None, least: int = MIN_SUPPORT) -> DataFrame:
    """by_recording() -> model, level, class, precision, recall, f1, support, in_macro, over windows and over recordings."""
    own = lambda k, kind, level, n: F.struct(F.lit(level).alias("level"), F.lit(classes[k]).alias("class"), *(F.col(f"{kind}{x}_{k}").cast("long").alias(x) for x in ("tp", "fp", "fn")), (F.col(n) - F.col(f"{kind}tp_{k}") - F.col(f"{kind}fp_{k}") - F.col(f"{kind}fn_{k}")).alias("tn"))
    counts = recording_counts(classes)
    total = each.groupBy("model").agg(F.sum("n").alias("windows"), F.count("*").alias("recordings"), *(F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in range(len(classes)) for x in ("tp", "fp", "fn")), *(F.sum(c).alias(n) for n, c in counts.items()))
    long = total.select("model", F.inline(F.array(*(own(k, kind, level, n) for k in range(len(classes)) for kind, level, n in (("", "window", "windows"), ("r", "recording", "recordings"))))))
    left_out = (F.col("level") == "recording") & F.col("class").isin(excluded) if excluded else F.lit(False)
    return rates(long).select("model", "level", "class", "precision", "recall", "f1", "support", ((F.col("support") >= least) & ~left_out).alias("in_macro"))


def answers_of(w: DataFrame, model: str) -> DataFrame:
    return answers(w.withColumn("ord", F.struct("ord", "path")), [model], F.col("pred"), "ord")


def generated(df: DataFrame, by: list[str], nll: str, label: str, chars: str, answer: str, cap: int = 1200) -> DataFrame:
    """Of generated texts: mean loss of all, of positives and of negatives, median length, how many reach the cap, and the balanced accuracy of their answers."""
    y, p = F.col(label), F.col(answer)
    rate = lambda a, b: divide(F.count_if(a & b), F.count_if(b))
    return df.groupBy(*by).agg(
        F.avg(nll).alias("nll"), F.avg(F.when(y, F.col(nll))).alias("nll_positive"), F.avg(F.when(~y, F.col(nll))).alias("nll_negative"),
        F.percentile(F.col(chars).cast("double"), 0.5).alias("median_chars"), F.count_if(F.col(chars) >= cap).alias("at_cap"),
        ((rate(p, y) + rate(~p, ~y)) / 2).alias("balanced_accuracy"),
    )


def token_accuracy(labels: str, predicted: str, true: int, false: int) -> Column:
    """Balanced accuracy over the tokens of an array whose label is one of two; 0.0 for a class without tokens."""
    pairs = F.filter(F.arrays_zip(F.col(labels).alias("y"), F.col(predicted).alias("p")), lambda t: t["y"].isin(true, false))
    n = lambda test: F.size(F.filter(pairs, test))
    rate = lambda k: divide(n(lambda t: (t["y"] == k) & (t["p"] == k)), n(lambda t: t["y"] == k))
    return (rate(true) + rate(false)) / 2


def levels(df: DataFrame, by: list[str], values: str, share: float = 0.99) -> DataFrame:
    """Of each group of rows with arrays of samples: the median over rows of the positive percentiles of absolute values; 1.0 if there is none."""
    each = df.withColumn("_row", F.monotonically_increasing_id()).select(*by, "_row", F.explode(values).alias("x")).groupBy(*by, "_row").agg(F.percentile(F.abs("x").cast("double"), share).alias("level"))
    return each.groupBy(*by).agg(F.coalesce(F.percentile(F.when(F.col("level") > 0, F.col("level")), 0.5), F.lit(1.0)).alias("level"))


def softmax_true(logits: Column, true: int, false: int) -> Column:
    """The probability of `true` against `false` from an array of logits: a sigmoid of their difference."""
    return 1 / (1 + F.exp(F.get(logits, F.lit(false)) - F.get(logits, F.lit(true))))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


#: Names of figures, what they are called in reports, and whether more is better.
FIGURES = {"balanced_accuracy": ("Balanced accuracy", True), "macro_f1": ("Macro F1", True), "auroc": ("AUROC", True), "nll": ("Loss", False)}


def best_by(df: DataFrame, by: list[str], figure: str, key: str) -> DataFrame:
    """by, best: the key with the best value of a figure in FIGURES; ties by key."""
    value = F.col(figure) if FIGURES[figure][1] else -F.col(figure)
    return df.where(F.col(figure).isNotNull()).groupBy(*by).agg(F.min_by(key, F.struct(-value, F.col(key))).alias("best"))


def table_order(df: DataFrame, coverage: str, score: str, name: str, complete: float = 0.99) -> DataFrame:
    """df with group (0 complete, 1 partial, 2 without a score) and place, the row of a report: groups, then better scores, then names. A report is small."""
    from pyspark.sql import Window

    group = F.when(F.col(score).isNull(), 2).when(F.col(coverage) < complete, 1).otherwise(0)
    return df.withColumn("group", group).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("group", F.desc(F.coalesce(F.col(score), F.lit(0.0))), name)))
