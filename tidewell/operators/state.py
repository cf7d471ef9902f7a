"""The pipeline's state as a view over what exists: images, models, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_of(split: Column, sampled: Column, labelled: Column) -> Column:
    return F.when((split == "test") & sampled, "full").when((split == "train") & sampled & labelled, "rationale").otherwise("none")


def done_of(scope: Column, rationale: Column, evaled: Column, judged: Column, judged_gpt: Column) -> Column:
    """Nothing to do counts as done."""
    return F.when(scope == "full", rationale & evaled & judged & judged_gpt).when(scope == "rationale", rationale).otherwise(F.lit(True))


FEW_MODELS = 300


def expanded(images: DataFrame, models: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Each image with each model that its dataset is open to; a null list of datasets is open to all.

    models is a registry, a row for each model. Up to FEW_MODELS of them become part of the plan, and no join is needed; more are
    joined by dataset, as Spark sees fit for their size.
    """
    rows = models.limit(FEW_MODELS + 1).collect()
    fields = [c for c in models.columns if c != "datasets"]
    kinds = {c: models.schema[c].dataType for c in models.columns}
    if not rows:
        return images.where("false").select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in fields))
    if len(rows) > FEW_MODELS:
        named = models.where("datasets is not null").withColumn("_d", F.explode(F.array_distinct("datasets"))).select("_d", *fields)
        # a row for each dataset and model is what the result has for each image anyway
        every = images.select(F.col(dataset).alias("_d")).distinct().join(models.where("datasets is null").select(*fields), how="cross")
        return images.join(named.unionByName(every), F.col(dataset).eqNullSafe(F.col("_d"))).select(*images.columns, *fields)
    each = [F.struct(F.lit(r["datasets"] if r["datasets"] is None else list(r["datasets"])).cast(kinds["datasets"]).alias("datasets"), *(F.lit(r[c]).cast(kinds[c]).alias(c) for c in fields)) for r in rows]
    open_to = F.filter(F.array(*each), lambda m: m["datasets"].isNull() | F.array_contains(m["datasets"], F.col(dataset)))
    return images.withColumn("_m", F.explode(open_to)).select(*images.columns, *(F.col(f"_m.{c}").alias(c) for c in fields))


def with_bit(df: DataFrame, done: DataFrame, key: list[str], name: str) -> DataFrame:
    """df with a boolean: whether its key is in done."""
    return df.join(done.select(*key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def sync(images: DataFrame, models: DataFrame, results: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The whole state: images x models, a bit for each result, scope and done. Recomputed, never updated; orphans can't arise."""
    out = expanded(images, models)
    for name, (done, key) in results.items():
        out = with_bit(out, done, key, name)
    c = F.col
    return out.withColumn("scope", scope_of(c("split"), c("sampled"), c("labelled"))).withColumn("done", done_of(c("scope"), c("rationale"), c("evaled"), c("judged"), c("judged_gpt")))


def everywhere(df: DataFrame, key: list[str], flag: str) -> DataFrame:
    """The flag on all rows of a key if one has it."""
    return df.withColumn(flag, F.bool_or(flag).over(Window.partitionBy(*key)))


def summary(state: DataFrame) -> DataFrame:
    c, one = F.col, lambda x: F.when(x, F.col("path"))
    return state.groupBy("dataset").agg(
        F.count_distinct("path").alias("images"), F.count_distinct(one(c("sampled") & (c("split") == "test"))).alias("test"), F.count_distinct(one(c("sampled") & (c("split") == "train"))).alias("train"),
        F.count_distinct(one(c("rationale"))).alias("rationales"), F.count_if("evaled").alias("evaled"), F.count_if("judged").alias("judged"), F.count_if("judged_gpt").alias("judged_gpt"), F.count_if("done").alias("done"), F.count("*").alias("n"),
    )


def pending(scope: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return scope.join(done.select(*key), key, "left_anti")


def open_failures(failures: DataFrame, todo: DataFrame, key: list[str]) -> DataFrame:
    return failures.join(todo.select(*key).distinct(), key, "left_semi")


def failure_report(failures: DataFrame, by: list[str], unit: str, error: str, top: int = 3, chars: int = 80) -> DataFrame:
    """attempts, units and the commonest errors of each group, as 'n x error' joined."""
    short = failures.withColumn("_e", F.substring(error, 1, chars))
    each = short.groupBy(*by, "_e").agg(F.count("*").alias("n"))
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_e"))).where(F.col("_r") <= top)
    told = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat(F.col("n").cast("string"), F.lit(" x "), F.col("_e")).alias("t")))).alias("x")).select(*by, F.array_join(F.transform("x", lambda x: x["t"]), "; ").alias("errors"))
    return short.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_distinct(unit).alias("units")).join(told, by)


def tasks(events: DataFrame, key: list[str], kind: str, at: str, detail: str) -> DataFrame:
    """started and ended of each task, its end's detail, and whether it is open: started and not ended."""
    start, end = F.when(F.col(kind) == "start", F.col(at)), F.when(F.col(kind) == "end", F.col(at))
    out = events.groupBy(*key).agg(F.max(start).alias("started"), F.max(end).alias("ended"), F.max_by(detail, end).alias("detail"))
    return out.withColumn("open", F.col("started").isNotNull() & F.col("ended").isNull())


def pending_report(todo: DataFrame, failed: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Of each group: pending, of these failed before, and never attempted."""
    marked = with_bit(todo, failed, key, "_failed")
    return marked.groupBy(*by).agg(F.count("*").alias("pending"), F.count_if("_failed").alias("failed"), F.count_if(~F.col("_failed")).alias("untried"))


def failure_key(stage: Column, common: list[Column], more: list[Column], short: str) -> Column:
    """A failure's key as text: stages named `short` are known by the common parts, others by more."""
    text = lambda parts: F.concat_ws("/", *(p.cast("string") for p in parts))
    return F.when(stage == short, text(common)).otherwise(text([*common, *more]))


def with_backend(df: DataFrame, models: DataFrame, tuned: str = "hf") -> DataFrame:
    """df with zero_shot: whether its model, by the registry, isn't a tuned one."""
    return df.join(models.select("model", (F.col("backend") != tuned).alias("zero_shot")), "model", "left")
