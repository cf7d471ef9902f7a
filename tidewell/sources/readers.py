"""Typed readers. A missing path is an empty relation with the declared schema; blanks are null; text stays text until it is parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ranks import dealt

ANNOTATIONS = "channel string, start_time double, stop_time double, label string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path, which may hold wildcards, names anything; in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, comment: str | None = None, multiline: bool = True) -> DataFrame:
    """Quotes are doubled, cells may hold line breaks and be of any length. multiline files can't be split; say False for large ones without."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("maxCharsPerColumn", -1)
    if comment:
        reader = reader.option("comment", comment)
    return blank_to_null(reader.csv(paths))


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    """df with the file that each row came from, to order or to parse by."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line an object; blank lines are skipped."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def nested_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON string inside a row, decoded; null if it can't be."""
    return df.withColumn(column, F.from_json(column, schema))


def pairs(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key).distinct()


def annotations(spark: SparkSession, path: str | list[str], vocabulary: list[str], schema: str = ANNOTATIONS) -> DataFrame:
    """Rows of annotation files: '#' lines dropped, compound labels split, labels beyond the vocabulary dropped; with the file's name."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, recording string")
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").csv(paths)
    rows = rows.withColumn("recording", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_[a-z]+)?\.csv$", 1))
    return rows.withColumn("label", F.explode(F.split(F.trim("label"), "_"))).where(F.col("label").isin(vocabulary))


def coded_lines(spark: SparkSession, path: str, codes: dict[str, str]) -> DataFrame:
    """Headerless 'channel,start,stop,code' lines; others are skipped, codes named."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{ANNOTATIONS}, recording string")
    parts = F.split("value", ",")
    lines = spark.read.text(path).select(parts.alias("p"), F.col("_metadata.file_name").alias("recording")).where(F.size("p") == 4)
    named = F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.trim(F.col("p")[3]))
    return lines.select(F.col("p")[0].alias("channel"), F.expr("try_cast(p[1] AS double)").alias("start_time"), F.expr("try_cast(p[2] AS double)").alias("stop_time"), named.alias("label"), "recording").where("label is not null")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below; contents aren't read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and md5 of all files below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.md5("content").alias("md5"))


def first_rows(spark: SparkSession, path: str, schema: str, key: list[str], rows: int = 0) -> DataFrame:
    """Rows of all files that the wildcard names, in the order of the files' names and their lines: the first of each key. rows: about how many there are, so that tasks' shares don't grow with them."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = csv(spark, path, schema)
    lines = lines.withColumn("_at", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))
    others = [c for c in lines.columns if c not in (*key, "_at")]
    return dealt(lines, key, rows).groupBy(*key).agg(F.min_by(F.struct(*others), "_at").alias("_r")).select(*key, "_r.*")


def by_file_name(spark: SparkSession, path: str, schema: str, models: DataFrame, ending: str = ".csv") -> DataFrame:
    """Rows of <model slug>-<dataset>.csv files with model and dataset; model by the registry's slug, null where it has none. models: slug, model."""
    rows = csv(spark, path, schema).withColumn("_f", F.regexp_replace(F.col("_metadata.file_name"), f"{ending}$", ""))
    cut = rows.withColumn("slug", F.regexp_extract("_f", "^(.*)-[^-]*$", 1)).withColumn("dataset", F.regexp_extract("_f", "([^-]*)$", 1)).drop("_f")
    return cut.join(models.select("slug", "model"), "slug", "left").drop("slug")


def summaries(spark: SparkSession, path: str, schema: str, names: DataFrame, key: str = "arm", prefix: str = "summary-") -> DataFrame:
    """names with the one row of each <prefix><name>.csv; nulls where there is no such file."""
    found = csv(spark, path, schema)
    found = found.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), f"^{prefix}(.*)\\.csv$", 1)) if exists(spark, path) else found.withColumn(key, F.lit(None).cast("string"))
    return names.join(found, key, "left")


def from_folder(path: Column) -> Column:
    """The folder that a file lies in: its class."""
    return F.element_at(F.split(path, "/"), -2)


def latest_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of each run's last checkpoint, by its number: <run>/checkpoint-<step>/trainer_state.json."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_p", F.col("_metadata.file_path"))
    rows = rows.withColumn("run", F.regexp_extract("_p", r"([^/]+)/checkpoint-\d+/[^/]*$", 1)).withColumn("step", F.regexp_extract("_p", r"checkpoint-(\d+)", 1).cast("long"))
    fields = [c for c in rows.columns if c not in ("_p", "run", "step")]
    return rows.groupBy("run").agg(F.max("step").alias("step"), *(F.max_by(c, "step").alias(c) for c in fields))


def union_by_schema(spark: SparkSession, paths: list[str], needed: list[str]) -> DataFrame | None:
    """All CSV files that have the needed columns, missing others as nulls. Headers are read by Spark, a row for each file; files of one header are one scan."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("head"))
    scans: dict[str, list[str]] = {}
    for row in heads.orderBy("path").collect():
        scans.setdefault(row["head"], []).append(row["path"])
    frames = [spark.read.option("header", True).csv(own) for head, own in sorted(scans.items()) if set(needed) <= {c.strip().strip('"') for c in head.split(",")}]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def registry(models: DataFrame, derived: DataFrame, key: str = "model") -> DataFrame:
    """Entries of a configuration and derived ones; explicit ones win over derived ones of the same name."""
    return models.unionByName(derived.join(models.select(key), key, "left_anti"), allowMissingColumns=True)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    try:
        return spark.table(name)
    except AnalysisException:
        return spark.createDataFrame([], schema)
