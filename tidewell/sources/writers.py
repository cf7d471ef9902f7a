"""Sinks. Spark's commit protocol stands in for locks; a rewrite goes to a new folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import one_line
from tidewell.operators import ranks


def append(df: DataFrame, path: str, fields: list[str], partition: list[str] | None = None) -> None:
    """Rows added as Parquet, columns in the given order."""
    writer = df.select(*fields).write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """path as a whole by df, which may read path. Written beside it, then the old folder moves aside and the new one takes its name; a crash between leaves both, whole."""
    spark, new = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    there, tmp, aside = jvm.Path(path), jvm.Path(new), jvm.Path(f"{new}.old")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(there)
    if had and not fs.rename(there, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(tmp, there):
        raise OSError(f"{new} can't be renamed to {path}")
    if had:
        fs.delete(aside, True)


def csv(df: DataFrame, path: str, fields: list[str], files: int | None = None) -> None:
    """Columns in the given order, quotes doubled; files=1 for a small report."""
    out = df.select(*fields)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def jsonl(df: DataFrame, path: str, by: list[str]) -> None:
    """Lines in a folder for each value of by, such as target and split."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def chat(instruction: Column, output: Column, image: Column, kind: str, id_: Column | None = None) -> Column:
    """A line of a chat format about one image: sharegpt, minicpm (with an id) or messages."""
    marked = F.concat(F.lit("<image>\n"), instruction)
    turn = lambda who, what, a, b: F.struct(F.lit(who).alias(a), what.alias(b))
    if kind == "sharegpt":
        return F.to_json(F.struct(F.array(turn("human", marked, "from", "value"), turn("gpt", output, "from", "value")).alias("conversations"), F.array(image).alias("images")))
    if kind == "minicpm":
        return F.to_json(F.struct(id_.cast("string").alias("id"), image.alias("image"), F.array(turn("user", marked, "role", "content"), turn("assistant", output, "role", "content")).alias("conversations")))
    if kind == "messages":
        part = lambda what, text: F.struct(F.lit(what).alias("type"), *([F.lit(None).cast("string").alias("text"), text.alias("image")] if what == "image" else [text.alias("text"), F.lit(None).cast("string").alias("image")]))
        return F.to_json(F.struct(F.array(turn("user", F.array(part("image", image), part("text", instruction)), "role", "content"), turn("assistant", F.array(part("text", output)), "role", "content")).alias("messages")))
    raise ValueError(f"unknown chat format {kind!r}")


def manifest(new: DataFrame, old: DataFrame, key: str = "path", kept: str = "ground_truth_rationale") -> DataFrame:
    """new, with the kept column of old where it has the key and blank otherwise."""
    before = old.select(key, F.col(kept).alias("_old"))
    return new.drop(kept).join(before, key, "left").withColumn(kept, F.coalesce("_old", F.lit(""))).drop("_old")


def failures(df: DataFrame, error: str) -> DataFrame:
    """Rows for the failure log: the error as one line of 500 characters, and when."""
    return df.withColumn(error, one_line(F.col(error))).withColumn("time", F.date_trunc("second", F.current_timestamp()))


def missing(todo: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """What an idempotent sink has still to write."""
    return todo.join(existing.select(key), key, "left_anti")


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """rows and md5 of a table or of each of its groups, whatever the order of rows: a digest of the sum of the rows' hashes, in decimal."""
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.md5(F.coalesce(F.sum(row), F.lit(0)).cast("string").cast("binary")).alias("md5"))


def named_files(df: DataFrame, parts: str, name: str, order: list[str], line: str, to: str, ending: str, place=None) -> None:
    """A text file for each name, its lines in order: <to>/<place(name)><ending>. Tasks write below `parts`, a file a name, then each is renamed; names are few, a file is what one task can write."""
    df.select(name, *order, F.col(line).alias("_line")).repartition(name).sortWithinPartitions(name, *order).select(F.col(name).alias("_name"), "_line").write.partitionBy("_name").text(parts)
    _renamed(df.sparkSession, parts, lambda own, file: f"{to}/{place(own) if place else own}{ending}")


def numbered_files(df: DataFrame, parts: str, name: str, order: list[str], fields: list[str], to: str, rows: int) -> None:
    """CSV files with a header, their lines in order: <to>/<name>-<number>.csv, as many for a name as it takes for no task to sort more than about ranks.ROWS rows; numbers follow the order. rows: about how many rows there are."""
    cut = df.select(name, *dict.fromkeys([*order, *fields])).repartitionByRange(max(-(-rows // ranks.ROWS), 1), name, *order).sortWithinPartitions(name, *order)
    cut.select(F.col(name).alias("_name"), *fields).write.partitionBy("_name").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(parts)
    _renamed(df.sparkSession, parts, lambda own, file: f"{to}/{own}-{int(file.split('-')[1]):08d}.csv")


def _renamed(spark, parts: str, to) -> None:
    """Each file of <parts>/_name=<name> moves to to(name, file)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.Path(f"{parts}/_name=*/part-*")):
        own = found.getPath().getParent().getName().split("=", 1)[1]
        there = jvm.Path(to(own, found.getPath().getName()))
        fs.mkdirs(there.getParent())
        if not fs.rename(found.getPath(), there):
            raise OSError(f"{there} can't be written")


def bundle(frames: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Several tables as CSV folders below path, columns in the given order."""
    for name, (df, fields) in frames.items():
        csv(df, f"{path}/{name}", fields)
