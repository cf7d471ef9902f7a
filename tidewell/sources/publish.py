"""Several tables published together or not at all.

Each version of all tables is a folder; a small pointer file names the current one and is replaced by a rename, which happens or
doesn't. The first version stays as the backup, and each table is pinned by its digest, which reading it can check.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.readers import exists
from tidewell.sources.writers import fingerprint


class NotPublished(Exception):
    """A table failed its checks; what was published before still is."""


def publish(spark: SparkSession, root: str, sets: dict[str, tuple[DataFrame, DataFrame | None]]) -> str:
    """The name of the new version. sets: name -> (rows, report); a report that has rows, or a table that has none, fails them all.

    Every table is written and checked as it was written before the pointer moves.
    """
    version, pins = uuid4().hex, {}
    for name, (_, report) in sets.items():
        if report is not None and (found := report.limit(3).collect()):
            raise NotPublished(f"{name}: " + "; ".join(str(r.asDict()) for r in found))
    for name, (rows, _) in sets.items():
        rows.write.parquet(f"{root}/versions/{version}/{name}")
        pins[name] = pin(spark.read.parquet(f"{root}/versions/{version}/{name}"))
        if not pins[name]["rows"]:
            raise NotPublished(f"{name} has no rows")
    old = pointer(spark, root)
    point(spark, root, {"version": version, "first": old["first"] if old else version, "before": old["version"] if old else None, "pins": pins})
    return version


def pin(df: DataFrame) -> dict:
    return fingerprint(df, sorted(df.columns)).first().asDict()


def pointer(spark: SparkSession, root: str) -> dict | None:
    return json.loads(spark.read.text(f"{root}/current", wholetext=True).first()[0]) if exists(spark, f"{root}/current") else None


def point(spark: SparkSession, root: str, what: dict) -> None:
    """Replaces the pointer in one step."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there, new = hadoop.Path(f"{root}/current"), hadoop.Path(f"{root}/current.{uuid4().hex}")
    store = there.getFileSystem(conf)
    there, new = store.makeQualified(there), store.makeQualified(new)
    out = store.create(new)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    kinds = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    kinds[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(there.toUri(), conf).rename(new, there, kinds)


def published(spark: SparkSession, root: str, name: str, which: str = "version", check: bool = False) -> DataFrame:
    """A table of the current version, of the one "before", or of the "first", the backup. check: compare the current one with its pin."""
    now = pointer(spark, root)
    df = spark.read.parquet(f"{root}/versions/{now[which]}/{name}")
    if check and pin(df) != now["pins"][name]:
        raise NotPublished(f"{name} isn't what was published")
    return df
