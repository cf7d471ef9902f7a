"""Folders of intermediate tables: below spark.checkpoint.dir, which the cluster's machines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, or what setCheckpointDir() was given."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)


def new_folder(spark: SparkSession, name: str = "") -> str:
    """A new folder's path below the checkpoint folder; where none is set (tests) below the warehouse, which is as shared as the tables are."""
    root = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    parts = ["tidewell", *re.findall(r"[a-z0-9]+", name.lower()), uuid.uuid4().hex]
    return f"{root.rstrip('/')}/{'-'.join(parts)}"


def saved(df: DataFrame, name: str = "") -> DataFrame:
    """df written to such a folder and read again: lineage ends there, and any executor may be lost. The folder's owner removes what is old."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
