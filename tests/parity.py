"""Compares queries with their SQL in DuckDB: names, types, rows and values. python tests/parity.py [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/tidewell-tests/warehouse").config("spark.checkpoint.dir", "/tmp/tidewell-tests/checkpoints").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark, con, sf_dir: str, f, sql: str) -> str:
    """What differs, or an empty string."""
    a, b = f(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {sorted(a.column_names)} and {sorted(b.column_names)}"
    kinds = {n: (str(a.schema.field(n).type), str(b.schema.field(n).type)) for n in a.column_names}
    odd = {n: k for n, k in kinds.items() if k[0].replace("large_", "").replace("[us]", "") != k[1].replace("large_", "").replace("[us]", "")}
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    wrong = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(wrong)} of {len(x)} rows, such as {wrong[0]}" if wrong else f"types {odd}" if odd else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, d = session(), os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con, sql = duck(d), entry.oracle_sql()
    for name, f in entry.queries().items():
        if (sys.argv[1:] and name not in sys.argv[1:]) or (not sys.argv[1:] and (name.startswith("op") or name == "pipeline")):
            continue
        t = time.time()
        try:
            said = differences(spark, con, d, f, sql[name]) if name in sql else f"{f(spark, d).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__} {str(e)[:300]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
