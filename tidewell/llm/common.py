"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.folders import new_folder, saved

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def decoded(data: bytes | None) -> str:
    return "" if data is None else data.decode("utf-8", "replace")


class Taken:
    """Half-open spans that are taken, joined where they overlap; asking is a binary search."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in spans:
            self.add(a, b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        low, high = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if low < high:
            a, b = min(a, self.starts[low]), max(b, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [a], [b]


def chunks(sizes, most: int):
    """Ranges [a, b) of consecutive items whose sizes sum to at most `most`, one item at least."""
    sizes = list(sizes)
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def parts_of(batch, column: int, most: int = 4 << 20):
    """Parts of an Arrow batch, of `most` bytes of text or one row; then what Arrow holds unused goes back."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in chunks(sizes, most):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def slices(batch, column: int, most: int = 4 << 20):
    """(part of an Arrow batch, its texts as bytes), as parts_of() cuts them."""
    for part in parts_of(batch, column, most):
        yield part, utf8(part.column(column))


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to a Parquet folder below spark.checkpoint.dir and read again: lineage is cut and any executor may be lost."""
    return saved(df, name)


def bucketed(df: DataFrame, key: list[str], name: str, dealt: bool = False) -> DataFrame:
    """df as a table below spark.checkpoint.dir, dealt into buckets by key, as many as shuffles have partitions: later joins by key don't move it.

    dealt: whether df is grouped by the key already, and so in the tasks that write its buckets. The catalog forgets the table at
    once; the DataFrame keeps its files and buckets.
    """
    spark = df.sparkSession
    table, n = f"tidewell_{uuid4().hex}", min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))  # Spark has no more buckets than that
    df = df if dealt else df.repartition(n, *key)
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(n, *key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int, needs: Column | None = None) -> DataFrame:
    """rows with the columns of table, which has one row for each key and in n how many of the `total` rows have it; nulls where it has none.

    Keys with more than a thousandth of all rows are under a thousand, so theirs is the part that is broadcast; all other rows are
    joined by sorting. Rows of hot keys, and those that `needs` says need no lookup, are spread evenly in that join.
    """
    more = [c for c in table.columns if c not in key]
    anywhere = F.monotonically_increasing_id().cast("string").cast(rows.schema[key[0]].dataType)
    hot = F.broadcast(table.where(F.col(n) > total / HOT_SHARE).select(*(F.col(c).alias(f"_h_{c}") for c in table.columns), F.lit(True).alias("_hot")))
    cold = table.where(F.col(n) <= total / HOT_SHARE).select(*(F.col(c).alias(f"_c_{c}") for c in table.columns), F.lit(False).alias("_cold"))
    needs = F.lit(True) if needs is None else needs
    found = rows.join(hot, [F.col(c) == F.col(f"_h_{c}") for c in key] + [needs], "left").withColumn("_done", F.coalesce("_hot", ~needs))
    keys = [F.when(F.col("_done"), None).otherwise(F.col(c)) if k else F.when(F.col("_done"), anywhere).otherwise(F.col(c)) for k, c in enumerate(key)]
    dealt = found.select("*", *(k.alias(f"_k_{c}") for k, c in zip(keys, key, strict=True)))
    met = [F.col(f"_k_{c}") == F.col(f"_c_{c}") for c in key] + [F.col("_done") == F.col("_cold")]
    return dealt.join(cold, met, "left").select(*rows.columns, *(F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in more))


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir."""
    return new_folder(spark, name)
