"""Vectors as rows of integers, which several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import durable

EXACT = 1 << 53  # floats hold every integer up to here


def reach(width: int) -> int:
    """The largest component of a vector of `width`: 100 times an inner product or a squared distance then fits 64 bits."""
    return 1 << ((55 - max(1, width).bit_length()) // 2)


def scaled(column, scale: float):
    """An Arrow list column -> (kept, lengths, components): rows that are no null and have only finite components; floor(scale * x) of theirs, one after the other."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast("double").to_numpy(zero_copy_only=False)  # nulls become nan
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(x)], minlength=len(lengths)) == 0)
    most = float(reach(1))
    return kept, lengths[kept], np.clip(np.floor(x[kept[row]] * scale), -most, most).astype(np.int64)


def integer_rows(df: DataFrame, columns: dict[str, Column], vector_col: str, scale: float, name: str) -> DataFrame:
    """The rows whose vector can be used: `columns`, v (components as integers), norm (their squares' sum) and row (a number of its own).

    A vector that is null or has null, infinite or nan components leaves its row out; components beyond reach(length) are held
    there. The table is written once, so that row stays what it is.
    """
    own = df.select(*(c.alias(k) for k, c in columns.items()), F.col(vector_col).cast("array<double>").alias("v"))
    schema, names = own.drop("v").schema, [*columns, "v", "norm"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept, lengths, x = scaled(batch.column(batch.num_columns - 1), scale)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            each, of = np.unique(lengths, return_inverse=True)
            limit = np.repeat(np.array([reach(n) for n in each.tolist()], np.int64)[of], lengths)
            x = np.clip(x, -limit, limit)
            sums = np.concatenate([[0], np.cumsum(x * x)])
            part = batch.filter(pa.array(kept))
            v = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], v, pa.array(sums[ends[1:]] - sums[ends[:-1]])], names)

    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + ["v array<int>", "norm bigint"])
    return durable(own.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), name)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of integer lists as rows of `width` components; shorter ones end in zeros."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return x.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
    return out


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as floats if inner products and squared distances of their rows are exact in floats, else as they are."""
    most = max([int(np.abs(a).max()) for a in arrays if a.size], default=0)
    return [a.astype(np.float64) for a in arrays] if 4 * max(1, arrays[0].shape[1]) * most * most < EXACT else list(arrays)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of y, exact for what fitting() gives."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
