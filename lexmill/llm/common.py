"""What the operators of this subpackage share: reading, shared storage, Arrow mapping, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import shared_folder, shared_path  # noqa: F401

#: Bytes up to which a side may be broadcast. Beyond it the join is left to shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint for a side of ``rows`` counted rows, if they are few enough; else the planner's own choice."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of its like that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def as_rows(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it cannot clash with their names."""
    return F.struct(*all_columns(df))


#: Rows of an Arrow batch that are worked on at a time, so that a worker holds few texts as Python objects.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def released() -> None:
    """Gives the worker's free memory back to the machine, as idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow``, after each task of which the worker's free memory is given back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return df.mapInArrow(tidy, schema)


def map_arrow(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """``mapInArrow`` over columns as Python lists: ``rows`` turns the lists of a slice into the output's columns."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return in_arrow(df, run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Ranges that a table is cut into at most, so that the driver's list of cuts is bounded.
RANGES = 1 << 14


def range_cuts(df: DataFrame, column: str, rows_each: int) -> list[int]:
    """Sorted values of an integer column that cut it into ranges of about ``rows_each`` rows, RANGES at most."""
    n = min(RANGES, -(-df.count() // rows_each))
    found = df.approxQuantile(column, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({int(c) for c in found})


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than the value, looked up in two steps."""
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    less = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    k = less(longs([x[-1] for x in fine[:-1]]))
    return k * step + less(F.element_at(F.array(*map(longs, fine)), k + 1))
