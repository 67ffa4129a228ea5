"""Arrival order of tables without ids: files by name, rows as they lie in a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, before): rows of each Parquet file, and of all files before it in order of their paths. A row for each file."""
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0)))


def arrived(spark: SparkSession, path: str, name: str = "arrival") -> DataFrame:
    """The Parquet table with ``name``: the row's place, from 0 on without gaps, by its file's path and its place in the file.

    Files are numbered by their paths, so a table written again in other files has another order. Places come from the
    files' row counts and the reader's row index: no row is sorted or shuffled. A column called ``name`` is replaced.
    """
    from ..operators.quota import few

    rows = spark.read.parquet(path)
    placed = rows.withColumns({"__file": F.col("_metadata.file_path"), name: F.col("_metadata.row_index")})
    offsets = file_rows(spark, path).select(F.col("file").alias("__file"), F.col("before").alias("__before"))
    kept = [c for c in rows.columns if c != name]
    return placed.join(few(offsets), "__file").select(*[F.col(f"`{c}`") for c in kept], (F.col("__before") + F.col(name)).alias(name))
