"""Random access to lines of large text files by an index of byte offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import commit
from .files import _file_system

#: Bytes of a file that one step of the index reads.
SPLIT = 8 << 20


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, path, bytes, changed) of the files, numbered as given. Only their status is read."""
    if not paths:
        return spark.createDataFrame([], "file int, path string, bytes long, changed timestamp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for i, name in enumerate(paths):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        rows.append((i, status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return spark.createDataFrame(rows, "file int, path string, bytes long, changed long").withColumn("changed", F.timestamp_millis("changed"))


def fingerprint(files: DataFrame) -> str:
    """Of names, sizes and times of files, which say whether an index is still theirs."""
    return hashlib.sha256(repr([tuple(r) for r in files.orderBy("file").collect()]).encode()).hexdigest()


def _newlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, the places after its newlines; a file's first split begins with place 0."""
    for batch in batches:
        for file, path, at, n, last in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "at", "n", "bytes"))):
            files, name = _file_system(path)
            with files.open_input_file(name) as f:
                raw = np.frombuffer(f.read_at(n, at), np.uint8)
            starts = np.flatnonzero(raw == 10) + at + 1
            starts = np.append(0, starts) if at == 0 else starts
            starts = starts[starts < last]
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "at": [at], "starts": pa.array([starts], pa.list_(pa.int64()))})


def offsets(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(file, line, offset, length): where each line of the files begins and how many bytes it has, its newline included.

    Files are read once, in splits by as many tasks; lines are numbered from the counts of the splits before. A line may
    be longer than a split; the last may lack its newline; an empty file has no lines.
    """
    cut = files.where("bytes > 0").select("file", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("at"))
    cut = cut.withColumn("n", F.least(F.lit(split), F.col("bytes") - F.col("at"))).repartition("file", "at")
    found = cut.mapInArrow(_newlines, "file int, at long, starts array<long>")
    found = found.join(files.select("file", "bytes"), "file").where(F.size("starts") > 0)
    order = Window.partitionBy("file").orderBy("at")  # a row for each split
    before = F.coalesce(F.sum(F.size("starts")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumns({"first": before, "next": F.coalesce(F.lead(F.element_at("starts", 1)).over(order), "bytes")})
    rows = placed.select("file", "first", "next", "starts", F.posexplode("starts").alias("i", "offset"))
    after = F.coalesce(F.get("starts", F.col("i") + 1), "next")
    return rows.select("file", (F.col("first") + F.col("i")).alias("line"), "offset", (after - F.col("offset")).alias("length"))


def build(spark: SparkSession, paths: list[str], folder: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(files, index): the index of ``offsets`` as a table under ``folder``, in order; made again only if a file has changed."""
    files = listed(spark, paths)
    mark = f"{fingerprint(files)}"
    state = commit.current(spark, folder)
    if not state or state["fingerprint"] != mark:
        commit.write(offsets(files, split).repartitionByRange("file", "line").sortWithinPartitions("file", "line"), folder, mark)
    return files, commit.read(spark, folder)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[str, object] = {}
    try:
        for batch in batches:
            values = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("__path", "__offset", "__length"))):
                if path not in opened:
                    while len(opened) >= 16:
                        opened.pop(next(iter(opened))).close()
                    files, name = _file_system(path)
                    opened[path] = files.open_input_file(name)
                values.append(opened[path].read_at(n, at))
            rest = [batch.column(i) for i, f in enumerate(batch.schema) if not f.name.startswith("__")]
            names = [f.name for f in batch.schema if not f.name.startswith("__")]
            text = [v.removesuffix(b"\n").removesuffix(b"\r").decode() for v in values]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(text, pa.string()), pa.array(map(len, values), pa.int64())], names=[*names, "value", "bytes_read"])
    finally:
        for f in opened.values():
            f.close()


def lines_at(places: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """``places`` (file, line and other columns) with value, the line without its end, and bytes_read; places outside the files give no row.

    Only the wanted bytes are read, in order of their places. Of the index, the join reads the row groups that
    hold the wanted places where those are few, as the index lies in order.
    """
    spark = places.sparkSession
    bounds = places.agg(F.min("file"), F.max("file"), F.min("line"), F.max("line")).first()
    if bounds[0] is None:
        return spark.createDataFrame([], places.schema).withColumns({"value": F.lit("").cast("string"), "bytes_read": F.lit(0).cast("long")}).where("false")
    near = index.where(F.col("file").between(bounds[0], bounds[1]) & F.col("line").between(bounds[2], bounds[3]))
    found = places.join(near, ["file", "line"]).join(F.broadcast(files.select("file", F.col("path"))), "file")  # a row for each file
    located = found.select(*places.columns, F.col("path").alias("__path"), F.col("offset").alias("__offset"), F.col("length").alias("__length"))
    ordered = located.sortWithinPartitions("__path", "__offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)
    return ordered.mapInArrow(_lines, f"{schema}, value string, bytes_read long")
