"""Tables and small files that are there whole or not at all, on any file system of Spark's.

A table is a folder of generations and one small file that names the current one. A write makes a new generation beside the
others and then replaces that file by a rename, so a reader sees the old rows or the new ones, whenever the writer dies.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The file that names a table's current generation.
CURRENT = "_CURRENT.json"


def _context(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(conf), conf


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs, _ = _context(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; FileNotFoundError if there is none."""
    _, p, fs, _ = _context(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it over ``path`` in one step."""
    jvm, p, fs, conf = _context(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(p), overwrite)


def put_json(spark: SparkSession, path: str, value: object) -> None:
    put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def get_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def current(spark: SparkSession, path: str) -> dict | None:
    """What is recorded of the table's current generation: files, fingerprint, format, schema; None if there is no table."""
    at = f"{path.rstrip('/')}/{CURRENT}"
    return get_json(spark, at) if exists(spark, at) else None


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Data files of a folder, by name. The driver holds a name for each file."""
    _, p, fs, _ = _context(spark, folder)
    found = fs.listFiles(p, True)
    out = []
    while found.hasNext():
        name = found.next().getPath().toString()
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            out.append(name)
    return sorted(out)


def commit(spark: SparkSession, path: str, files: list[str], fingerprint: str, format: str, schema: str) -> dict:
    """Makes the named files the table's current generation, in one step."""
    state = {"schema_version": 1, "fingerprint": fingerprint, "format": format, "schema": schema, "files": files, "generation": uuid.uuid4().hex}
    put_json(spark, f"{path.rstrip('/')}/{CURRENT}", state)
    return state


def write(df: DataFrame, path: str, fingerprint: str = "", format: str = "parquet", rows_each: int = 0, **options: str) -> bool:
    """Writes ``df`` as the table's new generation; false if the current one has this (non-empty) fingerprint and nothing is written.

    The fingerprint says what the rows were made from, so a finished write is used again only for the same work, and an
    unfinished one never. Older generations stay until ``clean``. A writer that dies leaves files that no reader sees.
    """
    spark = df.sparkSession
    before = current(spark, path)
    if fingerprint and before and before["fingerprint"] == fingerprint:
        return False
    folder = f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
    writer = df.write.format(format).options(**options)
    (writer.option("maxRecordsPerFile", rows_each) if rows_each else writer).save(folder)
    commit(spark, path, _files(spark, folder), fingerprint, format, df.schema.json())
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current generation's rows; FileNotFoundError if nothing was ever committed."""
    from pyspark.sql.types import StructType

    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no table in {path}")
    schema = StructType.fromJson(json.loads(state["schema"]))
    if not state["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.format(state["format"]).schema(schema).load(state["files"])


def clean(spark: SparkSession, path: str, older_than: float = 0.0) -> list[str]:
    """Deletes data files that the current generation does not have and that are older than so many seconds; their names.

    Readers of older generations, and writers at work, must be done: ``older_than`` should exceed their longest time.
    """
    kept = set((current(spark, path) or {"files": []})["files"])
    gone = []
    for name in _files(spark, path):
        _, p, fs, _ = _context(spark, name)
        if name not in kept and "/data-" in name and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= older_than:
            fs.delete(p, False)
            gone.append(name)
    return gone


def upsert(updates: DataFrame, path: str, keys: list[str], fingerprint: str = "") -> dict[str, int]:
    """Replaces the stored rows that have an update's keys, adds those that have none, in one commit.

    Only files with a row of some update's keys are written anew; all others keep their names and bytes. Keys compare as null-safe
    equal, and must be unique in ``updates``. The driver sees the names of files, never rows.
    """
    spark, state = updates.sparkSession, current(updates.sparkSession, path)
    if state is None:
        write(updates, path, fingerprint)
        return {"rewritten": 0, "kept": 0}
    whole, marks = read(spark, path), updates.select(*[F.col(k).alias(f"__{k}") for k in keys])
    rewritten, kept, new = [], state["files"], updates.select(*whole.columns)
    if kept:
        stored = whole.withColumn("__file", F.col("_metadata.file_path"))
        met = stored.join(marks, [stored[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi").select("__file").distinct().collect()  # a name for each file
        plain = lambda name: unquote(name.split(":", 1)[-1]).lstrip("/")
        touched = {plain(r["__file"]) for r in met}
        rewritten, kept = [f for f in kept if plain(f) in touched], [f for f in kept if plain(f) not in touched]
    if rewritten:
        old = spark.read.format(state["format"]).schema(whole.schema).load(rewritten)
        new = old.join(marks, [old[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti").unionByName(new)
    folder = f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
    new.write.format(state["format"]).save(folder)
    commit(spark, path, kept + _files(spark, folder), fingerprint, state["format"], state["schema"])
    return {"rewritten": len(rewritten), "kept": len(kept)}
