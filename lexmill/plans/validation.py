"""What is wrong with files: manifests of SHA-256 digests and token binaries, scanned by tasks, reported as tables of errors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import _file_system

#: Bytes of a file that a task holds at a time.
CHUNK = 8 << 20


def files_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes) of a folder's files, with folders below it; names are relative to it. Hidden files do not count.

    Spark's file index lists the folder; the driver holds a name for each file, as that index does.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    plain = lambda path: F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    sized = found.select("path", F.col("length").alias("bytes"))
    names = spark.createDataFrame([(unquote(n),) for n in found.inputFiles()], "path string")
    empty = names.withColumn("key", plain("path")).join(sized.select(plain("path").alias("key")), "key", "left_anti")  # a scan leaves these out
    _, root = folder.split(":", 1) if ":" in folder.split("/")[0] else ("", folder)
    both = sized.unionByName(empty.select("path", F.lit(0).cast("long").alias("bytes")))
    return both.select("path", F.substring(plain("path"), len("/" + root.strip("/")) + 2, 1 << 30).alias("name"), "bytes")


def _sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
            files, at = _file_system(path)
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(at) as f:
                while block := f.read(CHUNK):
                    digest.update(block)
                    size += len(block)
            yield pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})


def file_digests(files: DataFrame, tasks: int = 0) -> DataFrame:
    """(name, bytes, sha256) of the files of ``files_of``: each is read once, in chunks, by one task; the driver reads none.

    A digest is of a whole file, so a file is a task's work at least; write data in shards. Nothing is listed twice.
    """
    n = tasks or files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path", "name").repartition(n, "path").mapInArrow(_sha256, "name string, bytes long, sha256 string")


def manifest_errors(recorded: DataFrame, spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, error): files of a manifest (name, bytes, sha256) that are missing, of another size or content, and files that it lacks.

    Sizes are compared first, and only files of the right size are read.
    """
    there = files_of(spark, folder, pattern).withColumnRenamed("bytes", "__bytes")
    met = recorded.join(there, "name", "full")
    sized = met.withColumn("error", F.when(F.col("path").isNull(), F.lit("missing")).when(F.col("sha256").isNull(), F.lit("not in the manifest")).when(
        F.col("bytes") != F.col("__bytes"), F.concat(F.col("__bytes"), F.lit(" bytes, not "), F.col("bytes"))
    ))
    now = file_digests(sized.where("error is null").select("path", "name")).select("name", F.col("sha256").alias("__sha256"))
    other = recorded.join(now, "name").where("sha256 <> __sha256").select("name", F.lit("other content").alias("error"))
    return sized.where("error is not null").select("name", "error").unionByName(other)


# ---- token binaries ----
def _scan(batches: Iterator[pa.RecordBatch], dtype: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    width = np.dtype(dtype).itemsize
    for batch in batches:
        for path, name, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "at", "n"))):
            files, place = _file_system(path)
            with files.open_input_file(place) as f:
                raw = f.read_at(n, at)
            ids = np.frombuffer(raw[: len(raw) // width * width], dtype)
            yield pa.RecordBatch.from_pydict({
                "name": [name], "bytes": [len(raw)], "tokens": [len(ids)], "least": pa.array([int(ids.min()) if len(ids) else None], pa.int64()),
                "most": pa.array([int(ids.max()) if len(ids) else None], pa.int64()), "outside": [int((ids >= vocabulary).sum())],
                "total": pa.array([int(ids.sum(dtype=np.int64))], pa.int64()),
            })


def scan_parts(spark: SparkSession, folder: str, vocabulary: int, dtype: str = "<u2", chunk: int = CHUNK, pattern: str = "*.bin") -> DataFrame:
    """(name, bytes, tokens, least, most, outside, total) of each part of a token binary: every id is read, in chunks by as many tasks.

    ``outside`` counts ids that are not below ``vocabulary``. An empty file has no tokens and null bounds.
    """
    width = np.dtype(dtype).itemsize
    if chunk % width:
        raise ValueError(f"chunks must be whole items of {width} bytes")
    found = files_of(spark, folder, pattern)
    cut = found.select("path", "name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("at"))
    cut = cut.select("path", "name", "at", F.least(F.lit(chunk), F.col("bytes") - F.col("at")).alias("n")).repartition("path", "at")
    read = cut.mapInArrow(lambda b: _scan(b, dtype, vocabulary), "name string, bytes long, tokens long, least long, most long, outside long, total long")
    return read.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens")], F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in ("outside", "total")])


def part_table(spark: SparkSession, total: int, items: int) -> DataFrame:
    """(name, expected) of the parts that ``write_token_binary`` makes of a stream."""
    k = F.col("id")
    return spark.range(-(-total // items)).select(F.concat(F.lit("tokens-"), F.lpad(k.cast("string"), 6, "0"), F.lit(".bin")).alias("name"), F.least(F.lit(items), F.lit(total) - k * items).alias("expected"))


def token_part_errors(scanned: DataFrame, parts: DataFrame, item_bytes: int = 2) -> DataFrame:
    """(name, error) for ``scan_parts`` against ``part_table``: all errors, none if the binary is as it should be."""
    met = parts.join(scanned, "name", "full")
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    col = lambda c: F.col(c).cast("string")
    checks = F.array(
        F.when(F.col("tokens").isNull(), F.lit("missing")),
        F.when(F.col("expected").isNull(), F.lit("not a part of the stream")),
        F.when(F.col("tokens") != F.col("expected"), text(col("tokens"), " tokens, not ", col("expected"))),
        F.when(F.col("bytes") != F.col("tokens") * item_bytes, text(col("bytes"), " bytes for ", col("tokens"), " tokens")),
        F.when(F.col("outside") > 0, text(col("outside"), " ids outside the vocabulary, up to ", col("most"))),
    )
    return met.select("name", F.explode(F.filter(checks, lambda e: e.isNotNull())).alias("error"))


def state_errors(state: dict, sources: DataFrame, expected: int, vocabulary: int, tokenizer: str) -> DataFrame:
    """(name, error) for what is recorded of a token binary: its tokens, target, vocabulary, tokenizer, and the tokens of its sources.

    ``sources`` has source, quota and tokens; sources that differ from their quotas are named, however many they are.
    """
    spark = sources.sparkSession
    wrong = [
        ("state", f"{state.get(k)} {k}, not {want}")
        for k, want in (("tokens", expected), ("target_tokens", expected), ("vocab_size", vocabulary), ("tokenizer_sha256", tokenizer))
        if state.get(k) != want
    ]
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    if total != expected:
        wrong.append(("sources", f"{total} tokens, not {expected}"))
    each = sources.where(~F.col("tokens").eqNullSafe(F.col("quota"))).select(
        F.col("source").alias("name"), F.concat(F.coalesce(F.col("tokens").cast("string"), F.lit("no")), F.lit(" tokens, not "), F.col("quota").cast("string")).alias("error")
    )
    return spark.createDataFrame(wrong, "name string, error string").unionByName(each)


def require(errors: DataFrame, shown: int = 20) -> None:
    """Raises ValueError with the first errors, as a start of training must; nothing if there are none."""
    found = errors.orderBy("name", "error").limit(shown + 1).collect()
    if found:
        raise ValueError("; ".join(f"{r['name']}: {r['error']}" for r in found[:shown]) + ("; and more" if len(found) > shown else ""))


# ---- training configurations ----
#: Fixed: values that must be above zero, and the types of numbers a model may have.
POSITIVE = ("batch_size", "gradient_accumulation_steps", "learning_rate", "max_steps", "save_steps", "grad_clip")
DTYPES = ("float32", "float16", "bfloat16")


def training_errors(config: dict) -> list[str]:
    """What is wrong with the ``training`` section of a configuration."""
    section = config.get("training", {})

    def number(name: str) -> float:
        try:
            return float(section.get(name, 0) or 0)
        except (TypeError, ValueError):
            return float("nan")

    wrong = [f"training.{n} is {section.get(n)!r}, not above 0" for n in POSITIVE if not number(n) > 0]
    if not number("warmup_steps") >= 0:
        wrong.append(f"training.warmup_steps is {section.get('warmup_steps')!r}, below 0")
    if section.get("dtype") not in DTYPES:
        wrong.append(f"training.dtype is {section.get('dtype')!r}, none of {', '.join(DTYPES)}")
    return wrong


def completion_errors(spark: SparkSession, checkpoint: str, expected_step: int) -> list[str]:
    """Why a run is not complete: its checkpoint or the metadata beside it is missing, or their steps are others."""
    from ..sources import commit

    beside = checkpoint.rsplit(".", 1)[0] + ".json" if "." in checkpoint.rsplit("/", 1)[-1] else checkpoint + ".json"
    gone = [p for p in (checkpoint, beside) if not commit.exists(spark, p)]
    if gone:
        return [f"missing: {p}" for p in gone]
    about = commit.get_json(spark, beside)
    step, last = int(about.get("step", -1)), int(about.get("max_steps", expected_step))
    return [f"{k} is {v}, not {expected_step}" for k, v in (("step", step), ("max_steps", last)) if v != expected_step]


def ready(spark: SparkSession, config: dict, items: int) -> dict:
    """What a training would start on: tokens and parts; raises ValueError with what is wrong if it must not start.

    ``config`` has sections model (vocab_size), training, and data: train_bin, the folder of a token binary whose parts have
    ``items`` tokens and beside which ``state.json`` lies. Sections, state, parts and every id are checked, and all errors said.
    """
    from ..sources import commit

    folder, vocabulary = config["data"]["train_bin"], config["model"]["vocab_size"]
    where = f"{folder.rstrip('/')}/state.json"
    if not commit.exists(spark, where):
        raise ValueError(f"missing: {where}")
    state = commit.get_json(spark, where)
    tokens, target = state.get("tokens", -1), state.get("target_tokens", -1)
    wrong = [("config", e) for e in training_errors(config)]
    wrong += [("state", f"{tokens} tokens, not {target}")] if tokens <= 0 or tokens != target else []
    errors = spark.createDataFrame(wrong, "name string, error string")
    parts = part_table(spark, max(target, 0), items)
    require(errors.unionByName(token_part_errors(scan_parts(spark, folder, vocabulary), parts)))
    return {"tokens": tokens, "parts": -(-target // items), "vocab_size": vocabulary}
