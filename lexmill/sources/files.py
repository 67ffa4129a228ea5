"""Files: JSONL folders in a fixed order, lines with their places, raw 16-bit token binaries."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl_paths(spark: SparkSession, path: str) -> list[str]:
    """A file itself; of a folder its ``*.jsonl`` in order, then its ``*.jsonl.gz``. Works on any file system of Spark's."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.isFile(hadoop):
        return [path]
    names = sorted(s.getPath().toString() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
    return [n for n in names if n.endswith(".jsonl")] + [n for n in names if n.endswith(".jsonl.gz")]


def training_paths(spark: SparkSession, path: str) -> list[str]:
    """As ``jsonl_paths``; raises FileNotFoundError if there are none."""
    if not (paths := jsonl_paths(spark, path)):
        raise FileNotFoundError(f"no JSONL files in {path}")
    return paths


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, ord, value): every line of the files, blank ones too, with its file's place and its own.

    Lines are numbered within the splits that files are read in, and from the counts of the splits before.
    """
    if not paths:
        return spark.createDataFrame([], "file int, ord long, value string")
    places = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p.rsplit("/", 1)[-1], i)])
    read = spark.read.text(paths).select("value", places[F.col("_metadata.file_name")].alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("turn"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = read.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("turn"))
    return read.withColumn("i", inside).join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("i") - 1).alias("ord"), "value")


def not_blank(line: Column) -> Column:
    from ..functions.text import non_blank

    return non_blank(line).isNotNull()


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSONL files; blank lines are skipped and a broken one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(training_paths(spark, path))


def first_lines(rows: DataFrame, limit: int) -> DataFrame:
    """Of ``lines``, those among the first ``limit`` of each file that are not blank; blank ones count."""
    return rows.where((F.col("ord") < limit) & not_blank(F.col("value")))


def row_at(rows: DataFrame, file: int, ord: int) -> DataFrame:
    """The line at one place of ``lines``: random access by place, with filters in place of an index of byte offsets."""
    return rows.where((F.col("file") == file) & (F.col("ord") == ord))


class Revisions:
    """Revisions of repositories by a lookup, which is asked once for each; one that cannot be looked up has none, with a warning."""

    def __init__(self, lookup: Callable[[str], str]):
        self.lookup, self.known = lookup, {}

    def __call__(self, repository: str) -> str | None:
        if repository not in self.known:
            try:
                self.known[repository] = self.lookup(repository)
            except Exception as error:  # an unpinned source is read as it is now
                warnings.warn(f"no revision of {repository}: {error}", stacklevel=2)
                self.known[repository] = None
        return self.known[repository]

    def plan(self, sources: list[dict]) -> list[dict]:
        """The sources, each with the revision of its ``repository``."""
        return [{**s, "revision": self(s["repository"])} for s in sources]


def pinned(reader, revision: str | None):
    """A reader with the option of a revision, where there is one."""
    return reader if revision is None else reader.option("revision", revision)


def opened(load, schema: str, spark: SparkSession) -> DataFrame:
    """What ``load()`` gives, or an empty table of the schema if it cannot be opened."""
    try:
        df = load()
        df.schema  # noqa: B018  resolves the source
        return df
    except Exception:  # an unavailable source gives no rows
        return spark.createDataFrame([], schema)


def _file_system(path: str):
    """Arrow's file system and the path in it; Spark's names of the S3 connector (s3a, s3n) are Arrow's s3. Local names are taken as they stand."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


#: Tokens of a part of a token binary: what an interrupted build loses at most.
PART_TOKENS = 10_000_000


def write_token_binary(stream: DataFrame, folder: str, total: int, plan: object, tokenizer: str, items: int = PART_TOKENS, dtype: str = "<u2") -> dict:
    """Writes a token stream as raw parts ``tokens-<n>.bin`` of ``items`` tokens and returns the state it saves beside them.

    ``stream`` has ``start``, the place of a row's first token, and ``ids``. A row is cut where parts meet, so what is
    shuffled is a piece for each row and part; a part is sorted and written by one task, under a name of its own until
    it is whole. Run again with the same plan and tokenizer, it writes only the parts that are missing; another plan, an
    id that does not fit, and a stream that does not fill ``total`` are errors. ``state.json`` has schema_version,
    tokens, target_tokens, plan_sha256 and sources.
    """
    from ..plans.artifacts import check_resume, plan_fingerprint

    spark, mark, width, most = stream.sparkSession, plan_fingerprint(plan, tokenizer), np.dtype(dtype).itemsize, np.iinfo(dtype).max
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    state_file = f"{root}/state.json"

    def save(tokens: int) -> dict:
        state = {"schema_version": 1, "tokens": tokens, "target_tokens": total, "plan_sha256": mark, "sources": plan}
        with files.open_output_stream(state_file + ".tmp") as f:
            f.write(json.dumps(state).encode())
        files.move(state_file + ".tmp", state_file)
        return state

    from pyarrow import fs

    def size(path: str) -> int:
        info = files.get_file_info(path)
        return info.size if info.type == fs.FileType.File else -1

    if size(state_file) >= 0:
        with files.open_input_stream(state_file) as f:
            check_resume(json.loads(f.read()), mark)
    else:
        save(0)
    parts = -(-total // items)
    lengths = [min(items, total - k * items) for k in range(parts)]
    missing = [k for k in range(parts) if size(f"{root}/tokens-{k:06d}.bin") != width * lengths[k]]
    end = F.col("start") + F.size("ids")
    pieces = (
        stream.where(F.size("ids") > 0).withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / items), F.floor((end - 1) / items))))
        .withColumns({"a": F.greatest(F.col("start"), F.col("part") * items), "b": F.least(end, (F.col("part") + 1) * items, F.lit(total))}).where("b > a")
        .select(F.col("part").cast("int"), "a", F.slice("ids", (F.col("a") - F.col("start") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("ids"))
    )

    def run(batches):
        import pyarrow as pa

        out, now, held, done = _file_system(folder)[0], None, None, 0

        def close():
            if held is not None:
                held[0].close()
                if done == lengths[now]:
                    out.move(held[1], f"{root}/tokens-{now:06d}.bin")
                else:
                    out.delete_file(held[1])
            return pa.RecordBatch.from_pydict({"part": [now] if held else [], "tokens": [done] if held else []}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64())]))

        for batch in batches:
            for part, a, ids in zip(batch.column("part").to_pylist(), batch.column("a").to_pylist(), batch.column("ids")):
                if part != now:
                    if held:
                        yield close()
                    name = f"{root}/tokens-{part:06d}.{uuid.uuid4().hex}.part"
                    now, held, done = part, (out.open_output_stream(name), name), 0
                values = ids.values.to_numpy(zero_copy_only=False)
                if a != part * items + done:
                    raise ValueError(f"the stream has no token at place {part * items + done}")
                if len(values) and not 0 <= values.min() <= values.max() <= most:
                    raise ValueError(f"an id does not fit in {width} bytes")
                held[0].write(values.astype(dtype).tobytes())
                done += len(values)
        if held:
            yield close()

    if missing:
        wanted = pieces.join(F.broadcast(spark.createDataFrame([(k,) for k in missing], "part int")), "part", "left_semi")  # a row for each part
        made = wanted.repartitionById(parts, "part").sortWithinPartitions("part", "a").mapInArrow(run, "part int, tokens long").collect()
        got = {r["part"]: r["tokens"] for r in made}
        short = [k for k in missing if got.get(k, 0) != lengths[k]]
        if short:
            save(sum(lengths[: short[0]]))
            raise ValueError(f"the stream is exhausted: part {short[0]} has {got.get(short[0], 0)} of {lengths[short[0]]} tokens")
    return save(total)


def token_binary(spark: SparkSession, path: str, dtype: str = "<u2", items: int = 1 << 20) -> DataFrame:
    """(name, start, ids) runs of a raw token file or folder of them, each with the place of its first token."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    width = np.dtype(dtype).itemsize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, start, n in frame[["path", "start", "n"]].itertuples(index=False):
                files, at = _file_system(name)
                with files.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(int(n) * width, int(start) * width), dtype)
                yield pd.DataFrame({"name": [name.rsplit("/", 1)[-1]], "start": [int(start)], "ids": [ids.astype("int32")]})

    size = F.floor(F.col("length") / width)
    cut = found.where(size > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(items).cast("long"))))
    return cut.select("path", "start", F.least(F.lit(items), size - F.col("start")).alias("n")).mapInPandas(run, "name string, start long, ids array<int>")
