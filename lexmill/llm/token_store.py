"""Token files: ids in patched frame-of-reference blocks, with an index of block starts.

A file is the magic bytes, then blocks of up to BLOCK ids, then an index, then a trailer. A block subtracts its least
id and packs the rest at a width taken from the percentiles of their bit lengths, whichever makes it smallest; ids too
wide for it stand in an exception list of places and values. The index has each block's place in the file and each
document's id and first token, so any span is read without the blocks before it. Integers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_arrow, range_cuts, range_of, shared_path, slices

MAGIC = b"LXMTOK01"
BLOCK = 8192
#: Percentiles of bit lengths that a block's width is chosen from.
PERCENTILES = (50, 75, 90, 95, 98, 100)
BLOCK_HEAD, TRAILER = struct.Struct("<IIBI"), struct.Struct("<QIIQ8s")
#: Ids after which a task begins another file.
FILE_TOKENS = 1 << 26


def _bits(values: np.ndarray, width: int) -> bytes:
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    each = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize), axis=1, bitorder="little")
    return np.packbits(each[:, :width], bitorder="little").tobytes()


def _values(packed: bytes, n: int, width: int) -> np.ndarray:
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    each = np.zeros((n, kind.itemsize * 8), np.uint8)
    each[:, :width] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(each, axis=1, bitorder="little").view(kind).ravel().astype(np.uint32)


#: Bit lengths of 16-bit numbers.
LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _lengths(values: np.ndarray) -> np.ndarray:
    return LENGTHS[values] if values.max() < 1 << 16 else np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_block(ids: np.ndarray) -> bytes:
    """1 to BLOCK ids as a block."""
    ids = ids.astype(np.uint32)
    least = ids.min()
    rest = ids - least
    lengths = _lengths(rest)
    counts = np.bincount(lengths, minlength=33)
    wider = len(ids) - np.cumsum(counts)
    ranks = [-(-len(ids) * p // 100) - 1 for p in PERCENTILES]
    widths = sorted({int(x) for x in np.searchsorted(np.cumsum(counts), np.array(ranks) + 1)})
    width = min(widths, key=lambda w: (-(-len(ids) * w // 8) + 6 * int(wider[w]), w))
    places = np.flatnonzero(lengths > width)
    packed = _bits(np.where(lengths > width, 0, rest), width) if width else b""
    return BLOCK_HEAD.pack(len(ids), int(least), width, len(places)) + packed + places.astype("<u2").tobytes() + rest[places].astype("<u4").tobytes()


def unpack_block(block: bytes) -> np.ndarray:
    n, least, width, k = BLOCK_HEAD.unpack_from(block)
    at = BLOCK_HEAD.size + -(-n * width // 8)
    rest = _values(block[BLOCK_HEAD.size : at], n, width) if width else np.zeros(n, np.uint32)
    rest[np.frombuffer(block, "<u2", k, at)] = np.frombuffer(block, "<u4", k, at + 2 * k)
    return rest + np.uint32(least)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; Spark's names of the S3 connector (s3a, s3n) are Arrow's s3."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; it is there under its name only when closed."""

    def __init__(self, path: str):
        self.files, self.path = _open(path)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.files.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.at, self.held, self.waiting = len(MAGIC), [], 0
        self.blocks: list[int] = []
        self.ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        done = 0
        while len(ids) - done >= max(1, least):
            block = pack_block(ids[done : done + BLOCK])
            self.blocks.append(self.at)
            self.out.write(block)
            self.at += len(block)
            done += BLOCK
        self.held, self.waiting = [ids[done:]], max(0, len(ids) - done)

    def close(self) -> dict[str, object]:
        if self.waiting:
            self._flush(1)
        known = np.array([x is not None for x in self.ids], np.uint8)
        index = np.array(self.blocks, "<u8").tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes() + known.tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index + TRAILER.pack(self.at, len(self.blocks), len(self.ids), self.starts[-1], MAGIC))
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        return {"n_docs": len(self.ids), "n_tokens": self.starts[-1]}


class Reader:
    """Reads a file by its index."""

    def __init__(self, path: str):
        files, name = _open(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        self.index_at, n_blocks, n_docs, self.n_tokens, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        index, at = self.file.read_at(size - TRAILER.size - self.index_at, self.index_at), 0
        self.blocks = [*np.frombuffer(index, "<u8", n_blocks, at).tolist(), self.index_at]
        at += 8 * n_blocks
        ids, known = np.frombuffer(index, "<i8", n_docs, at).tolist(), np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs)
        self.ids = [x if k else None for x, k in zip(ids, known)]
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        return unpack_block(self.file.read_at(self.blocks[i + 1] - self.blocks[i], self.blocks[i]))

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` up to ``end``."""
        if start >= end:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        return np.concatenate([self.block(i) for i in range(first, (end - 1) // BLOCK + 1)])[start - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start and ids of each document in order; every block is read once."""
        held, at, nxt = np.empty(0, np.uint32), 0, 0  # the ids from place ``at`` on, up to block ``nxt``
        for k, doc_id in enumerate(self.ids):
            start, end = int(self.starts[k]), int(self.starts[k + 1])
            more = []
            while nxt * BLOCK < end:
                more.append(self.block(nxt))
                nxt += 1
            if more:
                held, at = np.concatenate([held[start - at :], *more]), start
            yield doc_id, start, held[start - at : end - at]


class PieceEncoder:
    """Ids by the tokenizers library, which is asked once for each distinct stretch of text it has not seen lately.

    A text is cut in front of each space that follows something else than white space. No match of the byte-level
    splitting pattern spans such a place and none looks across it, so the stretches' ids in a row are the ids of the
    whole text. Stretches new to this process are handed to the library in rows of ROW, as one text; as each stands in
    front of a safe place, and the ids of a stretch stand for just its bytes, sums of the ids' byte lengths part them.
    Names of special tokens in a text are found by the library as in an untouched ``Tokenizer``: ``<|endoftext|>`` has
    one id. A tokenizer for which these cuts are not safe is asked for whole texts.
    """

    #: Bytes of stretches remembered, the longest of them, stretches in a row, bytes of text worked on at a time.
    KEPT, LONGEST, ROW, GROUP = 8 << 20, 64, 256, 8 << 20
    # white space that a space follows: RE2 for Arrow, and what Python takes for white space
    UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\pZ] "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = made["added_tokens"]
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made["normalizer"]
        self.cuts = plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in added)
        self.byte_lengths = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.byte_lengths[i] = len(token)  # a character for each byte
        for x in added:
            self.byte_lengths[x["id"]] = len(x["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_ids, self.known_ends = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)

    def groups(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The texts in order, in runs of about GROUP bytes (of one text at least)."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.GROUP, "right")))
            yield texts.slice(at, to - at)
            at = to

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. Null texts are not taken."""
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if not self.cuts:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        return list(chain.from_iterable(map(self._group, self.groups(texts))))

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        unsafe = pc.match_substring_regex(texts, self.UNSAFE)
        if pc.any(unsafe).as_py():
            pieces = pa.array([self._joined(p) if bad else p for p, bad in zip(pieces.to_pylist(), unsafe.to_pylist())], pieces.type)
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        first = offsets[:-1]  # the first piece of a text has no space in front
        coded = flat.dictionary_encode()
        places = coded.indices.to_numpy()
        ids, ends = self._ids(coded.dictionary, np.bincount(places, minlength=len(coded.dictionary)) > 1)
        heads = self._asked(pc.take(flat, pa.array(first)).to_pylist())
        places = places.copy()
        places[first] = np.arange(len(ends), len(ends) + len(first))
        ids, ends = self._after(ids, ends, *heads)
        lengths = np.diff(ends, prepend=0)
        each = lengths[places]
        through = np.cumsum(each)
        whole = ids[np.repeat((ends - lengths)[places] - through + each, each) + np.arange(through[-1] if len(through) else 0)]
        bounds = np.append(0, through)[offsets].tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        """The pieces of a split at spaces, with those put together again between which a cut is not safe."""
        runs = [pieces[:1]]
        for x in pieces[1:]:
            last = runs[-1][-1]
            if not last or last[-1].isspace():
                runs[-1].append(x)
            else:
                runs.append([x])
        return [" ".join(r) for r in runs]

    @staticmethod
    def _after(ids: np.ndarray, ends: np.ndarray, more: np.ndarray, more_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([ids, more]), np.append(ends, more_ends + len(ids))

    def _ids(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words, each with a space in front, and where each word's end. Those marked in ``often`` are remembered."""
        at = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        asked = pc.take(words, pa.array(new))
        # white space at its end, or nothing behind its space, is no safe place to go on from
        alone = pc.match_substring_regex(asked, r"(^|[\s\x0b\x1c-\x1f\x{85}\pZ])$").to_numpy(zero_copy_only=False)
        single = self._asked([" " + x for x in pc.filter(asked, pa.array(alone)).to_pylist()])
        many = self._asked_in_rows(pc.filter(asked, pa.array(~alone)))
        order = np.empty(len(words), np.int64)  # each word's place in what is known, then asked in rows, then asked alone
        known = at >= 0
        order[known] = at[known]
        order[new[~alone]] = np.arange(len(many[1])) + len(self.known_ends)
        order[new[alone]] = np.arange(len(single[1])) + len(self.known_ends) + len(many[1])
        ids, ends = self._after(*self._after(self.known_ids, self.known_ends, *many), *single)
        lengths = np.diff(ends, prepend=0)
        each = lengths[order]
        through = np.cumsum(each)
        ids = ids[np.repeat((ends - lengths)[order] - through + each, each) + np.arange(through[-1] if len(through) else 0)]
        keep = new[often[new] & (pc.binary_length(asked).to_numpy(zero_copy_only=False) <= self.LONGEST)]
        if self.known.nbytes > self.KEPT:
            self._forget()
        if len(keep):
            kept = np.repeat(through[keep] - np.cumsum(each[keep]), each[keep]) + np.arange(each[keep].sum())
            self.known = pa.concat_arrays([self.known, pc.take(words, pa.array(keep))])
            self.known_ids, self.known_ends = self._after(self.known_ids, self.known_ends, ids[kept], np.cumsum(each[keep]))
        return ids, through

    def _asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the texts, and where each text's end."""
        got = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *got]), np.cumsum([*map(len, got)], dtype=np.int64)

    def _asked_in_rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a space in front, each of which ends at a safe place."""
        n = len(words)
        lists = pa.ListArray.from_arrays(pa.array([*range(0, n, self.ROW), n], pa.int32()), words) if n else pa.array([], pa.list_(pa.string()))
        ids, _ = self._asked([" " + x for x in pc.binary_join(lists, " ").to_pylist()])
        through = np.cumsum(self.byte_lengths[ids])
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
        cuts = np.searchsorted(through, ends) + 1
        if n and (cuts[-1] != len(ids) or (through[cuts - 1] != ends).any()):
            raise ValueError("ids of a stretch do not stand for its bytes")
        return ids, cuts


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this process, which keeps what it has seen from task to task."""
    return PieceEncoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, rows_each: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Writes the table's token files and returns the manifest: (path, first token, documents, tokens) in order.

    Documents stand in ascending doc_id (null ids first; rows of one id by their texts), each with ``end_id`` at its
    end; null texts are empty; an empty table has no files. ``tokenizer`` is a path that executors can read; ``folder``
    is one that all share (default: a new one in spark.checkpoint.dir). Texts are shuffled once, to ranges of about
    ``rows_each`` ids; each range is sorted and written by one task. A task that is run again writes under new names,
    and only files of finished tasks are in the manifest, which has a row for each file.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = range_cuts(d, "doc_id", rows_each)
    dealt = d.withColumn("part", range_of(F.coalesce("doc_id", F.lit(-(1 << 63))), cuts).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        writer, part, end = None, None, np.array([end_id], "<u4")

        def close() -> None:
            if writer:
                made.append((writer_path, part, len(made), *writer.close().values()))

        for batch in slices(batches, 4096):
            ids, parts = (batch.column(k).to_pylist() for k in ("doc_id", "part"))
            for doc_id, p, tokens in zip(ids, parts, encoder(tokenizer).encode(batch.column("text"))):
                if p != part or writer.starts[-1] >= FILE_TOKENS:
                    close()
                    writer_path = f"{folder}/part-{p:06d}-{len(made):04d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.lxt"
                    writer, part = Writer(writer_path), p
                writer.add(doc_id, np.concatenate([tokens, end]))
        close()
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["path", "part", "seq", "n_docs", "n_tokens"])

    in_order = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    written = in_arrow(in_order, run, "path string, part int, seq int, n_docs long, n_tokens long")
    manifest, start = [], 0
    for r in sorted(written.collect(), key=lambda r: (r["part"], r["seq"])):
        manifest.append((r["path"], start, r["n_docs"], r["n_tokens"]))
        start += r["n_tokens"]
    return manifest


def read(spark: SparkSession, manifest: list[tuple[str, int, int, int]], use: Callable[[np.ndarray], object] | None = None, column: str = "ids", kind: str = "binary") -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, and what ``use`` makes of its ids (default: their bytes).

    A null doc_id is null again, and a document that was null or empty has its end id alone. An empty manifest gives an empty table.
    """
    schema = f"doc_id long, start long, n_tokens long, {column} {kind}"
    use = use or (lambda ids: ids.astype("<u4").tobytes())
    if not manifest:
        return spark.createDataFrame([], schema)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, start, ids in Reader(path).documents():
                    rows.append((doc_id, first + start, len(ids), use(ids)))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    files = spark.createDataFrame(manifest, "path string, start long, n_docs long, n_tokens long").select("path", "start")
    return in_arrow(files.repartition(len(manifest)), run, schema)


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
