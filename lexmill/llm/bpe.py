"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut in front of white space that follows something else: no match of the splitting pattern spans such
a place and none looks across it, so the parts' ids in a row are the ids of the whole. A long run of white space, over
which the library's regular expression would run out of stack, is one match up to its last character (the last one too
at the end of a text), and is merged as one piece without the expression.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Code points from which on a text is encoded in parts, and about how many each part has.
PART = 1 << 16
SAFE = re.compile(r"(?<=\S)[ \t\n\r]")
#: White space as Unicode has it (which the library's expressions follow), and runs of it that are merged as one piece.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 4096


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank on each line), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that are safe to encode each by itself; longer than ``size`` only where no cut is safe."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(f"[{WHITE}]{{{least},}}")


def encode(enc: tiktoken.Encoding, text: str, run: int = RUN, size: int = PART) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers. ``run``: white-space characters (2 at least) from which on a run is one piece."""
    if len(text) <= min(run, size):
        return np.array(enc.encode_ordinary(text), "<u4")
    ids, at = [np.empty(0, "<u4")], 0
    for found in _runs(run).finditer(text):
        end = found.end() - (found.end() < len(text))
        ids += [np.array(enc.encode_ordinary(p), "<u4") for p in parts(text[at : found.start()], size)]
        ids.append(np.array(enc._encode_single_piece(text[found.start() : end]), "<u4"))
        at = end
    return np.concatenate([*ids, *(np.array(enc.encode_ordinary(p), "<u4") for p in parts(text[at:], size))])


def decode(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids, whether or not they are whole UTF-8 characters."""
    return enc.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, pattern: str, decode_too: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    With ``decode_too`` also ``bytes``, the raw bytes that the ids decode to. A null text counts as empty (no tokens).
    Whole texts of any length are encoded, in parts that no match spans; null ids and repeated rows are kept; other columns are not
    read; an empty table gives an empty result. ``path`` must be readable on the executors. No shuffle.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        enc = encoding(path, pattern)
        ids = [encode(enc, t or "") for t in batch["text"]]
        out = {"doc_id": batch["id"], "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}
        return out | {"bytes": [decode(enc, x) for x in ids]} if decode_too else out

    schema = "doc_id long, n_tokens long, ids binary" + ", bytes binary" * decode_too
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema)


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded``'s rows with the raw bytes that their ids stand for in ``bytes``.

    Null ids (binary) count as none: no bytes. Null doc_ids and repeated rows are kept, columns other than ``encoded``'s
    are not read, an empty table gives an empty result. An id that the rank file lacks fails the task.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        enc = encoding(path, pattern)
        return batch | {"bytes": [decode(enc, np.frombuffer(x or b"", "<u4")) for x in batch["ids"]]}

    return map_arrow(tokens.select("doc_id", "n_tokens", "ids"), rows, "doc_id long, n_tokens long, ids binary, bytes binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex) of ``decoded``'s rows."""
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
