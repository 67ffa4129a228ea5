"""Token arrays: the white-space tokenizer, UTF-8 bytes, and any tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def white_space(text: Column) -> Column:
    return words(text)


def white_space_all(texts: Column) -> Column:
    return F.transform(texts, words)


#: Texts, and their code points or ids (one longer text aside), that the library takes at a time: it holds many times an id's bytes of each token.
SLICE_TEXTS, SLICE_SIZE = 256, 1 << 20


def slices(sizes: Iterable[int]) -> Iterator[slice]:
    """Consecutive slices of SLICE_TEXTS texts and a size of SLICE_SIZE at most; a longer text is a slice of its own."""
    start = held = end = 0
    for end, n in enumerate(sizes):
        if end > start and (end - start == SLICE_TEXTS or held + n > SLICE_SIZE):
            yield slice(start, end)
            start, held = end, 0
        held += n
        end += 1
    if end > start:
        yield slice(start, end)


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what is parallel; threads of each would hold memory of their own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_texts(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in _library(path).encode_batch_fast(texts, add_special_tokens=False)]


def bpe(path: str):
    """A function of a text column: its ids, in slices of Arrow batches; null counts as empty."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            for part in slices(map(len, texts)):
                encoded = _library(path).encode_batch_fast(texts[part], add_special_tokens=False)
                yield pd.Series([np.array(e.ids, np.int32) for e in encoded])

    return encode


def bpe_all(path: str):
    """A function of a column of text arrays: an array of ids for each text."""

    @F.pandas_udf("array<array<int>>")
    def encode(rows: pd.Series) -> pd.Series:
        ids = iter(encode_texts(path, [t for row in rows for t in row]))
        return pd.Series([[next(ids) for _ in row] for row in rows])

    return encode


def bpe_text(path: str):
    """A function of a column of ids: the text that they decode to, in slices of Arrow batches."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            for part in slices(map(len, rows)):
                yield pd.Series(_library(path).decode_batch([r.tolist() for r in rows.iloc[part]], skip_special_tokens=False))

    return decode


def wrapped(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def fits_16_bits(ids: Column) -> Column:
    """The ids; raises if one does not fit in 16 bits."""
    return F.when(F.coalesce(F.array_max(ids), F.lit(0)) < 65536, ids).otherwise(F.raise_error(F.lit("an id does not fit in 16 bits")))
