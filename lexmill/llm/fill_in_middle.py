"""Fill-in-the-middle transformation: a text's middle goes to its end, cut at the ends of units.

Units are matched left to right by one pattern. Their end offsets are gathered in a compact array, so a cut is two
lookups in it. Where the cuts are and which form a text takes follow from a digest of its id, so that a row has the same
result in every run.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, released

# Fixed formats: the units, and the marks before a prefix, a suffix and a middle.
UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    """Percentages of texts that are rearranged, and of those that have their suffix first."""

    rate: int = 90
    suffix_first: int = 20
    version: int = 1


@dataclass(frozen=True)
class Made:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def ends(text: str, units: regex.Pattern) -> array:
    """Where the units end, 8 bytes each."""
    return array("Q", (m.end() for m in units.finditer(text)))


def draws(doc_id: int | str | None, version: int) -> list[int]:
    """Four numbers below 2^32 from the id; a null id has those of an empty one."""
    digest = hashlib.sha256(f"{version}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | str | None, text: str | None, units: regex.Pattern = regex.compile(UNITS), settings: Settings = Settings()) -> Made:
    """The text as it is (plain), or with its prefix (psm) or its suffix (spm) first and its middle last.

    A null text counts as empty. Texts that are empty or hold a mark stay plain, as nothing could tell the parts apart.
    """
    text = text or ""
    places = ends(text, units)
    n = len(places)
    h1, h2, h3, h4 = draws(doc_id, settings.version)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= settings.rate:
        return Made(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (places[k - 1] if k else 0 for k in (low, high))
    if high == n:
        b = len(text)  # also where the units leave a rest that none matches
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < settings.suffix_first:
        return Made(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Made(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that became ``output`` in this form."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    first, second = head[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


RESULT = "n long, form string, prefix_chars long, middle_chars long"


def _transformer(pattern: str, settings: Settings, with_output: bool) -> Column:
    """The pandas UDF of (id, text): RESULT and the output, or RESULT and digests of the output and of the text rebuilt from it."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(pattern)
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts):
                made = transform(None if pd.isna(i) else i, t, units, settings)
                last = (made.output,) if with_output else (sha256(made.output), sha256(restored(made.output, made.form)))
                rows.append((made.n, made.form, made.prefix_chars, made.middle_chars, *last))
            frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", *(["output"] if with_output else ["output_sha256", "restored_sha256"])])
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        released()

    return F.pandas_udf(run, RESULT + (", output string" if with_output else ", output_sha256 string, restored_sha256 string"))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), pattern: str = UNITS) -> DataFrame:
    """The rows of ``docs`` with the text replaced by its output, and n, form, prefix_chars and middle_chars of it.

    n is the number of units; lengths are in code points and null where the form is plain. A null text counts as empty
    and becomes one; a null id draws as an empty one does; rows that share an id draw alike. Repeated rows and whole
    texts of any length pass; columns of ``docs`` named like a result are replaced, others kept, whatever their names. An
    empty table gives an empty one. No shuffle.
    """
    row, made = "row", "made"
    both = docs.select(as_rows(docs).alias(row), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    run = _transformer(pattern, settings, with_output=True)
    done = both.select(row, run("id", "text").alias(made))
    results = ["n", "form", "prefix_chars", "middle_chars"]
    keep = [c for c in docs.columns if c.lower() not in {text_col.lower(), *results}]
    quoted = lambda c: f"{row}.`{c.replace('`', '``')}`"
    return done.select(*[F.col(quoted(c)).alias(c) for c in keep], F.col(f"{made}.output").alias(text_col), *[F.col(f"{made}.{r}").alias(r) for r in results])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), pattern: str = UNITS) -> DataFrame:
    """doc_id, RESULT, and digests of each output and of the text that is rebuilt from it, one row for each row.

    Nulls, empty and long texts, repeated rows and empty tables as in ``transformed``; other columns are not read.
    """
    run = _transformer(pattern, settings, with_output=False)
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(id_col).cast("string"), F.col(text_col)).alias("made"))
    return made.select("doc_id", "made.*")
