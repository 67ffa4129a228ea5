"""Document fingerprints from prefix polynomial hashes.

Two modular prefix arrays of a text answer whether any two spans are equal, and by binary search how long two texts
agree from given places. A fingerprint keeps, of these arrays: the length and the hash of the whole text, hashes of
prefixes and suffixes whose lengths form a fixed grid (every length to 16, then geometric), and the least hashes of its fixed-width spans.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_arrow, map_arrow, mix64, range_cuts, range_of, slices

#: The modulus 2^31 - 1 and two bases.
PRIME, BASES = (1 << 31) - 1, (911382323, 972663749)
#: Width of sampled spans in code points, spans kept, and the grid's first length and ratio.
SPAN, KEPT, GRID_FIRST, GRID_RATIO = 24, 32, 16, 1.25
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x < 2^63."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.minimum(x, x - _P)  # of less than PRIME the difference wraps around


#: Code points that arrays are worked out for at a time; what a text keeps is 8 bytes a code point.
CHUNK = 1 << 16


class _Powers:
    """Powers of a base below CHUNK, and of its inverse there and at multiples of CHUNK as far as asked for so far."""

    def __init__(self, base: int):
        self.base, inverse = base, pow(base, -1, PRIME)
        self.low, self.inverse_low = self._powers(base), self._powers(inverse)
        self.step, self.inverse_high = np.uint64(pow(inverse, CHUNK, PRIME)), np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < CHUNK:
            out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), PRIME)))])
        return out[:CHUNK]

    def inverses(self, n: np.ndarray) -> np.ndarray:
        """The inverse to the power of each number."""
        high = n >> 16
        if not high.any():
            return self.inverse_low[n]
        while len(self.inverse_high) <= (int(high.max()) if len(high) else 0):
            self.inverse_high = np.append(self.inverse_high, _mod(self.inverse_high[-1:] * self.step))
        return _mod(self.inverse_low[n & (CHUNK - 1)] * self.inverse_high[high])

    def inverses_from(self, start: int, end: int) -> np.ndarray:
        """The same for start to end - 1."""
        return self.inverse_low[start:end] if end <= CHUNK else self.inverses(np.arange(start, end))

    def inverse(self, n: int) -> int:
        return int(self.inverse_low[n & (CHUNK - 1)]) * int(self.inverses(np.array([n & ~(CHUNK - 1)]))[0] if n >= CHUNK else 1) % PRIME


_POWERS = [_Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _agreed(limit: int, same: Callable[[int], bool]) -> int:
    """The greatest length up to the limit for which ``same`` holds, as it does for all shorter ones: by doubling, then bisection."""
    held, k = 0, 1
    while k <= limit and same(k):
        held, k = k, 2 * k
    return held + bisect.bisect_left(range(held + 1, min(k, limit + 1)), True, key=lambda x: not same(x))


class PrefixHash:
    """Prefix arrays of a text; spans are [start, end) in code points."""

    #: Mixed hashes of all spans of the fixed width, kept by ``fingerprint`` for texts of CHUNK code points at most.
    mixed: np.ndarray | None = None

    def __init__(self, text: str):
        self.n = len(text)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in _POWERS]
        for i in range(0, self.n, CHUNK):
            c = code_points(text[i : i + CHUNK])
            for powers, sums in zip(_POWERS, self.sums):
                terms = c * powers.low[: len(c)]
                if i:
                    terms = _mod(terms) * np.uint64(pow(powers.base, i, PRIME))
                terms = (terms & _P) + (terms >> np.uint64(31))  # below 2^32, so that a chunk's sum is below 2^48
                sums[i + 1 : i + 1 + len(c)] = _mod(np.cumsum(terms) + np.uint64(sums[i]))

    @classmethod
    def joined(cls, a: PrefixHash, k: int, b: PrefixHash, m: int) -> PrefixHash:
        """Of the first k code points of one text and the first m of another, from their arrays.

        Spans of the fixed width are taken over too where both are kept; only those across the seam are worked out.
        """
        out = cls("")
        out.n = k + m
        out.sums = [np.empty(out.n + 1, np.uint32) for _ in _POWERS]
        for powers, s, t, sums in zip(_POWERS, a.sums, b.sums, out.sums):
            shift, base = np.uint64(pow(powers.base, k, PRIME)), np.uint64(s[k])
            sums[: k + 1] = s[: k + 1]
            for i in range(1, m + 1, CHUNK):
                part = t[i : min(i + CHUNK, m + 1)]
                sums[k + i : k + i + len(part)] = _mod(part * shift + base)
        if a.mixed is not None and b.mixed is not None and SPAN <= out.n <= CHUNK:
            first, last = max(0, k - SPAN + 1), min(k, out.n - SPAN + 1)
            out.mixed = np.concatenate([a.mixed[:first], mix64(out.windows(first, last)), b.mixed[: max(0, m - SPAN + 1)]])
        return out

    def windows(self, first: int, last: int) -> np.ndarray:
        """``spans`` of the fixed width that start at first to last - 1."""
        out = np.zeros(last - first, np.uint64)
        for powers, s in zip(_POWERS, self.sums):
            d = s[first + SPAN : last + SPAN].astype(np.uint64) + _P - s[first:last]
            out = (out << np.uint64(31)) | _mod(d * powers.inverses_from(first, last))
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans; equal spans have equal hashes wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        for powers, s in zip(_POWERS, self.sums):
            out = (out << np.uint64(31)) | _mod((s[ends].astype(np.uint64) + _P - s[starts]) * powers.inverses(starts))
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for powers, s in zip(_POWERS, self.sums):
            d = int(s[end]) - int(s[start])
            out = (out << 31) | (d * powers.inverse(start) if start else d) % PRIME
        return out

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """How many code points agree from the two places on: the longest common extension."""
        return _agreed(min(self.n - start, other.n - other_start), lambda k: self.span(start, start + k) == other.span(other_start, other_start + k))

    def extension_back(self, end: int, other: PrefixHash, other_end: int) -> int:
        """The same, backwards from the ends of two spans."""
        return _agreed(min(end, other_end), lambda k: self.span(end - k, end) == other.span(other_end - k, other_end))


@lru_cache(maxsize=4096)
def grid(n: int) -> np.ndarray:
    """The grid's lengths up to n, each one below GRID_FIRST; the same for all texts."""
    out, x = list(range(1, min(GRID_FIRST - 1, n) + 1)), float(GRID_FIRST)
    while int(x) <= n:
        out.append(int(x))
        x *= GRID_RATIO
    return np.array(out, np.int64)


def _least(spans: np.ndarray) -> np.ndarray:
    """The KEPT least of the spans, more if copies of one are among them, or all."""
    limit = KEPT
    while 4 * limit < len(spans):
        least = np.unique(np.partition(spans, limit - 1)[:limit])
        if len(least) >= KEPT:
            return least
        limit *= 4
    return np.unique(spans)


def fingerprint(text: str | PrefixHash) -> str:
    """``length-whole-prefixes-suffixes-spans`` in hexadecimal; equal texts have equal fingerprints."""
    h = text if isinstance(text, PrefixHash) else PrefixHash(text)
    g = grid(h.n)
    heads, tails = (h.sums[0][g].astype(np.uint64) << np.uint64(31)) | h.sums[1][g], h.spans(h.n - g, np.full(len(g), h.n))
    if SPAN <= h.n <= CHUNK and h.mixed is None:
        h.mixed = mix64(h.windows(0, h.n - SPAN + 1))
    if h.mixed is not None:
        least = _least(h.mixed)[:KEPT]
    elif h.n < SPAN:
        least = mix64(np.array([h.span(0, h.n)], np.uint64))
    else:
        least = np.empty(0, np.uint64)  # the least of the spans so far
        for i in range(0, h.n - SPAN + 1, CHUNK):
            spans = mix64(h.windows(i, min(i + CHUNK, h.n - SPAN + 1)))
            if len(least) == KEPT:
                spans = spans[spans < least[-1]]
            least = np.unique(np.concatenate([least, _least(spans)]))[:KEPT]
    brief = lambda x: (x >> np.uint64(32)).astype(">u4").tobytes().hex()
    return f"{h.n:x}-{h.span(0, h.n):016x}-{brief(mix64(heads))}-{brief(mix64(tails))}-{brief(least)}"


@lru_cache(maxsize=16)  # a fingerprint is compared up to three times in a row
def _parse(mark: str) -> tuple[int, str, list[str], list[str], list[str]]:
    n, whole, *lists = mark.split("-")
    return int(n, 16), whole, *([x[i : i + 8] for i in range(0, len(x), 8)] for x in lists)


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone.

    The greater of: the share that the longest common prefix and suffix take of the longer text (found by binary
    search over the grid, so a lower bound within the grid's ratio), and the Dice coefficient of the texts' spans as
    their least hashes estimate it. Equal texts have 1.
    """
    if a == b:
        return 1.0
    (n, _, prefixes, suffixes, spans), (m, _, prefixes2, suffixes2, spans2) = _parse(a), _parse(b)
    g = grid(min(n, m))
    agreed = 0
    for x, y in ((prefixes, prefixes2), (suffixes, suffixes2)):
        k = bisect.bisect_left(range(len(g)), True, key=lambda i: x[i] != y[i])
        agreed += int(g[k - 1]) if k else 0
    whole = max(len(spans), len(spans2)) < KEPT  # else only the least of the union are known
    least = sorted({*spans, *spans2})[: None if whole else KEPT]
    both = len({*spans} & {*spans2} & {*least})
    jaccard = both / len(least) if least else 0.0
    return min(1.0, max(agreed / max(n, m, 1), 2 * jaccard / (1 + jaccard)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, fingerprint; no shuffle.

    A null text counts as empty. Whole texts of any length are taken. Null ids and repeated rows are kept, equal texts
    have equal fingerprints, other columns are not read, and an empty table gives an empty result.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in batch["text"]]
        return {"doc_id": batch["id"], "n_chars": [len(t) for t in texts], "fingerprint": [fingerprint(t) for t in texts]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "doc_id long, n_chars long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_head_edited long, same_tail_edited long, same_head_next long, same_tail_next long"


def against_next(docs: DataFrame, rows_each: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    Likeness is by fingerprints alone and so a lower bound of what two texts share at their ends. ``same_head_`` and
    ``same_tail_`` (``edited``, ``next``) are exact: how many code points the text has in common with the edited or the
    next text from the start on, and back from the end, by binary search over the two texts' prefix arrays.

    The next document is the one with the next smaller doc_id; after the last comes the first. The edited text has the
    last floor(n / 2) code points replaced by the first as many (or all) of the next document. Null texts are empty.
    Null ids come last; rows that share an id stand in the order of their texts, so results are the same each time. One
    row alone is its own next document; an empty table gives an empty result; other columns are not read.

    Texts move once: ids are cut into ranges of about ``rows_each`` rows (16,384 ranges at most), each range is sorted
    by one task, and the first document of each range is sent to the end of the range before, so no task needs
    another's rows. What the driver sees is a number for each range.
    """
    spark, lowest = docs.sparkSession, -(1 << 63)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(lowest))  # a null id comes after the smallest
    cuts = range_cuts(d, "doc_id", rows_each)
    dealt = d.withColumn("part", (F.lit(len(cuts)) - range_of(place, cuts)).cast("int"))
    tops = dealt.groupBy("part").agg(F.max(place).alias("top")).sort("part").collect()
    if not tops:
        return spark.createDataFrame([], EDITED)
    before = [(r["part"], r["top"], tops[i - 1]["part"]) for i, r in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(before, "part int, top long, to int"))  # a row for each range
    first = (
        dealt.join(heads, "part").where(place == F.col("top")).groupBy("part", "to")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "text", "doc_id")).alias("row"))
    )
    borrowed = first.select("row.doc_id", "row.text", F.col("to").alias("part"), F.lit(True).alias("borrowed"))
    rows = dealt.withColumn("borrowed", F.lit(False)).unionByName(borrowed)  # part numbers are dense up to the number of cuts
    schema = to_arrow_schema(StructType.fromDDL(EDITED))
    order = ["part", "borrowed", F.col("doc_id").desc_nulls_last(), "text"]
    return in_arrow(rows.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order), lambda batches: _edit_along(batches, schema), EDITED)


def _edit_along(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``against_next`` for rows in order by part, each part ending with the row lent by the next."""
    held: tuple | None = None  # the row before: part, id, text, prefix arrays, fingerprint
    for batch in slices(batches):
        out = []
        for doc_id, text, part in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "text", "part"))):
            if held and held[2] == text:
                h, mark = held[3:]
            else:
                h = PrefixHash(text)
                mark = fingerprint(h)
            if held and held[0] == part:
                _, own_id, own, own_h, own_mark = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                seam = len(own) - half  # up to which own and edited text agree
                edited_h = own_h if edited == own else PrefixHash.joined(own_h, seam, h, min(half, len(text)))
                edited_mark = own_mark if edited == own else fingerprint(edited_h)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                same = [at + own_h.extension(at, other, at) if f else own_h.extension_back(own_h.n, other, other.n) for other, at in ((edited_h, seam), (h, 0)) for f in (True, False)]
                out.append((own_id, len(own), digest, own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark), *same))
            held = (part, doc_id, text, h, mark)
        columns = list(zip(*out)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
