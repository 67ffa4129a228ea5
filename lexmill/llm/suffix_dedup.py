"""Removal of repeated byte strings by suffix sorting, over a whole table.

A string of ``width`` bytes that also starts earlier, in a smaller document or in the same one, is a copy, and every byte
that a copy covers is removed. Copies are found in four steps:

1. Strings that may be equal are brought together. Every string of ``width`` bytes has an anchor: the least hash of its
   ``anchor`` bytes long parts. Equal strings have equal anchors. A text is cut into stretches of neighbouring strings
   with one anchor, about one for each 33 bytes; of a stretch only hashes are shuffled, to the task of its anchor.
2. Stretches that are equal as a whole (128 bits of hashes) are copies but for the first. An anchor of one
   stretch only has no copies.
3. The different stretches of an anchor are laid side by side in blocks, whose suffixes are put in order by two-stage
   sorting: suffixes that are smaller than their successors are sorted directly, the others follow from a scan of
   the buckets. Neighbours in that order with a common prefix of ``width`` bytes are equal strings, the first of them stays.
4. Each text is cut by what was found in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_arrow, mix64, slices, small, written

#: Bytes whose stretches are found at a time, and that equal stretches are looked for in before the shuffle.
CHUNK, COMBINED = 1 << 20, 1 << 23
#: Strings in a stretch at most, and bytes of stretches that are sorted at a time.
LONGEST, BLOCK = 128, 1 << 20
INNER = 1 << 16
#: An odd multiplier of polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    """Bytes of a string and of its anchor, and how many different stretches of an anchor are sorted in one block.

    The strings of anchors with more stretches are compared one by one, by 128 bits of hashes, over all tasks.
    """

    width: int = 100
    anchor: int = 40
    block_stretches: int = 4096


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """An odd 64-bit number for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


class SpanHashes:
    """Prefix sums of a polynomial hash: the hash of any span of some bytes."""

    def __init__(self, raw: np.ndarray, longest: int):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_values()[raw] * _powers(BASE, longest + 1)[: len(raw)], out=self.sums[1:])
        self.inverses = _powers(INVERSE, longest + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inverses[starts])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.inverses[:n])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - size + 1
    blocks = np.concatenate([x, np.full(-len(x) % size, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def stretches(raw: np.ndarray, of: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """(start, strings, anchor, hash of the stretch) of each stretch; ``of`` names the document of each byte.

    INNER is added to the number of strings where the anchor stands twice in the stretch, which then may have copies within itself.
    """
    w, n = settings.width, len(raw) - settings.width + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    hashes, size = SpanHashes(raw, CHUNK + w), w - settings.anchor + 1
    parts_hashes = hashes.all(settings.anchor)
    anchors = sliding_least(parts_hashes, size)
    whole = of[:n] == of[w - 1 :]  # the string lies in one document
    cut = np.ones(n + 1, bool)
    cut[1:n] = (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1]) | (of[1:n] != of[: n - 1])
    starts = np.flatnonzero(cut)
    lengths = np.diff(starts)
    if len(lengths) and lengths.max() > LONGEST:  # of a repeating text: pieces of LONGEST strings
        parts = -(-lengths // LONGEST)
        at = np.repeat(starts[:-1], parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        starts = np.append(at, n)
        lengths = np.diff(starts)
    starts = starts[:-1]
    starts, lengths = starts[whole[starts]], lengths[whole[starts]]
    edge = np.zeros(size - 1, anchors.dtype)
    some = np.flatnonzero(~sliding_least(~np.concatenate([edge, anchors, edge]), size) == parts_hashes)  # parts that are the anchor of a string
    begin, end = np.searchsorted(some, starts), np.searchsorted(some, starts + lengths + size - 1)
    of_stretch = np.repeat(np.arange(len(starts)), end - begin)
    part = some[np.arange(len(of_stretch)) - np.repeat(np.cumsum(end - begin) - end, end - begin)]
    same = np.bincount(of_stretch, parts_hashes[part] == anchors[starts][of_stretch], len(starts)) > 1
    return starts, lengths + INNER * same, anchors[starts], hashes.of(starts, starts + lengths + w - 1) ^ lengths.astype(np.uint64)


MARKS = "m long, s long, kid long, tie long, start long, n int"
FOUND = "copy boolean, m long, kid long, tie long, start long, n int"
#: ``n`` of a mark that its own task has found to be a run of copies is negative; INNER may be added to that of others.


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _combined(m: np.ndarray, s: np.ndarray, kid: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The marks, equal stretches but the first marked as copies and dealt out by what they are, not by what they equal."""
    order = np.lexsort((start, tie, kid, s, m))
    m, s, kid, tie, start, n = (x[order] for x in (m, s, kid, tie, start, n))
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    same = (kid == kid[first]) & (tie == tie[first]) & (start == start[first])
    keep, copy = new | ~same, ~new & ~same  # the rest are repeated rows
    marks = tuple(x[keep & ~copy] for x in (m, s, kid, tie, start, n))
    kid, tie, start, n = (x[copy] for x in (kid, tie, start, n & (INNER - 1)))
    order = np.lexsort((start, tie, kid))
    kid, tie, start, n = (x[order] for x in (kid, tie, start, n))
    begins = np.ones(len(kid), bool)
    begins[1:] = (kid[1:] != kid[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + n[:-1])
    if len(kid):  # neighbouring copies are one run
        n = np.add.reduceat(n, np.flatnonzero(begins))
        kid, tie, start = kid[begins], tie[begins], start[begins]
    m = mix64(kid.astype(np.uint64) * np.uint64(BASE) + start.astype(np.uint64)).view(np.int64)
    return tuple(map(np.concatenate, zip(marks, (m, np.zeros_like(m), kid, tie, start, -n))))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, kid, tie) of a batch's texts, without copying them."""
    text = batch.column(batch.schema.get_field_index("raw"))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kid, tie = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("kid", "tie"))
    return raw, offsets - offsets[0], kid, tie


def _mark(batches: Iterator[pa.RecordBatch], schema: pa.Schema, settings: Settings) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        raw, offsets, kid, tie = _flat(batch)
        for i in range(0, len(raw), CHUNK):
            piece = raw[i : i + CHUNK + settings.width - 1]
            of = np.searchsorted(offsets, np.arange(i, i + len(piece)), side="right") - 1 if len(offsets) else piece
            start, n, m, s = stretches(piece, of, settings)
            doc = of[start]
            held.append((m.view(np.int64), s.view(np.int64), kid[doc], tie[doc], start + i - offsets[doc], n))
            size += len(piece)
            if size >= COMBINED:
                yield _batch(schema, *_combined(*map(np.concatenate, zip(*held))))
                held, size = [], 0
    if held:
        yield _batch(schema, *_combined(*map(np.concatenate, zip(*held))))


def _judge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """FOUND for marks in order by (m, s, kid, tie, start): copies, and the first of each of an anchor's different stretches.

    The last anchor of a batch is carried on as the first row of its last stretch; ``told`` says whether that row is out,
    ``more`` whether the anchor has other stretches before it. A stretch that may have copies within itself is told in any case.
    """
    carried: list[np.ndarray] | None = None
    told = more = False
    for batch in batches:
        m, s, kid, tie, start, n = (c.to_numpy() for c in batch.columns)
        known = n < 0
        if known.any():
            yield _batch(schema, np.ones(known.sum(), bool), m[known], kid[known], tie[known], start[known], -n[known])
            m, s, kid, tie, start, n = (x[~known] for x in (m, s, kid, tie, start, n))
        if not len(m):
            continue
        if carried:
            m, s, kid, tie, start, n = (np.concatenate(x) for x in zip(carried, (m, s, kid, tie, start, n)))
        anchor, stretch = np.ones(len(m), bool), np.ones(len(m), bool)
        anchor[1:] = m[1:] != m[:-1]
        stretch[1:] = anchor[1:] | (s[1:] != s[:-1])
        first = np.maximum.accumulate(np.where(stretch, np.arange(len(m)), 0))
        copy = (kid != kid[first]) | (tie != tie[first]) | (start != start[first])
        group = np.cumsum(anchor) - 1
        several = np.bincount(group, weights=stretch) > 1
        several[0] |= more
        out = stretch & (several[group] | (n >= INNER))
        out[0] &= not told
        rows = copy | out
        yield _batch(schema, copy[rows], m[rows], kid[rows], tie[rows], start[rows], n[rows] & (INNER - 1))
        last = first[-1]
        told, more = bool(several[-1] or n[last] >= INNER), bool(several[-1])
        carried = [x[last : last + 1] for x in (m, s, kid, tie, start, n)]


# ---- suffixes of a block ----
def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the end counts as greater than any byte."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[1:] != t[:-1]
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n - 1)[::-1])[::-1]  # where the run of this byte ends
    rises = np.ones(n, bool)
    rises[:-1] = t[1:] > t[:-1]
    return rises[at]


def _words(t: np.ndarray, width: int) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([t, np.zeros(width + 8, np.uint8)])
    out = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def sorted_directly(places: np.ndarray, words: np.ndarray, width: int, strings: np.ndarray) -> np.ndarray:
    """The suffixes at these places in order by ``width`` bytes, eight at a time.

    Suffixes that agree so far are compared further only until ``strings``, a hash of their ``width`` bytes, says that
    they agree to the end.
    """
    key = words[places]
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    new = np.ones(len(out), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.arange(len(out))  # the places of ``out`` that are still open, and whether a group begins there
    for depth in range(8, width, 8):
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        h = strings[out[at]]
        uneven = np.logical_or.reduceat(h != h[begins][group], begins) if len(begins) else new
        open_ = uneven[group]
        at, group = at[open_], group[open_]
        if not len(at):
            break
        key = words[out[at] + depth]
        order = np.lexsort((key, group))
        out[at] = out[at[order]]
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])  # groups stay where they were
    return out


def suffix_order(t: np.ndarray, width: int, strings: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of the bytes in order by their first ``width`` bytes, by two-stage sorting.

    A bucket holds the suffixes of one first byte: first those greater than their successors, then those smaller. The
    latter are sorted directly. A scan of the buckets in order puts each of the former, when its successor is met, at the
    next free place of its bucket.
    """
    words = _words(t, width) if words is None else words
    if strings is None:
        padded = np.concatenate([t, np.zeros(width - 1, np.uint8)])
        strings = SpanHashes(padded, len(padded)).all(width)
    n, rising = len(t), smaller_than_next(t)
    order = np.empty(n, np.int64)
    sizes, falling = np.bincount(t, minlength=256), np.bincount(t[~rising], minlength=256)
    begin = np.cumsum(sizes) - sizes
    direct = sorted_directly(np.flatnonzero(rising), words, width, strings)
    firsts = t[direct]
    rank = np.arange(len(direct)) - np.searchsorted(firsts, firsts)
    order[begin[firsts] + falling[firsts] + rank] = direct
    free = begin.copy()
    for c in np.flatnonzero(sizes):
        done = begin[c]
        while done < free[c]:  # runs of this byte: each round puts those that are one byte longer
            before = order[done : free[c]] - 1
            done = free[c]
            before = before[(before >= 0) & (t[before] == c)]
            order[done : done + len(before)] = before
            free[c] += len(before)
        before = order[begin[c] : begin[c] + sizes[c]] - 1
        before = before[before >= 0]
        before = before[t[before] > c]
        bytes_ = t[before]
        turn = np.argsort(bytes_, kind="stable")
        before, bytes_ = before[turn], bytes_[turn]
        order[free[bytes_] + np.arange(len(before)) - np.searchsorted(bytes_, bytes_)] = before
        free += np.bincount(bytes_, minlength=256)
    return order


def equal_neighbours(order: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix of an order has ``width`` bytes or more in common with the one before it."""
    equal = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for depth in [*range(0, width - 7, 8), width - 8]:
        left = left[words[order[left] + depth] == words[order[left - 1] + depth]]
    equal[left] = True
    return equal


def copies(raw: np.ndarray, begins: np.ndarray, n: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, strings) of the runs of copies in some stretches that are laid side by side.

    ``rank`` is the order of the stretches in the table.
    """
    hashes = SpanHashes(np.concatenate([raw, np.zeros(width - 1, np.uint8)]), 4 * BLOCK if len(raw) < 2 * BLOCK else len(raw) + width)
    words = _words(raw, width)
    order = suffix_order(raw, width, hashes.all(width), words)
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + n, -1)
    order = order[np.cumsum(inside)[order] > 0]  # whole strings of a stretch
    of = np.searchsorted(begins, order, side="right") - 1
    place = rank[of] * (1 << 32) + order - begins[of]
    heads = np.flatnonzero(~equal_neighbours(order, words, width))
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(order)))) if len(order) else place
    copied = np.zeros(len(raw) + 1, np.int8)
    copied[order[place != least]] = 1
    edge = np.diff(copied, prepend=0)
    edge[begins] |= copied[begins]  # runs do not go on from one stretch to the next
    at = np.flatnonzero(edge > 0)
    ends = np.flatnonzero(np.append(edge[1:] != 0, True) & (copied > 0)) + 1
    of = np.searchsorted(begins, at, side="right") - 1
    return of, at - begins[of], ends - at


STRETCH = "m long, kid long, tie long, start long, n int, raw binary"
RUNS = "kid long, tie long, start long, n int"


def _sort_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, settings: Settings) -> Iterator[pa.RecordBatch]:
    """RUNS of copies for stretches in order by anchor: whole anchors make blocks of about BLOCK bytes."""
    held, size = [], 0

    def block(part: pa.Table) -> pa.RecordBatch:
        kid, tie, start, n = (part.column(c).to_numpy() for c in ("kid", "tie", "start", "n"))
        texts = part.column("raw").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        rank, order = np.empty(len(kid), np.int64), np.lexsort((start, tie, kid))
        a, b = order[1:], order[:-1]  # repeated rows have one rank
        rank[order] = np.cumsum(np.append(False, (kid[a] != kid[b]) | (tie[a] != tie[b]) | (start[a] != start[b])))
        of, offset, strings = copies(raw, offsets[:-1] - offsets[0], n, rank, settings.width)
        return _batch(schema, kid[of], tie[of], start[of] + offset, strings)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < BLOCK:
            continue
        rows = pa.Table.from_batches(held)
        m = rows.column("m").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, m[1:] != m[:-1])), len(m))
        ends = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy().astype(np.int64) + settings.width - 1)])
        done = 0
        while True:
            after = cuts[(cuts > done) & (cuts < len(m))]
            full = after[ends[after] - ends[done] >= BLOCK]
            if not len(full):
                break
            yield block(rows.slice(done, full[0] - done))
            done = int(full[0])
        held = rows.slice(done).to_batches()
        size = int(ends[-1] - ends[done])
    if held and sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held))


def _cut_out(batches: Iterator[pa.RecordBatch], schema: pa.Schema, settings: Settings, single: bool) -> Iterator[pa.RecordBatch]:
    """From texts with the places of stretches: STRETCH rows; or, if ``single``, MARKS of their single strings."""
    for batch in slices(batches):
        raw, offsets, kid, tie = _flat(batch)
        lists = batch.column(batch.schema.get_field_index("found"))
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        fields = lists.flatten().flatten()  # m, start, n
        m, start, n = (f.to_numpy() for f in fields)
        at = offsets[doc] + start
        if single:
            for i in range(0, len(at), 1 << 13):
                part = slice(i, i + (1 << 13))
                of = np.repeat(np.arange(len(at))[part], n[part])
                step = np.arange(len(of)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                pieces = np.concatenate([raw[a : a + k + settings.width - 1] for a, k in zip(at[part], n[part])])
                hashes = SpanHashes(pieces, len(pieces))
                base = np.cumsum(n[part] + settings.width - 1) - (n[part] + settings.width - 1)
                b = base[of - i] + step
                first, second = hashes.of(b, b + settings.width), hashes.of(b, b + settings.width // 2)
                yield _batch(schema, *_combined(first.view(np.int64), second.view(np.int64), kid[doc[of]], tie[doc[of]], start[of] + step, np.ones(len(of), np.int64)))
        else:
            data = raw.tobytes()
            yield _batch(schema, m, kid[doc], tie[doc], start, n, [data[a : a + k + settings.width - 1] for a, k in zip(at.tolist(), n.tolist())])


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _trim(batches: Iterator[pa.RecordBatch], schema: pa.Schema, width: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for doc_id, raw, found in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "raw", "runs"))):
            spans = merged([(f["start"], f["start"] + f["n"] + width - 1) for f in found or ()])
            at, kept = 0, []
            for a, b in spans:
                kept.append(memoryview(raw)[at:a])
                at = b
            kept.append(memoryview(raw)[at:])
            removed = sum(b - a for a, b in spans)
            if digest:
                sha = hashlib.sha256()
                for k in kept:
                    sha.update(k)
                out.append((doc_id, len(raw), removed, len(spans), sha.hexdigest()))
            else:
                out.append((doc_id, len(raw), removed, [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_arrow(df: DataFrame, run: Callable[..., Iterator[pa.RecordBatch]], ddl: str, *args: object) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return in_arrow(df, lambda batches: run(batches, schema, *args), ddl)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(kid, tie, doc_id, raw): ids that order the rows, and texts as bytes; ``tie`` tells texts under one id apart.

    Also the columns that are a document's key: ``tie`` is 0 where no two rows share an id.
    """
    d = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("kid"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"),
    )
    shared = written(d.groupBy("kid").agg(F.count("*").alias("rows")).where("rows > 1").select("kid", F.lit(True).alias("shared")), "suffix-ids")
    n = shared.count()
    tie = F.xxhash64("raw")
    if n:
        return d.join(small(shared, n, 16), "kid", "left").select("kid", F.when(F.col("shared"), tie).otherwise(F.lit(0)).alias("tie"), "doc_id", "raw"), ["kid", "tie"]
    return d.select("kid", F.lit(0).cast("long").alias("tie"), "doc_id", "raw"), ["kid"]


def _runs(texts: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """RUNS of copies: from ``start`` on, ``n`` strings of ``width`` bytes that also start earlier."""
    marks = ["m", "s", "kid", "tie", "start"]
    judged = lambda df: _in_arrow(df.repartition("m").sortWithinPartitions(*marks), _judge, FOUND)
    found = written(judged(_in_arrow(texts.select("kid", "tie", "raw"), _mark, MARKS, settings)), "suffix-found")
    open_ = found.where("not copy")
    large = written(open_.groupBy("m").agg(F.count("*").alias("stretches")).where(F.col("stretches") > settings.block_stretches), "suffix-large")
    n = large.count()
    ids = small(large.select("m"), n, 16)

    def cut_out(of: DataFrame, single: bool) -> DataFrame:
        places = of.groupBy(*key).agg(F.collect_list(F.struct("m", "start", "n")).alias("found"))
        both = texts.join(places.hint("shuffle_hash"), key).select("kid", texts["tie"], "doc_id", "raw", "found")
        return _in_arrow(both, _cut_out, MARKS if single else STRETCH, settings, single)

    in_blocks = cut_out(open_.join(ids, "m", "left_anti") if n else open_, single=False)
    sorted_ = _in_arrow(in_blocks.repartition("m").sortWithinPartitions("m"), _sort_blocks, RUNS, settings)
    out = found.where("copy").select("kid", "tie", "start", "n").unionByName(sorted_)
    if n:
        out = out.unionByName(judged(cut_out(open_.join(ids, "m", "left_semi"), single=True)).where("copy").select("kid", "tie", "start", "n"))
    return out


def _trimmed(docs: DataFrame, settings: Settings, id_col: str, text_col: str, digest: bool) -> DataFrame:
    texts, key = _texts(docs, id_col, text_col)
    found = _runs(texts, key, settings).groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    both = texts.join(found.hint("shuffle_hash"), key, "left").select("kid", texts["tie"], "doc_id", "raw", "runs")
    return _in_arrow(both, _trim, DIGESTS if digest else KEPT, settings.width, digest)


def trimmed(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, the removed spans in bytes, and what is kept, as bytes.

    Texts are taken as UTF-8 bytes, so a span may cut a character. Of each string of ``width`` bytes the first
    occurrence stays, in the order of ids and of bytes in a text; all others are removed, judged on the texts as they are.
    A null text counts as empty; a null id comes after all others; texts under one id stand in the order of a
    hash; rows with equal id and text are one document, each with its result. Other columns are not read. An empty
    table gives an empty result.

    A task holds 8 MB of texts' hashes, or a block of about 1 MB of stretches. A string that many documents share is one row a task
    before it is shuffled. Texts are shuffled once, by document.
    """
    return _trimmed(docs, settings, id_col, text_col, digest=False)


def digests(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that ``trimmed`` keeps; the same rows."""
    return _trimmed(docs, settings, id_col, text_col, digest=True)
