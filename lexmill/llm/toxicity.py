"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are binary: words and their stems (first 4, 5 and 6 letters), word pairs, and pairs one or two words apart,
hashed into 2^bits slots. Every coordinate has its own learning rate and an L1 threshold, so nearly all weights are
exactly zero; what is left is small enough to broadcast. The bias is no coordinate of FTRL: it has neither L1 nor L2 and
takes plain steps of an adaptive rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_arrow, mix64, slices, written

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
#: Distinct words that a task keeps hashed.
MEMO_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_chars`` bound the labelled documents a fit takes: those with the least hash of doc_id,
    as long as their texts have no more characters together; one with more than ``text_chars`` is not drawn. So the
    features of a fit, some 5 bytes a character, are bounded by bytes. A feature in fewer than ``least_documents`` of the
    documents is not learned."""

    bits: int = 22
    sample_rows: int = 8192
    sample_chars: int = 40_000_000
    text_chars: int = 1_000_000
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    least_documents: int = 4
    seed: int = 20


@dataclass(frozen=True)
class Model:
    """``slots``: sorted feature slots with a weight; every other weight is zero."""

    bits: int
    bias: float
    slots: np.ndarray
    weights: np.ndarray


class Scorer:
    """A model with what a task keeps while it runs, and no longer: the hashed words and the table of weights."""

    def __init__(self, model: Model):
        self.model, self.words, self.table = model, _Words(), np.zeros(1 << model.bits, np.float32)
        self.table[model.slots] = model.weights

    def __call__(self, text: str | None) -> float:
        """The log-odds that the text is toxic."""
        m = self.model
        x = _slots(self.words, text, m.bits)
        return m.bias + float(self.table[np.unique(x[self.table[x] != 0])].sum(dtype=np.float64))


class _Words:
    """Hashes of a word and of its stems, as rows of one table."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.hashes = np.empty((1024, 1 + len(STEMS)), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.row) > MEMO_WORDS:
            self.row.clear()
        row = self.row
        for w in set(words).difference(row):
            if len(row) == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            self.hashes[len(row)] = [xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(w[:n], seed=n) for n in STEMS)]
            row[w] = len(row)
        return self.hashes[np.fromiter(map(row.__getitem__, words), np.int64, len(words))]


def _slots(words: _Words, text: str | None, bits: int) -> np.ndarray:
    """The feature slots of a text, each as often as it occurs."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.int64)
    h = words.of(found)
    a = h[:, 0]
    pairs = [mix64(a[:-k] * np.uint64(0x9E3779B97F4A7C15) + a[k:] + np.uint64(k)) for k in (1, 2, 3)]
    return (np.concatenate([h.ravel(), *pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """FTRL-proximal over (unique slots, label) rows, in a shuffled order of its own each epoch. ``rows`` is used up."""
    counts = np.zeros(1 << s.bits, np.int32)
    for x, _ in rows:
        counts[x] += 1
    slots = np.flatnonzero(counts >= s.least_documents)
    place = np.full(1 << s.bits, -1, np.int32)
    place[slots] = np.arange(len(slots))
    for i, (x, y) in enumerate(rows):
        p = place[x]
        rows[i] = p[p >= 0], y
    del counts, place
    z, n, bias, bias_n = np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
    weights = lambda z, n: np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            x, label = rows[i]
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / s.alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    w = weights(z, n)
    return Model(s.bits, float(bias), slots[w != 0], w[w != 0])


def fit(labelled: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``labelled`` (doc_id, label 0 or 1) and the texts of ``docs`` (doc_id, text).

    Rows with a null id or label are left out; of rows of one id the greatest label and the least text count. At most
    ``settings.sample_rows`` ids and ``settings.sample_chars`` characters are taken, by the hash of the id, so what is
    trained on in one task is bounded. An empty or null text is a document without features. No rows: a model that
    scores 0.5.
    """
    s = settings
    chosen = (
        labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("turn", F.xxhash64("doc_id", F.lit(s.seed))).orderBy("turn", "doc_id").limit(s.sample_rows)
    )
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    short = docs.select("doc_id", "text").where(chars <= s.text_chars)
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    texts = written(texts.withColumn("chars", chars), "labelled")
    through = F.sum("chars").over(Window.orderBy("turn", "doc_id"))  # a row for each chosen id
    within = texts.select("turn", "doc_id", "chars").withColumn("through", through).where(F.col("through") <= s.sample_chars).select("doc_id")
    texts = texts.join(F.broadcast(within), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches):
            slots = [np.unique(_slots(words, t, s.bits)).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("turn", "doc_id", "label")), pa.array(slots, pa.binary())], ["turn", "doc_id", "label", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in ("turn", "doc_id", "label", "slots")))
        rows.sort(key=lambda r: r[:2])
        for i, (*_, y, x) in enumerate(rows):
            rows[i] = np.frombuffer(x, "<u4"), y
        m = train(rows, s)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.slots, -1), pa.int64()), pa.array(np.append(m.weights, m.bias), pa.float64())], ["slot", "weight"])

    ready = in_arrow(texts.select("turn", "doc_id", F.col("label").cast("int"), "text"), features, "turn long, doc_id long, label int, slots binary")
    learned = sorted(tuple(r) for r in in_arrow(ready.repartition(1), learn, "slot long, weight double").collect())
    if not learned:  # an empty table has no task to train in
        return Model(s.bits, 0.0, np.empty(0, np.int64), np.empty(0))
    return Model(s.bits, learned[0][1], np.array([r[0] for r in learned[1:]], np.int64), np.array([r[1] for r in learned[1:]], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, score (0 to 1), predicted (1 if the score is at least 0.5).

    A null, empty or wordless text gets the score of the bias alone. Whole texts of any length are scored, in one pass
    with no shuffle. Null ids and repeated rows are kept; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            p = 1 / (1 + np.exp(-np.clip(np.array([*map(scorer, batch.column("text").to_pylist())], float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=out)

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is not predicted toxic; in one pass with no shuffle.

    Whole texts of any length are scored. A null, empty or wordless text has the score of the bias alone, so such rows
    stay or go together (they stay under a model that was learned from mostly clean rows). Rows are judged each by their
    own text: repeated rows, null ids and rows that share an id included. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([not scorer(t) >= 0 for t in batch.column(at).to_pylist()], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes no names with dots or quotes
    return in_arrow(plain, run, plain.schema).toDF(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
