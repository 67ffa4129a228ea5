"""Audit of how filters interact: what each removes after which others, over all orders.

The orders of the filters form a trie whose nodes, up to the order of what came before, are the sets of filters applied
so far. The trie is walked depth-first: a node's survivors are a persisted DataFrame, made from its parent's by one
filter; a set that another order has reached already is not visited again. At every edge the documents that the next
filter really removes from the survivors are counted. All orders' figures are sums of edges.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, written

#: Fixed: the characters whose presence fails filter D.
MARKED = "#$%&*|"


@dataclass(frozen=True)
class Filter:
    """A letter, and when a text fails: by its words, by its characters and bytes, or (neither given) by being a later copy."""

    name: str
    fails: Callable[[str, list[bytes]], bool] | None


def upper_case(text: str) -> int:
    """How many characters are A to Z."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


FILTERS = (
    Filter("A", lambda text, words: len(words) < 100),
    Filter("B", lambda text, words: 100 * len(set(words)) < 80 * len(words)),
    Filter("C", lambda text, words: 100 * upper_case(text) > 10 * len(text)),
    Filter("D", lambda text, words: any(c in text for c in MARKED)),
    Filter("E", None),
)


def verdicts(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each document: part, good, toxic, and fails, a mask in which bit i says that filter i fails.

    Words are runs of bytes other than space and tab to carriage return. A null text counts as empty, a null part as the
    empty string. A later copy has a text that a document with a smaller id has too, in the whole table; rows that share an id
    are no copies of each other, and a null id is neither smaller nor greater than any. Rows without a label, or with a null
    one, are neither good nor toxic; where an id has several label rows, one of them is enough. Only digests of texts are shuffled.
    """
    seen = [(1 << i, f.fails) for i, f in enumerate(filters) if f.fails]
    copy_bit = sum(1 << i for i, f in enumerate(filters) if not f.fails)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        fails, digests = [], []
        for text in batch["text"]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            fails.append(sum(bit for bit, failing in seen if failing(text or "", words)))
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
        return {"id": batch["id"], "part": batch["part"], "fails": fails, "digest": digests}

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    judged = written(map_arrow(wanted, rows, "id long, part string, fails long, digest binary"), "audit-judged")
    first = judged.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    is_copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return (
        judged.join(first, "digest", "left").join(known, "id", "left")
        .select(
            "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
            F.col("fails").bitwiseOR(F.when(is_copy, F.lit(copy_bit)).otherwise(F.lit(0))).cast("int").alias("fails"),
        )
    )


def _removed(survivors: DataFrame, applied: int, n_filters: int) -> DataFrame:
    """A row for each part and filter that is not applied yet: what it removes from the survivors."""
    ahead = [i for i in range(n_filters) if not applied >> i & 1]
    fails = lambda i: F.col("fails").bitwiseAND(F.lit(1 << i)) != 0
    count = lambda cond: F.count(F.when(cond, 1))
    counted = survivors.groupBy("part").agg(
        F.count("*").alias("before"),
        *[F.struct(count(fails(i)).alias("removed"), count(fails(i) & F.col("good")).alias("good_lost"), count(fails(i) & F.col("toxic")).alias("toxic_lost")).alias(f"edge{i}") for i in ahead],
    )
    edges = F.array(*[F.struct(F.lit(i).alias("filter"), F.col(f"edge{i}").alias("edge")) for i in ahead])
    return counted.select("part", F.lit(applied).alias("applied"), "before", F.inline(edges).alias("filter", "edge")).select("part", "applied", "before", "filter", "edge.*")


def edges(judged: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """Every edge of the trie: part, applied (mask of the filters before), filter (place), before, removed, good_lost, toxic_lost (long).

    ``judged`` has the columns of ``verdicts`` and should be a table. A part has rows only where survivors are left. Each
    set of filters is visited once: 2^n - 1 small jobs, along at most n persisted DataFrames; what is counted is a row a
    part. A lost executor's share of a persisted DataFrame is made again from the table.
    """
    path, schema = shared_path(judged.sparkSession, "audit-edges"), "part string, applied int, before long, filter int, removed long, good_lost long, toxic_lost long"
    seen: set[int] = set()

    def visit(applied: int, survivors: DataFrame) -> None:
        seen.add(applied)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        _removed(survivors, applied, n_filters).write.mode("append").parquet(path)
        for i in range(n_filters):
            after = applied | 1 << i
            if after not in seen and after != (1 << n_filters) - 1:  # nothing is left to apply after all filters
                visit(after, survivors.where(F.col("fails").bitwiseAND(F.lit(1 << i)) == 0))
        survivors.unpersist()

    visit(0, judged)
    return judged.sparkSession.read.schema(schema).parquet(path)


def orders(filters: tuple[Filter, ...] = FILTERS) -> Column:
    """An array with a struct for each order of the filters and each step of it, n! times n in all."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        name, applied = "".join(filters[i].name for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, i, applied))
            applied |= 1 << i
    text = ",".join(f"{n}:{s}:{i}:{a}" for n, s, i, a in out)
    field = lambda x, k: F.element_at(F.split(x, ":"), k)
    return F.transform(F.split(F.lit(text), ","), lambda x: F.struct(
        field(x, 1).alias("filter_order"), field(x, 2).cast("int").alias("step"), field(x, 3).cast("int").alias("filter"), field(x, 4).cast("int").alias("applied")
    ))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    redundant counts documents that fail the step's filter but were removed before; unique_fails those that fail it
    alone; shapley is what the filter removes, summed over all orders. Parts without a document do not appear; an empty
    table gives an empty result. Nulls, ties and repeated rows as in ``verdicts``; other columns are not read.
    """
    n = len(filters)
    judged = written(verdicts(docs, labels, filters, **columns), "audit-verdicts")
    found = edges(judged, n)
    weights = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)])
    of_filter = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("applied") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.expr("bit_count(applied)") == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.element_at(weights, F.expr("bit_count(applied)") + 1)).alias("shapley"),
    )
    steps = found.where("applied = 0").select("part").distinct().select("part", F.inline(orders(filters)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        steps.join(found, ["part", "filter", "applied"], "left").join(of_filter, ["part", "filter"], "left")
        .select(
            "part", "filter_order", "step", (F.coalesce("before", F.lit(0)) - F.coalesce("removed", F.lit(0))).cast("long").alias("kept"), zero("removed"),
            (F.coalesce("fails", F.lit(0)) - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant"),
            *map(zero, ("unique_fails", "good_lost", "toxic_lost", "shapley")),
        )
    )
