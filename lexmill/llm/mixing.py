"""Mixing sources by temperature, under a limit on repetition or a target entropy.

Source weights are proportional to token shares raised to an exponent: 1 keeps the corpus as it is, 0 makes sources
equal. The exponent is found by bisection. The weights are then realised as passes over each source in a keyed random
order, dealt into blocks of one token budget that each hold the sources at their weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, small, written


@dataclass(frozen=True)
class Settings:
    """``repeats``: passes over any source at most; ``entropy``: a target as a share (0 to 1) of the greatest, or None.

    The whole budget is the least with which every source is read at least once, so no document is lost.
    ``block_tokens`` is the budget of a block. ``sections`` exponents are tried in one pass over the sources, which
    narrows the bracket by as much plus one, ``passes`` times.
    """

    repeats: float = 2.0
    entropy: float | None = None
    block_tokens: int = 1 << 20
    key: int = 11
    sections: int = 15
    passes: int = 10


def n_words(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bisect(holds: Callable[[list[float]], list[bool]], s: Settings) -> tuple[float, float]:
    """The bracket in [0, 1] where a condition that holds from some exponent on begins to (it is taken to hold at 1)."""
    low, high = 0.0, 1.0
    for _ in range(s.passes):
        tried = [low + (high - low) * (i + 1) / (s.sections + 1) for i in range(s.sections)]
        k = [*holds(tried), True].index(True)
        low, high = (tried[k - 1] if k else low), (tried[k] if k < s.sections else high)
    return low, high


def exponent(sources: DataFrame, s: Settings) -> float:
    """The exponent in [0, 1] for a table of (source, tokens > 0); 1 for an empty one.

    With p a source's share, passes over it are (max p / p) ** (1 - exponent): at least 1, and more the smaller the
    exponent is. Without a target entropy it is the least exponent within the limit on passes; with one, the greatest
    that reaches the target, but none below that limit. Only sums over the sources reach the driver.
    """
    base = sources.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not base["n"]:
        return 1.0
    repeated = lambda alphas: [(base["most"] / base["least"]) ** (1 - a) <= s.repeats for a in alphas]
    bound = 0.0 if repeated([0.0])[0] else _bisect(repeated, s)[1]
    if s.entropy is None or base["n"] == 1:
        return bound
    p = F.col("tokens") / F.lit(float(base["all"]))

    def falls_short(alphas: list[float]) -> list[bool]:
        sums = sources.agg(*[F.sum(F.pow(p, F.lit(a))) for a in alphas], *[F.sum(F.pow(p, F.lit(a)) * F.lit(a) * F.log(p)) for a in alphas]).first()
        return [math.log(z) - x / z < s.entropy * math.log(base["n"]) for z, x in zip(sums[: len(alphas)], sums[len(alphas) :])]

    return max(bound, 1.0 if not falls_short([1.0])[0] else _bisect(falls_short, s)[0])


def weights(units: DataFrame, s: Settings) -> DataFrame:
    """For each source with tokens: source, n_rows, tokens, weight (they sum to 1), passes."""
    totals = written(units.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens")), "sources")
    some = totals.where("tokens > 0")
    a = exponent(some, s)
    raised = F.pow(F.col("tokens").cast("double"), F.lit(a))
    sums = some.agg(F.sum(raised), F.max("tokens")).first()
    whole, most = sums[0] or 1.0, sums[1] or 1
    passes = F.when(F.col("tokens") > 0, F.least(F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - a)), F.lit(float(s.repeats)))).otherwise(1.0)
    return totals.select("source", "n_rows", "tokens", F.when(F.col("tokens") > 0, raised / whole).otherwise(0.0).alias("weight"), passes.alias("passes"))


def mixed(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each copy of each input row: doc_id, source, n_tokens (words), pass, block, turn, content.

    Whole passes hold every document of a source; the last one holds those that come first in its order, up to the
    document with which the share of the source that is still due is filled. ``block`` is the block of the mixed
    stream that a copy falls in by the tokens of its source before it, ``turn`` its random place there, ``content`` a
    hash that tells texts of one id apart. A null source is a source of its own; a source without words is read
    once, in block 0. Repeated rows stand together. An empty table gives an empty result; other columns are not read.

    Sums along a source's order are taken in two steps, within buckets of the order's hash and over the buckets, of which
    there are about as many as rows in each, so a source with any share of all rows is spread over many tasks.
    """
    source = F.col(source_col).cast("string")
    units = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), n_words(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(text_col), source).alias("content"))
    units = written(units, "units")
    by_source = weights(units, s).withColumn("buckets", F.ceil(F.sqrt("n_rows")))
    n = by_source.count()
    same = units["source"].eqNullSafe(by_source["source"])
    joined = units.join(small(by_source, n, 128), same).drop(by_source["source"])
    copies = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil("passes").cast("int") - 1)))
    turn = F.xxhash64(F.lit(s.key), "pass", "doc_id", "content")
    share = (F.shiftrightunsigned(turn, 11).cast("double")) / F.lit(float(1 << 53))
    copies = copies.withColumn("turn", turn).withColumn("bucket", F.floor(share * F.col("buckets")).cast("int"))
    group = ["source", "pass", "bucket"]
    sums = copies.groupBy(*group).agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(sums.select(*group, F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    o = small(offsets, offsets.count(), 128)
    near = copies.join(o, copies["source"].eqNullSafe(o["source"]) & (copies["pass"] == o["pass"]) & (copies["bucket"] == o["bucket"])).drop(o["source"], o["pass"], o["bucket"])
    order = Window.partitionBy(*group).orderBy(F.expr("shiftrightunsigned(turn, 1)"), "turn", "doc_id", "content")
    placed = near.withColumn("through", F.col("offset") + F.sum("n_tokens").over(order))
    start = F.col("through") - F.col("n_tokens")
    due = F.least(F.col("passes") - F.col("pass"), F.lit(1.0)) * F.col("tokens")
    each = F.col("weight") * s.block_tokens
    block = F.when(F.col("weight") > 0, F.floor((F.col("pass") * F.col("tokens") + start) / each)).otherwise(0).cast("long")
    return placed.where((F.col("pass") < F.floor("passes")) | (start < due)).select("doc_id", "source", "n_tokens", "pass", block.alias("block"), "turn", "content")


def mixed_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture asks for, with a block's rows together in random order.

    All columns are kept, whatever their names. Rows with null ids, texts or sources are mixed as ``mixed`` has it; of
    repeated rows (one id, text and source) each is taken as often as the rows of its kind are at most. An empty table
    gives an empty one.
    """
    copies = mixed(docs, s).groupBy("doc_id", "content").agg(F.collect_set(F.struct("pass", "block", "turn")).alias("copies"))
    copies = written(copies, "copies")
    keyed = docs.select(as_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", F.col("source").cast("string")).alias("key"))
    met = keyed.join(small(copies, copies.count(), 160), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("content")))
    dealt = met.select("row", F.explode("copies").alias("copy")).select("row", "copy.block", "copy.turn")
    return dealt.repartition("block").sortWithinPartitions("block", "turn").select("row.*")
