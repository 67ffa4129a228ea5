"""Perplexity and bits per byte of corpora under models, from summed negative log-likelihoods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from . import quota

#: Digests that a node of a tree of digests joins, and its levels: together for up to 2^40 rows of a dataset.
FANOUT, LEVELS = 1024, 4


def corpus(rows: DataFrame, order: str, text: str = "text", keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """By dataset: its texts in order with a blank line between them (``corpus``), rows, bytes and SHA-256.

    An evaluation corpus is one text by definition; this is for test splits, not for training corpora.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    whole = rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n\n").alias("corpus"), F.count("*").alias("n_rows"))
    return whole.withColumns({"bytes": F.octet_length("corpus").cast("long"), "sha256": F.sha2("corpus", 256)})


def corpus_sums(rows: DataFrame, order: str, text: str = "text", key: str = "dataset") -> DataFrame:
    """By dataset: rows, and bytes of its ``corpus``, with ``tree_sha256``, a digest of the texts in order; the text itself is never joined.

    The digest is that of a tree: SHA-256 of each text, then LEVELS times of each run of FANOUT hexadecimal digests put
    one behind the other. ``order`` is a unique number within the dataset.
    """
    t = F.coalesce(text, F.lit(""))
    each = rows.select(key, order, F.octet_length(t).cast("long").alias("size"), F.sha2(t, 256).alias("digest"), F.lit(1).alias("one"))
    sums = each.groupBy(key).agg(F.count("*").alias("n_rows"), (F.sum("size") + 2 * (F.count("*") - 1)).alias("bytes"))
    level = quota.running(each.select(key, order, "digest", "one"), "one", order, key).select(key, (F.col("through") - 1).alias("at"), "digest")
    for _ in range(LEVELS):
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda r: r["digest"])
        level = level.groupBy(key, F.floor(F.col("at") / FANOUT).alias("up")).agg(F.sha2(F.array_join(run, ""), 256).alias("digest")).withColumnRenamed("up", "at")
    return sums.join(level.select(key, F.col("digest").alias("tree_sha256")), key)


def segment_sizes(rows: DataFrame, order: str, length: int, text: str = "text", key: str = "dataset") -> DataFrame:
    """(dataset, seg, tokens): how many white-space tokens each of ``packing.segments`` of the dataset's ``corpus`` has.

    Words never span the blank line between texts, so running sums of the texts' words give each its place; of a text
    a row for each segment it reaches is shuffled, never its words. ``order`` is a unique number within the dataset.
    """
    step = length - 1
    n = F.coalesce(F.regexp_count(text, F.lit(T.WORD)), F.lit(0)).cast("long")
    counted = stored(rows.select(key, order, n.alias("n")).where("n > 0"), "words")  # numbers only; counted once for all steps of the sums
    first = F.col("through") - F.col("n")
    reached = F.sequence(F.floor(first / step), F.floor((F.col("through") - 1) / step))
    pieces = quota.running(counted, "n", order, key).select(key, "through", first.alias("first"), F.explode(reached).alias("seg"))
    inside = F.least("through", (F.col("seg") + 1) * step) - F.greatest("first", F.col("seg") * step)
    return pieces.groupBy(key, "seg").agg(F.sum(inside).alias("tokens"))


def measures(nll: Column, tokens: Column, size: Column) -> dict[str, Column]:
    """Nats a token, perplexity (the exponent is capped at 50), bits a byte, byte perplexity, tokens a byte."""
    per_token, bits = F.try_divide(nll, tokens), F.try_divide(nll, size * math.log(2))
    return {
        "nats_per_token": per_token, "perplexity": F.exp(F.least(per_token, F.lit(50.0))), "bits_per_byte": bits,
        "byte_perplexity": F.pow(F.lit(2.0), bits), "tokens_per_byte": F.try_divide(tokens.cast("double"), size),
    }


def results(scores: DataFrame, corpora: DataFrame) -> DataFrame:
    """By model and dataset: summed nll and tokens with ``measures``. ``scores`` has model, dataset, nll, tokens."""
    sums = scores.groupBy("model", "dataset").agg(F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"), F.count("*").alias("segments"))
    met = sums.join(corpora.select("dataset", "bytes"), "dataset")
    return met.withColumns(measures(F.col("nll"), F.col("tokens"), F.col("bytes")))


def ranked(results_of: DataFrame, dataset: str) -> DataFrame:
    """A dataset's results, best first; models without a result are not there."""
    return results_of.where(F.col("dataset") == dataset).orderBy("bits_per_byte", "model")


def pending(models: DataFrame, datasets: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of model and dataset that have no result yet. Both lists are configuration, a row for each entry."""
    pairs = models.select("model", F.lit(1).alias("__one")).join(datasets.select("dataset", F.lit(1).alias("__one")), "__one").drop("__one")
    return pairs.join(done.select("model", "dataset"), ["model", "dataset"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with rows of ``new`` in place of those of equal key, and its other rows added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def check_names(names: list[str]) -> None:
    """Raises if a name stands twice or is blank."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice or not all(n.strip() for n in names):
        raise ValueError(f"names must be unique and not blank: {twice}")
