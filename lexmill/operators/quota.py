"""Token and byte quotas over sources in arrival order.

``running`` gives each row the sum of a source's sizes through it. It is taken in two steps: sums over ranges of the
order key, then within each range, so no task holds more of a source than one range, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range of the order key.
RANGE_ROWS = 250_000
#: Ranges at most: the table of their sums stays small.
RANGES = 4096
#: Sources up to which the quota table is broadcast.
FEW_SOURCES = 10_000


def quotas(weights: list[tuple[str, float]], total: int, rest_to: str = "last") -> list[tuple[str, int, int]]:
    """(source, place, quota): the whole part of each share; the last source, or the first, gets what is left."""
    shares = [int(total * w) for _, w in weights]
    shares[-1 if rest_to == "last" else 0] += total - sum(shares)
    return [(name, i, q) for i, ((name, _), q) in enumerate(zip(weights, shares))]


def quota_table(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, place int, quota long")


def share_table(rows: DataFrame, size: str = "n", part: int = 2, rest_to: str = "last") -> DataFrame:
    """(source, place, quota) by name: 1 / ``part`` of each source's items, rounded down; the last source, or the first,
    gets what the whole's share has over. A table of few sources is held by the driver, so that it is worked out once."""
    totals = rows.where("source is not null").groupBy("source").agg(F.sum(size).alias("s"))
    all_of, name = Window.partitionBy(), Window.orderBy("source" if rest_to == "first" else F.desc("source"))  # a row for each source
    share = F.floor(F.col("s") / part)
    over = F.floor(F.sum("s").over(all_of) / part) - F.sum(share).over(all_of)
    placed = totals.withColumns({"place": (F.row_number().over(Window.orderBy("source")) - 1), "quota": (share + F.when(F.row_number().over(name) == 1, over).otherwise(0)).cast("long")})
    table = placed.select("source", "place", "quota")
    few = table.limit(FEW_SOURCES + 1).collect()
    return rows.sparkSession.createDataFrame(few, table.schema) if len(few) <= FEW_SOURCES else table


def few(table: DataFrame) -> DataFrame:
    """A broadcast hint for a table of FEW_SOURCES rows at most; else the planner's own choice."""
    return F.broadcast(table) if table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else table


def running(df: DataFrame, size: str | dict[str, str], order: str, source: str | None = None, ordered: DataFrame | None = None) -> DataFrame:
    """``df`` with ``through``: the sum of ``size`` up to and with the row, by ``order`` (a number), within ``source``.

    Rows that share a number stand in some order, each with a sum of its own, so cuts are exact.

    Of several sums at a time, ``size`` has each one's column by the name of the sum. Where ``df`` is costly to work out,
    ``ordered`` may be the table it is made from: the ranges are then laid over that one's ``order`` column.
    """
    sums_of = size if isinstance(size, dict) else {"through": size}
    keys = [source] if source else []
    ordered = (df if ordered is None else ordered).select(order)
    n = max(1, min(RANGES, -(-ordered.count() // RANGE_ROWS)))
    if n == 1:
        all_rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({k: F.sum(c).over(all_rows) for k, c in sums_of.items()})
    cuts = sorted(set(ordered.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order)))
    cut = df.withColumn("__range", part)
    sums = cut.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__sum_{k}") for k, c in sums_of.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums_of])
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.join(offsets, [*keys, "__range"])
    return met.withColumns({k: F.col(f"__before_{k}") + F.sum(c).over(inside) for k, c in sums_of.items()}).drop("__range", *[f"__before_{k}" for k in sums_of])


def with_quota(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of sources that have a quota, with place and quota."""
    return df.join(few(table), "source")


def exact_cut(df: DataFrame, size: str = "n", items: str | None = None, skip: int = 0) -> DataFrame:
    """Rows of ``running`` with a quota, cut to it exactly; the last one is cut in the middle.

    Adds ``first`` (items of the row skipped) and ``taken``; with ``items`` that array is sliced too. ``skip`` leaves
    out as many items of each source first, as a resumed run does. A quota larger than its source takes all of it; where
    that is an error, ``filled`` raises it first.
    """
    start = F.col("through") - F.col(size)
    first = F.greatest(F.lit(skip) - start, F.lit(0))
    taken = F.least(F.col(size), F.col("quota") - start) - first
    out = df.where((start < F.col("quota")) & (F.col("through") > skip)).withColumns({"first": first, "taken": taken}).where("taken > 0")
    return out.withColumn(items, F.slice(items, F.col("first").cast("int") + 1, F.col("taken").cast("int"))) if items else out


def overshoot_cut(df: DataFrame, size: str = "n") -> DataFrame:
    """Whole rows up to and with the one that reaches the quota; a quota of 0 still takes the first."""
    start = F.col("through") - F.col(size)
    return df.where((start < F.col("quota")) | (start == 0)).withColumn("taken", F.col(size))


def short_sources(df: DataFrame, table: DataFrame, size: str = "n") -> DataFrame:
    """Sources whose rows do not fill their quota: source, quota, available."""
    have = df.groupBy("source").agg(F.sum(size).alias("available"))
    return table.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).where("available < quota").select("source", "quota", "available")


def filled(df: DataFrame, table: DataFrame, size: str = "n", share: float = 1.0) -> DataFrame:
    """``table``; raises if a source has less than ``share`` of its quota (1 for tokens, 0.99 for bytes of a tokenizer's corpus)."""
    short = short_sources(df, table, size).where(F.col("available") < share * F.col("quota")).orderBy("source").limit(20).collect()
    if short:
        raise ValueError("sources are exhausted before their quotas: " + ", ".join(f"{r['source']} at {r['available']} of {r['quota']}" for r in short))
    return table


def offsets(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows cut to quota with ``start``: their first item's place in the stream of all sources in order."""
    first = table.select("source", F.coalesce(F.sum("quota").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("source_start"))
    return df.join(few(first), "source").withColumn("start", F.col("source_start") + F.col("through") - F.col("n") + F.col("first"))


def byte_cut(df: DataFrame, text: str = "text", size: str = "n") -> DataFrame:
    """Lines cut to a quota of UTF-8 bytes; the last is cut to whole characters."""
    from ..functions.text import utf8_cut

    start = F.col("through") - F.col(size)
    kept = df.where(start < F.col("quota"))
    return kept.withColumn(text, utf8_cut(F.col(text), F.col("quota") - start)).withColumn("taken", F.octet_length(text).cast("long"))


