"""Exact dedup of conversations and targets, and decontamination against benchmark n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.text import gram_hash, grams, non_blank

#: Distinct n-grams up to which a blocked set is broadcast (about 100 bytes each, 8 as hashes).
BROADCAST_GRAMS = 500_000


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key, the first in a total order. Combined before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in {key, *order}]
    least = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"), F.min(F.struct(*order)).alias("__order"))
    return least.select(key, *[F.col(f"__order.{c}") for c in order], *[F.col(f"__row.{c}") for c in rest]).select(*df.columns)


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key, the last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def targets(df: DataFrame, conversation: str = "conversation") -> DataFrame:
    """One row for each assistant message: target_index, prefix (all messages up to it) and id (of the normalized prefix)."""
    out = df.select(*[c for c in df.columns if c != conversation], conversation, F.posexplode(conversation).alias("target_index", "__m"))
    out = out.where((F.col("__m.role") == "assistant") & non_blank(F.col("__m.content")).isNotNull())
    out = out.withColumn("prefix", F.slice(conversation, 1, F.col("target_index") + 1))
    return out.withColumn("id", chat.identity(F.col("prefix"))).drop("__m", conversation)


def user_text(conversation: Column) -> Column:
    """All user messages, a newline between them."""
    users = F.filter(conversation, lambda m: m["role"] == "user")
    return F.array_join(F.transform(users, lambda m: m["content"]), "\n")


def blocked(fields: list[tuple[DataFrame, str]], n: int = 13) -> DataFrame:
    """The distinct n-grams (``gram``) of the named columns of some tables."""
    each = [df.select(F.explode(grams(F.col(c), n)).alias("gram")) for df, c in fields]
    whole = each[0]
    for x in each[1:]:
        whole = whole.unionByName(x)
    return whole.distinct()


def contaminated(df: DataFrame, key: list[str], text: Column, blocked_grams: DataFrame, n: int = 13) -> DataFrame:
    """The distinct keys of rows that share an n-gram with the blocked set.

    Hashes of 8 bytes are joined first; of the few rows that meet one, the n-grams themselves are then compared.
    """
    count = blocked_grams.limit(BROADCAST_GRAMS + 1).count()
    few = F.broadcast if count <= BROADCAST_GRAMS else (lambda side: side)
    hashes = blocked_grams.select(gram_hash(F.col("gram")).alias("hash")).distinct()
    near = df.select(*key, F.explode(grams(text, n, hashed=True)).alias("hash")).join(few(hashes), "hash", "left_semi").select(*key).distinct()
    met = df.join(near, key, "left_semi").select(*key, F.explode(grams(text, n)).alias("gram"))
    return met.join(few(blocked_grams), "gram", "left_semi").select(*key).distinct()


def flagged(df: DataFrame, key: list[str], text: Column, blocked_grams: DataFrame, n: int = 13) -> DataFrame:
    """``df`` with ``blocked``: whether the row shares an n-gram with the set. Keys must be unique."""
    found = contaminated(df, key, text, blocked_grams, n).withColumn("__found", F.lit(True))
    return df.join(found, key, "left").withColumn("blocked", F.coalesce("__found", F.lit(False))).drop("__found")


def clean_unique(df: DataFrame, order: list[str]) -> DataFrame:
    """Of flagged rows, those not blocked, and of each id the first in order; blocked rows do not count as seen."""
    return first_of(df.where("not blocked"), "id", order)


def counters(df: DataFrame) -> DataFrame:
    """Of flagged rows, by source: how many there are, are blocked, are repeats (of rows not blocked, all sources together), stay.

    Counted by id and source first, before the shuffle, so an id that any number of rows have is a row a task; then the
    source of an id's first row not blocked keeps one, and all others are repeats.
    """
    clean = ~F.col("blocked")
    each = df.groupBy("id", "source").agg(
        F.count("*").alias("n"), F.count(F.when(~clean, 1)).alias("n_blocked"), F.min(F.when(clean, F.struct("place", "ord", "target_index"))).alias("first"),
    )
    of_id = each.groupBy("id").agg(  # a row for each source of the id
        F.min_by("source", F.when(F.col("first").isNotNull(), F.struct("first", "source"))).alias("keeper"), F.collect_list(F.struct("source", "n", "n_blocked")).alias("parts")
    )
    parts = of_id.select("keeper", F.inline("parts")).withColumn("keeps", F.col("keeper").eqNullSafe(F.col("source")) & (F.col("n") > F.col("n_blocked")))
    sums = parts.groupBy("source").agg(F.sum("n").alias("n_targets"), F.sum("n_blocked").alias("n_blocked"), F.count(F.when(F.col("keeps"), 1)).alias("kept"))
    return sums.select("source", "n_targets", "n_blocked", (F.col("n_targets") - F.col("n_blocked") - F.col("kept")).alias("repeats"), "kept")
