"""The order of a buffered shuffle, worked out without a buffer.

A buffer of B slots is filled with the first B rows. Every later row t draws a slot, the row in it goes out, and row t takes its
place; at the end the rows left go out in a random order. So a row goes out when its slot is drawn next: the
place of row t is the next later t' of the same slot, less B. That is a window over the rows of a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrivals of a range: a task's window holds one slot's rows of one range.
RANGE = 1 << 22


def draw(seed: int, place: Column, size: int) -> Column:
    """A number below ``size`` for each place: 32 bits of an MD5 of seed and place, so any engine can draw the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), place.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size))


def buffered(df: DataFrame, size: int, seed: int, arrival: str = "arrival", name: str = "place") -> DataFrame:
    """``df`` with ``name``: its place in the order of a shuffle with a buffer of ``size`` rows.

    ``arrival`` numbers the rows from 0 on without gaps. No row goes out more than ``size`` - 1 places before its arrival. The
    rows that the buffer holds at the end, ``size`` at most, are put in order by one task; all others by windows over a slot
    and a range of arrivals. An empty table gives none; a buffer of one row keeps the order.
    """
    if size < 1:
        raise ValueError("a buffer has one row at least")
    t = F.col(arrival)
    slotted = df.withColumn("__slot", F.when(t < size, t).otherwise(draw(seed, t, size))).withColumn("__range", F.floor(t / RANGE))
    inside = F.lead(arrival).over(Window.partitionBy("__slot", "__range").orderBy(arrival))
    firsts = slotted.groupBy("__slot", "__range").agg(F.min(arrival).alias("__first"))
    later = firsts.select("__slot", "__range", F.lead("__first").over(Window.partitionBy("__slot").orderBy("__range")).alias("__later"))
    met = slotted.withColumn("__next", inside).join(later, ["__slot", "__range"]).withColumn("__next", F.coalesce("__next", "__later")).drop("__later", "__range")
    left = met.where("__next is null").select("__slot", (F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}:end"), F.col("__slot"))), "__slot")) - 1).alias("__turn"))
    last = left.withColumn("__turn", F.col("__turn").cast("long"))  # a row for each slot
    n = df.agg((F.max(arrival) + 1).alias("n")).select(F.coalesce("n", F.lit(0)).alias("__n"))
    ended = met.join(last, "__slot", "left")
    total = n.first()["__n"]
    place = F.when(F.col("__next").isNotNull(), F.col("__next") - size).otherwise(F.greatest(F.lit(total - size), F.lit(0)) + F.col("__turn"))
    return ended.withColumn(name, place.cast("long")).drop("__slot", "__next", "__turn")
