"""Training logs: one row for each event, by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "type string, step bigint, loss double, lr double, total_seen_tokens bigint, total_supervised_tokens bigint, cumulative_gpu_time_seconds double"


def parsed(lines: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """Events of log lines (with ``ord``): NULs go; blank and broken lines, other types, and losses not finite are left out."""
    clean = F.trim(F.translate(F.col(line), "\0", ""))
    rows = lines.select(order, F.from_json(clean, EVENT, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}).alias("e")).select(order, "e.*")
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & ~F.col("loss").isin(float("inf"), float("-inf"))
    return rows.where(F.col("type").isin("train", "validation") & F.col("step").isNotNull() & finite)


def latest_by_step(events: DataFrame, order: str = "ord") -> DataFrame:
    """Of events of one type and step, the last."""
    from .dedup import last_of

    return last_of(events, ["type", "step"], order)


def rolling_mean(df: DataFrame, size: int, value: str = "loss", order: str = "step") -> DataFrame:
    """``df`` with ``rolling``: the mean of the latest ``size`` rows, NaN before there are as many; of a shorter series its mean.

    A log is one series with a row for each step, which one task takes in order.
    """
    w = Window.orderBy(order)
    n = F.count("*").over(Window.partitionBy())
    rolling = F.avg(value).over(w.rowsBetween(1 - size, 0))
    early = F.row_number().over(w) < size
    return df.withColumn("rolling", F.when(n < size, F.avg(value).over(Window.partitionBy())).when(early, F.lit(float("nan"))).otherwise(rolling))


def density(df: DataFrame, interval: int = 200) -> DataFrame:
    """(step, density): per cent supervised of the tokens seen in each run of ``interval`` rows, where any were seen."""
    w = Window.orderBy("step")
    back = lambda c: F.lag(c, interval).over(w)
    out = df.select("step", (F.row_number().over(w) - 1).alias("i"), (F.col("total_seen_tokens") - back("total_seen_tokens")).alias("seen"), (F.col("total_supervised_tokens") - back("total_supervised_tokens")).alias("sup"))
    return out.where((F.col("i") > 0) & (F.col("i") % interval == 0) & (F.col("seen") > 0)).select("step", (100 * F.col("sup") / F.col("seen")).alias("density"))


def thinned(df: DataFrame, most: int = 5000, order: str = "step") -> DataFrame:
    """Every k-th row from the first, k so that about ``most`` stay."""
    i = F.row_number().over(Window.orderBy(order)) - 1
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) / most))
    return df.withColumns({"__i": i, "__k": stride}).where("__i % __k = 0").drop("__i", "__k")


def progress(train: DataFrame, restart: int, max_steps: int, recent: int = 500) -> DataFrame:
    """One row: current step and mean of recent losses, the mean before a restart, improvement, pace, hours left."""
    turn = F.row_number().over(Window.orderBy(F.col("step").desc()))
    rows = train.withColumn("__n", turn)
    before = F.col("step").between(restart - 499, restart)
    later = F.when(F.col("step") >= restart, F.col("step"))
    seconds = F.col("cumulative_gpu_time_seconds")
    one = rows.agg(
        F.max("step").alias("current_step"), F.avg(F.when(F.col("__n") <= recent, F.col("loss"))).alias("current_mean"),
        F.coalesce(F.avg(F.when(before, F.col("loss"))), F.min_by("loss", "step")).alias("baseline_mean"),
        F.coalesce(F.min(later), F.min("step")).alias("from_step"), F.max_by(seconds, "step").alias("seconds"),
        F.coalesce(F.min_by(F.when(later.isNotNull(), seconds), later), F.min_by(seconds, "step")).alias("from_seconds"),
    )
    elapsed, steps = F.col("seconds") - F.col("from_seconds"), F.col("current_step") - F.col("from_step")
    pace = F.when((steps > 0) & (elapsed > 0), elapsed / steps)
    return one.select(
        "current_step", "current_mean", "baseline_mean", ((F.col("baseline_mean") - F.col("current_mean")) / F.col("baseline_mean") * 100).alias("improvement"),
        F.least(F.col("current_step") / max_steps, F.lit(1.0)).alias("progress"), pace.alias("seconds_per_step"), ((max_steps - F.col("current_step")) * pace / 3600).alias("hours_left"),
    )


def running_best(validation: DataFrame, by: str | None = None) -> DataFrame:
    """``validation`` with ``improved``: a loss below all before it, in each series of ``by`` where given."""
    keys = [by] if by else []
    best = F.min("loss").over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return validation.withColumn("improved", best.isNull() | (F.col("loss") < best))


def failures(steps: DataFrame, most: int = 10, by: str | None = None) -> DataFrame:
    """``steps`` (step, ok) with ``failed``: steps in a row that failed so far, and ``abort`` once there are ``most``; in each series of ``by`` where given."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy("step")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.withColumn("__island", island)
    failed = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy(*keys, "__island").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("failed", F.when(F.col("ok"), 0).otherwise(failed).cast("long")).withColumn("abort", F.col("failed") >= most).drop("__island")


def weighted_loss(batches: DataFrame) -> DataFrame:
    """One row: the mean loss by targets of batches with targets and a finite loss, its perplexity (exponent capped at 20)."""
    good = (F.col("targets") > 0) & ~F.isnan("loss") & ~F.col("loss").isin(float("inf"), float("-inf"))
    mean = batches.where(good).agg((F.sum(F.col("loss") * F.col("targets")) / F.sum("targets")).alias("m")).select(F.coalesce("m", F.lit(float("nan"))).alias("loss"))
    return mean.withColumn("perplexity", F.when(F.isnan("loss"), F.lit(float("nan"))).otherwise(F.exp(F.least("loss", F.lit(20.0)))))


def plain_loss(batches: DataFrame) -> DataFrame:
    """One row: the mean of finite losses, or null."""
    return batches.where(~F.isnan("loss") & ~F.col("loss").isin(float("inf"), float("-inf"))).agg(F.avg("loss").alias("loss"))


def counters(samples: DataFrame, order: str = "pos", ignored: int = -100) -> DataFrame:
    """Running totals over samples (inputs, labels, pad): positions seen, next tokens supervised, positions not padding.

    ``order`` is a unique number; the sums are taken in two steps over ranges of it.
    """
    from .quota import running

    labelled = F.size(F.filter(F.slice("labels", F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0))), lambda x: x != ignored))
    real = F.size(F.filter("inputs", lambda x: x != F.col("pad")))
    sizes = {"seen": F.size("inputs"), "supervised": labelled, "not_padding": real}
    counted = samples.select(order, *[c.cast("long").alias(f"n_{k}") for k, c in sizes.items()])
    return running(counted, {k: f"n_{k}" for k in sizes}, order).select(order, *sizes)


def last_loss(events: DataFrame, order: str = "ord", by: str | None = None) -> DataFrame:
    """One row, or one for each value of ``by``: the last record's eval_loss if it has one, else its loss, with four decimals, or ``not available``."""
    keys = [by] if by else []
    last = events.groupBy(*keys).agg(F.max_by(F.struct("eval_loss", "loss"), order).alias("r"))
    value: Column = F.coalesce("r.eval_loss", "r.loss")
    return last.select(*keys, F.when(value.isNull(), "not available").otherwise(F.format_string("%.4f", value)).alias("last_loss"))
