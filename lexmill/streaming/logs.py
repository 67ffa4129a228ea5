"""Training logs of many runs as they arrive: the latest record of each step, running bests and failures, kept up to date.

A record carries the number it has in its run's log (``ord``), so what is late or comes twice changes nothing that a batch over all
lines would not say. The state that Spark keeps is a record for each run, type and step; of the results, only those of
runs with news are worked out again, and only files that hold their rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs
from ..sources import commit
from ..sources.shared import stored

RECORD = "run string, ord long, type string, step long, loss double, ok boolean"
KEYS = ["run", "type", "step"]


def records(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """A stream of the records in JSONL files that appear in a folder; broken lines and those without a run, step or number are left out."""
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_each).option("mode", "PERMISSIVE").json(folder)
    return rows.where("run is not null and step is not null and ord is not null and type in ('train', 'validation')")


def latest(rows: DataFrame) -> DataFrame:
    """Of each run, type and step the record with the greatest number (of equal ones, the greatest loss). For streams and tables alike."""
    last = F.max(F.struct("ord", "loss", "ok")).alias("last")
    return rows.groupBy(*KEYS).agg(last).select(*KEYS, "last.ord", "last.loss", "last.ok")


def bests(rows: DataFrame) -> DataFrame:
    """(run, step, loss, improved) of the validations among ``latest`` rows; one without a finite loss improves nothing."""
    loss = F.when(~F.isnan("loss") & ~F.abs("loss").isin(float("inf")), F.col("loss"))
    best = logs.running_best(rows.where("type = 'validation'").select("run", "step", loss.alias("loss")), by="run")
    return best.withColumn("improved", F.col("improved") & F.col("loss").isNotNull())


def streaks(rows: DataFrame, most: int = 10) -> DataFrame:
    """(run, step, ok, failed, abort) of the training steps among ``latest`` rows; a step that says nothing is fine."""
    steps = rows.where("type = 'train'").select("run", "step", F.coalesce("ok", F.lit(True)).alias("ok"))
    return logs.failures(steps, most, by="run")


def follow(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes all that has arrived and ends; run again with the same checkpoint it takes only what is new.

    Under ``folder`` are three stored tables: latest, bests and streaks. A batch that is taken again after a failure writes the
    same rows over those of its first try.
    """

    def save(batch: DataFrame, _: int) -> None:
        spark, news = batch.sparkSession, stored(batch, "news")  # written once: a batch's plan may be run only as it stands
        runs = news.select("run").distinct()
        commit.upsert(news, f"{folder}/latest", KEYS)
        touched = commit.read(spark, f"{folder}/latest").join(runs, "run", "left_semi")
        commit.upsert(bests(touched), f"{folder}/bests", ["run", "step"])
        commit.upsert(streaks(touched), f"{folder}/streaks", ["run", "step"])

    return latest(rows).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
