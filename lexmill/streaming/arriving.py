"""Arriving JSONL shards: filtered and tokenized as they come, each file once, totals kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source string", files_each: int = 100) -> DataFrame:
    """A stream of the rows of JSONL files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def filtered(stream: DataFrame) -> DataFrame:
    """Stripped texts of at least 80 characters with their white-space tokens."""
    kept = stream.withColumn("text", T.strip(F.col("text"))).where(F.length("text") >= T.LEAST_CHARS)
    return kept.withColumn("n_tokens", F.size(T.words(F.col("text"))).cast("long"))


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that has arrived as Parquet, by source, and ends; run again it takes only what is new."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("source").trigger(availableNow=True).start()


def totals(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps documents and tokens by source in a table (a folder) that is written anew after each batch."""
    counted = stream.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)  # the whole state, a row for each source

    return counted.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and kind of a stream of (ts, kind); rows later than ``late`` are left out, and an hour is given when it is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "kind").agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), "kind", "n")
