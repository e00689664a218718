"""Streaming operators; each takes a streaming DataFrame, and works on a batch one as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import path_exists
from ..sources.texts import ingest_responses

#: Tokens of a day in total, and tries of one client in one stage, that are too many.
DAILY_TOKENS, DAILY_TRIES = 200_000, 2
IDLE = "1800 seconds"


def progress(lines: DataFrame) -> DataFrame:
    """(batch_id, n): data lines (batch_id, value) so far, headers left out. For update or complete mode."""
    data = X.is_data_line(F.col("value")) & ~F.contains(F.lower("value"), F.lit("targetfolder"))
    return lines.where(data).groupBy("batch_id").agg(F.count("*").alias("n"))


def store_progress(counts: DataFrame, checkpoint: str, sink: str):
    """Starts a stream that stores the batches whose count has changed, an epoch in its own folder, so that a repeated epoch
    writes the same files again. Returns the query."""

    def store(part: DataFrame, epoch: int) -> None:
        part.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, sink: str) -> DataFrame:
    """(batch_id, n): the count of each batch in its last epoch."""
    stored = spark.read.schema("batch_id string, n long, epoch int").option("basePath", sink).parquet(sink)
    return stored.groupBy("batch_id").agg(F.max_by("n", "epoch").alias("n"))


def usage_quota(usage: DataFrame, watermark: str = "1 day", cap: int = DAILY_TOKENS) -> DataFrame:
    """(day, tokens, over_cap) of usage (ts, tokens)."""
    days = usage.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"))
    return days.agg(F.sum("tokens").alias("tokens")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tokens", (F.col("tokens") > cap).alias("over_cap"))


def usage_tries(usage: DataFrame, watermark: str = "1 day", most: int = DAILY_TRIES) -> DataFrame:
    """(day, client, stage, tries, over) of usage (ts, client, stage)."""
    days = usage.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "client", "stage")
    return days.agg(F.count("*").alias("tries")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "client", "stage", "tries", (F.col("tries") > most).alias("over"))


def sessions(events: DataFrame, gap: str = IDLE, watermark: str = "1 hour") -> DataFrame:
    """(session_key, started, turns, tokens): activity (session_key, ts, tokens) that pauses for less than the gap."""
    own = events.withWatermark("ts", watermark).groupBy("session_key", F.session_window("ts", gap))
    return own.agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens")).select("session_key", F.col("session_window.start").alias("started"), "turns", "tokens")


def ingest(spark: SparkSession, folder: str, checkpoint: str, sink: str):
    """Starts the ingestion of stored answers (JSON: batch_id, ts, raw_text) into parsed assignments, each batch once even over
    restarts; ends when all that is there is read. Returns the query."""
    stream = spark.readStream.schema("batch_id string, ts timestamp, raw_text string").json(folder)
    fresh = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["batch_id"])

    def store(part: DataFrame, epoch: int) -> None:
        # The sink itself tells what is in; an epoch that is repeated after a failure writes its own folder again.
        if path_exists(spark, sink):
            known = spark.read.schema("batch_id string, epoch int").option("basePath", sink).parquet(sink)
            part = part.hint("merge").join(known.where(F.col("epoch") != epoch).select("batch_id").distinct().hint("merge"), "batch_id", "left_anti")
        ingest_responses(part).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
