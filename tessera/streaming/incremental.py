"""Incremental profiles of event streams: windowed counts, missingness and sessions with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import use_checkpoints


def read_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_profile(events: DataFrame, ts: str = "ts", value: str = "value", by: str = "event_type", width: str = "1 day", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts, missing values and mean per window and group; rows later than the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(F.window(ts, width, slide or width), by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), by, "n", "missing", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), user, "n")


def settled(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The rows of a stream once all that is there now has been read, from a table in the shared checkpoint folder.

    Each batch replaces (complete) or extends (append) the table, under a name of its own, so that a batch that is run again after a
    failure leaves no row twice; nothing goes through the driver.
    """
    folder = f"{use_checkpoints(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(store).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
