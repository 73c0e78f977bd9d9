"""Streams over the event log and over arriving papers.

An extension: the store's log is append-only, so it can be read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.config import shared_folder
from litspark.operators.routing import route


def event_windows(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, events, total) of events (ts, event_type, value), batch or stream; later events than `late` are dropped from a stream.

    Values are summed as decimals of six digits, so the sum doesn't depend on the order of events.
    """
    timed = events.withColumn("_at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(24,6)")).alias("total"))
    return counted.select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def run_to_end(stream: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """The result of a stream over what there is now, written to a shared folder with the stream's state."""
    at = folder or shared_folder(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def route_arrivals(papers: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None):  # noqa: ANN201
    """Route papers as they arrive: each batch's routes go to the sink, once per batch number."""
    folder = checkpoint or shared_folder(papers.sparkSession, "arrivals")

    def each(batch: DataFrame, number: int) -> None:
        sink(route(batch.dropDuplicates(["arxiv_id"])), number)

    return papers.writeStream.foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()
