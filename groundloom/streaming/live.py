"""The batch rules over streams of acquisitions: newest wins, running sums, daily windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundloom.operators.overlap import newest_per_cell


def daily_counts(events: DataFrame, ts: str, *by: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by day; on a stream, days close once the watermark has passed them."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    day = F.window(ts, "1 day")
    out = events.groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("day"), *by, "n", "total")


def newest_wins(stream: DataFrame, cell: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps at path the newest tile of each cell, whatever the order of arrival. A batch is written beside the last and named by its id, so a repeated batch does no harm."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = newest_per_cell(batch, cell).drop("n_rejected")
        if batch_id:
            old = spark.read.parquet(f"{path}/state-{batch_id - 1}")
            new = newest_per_cell(old.unionByName(new), cell).drop("n_rejected")
        new.write.mode("overwrite").parquet(f"{path}/state-{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).start()


