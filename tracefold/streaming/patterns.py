"""Pattern counts over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def windowed(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts of each (window, template, severity); on a stream give the lateness that is waited for."""
    if late is not None:
        events = events.withWatermark("ts", late)
    stack = T.stack(F.col("message"))
    shaped = events.select("ts", T.severity(F.col("severity")).alias("severity"), stack.alias("stack"), "message").select("ts", "severity", T.template(F.col("message"), F.col("stack")).alias("template"))
    out = shaped.groupBy(F.window("ts", size).alias("w"), "template", "severity").agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), "template", "severity", "events")


def start(events: DataFrame, size: str, late: str, sink: str, checkpoint: str):
    """Append finished windows of a stream to Parquet files."""
    return windowed(events, size, late).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()
