"""Log events enriched once with all that the later operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage


def enrich(events: DataFrame) -> DataFrame:
    """Add severity, stack, template, fingerprint and ids; ``events`` has seq, ts, service, severity, message."""
    fields = F.col("fields") if "fields" in events.columns else None
    out = events.withColumn("severity", T.severity(F.col("severity"))).withColumn("stack", T.stack(F.col("message")))
    out = out.withColumn("template", T.template(F.col("message"), F.col("stack")))
    return out.withColumn("fingerprint", T.pattern_id(F.col("template"), F.col("severity"))).withColumn("ids", T.correlation_ids(F.col("message"), fields))


def staged(events: DataFrame) -> DataFrame:
    """Enriched events without their messages, written once for all operators that read them."""
    return stage(enrich(events).drop("message"), "events")


def escalations(events: DataFrame, bucket: str = "minute") -> DataFrame:
    """How often a severity is higher than the one before, over all events by time.

    Neighbours are compared inside time buckets; the first event of a bucket is
    compared with the last of the bucket before it, from a table of one row for
    each bucket that has events.
    """
    ranked = events.select("ts", "seq", T.severity_rank(F.upper(F.coalesce("severity", F.lit("")))).alias("rank")).withColumn("bucket", F.date_trunc(bucket, "ts"))
    place = F.struct("ts", "seq")
    inside = ranked.withColumn("before", F.expr("lag(rank) over (partition by bucket order by ts, seq)"))
    ups = inside.groupBy("bucket").agg(F.count_if(F.col("rank") > F.col("before")).alias("ups"), F.min_by("rank", place).alias("first"), F.max_by("rank", place).alias("last"))
    edges = ups.withColumn("before", F.expr("lag(last) over (order by bucket)"))
    return edges.agg((F.coalesce(F.sum("ups"), F.lit(0)) + F.count_if(F.col("first") > F.col("before"))).cast("long").alias("escalations"))


def window_seconds(events: DataFrame) -> DataFrame:
    """Whole seconds from the first to the last event, at least 1."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000
    return events.agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(span), F.lit(1))).alias("window_seconds"))
