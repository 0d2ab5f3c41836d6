"""Cluster events from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import signals
from .http import iso

_EVENT = "metadata struct<namespace:string>, involvedObject struct<kind:string,name:string,namespace:string>, reason string, type string, message string, count bigint, eventTime string, lastTimestamp string, firstTimestamp string"


def shape(events: DataFrame) -> DataFrame:
    """Flat events from a table with the columns seq and ``event`` (JSON text)."""
    v = events.withColumn("v", F.from_json("event", _EVENT))
    first = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs))
    when = T.parse_iso(first("v.eventTime", "v.lastTimestamp", "v.firstTimestamp"))
    return v.select(
        F.coalesce(first("v.metadata.namespace", "v.involvedObject.namespace"), F.lit("default")).alias("namespace"), F.coalesce(first("v.involvedObject.kind"), F.lit("Unknown")).alias("object_kind"), F.coalesce(first("v.involvedObject.name"), F.lit("unknown")).alias("object_name"),
        F.coalesce(first("v.reason"), F.lit("Unknown")).alias("reason"), F.coalesce(first("v.type"), F.lit("Normal")).alias("type"), F.coalesce("v.message", F.lit("")).alias("message"), "v.count", F.coalesce(when, F.timestamp_seconds(F.lit(0))).alias("ts"), "seq",
    )


def groups(events: DataFrame, source: str, query_ref: str, start, end, most: int = 20) -> list[dict]:
    """The largest groups in wire form."""
    top = signals.top_infrastructure(signals.infrastructure_groups(shape(events)), most)
    rows = top.select("fingerprint", "namespace", "type", "reason", "object_kind", "object_name", "message_template", "count", T.iso_z(F.col("first_seen")).alias("first"), T.iso_z(F.col("last_seen")).alias("last"), "seq").orderBy(F.desc("count"), "namespace", "object_kind", "object_name", "reason", "seq").collect()
    evidence = [{"source": source, "queryRef": query_ref, "start": iso(start), "end": iso(end)}]
    return [{"fingerprint": r.fingerprint, "reason": r.reason, "objectKind": r.object_kind, "objectName": r.object_name, "messageTemplate": r.message_template, "count": r["count"], "firstSeen": r.first, "lastSeen": r.last, "evidence": evidence} for r in rows]
