"""Log events from JSON lines and from Python rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EVENTS

_LINE = "timestamp string, service string, severity string, message string, fields map<string,variant>, evidence struct<source:string,query_ref:string,queryRef:string,start:string,end:string>"


def read_lines(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Events of a file of JSON lines, in its order; blank lines are skipped.

    Lines are numbered by Spark's reader, so numbers are in order within a file
    and rise from file to file.  With ``check`` the first bad line is an error.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where(F.col("value").rlike(r"(?U)\S"))
    v = F.from_json("value", _LINE, {"mode": "PERMISSIVE"})
    ts = T.parse_iso(F.col("v.timestamp"))
    ref = F.coalesce("v.evidence.query_ref", "v.evidence.queryRef")
    parsed = lines.withColumn("v", v).select(
        "seq", "file", ts.alias("ts"), "v.service", F.coalesce("v.severity", F.lit("INFO")).alias("severity"), "v.message",
        F.coalesce(F.transform_values("v.fields", lambda k, x: F.to_json(x)), F.create_map().cast("map<string,string>")).alias("fields"),
        F.struct("v.evidence.source", ref.alias("queryRef"), "v.evidence.start", "v.evidence.end").alias("evidence"),
    )
    if check:
        bad = parsed.where("ts is null or service is null or message is null").orderBy("seq").limit(1).collect()
        if bad:
            raise ValueError(f"invalid event on line {_line_number(lines, bad[0])}: timestamp with offset, service and message are required")
    return parsed.drop("file")


def _line_number(lines: DataFrame, bad) -> int:
    """The line in its file, blank lines counted; one file's lines lie in a partition or several."""
    base = lines.sparkSession.read.text(bad.file).select(F.monotonically_increasing_id().alias("seq"), "value")
    return base.where(F.col("seq") <= bad.seq).count()


def file_bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def from_rows(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Events from mappings with timestamp (datetime or ISO text with offset), service, message and evidence."""
    out = []
    for seq, r in enumerate(rows):
        ts = r["timestamp"]
        ts = datetime.fromisoformat(ts.replace("Z", "+00:00")) if isinstance(ts, str) else ts
        if ts.tzinfo is None:
            raise ValueError("timestamps must be timezone-aware")
        fields = r.get("fields") if isinstance(r.get("fields"), Mapping) else {}
        e = r.get("evidence") or {}
        evidence = {"source": e.get("source"), "queryRef": e.get("queryRef", e.get("query_ref")), "start": e.get("start"), "end": e.get("end")}
        out.append((seq, ts, r["service"], r.get("severity", "INFO"), r["message"], {k: json.dumps(v, ensure_ascii=False) for k, v in fields.items()}, evidence))
    return spark.createDataFrame(out, EVENTS)
