"""Metric samples from a metric backend's range query, or from a recorded answer at any scale."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import signals
from .http import Backend, iso, observation

_RESULT = "array<struct<metric:map<string,string>,values:array<array<string>>>>"


@dataclass(frozen=True)
class MetricQuery:
    expression: str
    start: datetime
    end: datetime
    step_seconds: int = 15


def shape(result: DataFrame, points: int | None = None) -> DataFrame:
    """Samples (series, metric, labels, ord, ts, value) from a table with the column ``result``; a column ``slice`` sets its series apart.

    With ``points`` only so many samples are kept, counted over all series in order.
    """
    first = F.col("slice").cast("long") * (1 << 40) if "slice" in result.columns else F.lit(0).cast("long")
    series = result.select(first.alias("first"), F.posexplode(F.from_json("result", _RESULT)).alias("s", "x")).withColumn("series", F.col("first") + F.col("s"))
    samples = series.select("series", F.col("x.metric").alias("labels"), F.posexplode("x.values").alias("ord", "y")).where(F.size("y") >= 2)
    if points is not None:
        samples = samples.orderBy("series", "ord").limit(points)
    name = lambda k: F.nullif(F.try_element_at("labels", F.lit(k)), F.lit(""))
    seconds = F.element_at("y", 1).cast("double")
    return samples.select(
        "series", F.coalesce(name("__name__"), name("metric"), F.lit("unknown_metric")).alias("metric"), "labels", "ord",
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")).alias("ts"), F.element_at("y", 2).cast("double").alias("value"),
    )


class MetricBackend(Backend):
    name = "prom"

    def query(self, spark: SparkSession, q: MetricQuery) -> tuple[DataFrame, dict]:
        """Samples and the observation; ``retainedItems`` is the caller's to set."""
        self.check_window(q.start, q.end)
        if not q.expression.strip():
            raise ValueError("metric expression is required")
        if q.step_seconds < 1:
            raise ValueError("metric step must be positive")
        if int((q.end - q.start).total_seconds() // q.step_seconds) + 1 > self.limits.points:
            raise ValueError("metric query points exceed configured maximum")
        params = {"query": q.expression.strip(), "start": str(q.start.timestamp()), "end": str(q.end.timestamp()), "step": str(q.step_seconds), "timeout": f"{self.limits.seconds:g}s"}
        ref, result = self.fetch("/api/v1/query_range", params)
        rows = [r for r in result if isinstance(r, dict)]
        scanned = sum(isinstance(v, list) and len(v) >= 2 for r in rows for v in r.get("values", []))
        text = [{"metric": {str(k): str(v) for k, v in r.get("metric", {}).items()}, "values": [[str(x) for x in v[:2]] for v in r.get("values", []) if isinstance(v, list)]} for r in rows]
        raw = spark.createDataFrame([(json.dumps(text),)], "result string")
        return shape(raw, self.limits.points), observation("prometheus", ref, scanned, scanned, "point_limit_reached" if scanned > self.limits.points else None)


def anomalies(samples: DataFrame, ref: str, start: datetime, end: datetime, z_threshold: float = 3.0, most: int = 10) -> list[dict]:
    """The largest anomalies in wire form, each with its labels, baseline and peak.

    Series are matched by metric and labels in a canonical order; of equal ones the last counts.
    """
    keyed = samples.withColumn("key", F.to_json(F.array_sort(F.map_entries("labels"))))
    last = keyed.groupBy("metric", "key").agg(F.max("series").alias("series"))
    scores = signals.metric_anomalies(keyed, ["metric", "key", "series"], z_threshold)
    top = scores.orderBy(F.desc("score"), "metric", "key").limit(most)
    peaks = signals.baseline_and_peak(keyed.join(last, ["metric", "key", "series"]), ["metric", "key"])
    labels = keyed.groupBy("metric", "key").agg(F.first("labels").alias("labels"))
    rows = top.join(peaks, ["metric", "key"], "left").join(labels, ["metric", "key"], "left").select("metric", "score", "direction", T.iso_z(F.col("seen")).alias("seen"), "baseline", "peak", T.iso_z(F.col("peak_at")).alias("peak_at"), "labels", "key").orderBy(F.desc("score"), "metric", "key").collect()
    out = []
    for r in rows:
        text = "\0".join([r.metric, *(f"{k}={v}" for k, v in sorted(r.labels.items())), r.seen, r.seen])
        service = next((r.labels[k] for k in ("app", "service", "job") if r.labels.get(k)), "unknown")
        out.append({
            "id": "metric-" + hashlib.sha256(text.encode()).hexdigest()[:16], "metric": r.metric, "service": service, "state": "SPIKE" if r.direction == "up" else "DROP", "baseline": r.baseline, "peak": r.peak,
            "start": r.seen, "peakAt": r.peak_at, "shape": "spike" if r.direction == "up" else "drop", "evidence": [{"source": "prometheus", "queryRef": ref, "start": iso(start), "end": iso(end)}], "labels": r.labels, "score": r.score,
        })
    return out
