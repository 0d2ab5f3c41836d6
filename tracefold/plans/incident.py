"""From backends to a snapshot: log first or metric first; and the guard in front of a model."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..operators.events import window_seconds
from ..sources import loki, prometheus
from . import windows
from .snapshot import Request, Snapshot, build


def log_first(spark: SparkSession, logs: loki.LogBackend, scope: str, budget: int, query: loki.LogQuery, baseline: loki.LogQuery | None = None) -> Snapshot:
    events, seen = logs.query(spark, query)
    seconds = lambda q: int((q.end - q.start).total_seconds())
    r = Request(scope, budget, events, incident_seconds=seconds(query), observations=[seen])
    if baseline is not None:
        r.baseline, before = logs.query(spark, baseline)
        r.baseline_seconds = seconds(baseline)
        r.observations.append(before)
    return build(r)


def metric_first(spark: SparkSession, logs: loki.LogBackend, metrics: prometheus.MetricBackend, scope: str, budget: int, query: prometheus.MetricQuery, namespace: str, most: int = 10, apps: int = 5, limit: int = 500) -> Snapshot:
    """Anomalies first; then the logs of the services they name, or those with errors."""
    samples, seen = metrics.query(spark, query)
    found = prometheus.anomalies(samples, seen["queryRef"], query.start, query.end, most=most)
    wanted: list[str] = []
    for a in found:
        app = next((a["labels"][k] for k in ("app", "service", "job") if a["labels"].get(k)), None)
        if app and app not in wanted and len(wanted) < apps and all(c.isalnum() and c.isascii() or c in "_.:-" for c in app):
            wanted.append(app)
    log_query = loki.LogQuery(namespace, query.start, query.end, tuple(wanted), None if wanted else "ERROR", limit)
    events, lines = logs.query(spark, log_query)
    wire = [{k: v for k, v in a.items() if k not in ("labels", "score")} for a in found]
    observations = [seen | {"retainedItems": len(found)}, lines]
    return build(Request(scope, budget, events, incident_seconds=int((query.end - query.start).total_seconds()), anomalies=wire, observations=observations))


@dataclass(frozen=True)
class Source:
    """A tenant's backends; callers name it and never see its URLs."""

    tenant: str
    source_id: str
    logs: loki.LogBackend
    metrics: prometheus.MetricBackend | None = None
    namespace: str | None = None


class Catalog:
    def __init__(self):
        self._sources: dict[tuple[str, str], Source] = {}

    def register(self, source: Source) -> None:
        self._sources[source.tenant, source.source_id] = source

    def resolve(self, tenant: str, source_id: str) -> Source:
        if (found := self._sources.get((tenant, source_id))) is None:
            raise LookupError("observability source not found")
        return found


def from_source(spark: SparkSession, source: Source, scope: str, start: datetime, end: datetime, budget: int, namespace: str | None = None, apps: tuple[str, ...] = (), baseline_minutes: int | None = None, mode: str = "loki", expression: str | None = None, step: int = 15, most: int = 10, limit: int = 500) -> Snapshot:
    namespace = namespace or source.namespace
    if not namespace:
        raise ValueError("namespace is required when the source has no default namespace")
    if mode == "metric-first":
        if not (expression or "").strip():
            raise ValueError("metric_expression is required for metric-first mode")
        if source.metrics is None:
            raise ValueError("the source has no metric backend")
        return metric_first(spark, source.logs, source.metrics, scope, budget, prometheus.MetricQuery(expression, start, end, step), namespace, most, limit=limit)
    if mode != "loki":
        raise ValueError("mode must be 'loki' or 'metric-first'")
    query = loki.LogQuery(namespace, start, end, apps, None, limit)
    before = None if baseline_minutes is None else loki.LogQuery(namespace, *windows.before_baseline(start, end, baseline_minutes), apps, None, limit)
    return log_first(spark, source.logs, scope, budget, query, before)


# Kinds of payload; those that may not reach a model as they are.
KINDS = ("raw_logs", "loki_result", "prometheus_result", "stacktrace", "incident_context", "generic")


def protect(kind: str, payload, scope: str, budget: int = 2_000) -> dict:
    """Let compact context pass, compress raw log events, and refuse all other raw data."""
    if kind not in KINDS:
        raise ValueError(f"unknown context kind: {kind}")
    size = lambda v: max(1, len(str(v)) // 4)
    if kind in ("incident_context", "generic"):
        return {"kind": kind, "payload": payload, "rawItems": 0, "estimatedRawTokens": size(payload), "estimatedCompactTokens": size(payload), "preventedRawTokens": 0}
    if kind != "raw_logs":
        raise ValueError(f"{kind} cannot be passed to a model; build an incident from its source or convert it to log events")
    if not isinstance(payload, DataFrame):
        raise ValueError("raw_logs payload must be a table of log events")
    totals = payload.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("chars")).first()
    if not totals.n:
        raise ValueError("raw_logs payload must not be empty")
    span = window_seconds(payload).first()[0]
    with staging.scope():
        compact = build(Request(scope, budget, payload, incident_seconds=span + 1)).to_dict()
    raw, small = max(1, totals.chars // 4), size(json.dumps(compact))
    return {"kind": "incident_context", "payload": compact, "rawItems": totals.n, "estimatedRawTokens": raw, "estimatedCompactTokens": small, "preventedRawTokens": max(0, raw - small)}
