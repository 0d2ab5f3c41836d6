"""Range scans as a Spark source: the window in slices, each fetched where its task runs.

``spark.read.format("backend_range")`` asks a log or metric backend for every slice
of a window and gives a row (slice, result) for each, which ``loki.shape`` and
``prometheus.shape`` turn into events and samples.  A slice is bounded as a single
query is; a slice at its limit is an error, so that nothing is lost in silence.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import loki, prometheus
from .http import Backend, Limits, iso

NAME = "backend_range"


class _Slice(InputPartition):
    def __init__(self, at: int, start: str, end: str):
        super().__init__(at)
        self.at, self.start, self.end = at, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Slice]:
        start, end = (datetime.fromisoformat(self.options[k]) for k in ("start", "end"))
        n = int(self.options["slices"])
        step = (end - start) / n
        cuts = [start + step * k for k in range(n)] + [end]
        return [_Slice(k, a.isoformat(), b.isoformat()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def read(self, part: _Slice):
        o = self.options
        start, end = datetime.fromisoformat(part.start), datetime.fromisoformat(part.end)
        backend = Backend(o["url"], limits=Limits(seconds=float(o["seconds"]), response_bytes=int(o["bytes"])))
        backend.name = "loki" if o["kind"] == "logs" else "prom"
        if o["kind"] == "logs":
            # nanoseconds, the end left out, so that slices do not meet
            whole = lambda t: int(t.timestamp()) * 1_000_000_000 + t.microsecond * 1000
            params = {"query": o["query"], "start": str(whole(start)), "end": str(whole(end)), "limit": o["limit"], "direction": "forward"}
            _, result = backend.fetch("/loki/api/v1/query_range", params)
        else:
            last = end - timedelta(seconds=int(o["step"])) if part.end != o["end"] else end
            _, result = backend.fetch("/api/v1/query_range", {"query": o["query"], "start": str(start.timestamp()), "end": str(last.timestamp()), "step": o["step"], "timeout": o["seconds"] + "s"})
        key = "stream" if o["kind"] == "logs" else "metric"
        rows = [{key: {str(k): str(v) for k, v in r.get(key, {}).items()}, "values": [[str(x) for x in v[:2]] for v in r.get("values", []) if isinstance(v, list)]} for r in result if isinstance(r, dict)]
        if sum(len(r["values"]) for r in rows) >= int(o["limit"]):
            raise RuntimeError(f"slice {part.at} reached its limit; ask for more slices")
        yield part.at, json.dumps(rows)


class BackendRange(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "slice long, result string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _scan(spark: SparkSession, kind: str, url: str, query: str, start: datetime, end: datetime, slices: int, limits: Limits, **more) -> DataFrame:
    if start.tzinfo is None or end.tzinfo is None or end <= start:
        raise ValueError("a scan needs a timezone-aware window")
    if slices < 1 or (end - start) / slices > limits.window:
        raise ValueError("a slice exceeds the configured window")
    Backend(url)  # checks the URL here, before any task
    spark.dataSource.register(BackendRange)
    options = {"kind": kind, "url": url, "query": query, "start": start.isoformat(), "end": end.isoformat(), "slices": slices, "seconds": f"{limits.seconds:g}", "bytes": limits.response_bytes, **more}
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()


def scan_logs(spark: SparkSession, url: str, q: loki.LogQuery, slices: int, limits: Limits = Limits()) -> DataFrame:
    """Events of the whole window, whatever its length, in ``slices`` bounded queries."""
    raw = _scan(spark, "logs", url, loki.selector(q), q.start, q.end, slices, limits, limit=limits.lines)
    return loki.shape(raw, {"source": "loki", "queryRef": NAME, "start": iso(q.start), "end": iso(q.end)})


def scan_metrics(spark: SparkSession, url: str, q: prometheus.MetricQuery, slices: int, limits: Limits = Limits()) -> DataFrame:
    """Samples of the whole window; slices are whole steps, and the last one has the end."""
    if (q.end - q.start) % (timedelta(seconds=q.step_seconds) * slices):
        raise ValueError("a slice must be a whole number of steps")
    raw = _scan(spark, "metrics", url, q.expression, q.start, q.end, slices, limits, limit=limits.points + 1, step=q.step_seconds)
    return prometheus.shape(raw)
