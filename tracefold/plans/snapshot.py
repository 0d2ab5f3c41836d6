"""The incident snapshot: one bounded, evidence-backed view of a set of log events."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import correlate, events as E, patterns as P
from ..staging import placed, stage

SCHEMA_VERSION = "incident-context/v1"
# Tokens that the estimate takes for each entry of a section.
SECTION_TOKENS = {"deltas": 20, "timeline": 18, "metricAnomalies": 18, "infrastructureEvents": 18, "grafanaReferences": 10, "stackFingerprints": 24, "correlations": 16}
# Kinds of markers and states of anomalies.
MARKER_KINDS = ("deployment", "config", "restart", "feature_flag")
ANOMALY_STATES = ("NEW", "SPIKE", "DROP", "DISAPPEARED", "STABLE", "CHANGED", "RECOVERED", "MISSING")
_VERSION = re.compile(r"[A-Za-z0-9._:@/+\-]{1,128}")


@dataclass
class Request:
    """What a snapshot is built from; side inputs are mappings in wire form."""

    scope: str
    token_budget: int
    events: DataFrame
    baseline: DataFrame | None = None
    incident_seconds: int | None = None
    baseline_seconds: int | None = None
    markers: list[dict] = field(default_factory=list)
    anomalies: list[dict] = field(default_factory=list)
    infrastructure: list[dict] = field(default_factory=list)
    dashboards: list[dict] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)


def evidence(value: dict | None) -> dict:
    """Evidence in wire form; every coordinate is required."""
    value = value or {}
    out = {"source": value.get("source"), "queryRef": value.get("queryRef", value.get("query_ref")), "start": value.get("start"), "end": value.get("end")}
    for name, part in out.items():
        if part is None or not str(part).strip():
            raise ValueError(f"evidence {name} is required")
    return {k: str(v) for k, v in out.items()}


def aware(value: str, what: str) -> datetime:
    try:
        out = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"{what} must be an ISO timestamp") from None
    if out.tzinfo is None:
        raise ValueError(f"{what} must be timezone-aware")
    return out


def validate(r: Request) -> None:
    if not r.scope or not r.scope.strip():
        raise ValueError("scope is required")
    if r.token_budget < 64:
        raise ValueError("token budget must be at least 64")
    if r.baseline is not None and not ((r.incident_seconds or 0) >= 1 and (r.baseline_seconds or 0) >= 1):
        raise ValueError("a baseline needs both windows in seconds")
    for a in r.anomalies:
        if not all(str(a.get(k) or "").strip() for k in ("id", "metric", "service")):
            raise ValueError("an anomaly needs id, metric and service")
        if a.get("state") not in ANOMALY_STATES:
            raise ValueError("unsupported anomaly state")
        for k in ("start", "peakAt"):
            aware(a.get(k), f"anomaly {k}")
        if not a.get("evidence"):
            raise ValueError("an anomaly needs evidence")
    for i in r.infrastructure:
        if not all(str(i.get(k) or "").strip() for k in ("fingerprint", "reason", "objectName")):
            raise ValueError("an infrastructure event needs fingerprint, reason and object name")
        for k in ("firstSeen", "lastSeen"):
            aware(i.get(k), f"infrastructure {k}")
        if i.get("count", 0) < 1 or not i.get("evidence"):
            raise ValueError("an infrastructure event needs a count and evidence")
    for d in r.dashboards:
        url = urlparse(d.get("url") or "")
        if url.scheme not in ("http", "https") or not url.netloc or url.username or url.password:
            raise ValueError("a dashboard needs an absolute http URL without credentials")
        if any(T.looks_secret(str(k)) or T.looks_secret(str(v)) for k, v in (d.get("variables") or {}).items()):
            raise ValueError("dashboard variables must not hold secrets")
    for m in r.markers:
        if m.get("kind") not in MARKER_KINDS:
            raise ValueError("unsupported deployment marker kind")
        if not str(m.get("service") or "").strip():
            raise ValueError("deployment marker service is required")
        if not _VERSION.fullmatch(str(m.get("version") or "")):
            raise ValueError("deployment marker version is invalid")
        aware(m.get("timestamp"), "deployment marker timestamp")
        evidence(m.get("evidence"))
    for table in (r.events, r.baseline):
        if table is not None and "evidence" in table.columns:
            parts = ("source", "queryRef", "start", "end")
            blank = [~F.coalesce(F.col(f"evidence.{p}"), F.lit("")).rlike(r"(?U)\S") for p in parts]
            bad = table.select(*(b.alias(p) for b, p in zip(blank, parts))).where(" or ".join(f"`{p}`" for p in parts)).limit(1).collect()
            if bad:
                raise ValueError(f"evidence {next(p for p in parts if bad[0][p])} is required")


@dataclass
class Snapshot:
    """Staged tables of the parts that grow with the data, and the scalars.

    The events are read from their source once; all tables are made from a staged
    copy without messages, and the small ones from staged patterns.
    """

    request: Request
    patterns: DataFrame
    retained: DataFrame
    deltas: DataFrame | None
    stacks: DataFrame
    groups: DataFrame
    summary: DataFrame
    entries: DataFrame
    totals: DataFrame

    def sections(self) -> dict[str, tuple[DataFrame, list]]:
        """The sections that grow with the data, as tables with their orders; ``to_dict`` shows the same rows."""
        out = {
            "patterns": (self.retained.select(*_PATTERN, "cost"), P.ranked(self.retained)),
            "stackFingerprints": (self.stacks.select(*_STACK), [F.desc("count"), "fingerprint"]),
            "correlations": (self.groups.select(*_GROUP), [F.desc("confidence"), F.desc("event_count"), "correlation_ref"]),
            "timeline": (self.entries, ["timestamp", "kind", "service", "fingerprint"]),
        }
        return out if self.deltas is None else out | {"deltas": (self.deltas.select(*_DELTA), ["template", "severity"])}

    def write(self, folder: str) -> dict:
        """Write the sections as tables with places under ``folder``, whatever their size; returns the scalars."""
        sizes = {}
        for name, (table, order) in self.sections().items():
            placed(table, *order).write.mode("overwrite").parquet(f"{folder}/{name}")
            sizes[name] = self.retained.sparkSession.read.parquet(f"{folder}/{name}").count()
        r = self.request
        sizes["timeline"] += len(r.markers) + len(r.anomalies) + len(r.infrastructure)
        return self._scalars(sizes, self.retained.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])

    def to_dict(self) -> dict:
        """The snapshot in wire form; what it collects is what it shows, so large ones are for ``write``."""
        r = self.request
        tables = self.sections()
        shown = lambda name: [_wire(x) for x in tables[name][0].orderBy(*tables[name][1]).collect()] if name in tables else []
        patterns = shown("patterns")
        cost = sum(p.pop("cost") for p in patterns)
        timeline = sorted([*_side_entries(r), *(_entry(x) for x in self.entries.orderBy(*tables["timeline"][1]).collect())], key=lambda e: (e["timestamp"], e["kind"], e["service"]))
        sections = {"patterns": patterns, "deltas": shown("deltas"), "timeline": timeline, "stackFingerprints": shown("stackFingerprints"), "correlations": shown("correlations")}
        sections |= {"metricAnomalies": r.anomalies, "infrastructureEvents": r.infrastructure, "grafanaReferences": r.dashboards}
        return self._scalars({k: len(v) for k, v in sections.items()}, cost) | sections

    def _scalars(self, sizes: dict[str, int], cost: int) -> dict:
        """All that is no list, from the sizes of the lists and the cost of the patterns."""
        r = self.request
        sizes = {"metricAnomalies": len(r.anomalies), "infrastructureEvents": len(r.infrastructure), "grafanaReferences": len(r.dashboards)} | sizes
        discovered, kept = self.patterns.count(), sizes["patterns"]
        totals, summary = self.totals.first(), self.summary.first()
        tokens = P.ENVELOPE + cost + sum(SECTION_TOKENS[k] * n for k, n in sizes.items() if k in SECTION_TOKENS)
        times = [totals["last"], *(m["timestamp"] for m in r.markers), *(a["peakAt"] for a in r.anomalies), *(i["lastSeen"] for i in r.infrastructure)]
        moments = [aware(t, "timestamp") for t in times if t] or [datetime.now(timezone.utc)]
        return {
            "schemaVersion": SCHEMA_VERSION,
            "scope": r.scope,
            "generatedAt": max(moments).astimezone(timezone.utc).isoformat().replace("+00:00", "Z"),
            "rawEventCount": totals["n"],
            "incomplete": discovered > kept or any(not o["complete"] for o in r.observations),
            "omittedPatternCount": discovered - kept,
            "tokenBudget": r.token_budget,
            "requiredTokens": tokens,
            "budgetExceeded": tokens > r.token_budget,
            "sources": r.observations,
            "sourceQueries": sum(o["queryCount"] for o in r.observations),
            "correlationSummary": {_camel(k): v for k, v in summary.asDict().items()},
            "compression": {
                "rawEvents": totals["n"], "discoveredPatterns": discovered, "retainedPatterns": kept,
                "estimatedInputTokens": totals["tokens"], "estimatedOutputTokens": tokens, "estimatedCompressionRatio": round(totals["tokens"] / max(1, tokens), 2),
            },
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True)


_PATTERN = ("fingerprint", "template", "severity", "count", "first_seen", "last_seen", "services", "samples", "evidence", "retention_reason", "exception_fingerprint")
_DELTA = ("fingerprint", "template", "severity", "incident_count", "baseline_count", "incident_rate_per_minute", "baseline_rate_per_minute", "absolute_rate_delta", "relative_change", "state")
_STACK = ("fingerprint", "exception_type", "frames", "count", "services", "first_seen", "last_seen", "evidence")
_GROUP = ("correlation_ref", "id_type", "event_count", "services", "first_seen", "last_seen", "confidence")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _wire(row) -> dict:
    out = {_camel(k): v for k, v in row.asDict(recursive=True).items()}
    for s in out.get("samples") or []:
        s["fields"] = {k: json.loads(v) for k, v in s["fields"].items()}
    return out


def _entry(row) -> dict:
    out = _wire(row)
    out["metadata"] = {k: json.loads(v) for k, v in out["metadata"].items()}
    return out


def _side_entries(r: Request) -> list[dict]:
    one = lambda **x: {"fingerprint": None, "version": None, "metadata": {}, "correlationRefs": [], "evidence": []} | x
    out = []
    if r.markers:
        spark = r.events.sparkSession
        rows = [(k, m.get("summary") or "", {a: json.dumps(b) for a, b in (m.get("metadata") or {}).items()}) for k, m in enumerate(r.markers)]
        clean = spark.createDataFrame(rows, "k int, summary string, fields map<string,string>").select("k", T.normalize_message(F.col("summary")).alias("summary"), T.sanitized(F.col("fields")).alias("fields"))
        for x in clean.orderBy("k").collect():
            m = r.markers[x.k]
            ts = aware(m["timestamp"], "timestamp").astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
            out.append(one(timestamp=ts, kind=m["kind"], service=m["service"], summary=x.summary, version=m["version"], metadata={a: json.loads(b) for a, b in x.fields.items()}, evidence=[evidence(m["evidence"])]))
    for a in r.anomalies:
        out.append(one(timestamp=a["start"], kind="metric_anomaly", service=a["service"], summary=f"{a['metric']} {a['state'].lower()} ({a['shape']})", fingerprint=a["id"], metadata={"baseline": a["baseline"], "peak": a["peak"]}, evidence=a["evidence"]))
    for i in r.infrastructure:
        out.append(one(timestamp=i["firstSeen"], kind="infrastructure_event", service=i["objectName"], summary=f"{i['reason']}: {i['messageTemplate']}"[:240], fingerprint=i["fingerprint"], metadata={"count": i["count"], "objectKind": i["objectKind"]}, evidence=i["evidence"]))
    return out


def build(r: Request) -> Snapshot:
    """Plan the snapshot over events that are enriched and staged once."""
    validate(r)
    size = F.length("message")
    rows = r.events.withColumn("tokens", F.greatest(F.lit(1), F.floor(size / 4)) + 12)
    enriched = E.staged(rows)
    totals = enriched.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), T.iso_z(F.max("ts").cast("timestamp")).alias("last"))
    patterns = stage(P.discover(enriched), "patterns")
    retained = stage(P.retained(patterns, r.token_budget), "retained")
    groups = stage(correlate.correlation_groups(enriched), "groups")
    deltas = None if r.baseline is None else stage(correlate.deltas(enriched, E.enrich(r.baseline), r.incident_seconds, r.baseline_seconds), "deltas")
    entries = correlate.pattern_entries(retained, correlate.pattern_refs(retained, enriched, groups))
    return Snapshot(r, patterns, retained, deltas, P.stack_groups(enriched), groups, correlate.correlation_summary(enriched, groups), entries, totals)
