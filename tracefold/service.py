"""A thin HTTP and MCP service over snapshots: keys, roles, rates, storage per tenant, and an audit trail."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Protocol
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .plans import disclosure, incident
from .plans.snapshot import Request, Snapshot, aware, build, evidence
from .session import ship
from .sources.jsonl import from_rows
from .staging import scope

READ, WRITE, AUDIT = "read", "write", "audit"


class Refused(Exception):
    """An answer other than success: HTTP status, code, message and the audit's outcome."""

    def __init__(self, status: int, code: str, message: str, outcome: str = "failure"):
        super().__init__(message)
        self.status, self.code, self.outcome = status, code, outcome


@dataclass(frozen=True)
class Caller:
    tenant: str
    roles: frozenset[str]
    id: str


class Keys:
    """API keys by digest; the keys themselves are not kept."""

    def __init__(self):
        self._callers: dict[str, Caller] = {}

    def add(self, key: str, tenant: str, roles: set[str]) -> None:
        for value, what in ((key, "key"), (tenant, "tenant")):
            if not value or not str(value).strip():
                raise ValueError(f"{what} is required")
        digest = hashlib.sha256(key.encode()).hexdigest()
        self._callers[digest] = Caller(tenant.strip(), frozenset(roles), digest[:16])

    def caller(self, header: str | None) -> Caller:
        kind, _, key = (header or "").partition(" ")
        found = self._callers.get(hashlib.sha256(key.strip().encode()).hexdigest()) if kind.lower() == "bearer" and key.strip() else None
        if found is None:
            raise Refused(401, "unauthorized", "a valid bearer token is required", "unauthorized")
        return found


@dataclass
class Bounds:
    payload_bytes: int = 1_048_576
    events: int = 2_000
    per_minute: int = 60
    contexts: int = 64
    audit: int = 256
    read: int = 50


class Authority(Protocol):
    """Whoever tells callers by their authorization header, or refuses them; ``Keys`` is one."""

    def caller(self, header: str | None) -> Caller: ...


@dataclass
class Service:
    """All state is held per tenant and bounded."""

    spark: SparkSession
    keys: Authority
    sources: incident.Catalog = field(default_factory=incident.Catalog)
    bounds: Bounds = field(default_factory=Bounds)
    clock: Callable[[], float] = time.time
    builder: Callable[[Request], Snapshot] = build

    def __post_init__(self):
        ship(self.spark)
        self._lock = threading.Lock()
        self._windows: dict[str, tuple[float, int]] = {}
        self._stored: dict[str, dict[str, dict]] = defaultdict(dict)
        self._audit: dict[str, deque] = defaultdict(lambda: deque(maxlen=self.bounds.audit))

    # requests

    def charge(self, tenant: str) -> None:
        """A fixed minute from a tenant's first request on."""
        now = self.clock()
        with self._lock:
            start, n = self._windows.get(tenant, (now, 0))
            start, n = (now, 0) if now - start >= 60 else (start, n)
            if n >= self.bounds.per_minute:
                raise Refused(429, "rate_limited", "too many requests for this tenant", "rate_limited")
            self._windows[tenant] = start, n + 1

    def request(self, body: dict) -> Request:
        def events(name: str):
            rows = body.get(name)
            if not isinstance(rows, list):
                raise Refused(400, "bad_events", f"{name} must be a list", "validation_failed")
            if len(rows) > self.bounds.events:
                raise Refused(413, "too_many_events", f"{name} has too many events", "validation_failed")
            for r in rows:
                if not isinstance(r, dict) or not str(r.get("service") or "").strip() or not str(r.get("message") or "").strip():
                    raise Refused(400, "bad_events", "an event needs service and message", "validation_failed")
                aware(r.get("timestamp"), "event timestamp")
                evidence(r.get("evidence"))
            return from_rows(self.spark, rows)

        either = lambda x, a, b: x.get(a, x.get(b))
        refs = lambda x: [evidence(e) for e in (x.get("evidence") if isinstance(x.get("evidence"), list) else [x.get("evidence")])]
        parts = lambda *names: next((body[n] for n in names if n in body), None) or []
        anomalies = [
            {"id": either(a, "id", "anomaly_id") or f"metric-{k}", "metric": a.get("metric"), "service": a.get("service"), "state": str(a.get("state") or "CHANGED").upper(), "baseline": a.get("baseline"), "peak": a.get("peak"), "start": a.get("start"), "peakAt": either(a, "peakAt", "peak_at"), "shape": a.get("shape") or "", "evidence": refs(a)}
            for k, a in enumerate(parts("metric_anomalies", "metricAnomalies"))
        ]
        infra = [
            {"fingerprint": i.get("fingerprint") or f"infra-{k}", "reason": i.get("reason"), "objectKind": either(i, "objectKind", "object_kind"), "objectName": either(i, "objectName", "object_name"), "messageTemplate": either(i, "messageTemplate", "message_template") or "", "count": int(i.get("count") or 1), "firstSeen": either(i, "firstSeen", "first_seen"), "lastSeen": either(i, "lastSeen", "last_seen"), "evidence": refs(i)}
            for k, i in enumerate(parts("infrastructure_events", "infrastructureEvents"))
        ]
        boards = [{"dashboardUid": either(d, "dashboardUid", "dashboard_uid"), "panelId": either(d, "panelId", "panel_id"), "url": d.get("url"), "variables": d.get("variables") or {}, "evidence": refs(d)[0]} for d in parts("grafana_references", "grafanaReferences")]
        return Request(
            body.get("scope") or "", int(body.get("token_budget") or 2_000), events("events"), events("baseline_events") if body.get("baseline_events") is not None else None,
            body.get("incident_window_seconds"), body.get("baseline_window_seconds"), list(parts("deployment_markers", "deploymentMarkers")), anomalies, infra, boards,
        )

    def save(self, caller: Caller, snapshot: dict) -> dict:
        key = str(uuid.uuid4())
        with self._lock:
            held = self._stored[caller.tenant]
            held[key] = {"contextId": key, "tenantId": caller.tenant, "context": snapshot, "createdAt": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")}
            while len(held) > self.bounds.contexts:
                del held[next(iter(held))]
        return {"contextId": key, "tenantId": caller.tenant, "context": snapshot}

    def create(self, caller: Caller, body: dict) -> dict:
        with scope():
            return self.save(caller, self.builder(self.request(body)).to_dict())

    def create_from_sources(self, caller: Caller, body: dict) -> dict:
        try:
            source = self.sources.resolve(caller.tenant, str(body.get("source_id") or ""))
        except LookupError as e:
            raise Refused(404, "source_not_found", str(e), "not_found") from None
        start, end = (aware(body.get(k), k) for k in ("start", "end"))
        names = {"namespace": "namespace", "baseline_minutes": "baseline_minutes", "mode": "mode", "metric_expression": "expression", "metric_step_seconds": "step", "max_anomalies": "most", "loki_limit": "limit"}
        options = {to: body[k] for k, to in names.items() if body.get(k) is not None}
        with scope():
            made = incident.from_source(self.spark, source, str(body.get("scope") or ""), start, end, int(body.get("token_budget") or 2_000), apps=tuple(body.get("apps") or ()), **options)
            return self.save(caller, made.to_dict())

    def stored(self, caller: Caller, key: str) -> dict:
        if (found := self._stored[caller.tenant].get(key)) is None:
            raise Refused(404, "context_not_found", "incident context was not found for this tenant", "not_found")
        return found

    def expand(self, caller: Caller, key: str, body: dict) -> dict:
        found = self.stored(caller, key)
        wanted = [{"kind": d.get("kind"), "limit": d.get("limit", 0), "samplesPerPattern": d.get("samplesPerPattern", d.get("samples_per_pattern", 0))} for d in body.get("directives") or []]
        try:
            shown = disclosure.disclose(found["context"], body.get("level") or "L0", body.get("token_budget"), wanted, bool(body.get("strict")))
        except RuntimeError as e:
            raise Refused(409, "disclosure_budget_exhausted", str(e), "validation_failed") from None
        return {"contextId": key, "tenantId": caller.tenant, "disclosure": shown}

    def section(self, caller: Caller, key: str, name: str, arguments: dict) -> dict:
        s = self.stored(caller, key)["context"]
        try:
            limit = int(arguments.get("limit") if arguments.get("limit") is not None else 25)
        except (TypeError, ValueError):
            raise Refused(400, "bad_limit", "limit must be an integer", "validation_failed") from None
        if limit < 1:
            raise Refused(400, "bad_limit", "limit must be positive", "validation_failed")
        where, keep = SECTIONS[name], {"pattern": ("fingerprint", arguments.get("fingerprint")), "deployments": ("kind", "deployment")}.get(name)
        if name == "pattern" and not keep[1]:
            raise Refused(400, "fingerprint_required", "fingerprint is required", "validation_failed")
        rows = [r for r in s[where] if keep is None or r[keep[0]] == keep[1]]
        limit = min(limit, self.bounds.read)
        shown = rows[:limit]
        return {"contextId": key, "tenantId": caller.tenant, "section": name, "limit": limit, "items": shown, "telemetry": {"availableItems": len(rows), "returnedItems": len(shown), "truncated": len(rows) > len(shown)}}

    def audit(self, caller: Caller, limit: int) -> dict:
        return {"tenantId": caller.tenant, "items": list(self._audit[caller.tenant])[::-1][:limit]}

    # routing

    def mcp(self, caller: Caller, body: dict) -> dict:
        reply = lambda **x: {"jsonrpc": "2.0", "id": body.get("id")} | x
        method = body.get("method")
        if not isinstance(method, str):
            raise Refused(400, "bad_mcp_request", "method must be a string", "validation_failed")
        if method == "initialize":
            return reply(result={"protocolVersion": "2024-11-05", "serverInfo": {"name": "tracefold", "version": "0.1.0"}, "capabilities": {"tools": {"listChanged": False}}})
        if method == "tools/list":
            text = {"type": "string"}
            schema = lambda n: {"type": "object", "properties": {} if n == "build_incident_context" else {"context_id": text} | ({"fingerprint": text} if n == "expand_incident_pattern" else {})}
            return reply(result={"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": schema(n)} for n in TOOLS]})
        if method != "tools/call":
            return reply(error={"code": -32601, "message": "Unknown MCP method"})
        call = body.get("params") or {}
        name, arguments = call.get("name"), call.get("arguments", {})
        if not isinstance(arguments, dict):
            raise Refused(400, "bad_mcp_arguments", "arguments must be an object", "validation_failed")
        if name not in TOOLS:
            return reply(error={"code": -32601, "message": "Unknown tool"})
        key = str(arguments.get("context_id") or "")
        if name == "build_incident_context":
            need(caller, WRITE)
            result = self.create(caller, arguments)
            content = result["context"]
        elif not key:
            raise Refused(400, "context_id_required", "context_id is required", "validation_failed")
        elif name == "get_incident_context":
            result = self.stored(caller, key)
            content = result["context"]
        elif name == "expand_incident_context":
            result = self.expand(caller, key, arguments)
            content = result["disclosure"]
        else:
            result = content = self.section(caller, key, TOOLS[name], arguments)
        return reply(result={"content": [{"type": "json", "json": content}], "structuredContent": result})

    def handle(self, method: str, target: str, authorization: str | None, read: Callable[[], bytes]) -> tuple[int, dict, str]:
        """(status, answer, request id) of one request; every one but health is audited."""
        url, request_id = urlparse(target), str(uuid.uuid4())
        if url.path == "/health":
            return 200, {"status": "ok", "time": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")}, request_id
        caller, action, status, code, outcome = None, "unknown", 200, None, "success"
        try:
            caller = self.keys.caller(authorization)
            self.charge(caller.tenant)
            for verb, pattern, name, role, run in ROUTES:
                if verb == method and (m := re.fullmatch(pattern, url.path)):
                    action = name
                    need(caller, role)
                    body = json.loads(read() or b"{}") if verb == "POST" else {k: v[0] for k, v in parse_qs(url.query).items()}
                    if not isinstance(body, dict):
                        raise Refused(400, "bad_json", "the body must be a JSON object", "validation_failed")
                    answer = run(self, caller, body, *m.groups())
                    break
            else:
                raise Refused(404, "not_found", "endpoint not found", "not_found")
        except Refused as e:
            status, code, outcome = e.status, e.code, e.outcome
            answer = {"error": {"code": code, "message": str(e)}}
        except (ValueError, TypeError, KeyError) as e:
            status, code, outcome = 400, "invalid_request", "validation_failed"
            answer = {"error": {"code": code, "message": str(e)}}
        except Exception:  # what went wrong is not the caller's to see
            status, code, outcome = 500, "internal_error", "failure"
            answer = {"error": {"code": code, "message": "internal server error"}}
        with self._lock:
            self._audit[caller.tenant if caller else "anonymous"].append({
                "requestId": request_id, "tenantId": caller.tenant if caller else "anonymous", "action": action, "method": method, "path": url.path, "status": status, "outcome": outcome,
                "principalId": caller.id if caller else None, "roles": sorted(caller.roles) if caller else [], "errorCode": code, "createdAt": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"),
            })
        return status, answer, request_id


def need(caller: Caller, role: str) -> None:
    if role not in caller.roles:
        raise Refused(403, "forbidden", "this role may not do that", "forbidden")


def _audit_limit(body: dict) -> int:
    try:
        return int(body.get("limit", 25))
    except ValueError:
        raise Refused(400, "bad_limit", "limit query parameter must be numeric", "validation_failed") from None


# Sections and where a snapshot has them; the tools and their sections; the endpoints.
SECTIONS = {"patterns": "patterns", "pattern": "patterns", "timeline": "timeline", "correlations": "correlations", "exceptions": "stackFingerprints", "metrics": "metricAnomalies", "infrastructure": "infrastructureEvents", "deployments": "timeline", "grafana": "grafanaReferences"}
TOOLS = {
    "build_incident_context": None, "get_incident_context": None, "expand_incident_context": None, "read_incident_timeline": "timeline", "list_incident_patterns": "patterns", "expand_incident_pattern": "pattern",
    "list_incident_correlations": "correlations", "list_incident_exceptions": "exceptions", "list_metric_summaries": "metrics", "list_infrastructure_events": "infrastructure", "list_deployments": "deployments", "list_grafana_references": "grafana",
}
ROUTES = (
    ("POST", "/v1/incidents/build-from-sources", "incident_context.create_from_sources", WRITE, lambda s, c, body: s.create_from_sources(c, body)),
    ("POST", "/v1/contexts", "incident_context.create", WRITE, lambda s, c, body: s.create(c, body)),
    ("POST", "/v1/contexts/([^/]+)/expand", "incident_context.expand", READ, lambda s, c, body, key: s.expand(c, key, body)),
    ("GET", "/v1/contexts/([^/]+)", "incident_context.read", READ, lambda s, c, body, key: s.stored(c, key)),
    ("GET", "/v1/admin/audit", "incident_context.audit", AUDIT, lambda s, c, body: s.audit(c, _audit_limit(body))),
    ("POST", "/mcp", "incident_context.mcp", READ, lambda s, c, body: s.mcp(c, body)),
)


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            def body() -> bytes:
                n = int(self.headers.get("Content-Length") or 0)
                if n > service.bounds.payload_bytes:
                    raise Refused(413, "payload_too_large", "the payload is too large", "validation_failed")
                return self.rfile.read(n)

            status, value, request_id = service.handle(self.command, self.path, self.headers.get("Authorization"), body)
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Request-Id", request_id)
            if status == 429:
                self.send_header("Retry-After", "60")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
