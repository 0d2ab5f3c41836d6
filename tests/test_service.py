"""The service over real HTTP on a local port."""

import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timedelta, timezone

import pytest

from tracefold import service as S
from tracefold.plans.incident import Source
from tracefold.sources.loki import LogBackend

T0 = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
REF = {"source": "loki", "query_ref": "Q", "start": "a", "end": "b"}


@pytest.fixture(scope="module")
def call(spark):
    keys = S.Keys()
    keys.add("all", "t1", {S.READ, S.WRITE, S.AUDIT})
    keys.add("reader", "t1", {S.READ})
    keys.add("other", "t2", {S.READ, S.WRITE})
    keys.add("busy", "t3", {S.READ})
    app = S.Service(spark, keys, bounds=S.Bounds(payload_bytes=20_000, events=50, per_minute=60))
    values = [[str(1772366400000000000 + k), f"ERROR order={k}"] for k in range(3)]
    app.sources.register(Source("t1", "main", LogBackend("https://logs", lambda *a: {"status": "success", "data": {"result": [{"stream": {"app": "pay"}, "values": values}]}}), namespace="shop"))
    http = S.server(app)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def run(method, path, body=None, key="all"):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data, {"Authorization": f"Bearer {key}"} if key else {}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                assert answer.headers["X-Request-Id"]
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    yield run
    http.shutdown()


def events(n):
    return [{"timestamp": (T0 + timedelta(seconds=k)).isoformat(), "service": "pay", "severity": "ERROR", "message": f"timeout order={k}", "evidence": REF} for k in range(n)]


def test_contexts(call):
    assert call("GET", "/health", key=None)[0] == 200
    status, made = call("POST", "/v1/contexts", {"scope": "pay", "token_budget": 900, "events": events(5), "metricAnomalies": [{"metric": "m", "service": "s", "state": "spike", "start": T0.isoformat(), "peak_at": T0.isoformat(), "evidence": [REF]}] * 60})
    assert status == 200 and made["context"]["metricAnomalies"][1]["id"] == "metric-1"
    key = made["contextId"]
    assert call("GET", f"/v1/contexts/{key}", key="reader")[1]["context"] == made["context"]
    assert call("GET", f"/v1/contexts/{key}", key="other")[0] == 404
    status, shown = call("POST", f"/v1/contexts/{key}/expand", {"level": "L1", "token_budget": 4000})
    assert status == 200 and shown["disclosure"]["patterns"][0]["count"] == 5
    assert call("POST", f"/v1/contexts/{key}/expand", {"level": "L2", "token_budget": 300, "strict": True})[0] == 409
    tool = lambda name, **a: call("POST", "/mcp", {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": {"context_id": key} | a}})[1]
    metrics = tool("list_metric_summaries", limit=999)["result"]["structuredContent"]
    assert metrics["telemetry"] == {"availableItems": 60, "returnedItems": 50, "truncated": True}
    assert len(tool("expand_incident_pattern", fingerprint=made["context"]["patterns"][0]["fingerprint"])["result"]["structuredContent"]["items"]) == 1
    assert tool("what")["error"]["code"] == -32601
    assert len(call("POST", "/mcp", {"id": 1, "method": "tools/list"})[1]["result"]["tools"]) == 12


def test_sources(call):
    body = {"source_id": "main", "scope": "pay", "start": T0.isoformat(), "end": (T0 + timedelta(hours=1)).isoformat(), "baseline_minutes": 5}
    status, made = call("POST", "/v1/incidents/build-from-sources", body)
    assert status == 200 and made["context"]["rawEventCount"] == 3 and made["context"]["sourceQueries"] == 2
    assert call("POST", "/v1/incidents/build-from-sources", body, "other")[0] == 404


def test_refusals(call):
    assert call("GET", "/v1/contexts/x", key=None)[0] == 401
    assert call("POST", "/v1/contexts", {"events": []}, "reader")[0] == 403
    assert call("POST", "/v1/contexts", {"scope": "s", "events": events(51)})[0] == 413
    assert call("POST", "/v1/contexts", {"scope": "s", "events": [], "pad": "x" * 30_000})[0] == 413
    assert call("POST", "/v1/contexts", {"scope": " ", "events": []})[1]["error"]["code"] == "invalid_request"
    assert call("GET", "/nothing")[0] == 404
    codes = [call("GET", "/v1/contexts/x", key="busy")[0] for _ in range(61)]
    assert codes[-1] == 429 and codes[0] == 404
    items = call("GET", "/v1/admin/audit?limit=3")[1]["items"]
    assert len(items) == 3 and items[0]["status"] in (400, 404) and "all" not in json.dumps(items)
    assert call("GET", "/v1/admin/audit", key="reader")[0] == 403


def test_keys_need_a_key_and_a_tenant():
    for key, tenant in (("", "t"), (" ", "t"), ("k", ""), ("k", "  ")):
        with pytest.raises(ValueError):
            S.Keys().add(key, tenant, {S.READ})
