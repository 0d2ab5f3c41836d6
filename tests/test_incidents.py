"""Operators and the snapshot on small inputs with known answers."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators import correlate, events as E, patterns as P, signals
from tracefold.plans import disclosure, evaluation, quality, windows
from tracefold.plans.incident import protect
from tracefold.plans.snapshot import Request, build
from tracefold.sources import jsonl, kubernetes, loki, prometheus

T0 = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
REF = {"source": "loki", "query_ref": "Q", "start": "a", "end": "b"}


def event(k, message, severity="ERROR", service="pay", fields=None, ref=REF):
    return {"timestamp": T0 + timedelta(seconds=k), "service": service, "severity": severity, "message": message, "fields": fields or {}, "evidence": ref}


def snapshot(spark, rows, budget=900, **more):
    return build(Request("pay", budget, jsonl.from_rows(spark, rows), **more)).to_dict()


@pytest.mark.parametrize(
    "message, want",
    [
        ("  user a@b.co  token=abc\tfrom 10.0.0.1 ", "user <redacted> <redacted> from <ip>"),
        ("order=12 duration=5000ms timeout=1.5s ID=7", "order=<id> duration=<duration> timeout=<duration> ID=<id>"),
        ("request_id=r1 trace_id=9 api_token=x", "<correlation> <correlation> api_token=x"),
        ("id 123e4567-e89b-12d3-a456-426614174000 ok", "id <uuid> ok"),
        (" é=1 x ", "é=1 x"),
    ],
)
def test_redaction(spark, message, want):
    assert spark.createDataFrame([(message,)], "m string").select(T.normalize_message(F.col("m"))).first()[0] == want


def test_repeats_collapse_and_volume(spark):
    s = snapshot(spark, [event(k, f"timeout order={1000 + k} duration=5000ms") for k in range(10)])
    assert [(p["template"], p["count"]) for p in s["patterns"]] == [("timeout order=<id> duration=<duration>", 10)]
    assert s["patterns"][0]["samples"][1]["timestamp"] == "2026-03-01T12:00:09Z"
    base = spark.range(10_000).select(F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_770_000_000) + F.col("id")).alias("ts"), F.lit("pay").alias("service"), F.lit("ERROR").alias("severity"), F.concat(F.lit("timeout order="), "id").alias("message"))
    whole = P.discover(E.enrich(base)).collect()
    assert [r["count"] for r in whole] == [10_000]


def test_protected_patterns_survive_any_budget(spark):
    rows = [event(k, f"note {'abcdefghij'[k % 10]}", "INFO") for k in range(200)] + [event(300, "disk gone", "fatal ")]
    s = snapshot(spark, rows, 120)
    assert s["patterns"][0]["severity"] == "FATAL" and s["incomplete"] and s["omittedPatternCount"] > 0
    many = snapshot(spark, [event(k, f"failure of {'abcdefghijklmnopqrst'[k]}", "FATAL") for k in range(20)], 100)
    assert len(many["patterns"]) == 20 and many["budgetExceeded"]


def test_greedy_budget_skips_and_goes_on(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(24, 90), rng.random() < 0.1) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, cost long, protected boolean")
    got = {r.k for r in P.within_budget(df, 700, [F.col("k").asc()], key="k").collect()}
    want = {k for k, _, p in rows if p}
    used = sum(c for _, c, p in rows if p)
    for k, c, p in rows:
        if not p and used + c <= 700:
            want.add(k)
            used += c
    assert got == want
    prefix = P.within_prefix(df, 200, [F.col("k").asc()], 50).collect()
    total = 0
    for n, (_, c, _) in enumerate(rows):
        total += c
        if total > 200:
            break
    assert len(prefix) == n


def test_deltas(spark):
    incident = [event(k, "slow") for k in range(20)] + [event(30, "fresh")] + [event(40 + k, "same") for k in range(4)]
    before = [event(k, "slow") for k in range(2)] + [event(9, "gone")] + [event(40 + k, "same") for k in range(4)]
    s = snapshot(spark, incident, baseline=jsonl.from_rows(spark, before), incident_seconds=300, baseline_seconds=300)
    got = {d["template"]: d for d in s["deltas"]}
    slow = got["slow"]
    assert (slow["incidentRatePerMinute"], slow["baselineRatePerMinute"], slow["absoluteRateDelta"], slow["relativeChange"], slow["state"]) == (4.0, 0.4, 3.6, 10.0, "SPIKE")
    assert {k: d["state"] for k, d in got.items()} == {"slow": "SPIKE", "fresh": "NEW", "gone": "DISAPPEARED", "same": "STABLE"}
    assert [d["template"] for d in s["deltas"]] == sorted(got)
    assert got["fresh"]["relativeChange"] is None and got["gone"]["relativeChange"] == 0.0


def test_stacks(spark):
    trace = "shop.CartException: order=12 lost 4567\n  at shop.Cart.add(Cart.java:{})\n\n  ... more\nCaused by: id=5"
    s = snapshot(spark, [event(k, trace.format(10 + k)) for k in range(2)] + [event(5, "Traceback:\n  File \"x.py\", line 3\nValueError: no")])
    (one,) = s["stackFingerprints"]
    assert one["count"] == 2 and one["frames"] == ["at shop.Cart.add(Cart.java:<line>)", "Caused by: id=<id>"]
    top = next(p for p in s["patterns"] if p["count"] == 2)
    assert top["template"] == "shop.CartException: order=<id> lost <id>" and top["exceptionFingerprint"] == one["fingerprint"]
    literal = snapshot(spark, [event(0, "shop.CartException: x\\n at shop.Cart.add(Cart.java:1)")])
    assert literal["stackFingerprints"] == []


def test_correlations_and_timeline(spark):
    rows = [event(k, f"step {'abc'[k]}", service=f"s{k}", fields={"Trace-Id": "t1", "user_id": 4, "deep": {"x": 1}, "n": 2.5}) for k in range(3)]
    marker = {"timestamp": T0 - timedelta(seconds=30), "kind": "deployment", "service": "pay", "version": "v1", "summary": "release id=5", "metadata": {"token": "x", "n": 1}, "evidence": REF}
    s = snapshot(spark, rows, markers=[marker | {"timestamp": marker["timestamp"].isoformat()}])
    (g,) = s["correlations"]
    assert (g["idType"], g["eventCount"], g["confidence"], g["services"]) == ("trace_id", 3, 1.0, ["s0", "s1", "s2"])
    assert s["correlationSummary"] == {"totalEvents": 3, "correlatedEvents": 3, "coverage": 1.0, "confidence": 1.0, "level": "HIGH"}
    assert [e["kind"] for e in s["timeline"]] == ["deployment"] + ["log_pattern"] * 3
    assert s["timeline"][0]["summary"] == "release id=<id>" and s["timeline"][0]["metadata"] == {"token": "<redacted>", "n": 1}
    assert all(e["correlationRefs"] == [g["correlationRef"]] for e in s["timeline"][1:])
    assert s["patterns"][0]["samples"][0]["fields"] == {"Trace-Id": "<redacted>", "user_id": "<redacted>", "n": 2.5}
    assert '"t1"' not in json.dumps(s)


def test_nothing_to_correlate_and_no_events(spark):
    s = snapshot(spark, [event(0, "a"), event(1, "b")])
    assert s["correlations"] == [] and s["correlationSummary"]["level"] == "NONE"
    empty = snapshot(spark, [], 200)
    assert empty["patterns"] == [] and not empty["incomplete"] and empty["rawEventCount"] == 0


def test_validation(spark):
    for part in ("source", "query_ref", "start", "end"):
        with pytest.raises(ValueError, match="evidence"):
            snapshot(spark, [event(0, "a", ref=REF | {part: " "})])
    with pytest.raises(ValueError, match="budget"):
        snapshot(spark, [event(0, "a")], 63)
    with pytest.raises(ValueError, match="baseline"):
        snapshot(spark, [event(0, "a")], baseline=jsonl.from_rows(spark, []))
    good = {"kind": "deployment", "service": "s", "version": "1", "timestamp": "2026-01-01T00:00:00Z", "evidence": REF}
    for bad in ({"kind": "party"}, {"service": " "}, {"version": "a b"}, {"timestamp": "2026-01-01T00:00:00"}, {"evidence": {}}):
        with pytest.raises(ValueError):
            snapshot(spark, [event(0, "a")], markers=[good | bad])
    with pytest.raises(ValueError, match="aware"):
        jsonl.from_rows(spark, [event(0, "a") | {"timestamp": "2026-01-01T00:00:00"}])


def test_order_of_input_does_not_matter(spark):
    rows = [event(k % 7, f"m {'abc'[k % 3]} id={k}", service=f"s{k % 2}") for k in range(30)]
    df = jsonl.from_rows(spark, rows)
    once = build(Request("x", 500, df)).to_dict()
    assert once == build(Request("x", 500, df.orderBy(F.rand(3)).repartition(5))).to_dict()


def test_escalations(spark):
    df = jsonl.from_rows(spark, [event(3000 * k, "m", s) for k, s in enumerate(["INFO", "ERROR", "WARN", "FATAL", "what", "DEBUG", "TRACE"])])
    assert E.escalations(df).first()[0] == 3
    assert E.window_seconds(df).first()[0] == 18_000
    assert E.escalations(df.limit(0)).first()[0] == 0


def test_metric_anomalies(spark):
    rows = [(s, k, float(v)) for s, vs in {"a": [10, 11, 9, 100], "b": [20, 19, 21, 20], "c": [5, 6, 4, 80], "d": [1, 2]}.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series string, ord int, value double").withColumn("ts", F.timestamp_seconds("ord"))
    got = {r.series: (r.score, r.direction) for r in signals.metric_anomalies(df, ["series"]).collect()}
    assert got == {"a": (110.227, "up"), "c": (91.856, "up")}
    nan = df.where("series = 'a'").withColumn("value", F.when(F.col("ord") == 3, float("nan")).otherwise(F.col("value")))
    assert signals.metric_anomalies(nan, ["series"]).first().direction == "down"
    peak = signals.baseline_and_peak(df.where("series = 'a'"), ["series"]).first()
    assert (peak.baseline, peak.peak) == (10.0, 100.0)


def test_labels_and_code_links(spark):
    labels = [("pod", f"api-{k}") for k in range(12)] + [("route", f"/r{k}") for k in range(12)] + [("job", "j")] * 12 + [("sha", "0123456789abcdef")]
    got = {r.label: (r.severity, r.unique_values, list(r.examples)) for r in signals.label_cardinality(spark.createDataFrame(labels, "key string, value string")).collect()}
    assert got == {"pod": ("critical", 12, ["api-0", "api-1", "api-10"]), "route": ("warn", 12, ["/r0", "/r1", "/r10"]), "sha": ("warn", 1, ["0123456789abcdef"])}
    lines = ["NODE PayService.process [source=src/pay.py location=L3 community=pay]", "noise", "NODE Other [source=tests/x.py]", "NODE PayService.process [source=src/pay.py location=L3]", "NODE Plain [source=src/other.py bad]", "NODE Bare [community=zz]"]
    nodes = signals.code_nodes(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    terms = spark.createDataFrame([("payservice.process",), ("pay",)], "term string")
    got = signals.code_links(nodes, terms).collect()
    assert [(r.name, r.score) for r in got] == [("PayService.process", 22), ("Plain", 2)]
    assert got[0].reason == "incident terms: pay, payservice.process" and got[0].community == "pay"
    with pytest.raises(ValueError):
        signals.code_links(nodes, terms, 51)


def test_cluster_events(spark):
    one = {"metadata": {"namespace": "n"}, "involvedObject": {"kind": "Pod", "name": "p"}, "reason": "BackOff", "type": "Warning", "message": "restart 17 of deadbeef99"}
    rows = [(0, json.dumps(one | {"count": 1, "eventTime": "2026-01-01T00:00:00Z"})), (1, json.dumps(one | {"count": 2, "message": "restart 3 of deadbeef99", "lastTimestamp": "2026-01-01T01:00:00Z"})), (2, "{}")]
    got = kubernetes.groups(spark.createDataFrame(rows, "seq int, event string"), "k8s", "Q", T0, T0 + timedelta(minutes=1))
    assert [(g["objectName"], g["count"], g["messageTemplate"]) for g in got] == [("p", 3, "restart ? of ?"), ("unknown", 1, "")]
    assert got[0]["firstSeen"] == "2026-01-01T00:00:00Z" and got[1]["firstSeen"] == "1970-01-01T00:00:00Z"


def test_backends(spark):
    asked = []

    def transport(url, headers, seconds, most):
        asked.append(url)
        if "loki" in url:
            return {"status": "success", "data": {"result": [{"stream": {"app": "pay"}, "values": [["1772366400000000000", "ERROR \"a\" order=1"], ["1772366401000001000", "fine"]]}, {"stream": {"job": "j"}, "values": [["1772366402000000000", "WARN x"]]}]}}
        return {"status": "success", "data": {"result": [{"metric": {"__name__": "http_5xx", "app": "pay"}, "values": [[1772366400, "10"], [1772366415, "10"], [1772366430, "10"], [1772366445, "80"]]}]}}

    logs = loki.LogBackend("https://logs", transport)
    q = loki.LogQuery("shop", T0, T0 + timedelta(hours=1), ("a.b", "c"), 'say "x"', 2)
    events, seen = logs.query(spark, q)
    got = events.orderBy("seq").collect()
    assert [(r.service, r.severity, T0 is not None) for r in got] == [("pay", "ERROR", True), ("pay", "INFO", True)]
    assert (seen["complete"], seen["incompleteReason"], seen["scannedItems"], seen["retainedItems"]) == (False, "limit_reached", 3, 2)
    assert loki.selector(q) == '{namespace="shop",app=~"a\\.b|c"} |= "say \\"x\\""'
    before = len(asked)
    for bad in (loki.LogQuery("a b", T0, T0 + timedelta(hours=1)), loki.LogQuery("a", T0, T0), loki.LogQuery("a", T0, T0 + timedelta(hours=7)), loki.LogQuery("a", T0, T0 + timedelta(hours=1), limit=501)):
        with pytest.raises(ValueError):
            logs.query(spark, bad)
    metrics = prometheus.MetricBackend("https://metrics", transport)
    with pytest.raises(ValueError, match="points"):
        metrics.query(spark, prometheus.MetricQuery("up", T0, T0 + timedelta(hours=6), 1))
    assert len(asked) == before
    from tracefold.plans.incident import metric_first

    s = metric_first(spark, logs, metrics, "pay", 900, prometheus.MetricQuery("up", T0, T0 + timedelta(minutes=5)), "shop").to_dict()
    (a,) = s["metricAnomalies"]
    assert (a["baseline"], a["peak"], a["state"], a["service"]) == (10.0, 80.0, "SPIKE", "pay")
    assert "pay" in asked[-1] and s["rawEventCount"] == 3 and s["sourceQueries"] == 2
    for url in ("ftp://x", "https://u:p@x", "x"):
        with pytest.raises(ValueError):
            loki.LogBackend(url, transport)


def test_disclosure(spark):
    s = snapshot(spark, [event(k, f"kind {'abcde'[k % 5]}", service=f"s{k}") for k in range(9)], 2000)
    low, mid, high = (disclosure.disclose(s, level, 4000) for level in ("L0", "L1", "L2"))
    assert low["patterns"] == [] and "samples" not in mid["patterns"][0] and len(high["patterns"][0]["samples"]) <= 2
    assert [o["kind"] for o in low["state"]["operations"]] == list(disclosure.SECTIONS)
    assert low["state"]["nextLevel"] == "L1" and high["state"]["nextLevel"] is None
    small = disclosure.disclose(s, "L2", 500)
    assert not small["state"]["complete"] and small["state"]["tokensUsed"] <= 500
    with pytest.raises(RuntimeError):
        disclosure.disclose(s, "L2", 500, strict=True)
    more = disclosure.disclose(s, "L0", 9000, [{"kind": "patterns", "limit": 99, "samplesPerPattern": 1}])
    assert len(more["patterns"]) == 5 and len(more["patterns"][0]["samples"]) == 1
    for bad in ({"kind": "x", "limit": 1}, {"kind": "patterns", "limit": -1}):
        with pytest.raises(ValueError):
            disclosure.disclose(s, "L0", directives=[bad])
    package = disclosure.code_package(disclosure.disclose(s, "L1", 1200), [{"name": "n" * 200}] * 30, 1600)
    assert not package["complete"] and package["estimatedTokens"] <= 1600


def test_evaluation_and_cli(spark, tmp_path, capsys):
    rows = [event(k, f"timeout order={k} duration=5ms") for k in range(40)] + [event(50, "naïve \U0001f600 id=3", "INFO")]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(["", *(json.dumps(r | {"timestamp": r["timestamp"].isoformat().replace("+00:00", "Z")}, ensure_ascii=False) for r in rows), ""]))
    events = jsonl.read_lines(spark, str(path))
    x = evaluation.evaluate(Request("pay", 900, events), "l", jsonl.file_bytes(spark, str(path)))
    want = 0
    for r in rows:
        text = r["message"]
        message = "timeout order=<id> duration=<duration>" if "order" in text else text.replace("id=3", "id=<id>")
        want += len(json.dumps({"timestamp": r["timestamp"].isoformat().replace("+00:00", "Z"), "service": "pay", "severity": r["severity"], "message": message, "fields": {}, "evidence": REF}, sort_keys=True, separators=(",", ":"))) + 1
    assert x["rawContext"]["normalizedBytes"] == want and x["rawContext"]["fileBytes"] == path.stat().st_size
    assert x["retention"]["rarePatterns"] == 1 and x["comparison"]["compactSavingsPercent"] > 80
    from tracefold import cli

    assert cli.run(["build", "--input", str(path), "--scope", "pay"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rawEventCount"] == 41
    path.write_text('\n{"timestamp": "2026-01-01T00:00:00", "service": "s", "message": "m"}\n')
    with pytest.raises(ValueError, match="line 2"):
        jsonl.read_lines(spark, str(path))


def test_quality(spark):
    expected = quality.scenarios(spark)
    assert expected.count() == 48
    out = quality.run(expected, lambda name, rec: (rec.query("loki", scanned=5), [i.format("rare_root_cause") for i in ("deploy.{0}.marker", "metric.{0}.anomaly", "log.{0}.first_failure", "trace.{0}.root_cause")] + ["extra"])[1] if name == "rare-root-cause" else [])
    by = {r["scenario"]: r for r in out}
    c = by["rare-root-cause"]["correctness"]
    assert c["recall"] == pytest.approx(4 / 6) and list(c["unexpected"]) == ["extra"] and not c["passed"] and c["root_cause"] and not c["code_reference"]
    assert by["rare-root-cause"]["performance"]["sourceQueryCounts"] == {"loki": 1}
    with pytest.raises(ValueError):
        quality.check(expected.withColumn("kind", F.lit("x")))
    with pytest.raises(ValueError):
        quality.check(expected.union(expected))
    report = quality.Report("a | b\nc", "i", "m", "r", 0.5, timeline=[{"timestamp": "2", "event": "late"}, {"timestamp": "1", "event": "soon"}], evidence=[{"evidenceId": "z", "message": "raw secret"}])
    text = report.markdown()
    assert text.index("soon") < text.index("late") and "raw secret" not in text and "a \\| b c" in text and text.count("\n## ") == 10
    with pytest.raises(ValueError):
        quality.Report("a", "i", "m", "r", 0.5, confirmed_cause="x")


def test_windows_cache_and_guard(spark):
    w = windows.around_alert(T0, T0 + timedelta(minutes=10), {"service": "pay"}, "f", timedelta(minutes=30), timedelta(minutes=30), timedelta(minutes=40))
    assert (w.start, w.end, w.scope) == (T0 - timedelta(minutes=15), T0 + timedelta(minutes=25), "pay")
    grown = windows.expanded(windows.Window(T0, T0 + timedelta(minutes=10), "s"), timedelta(minutes=10), timedelta(minutes=30), 2, 2)
    assert (grown.start, grown.end) == (T0 - timedelta(minutes=10), T0 + timedelta(minutes=20))
    now = [0.0]
    cache = windows.Cache(10, 2, lambda: now[0])
    cache.set("a", {"token": "x", "v": [1]})
    assert cache.get("a") == {"token": "[REDACTED]", "v": [1]}
    cache.set("b", 1), cache.set("c", 1)
    now[0] = 11
    assert cache.get("a") is None and cache.get("b") is None and (cache.hits, cache.misses, cache.evictions) == (1, 2, 2)
    board = windows.dashboard("https://g/x?y=1", "u", REF, 3, 1, {"app": "pay", "api_key": "k"}, T0)
    assert board["url"] == f"https://g/d/u?orgId=1&var-app=pay&from={int(T0.timestamp() * 1000)}&viewPanel=3"
    out = protect("raw_logs", jsonl.from_rows(spark, [event(k, f"x order={k}") for k in range(20)]), "s")
    assert out["kind"] == "incident_context" and out["rawItems"] == 20 and out["preventedRawTokens"] >= 0
    for kind in ("loki_result", "stacktrace", "what"):
        with pytest.raises(ValueError):
            protect(kind, {}, "s")
    assert protect("generic", {"a": 1}, "s")["preventedRawTokens"] == 0


def test_stream_equals_batch(spark, tmp_path):
    from tracefold.streaming.patterns import start, windowed

    df = jsonl.from_rows(spark, [event(600 * k, f"m id={k}") for k in range(30)]).select("ts", "severity", "message")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = start(stream, "1 hour", "10 minutes", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in windowed(df, "1 hour").collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= want and len(want - got) <= 1


def published():
    """108 events of one incident, three of its baseline, and the figures that are published for them."""
    day = datetime(2026, 8, 10, tzinfo=timezone.utc)

    def one(h, m, sec, service, severity, message, pod, ref=("LQ-EVAL-RAW", "2026-08-10T12:00:00Z", "2026-08-10T12:10:00Z")):
        evidence = {"source": "loki", "query_ref": ref[0], "start": ref[1], "end": ref[2]}
        return {"timestamp": day + timedelta(hours=h, minutes=m, seconds=sec), "service": service, "severity": severity, "message": message, "fields": {"pod": pod}, "evidence": evidence}

    service = lambda k: "payments" if k % 3 else "billing"
    trace = "java.lang.IllegalStateException: invoice calculation failed\nat com.example.billing.InvoiceService.calculate(InvoiceService.java:74)\nat com.example.billing.InvoiceController.handle(InvoiceController.java:21)"
    rows = [one(12, 0, 2 * k, service(k), "ERROR", f"payment request timeout request_id={2000 + k} duration={420 + 35 * (k % 8)}ms", f"{service(k)}-{k % 4}") for k in range(80)]
    rows += [one(12, 3, 3 * k, "payments", "ERROR", f"database retry request_id={3000 + k} count={1 + k % 3}", f"api-{k % 3}") for k in range(24)]
    rows += [
        one(12, 4, 30, "payments", "INFO", "health check ok service=payments node=node-0", "api-0"),
        one(12, 5, 40, "orders", "FATAL", trace, "orders-1"),
        one(12, 5, 50, "payments", "WARN", "cache hit ratio below threshold service=payments request_id=4001", "cache-1"),
        one(12, 6, 0, "billing", "ERROR", "checksum mismatch for invoice shard=7", "billing-rare"),
    ]
    ref = ("LQ-EVAL-BASE", "2026-08-10T11:00:00Z", "2026-08-10T11:06:00Z")
    base = [
        one(11, 0, 0, "payments", "INFO", "health check ok service=payments node=node-a", "api-1", ref),
        one(11, 0, 10, "payments", "ERROR", "payment request timeout request_id=1901 duration=350ms", "api-1", ref),
        one(11, 0, 11, "billing", "ERROR", "payment request timeout request_id=1902 duration=420ms", "billing-2", ref),
    ]
    return rows, base


def test_published_figures(spark):
    rows, base = (jsonl.from_rows(spark, r) for r in published())
    x = evaluation.evaluate(Request("payments", 900, rows, base, 3600, 3600), "raw")
    assert (x["rawContext"]["lineCount"], x["rawContext"]["estimatedTokens"], x["rawContext"]["escalations"]) == (108, 8958, 2)
    assert (x["compactTokens"], x["compactContext"]["budgetExceeded"]) == (866, False)
    assert (x["comparison"]["rawToCompactTokenRatio"], x["comparison"]["compactSavingsPercent"]) == (10.3441, 90.33)
    kept = x["retention"]
    assert [(kept[k + "Retained"], kept[k]) for k in ("rarePatterns", "newPatterns", "rootCausePatterns")] == [(4, 4), (7, 7), (1, 1)]
    assert {k: v for k, v in x["deltaStates"].items() if v} == {"NEW": 7, "SPIKE": 1, "DISAPPEARED": 1}


def test_cache_keys_and_telemetry():
    w = windows.Window(T0, T0 + timedelta(hours=1), "pay", "r1")
    key = windows.Cache.key("loki", "q", w)
    assert key == ("loki", "q", "2026-03-01T12:00:00Z", "2026-03-01T13:00:00Z", "pay", "r1")
    assert windows.Cache.key("loki", "q", w, "shop", "") == ("loki", "q", *key[2:4], "shop", "")
    cache = windows.Cache(10)
    cache.set(key, 1)
    assert cache.get(key) == 1 and cache.get(("x",)) is None
    assert cache.telemetry == {"hits": 1, "misses": 1, "evictions": 0}


def test_anomaly_records(spark):
    rows = [("m", {"app": "a", "service": ""}, 2.5, "down", "s", "t"), ("m", {"job": "j"}, 1.5, "up", "s", "t"), ("m", {}, 1.0, "up", "s", "t")]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, score double, direction string, first_seen string, last_seen string")
    got = [tuple(r)[:9] for r in signals.incident_anomalies(df).collect()]
    import hashlib

    name = lambda s: "MA-" + hashlib.sha256(f"m\0{s}".encode()).hexdigest()[:16]
    assert got == [(name(s), "m", s, state, None, peak, "s", "t", "point-deviation") for s, state, peak in (("a", "DROP", -2.5), ("j", "SPIKE", 1.5), ("unknown", "SPIKE", 1.0))]


def test_places_follow_the_order(spark):
    from tracefold.staging import placed

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [r.place for r in placed(df, F.desc("v")).orderBy(F.desc("v")).collect()] == list(range(1, 1001))
    assert placed(df.limit(0), "v").count() == 0


def test_written_sections_equal_the_wire_form(spark, tmp_path):
    rows, base = (jsonl.from_rows(spark, r) for r in published())
    s = build(Request("payments", 900, rows, base, 3600, 3600))
    scalars, wire = s.write(str(tmp_path)), s.to_dict()
    assert scalars == {k: wire[k] for k in scalars} and set(wire) - set(scalars) == {"patterns", "deltas", "timeline", "stackFingerprints", "correlations", "metricAnomalies", "infrastructureEvents", "grafanaReferences"}
    for name in ("patterns", "deltas", "stackFingerprints"):
        assert [r.fingerprint for r in spark.read.parquet(f"{tmp_path}/{name}").orderBy("place").collect()] == [x["fingerprint"] for x in wire[name]]


def test_a_scope_deletes_what_it_staged(spark):
    import os

    from tracefold import staging

    before = staging.mark()
    with staging.scope():
        staging.stage(spark.range(3), "x")
        (path,) = [p.removeprefix("file:") for _, p in staging._scopes.tables]
        assert os.path.isdir(path)
    assert not os.path.exists(path) and staging.mark() == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tracefold import staging

    conf = SimpleNamespace(get=lambda k: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        staging.shared_dir(cluster)


def test_every_exported_name_is_there():
    import tracefold

    assert len(tracefold.__all__) > 60 and all(callable(getattr(tracefold, name)) for name in tracefold.__all__)


def test_range_scans_in_slices(spark):
    """A backend over HTTP, asked slice by slice from tasks: every line and sample once."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from tracefold.sources import ranges
    from tracefold.sources.http import Limits

    second = 1_000_000_000
    t0 = int(T0.timestamp())

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            if "loki" in url.path:
                times = [t for t in range(t0 * second, (t0 + 600) * second, second) if int(q["start"]) <= t < int(q["end"])]
                result = [{"stream": {"app": "pay"}, "values": [[str(t), f"ERROR at {t // second}"] for t in times]}]
            else:
                a, b, step = float(q["start"]), float(q["end"]), int(q["step"])
                n = int((b - a) // step) + 1
                result = [{"metric": {"__name__": "up"}, "values": [[a + k * step, str(k)] for k in range(n)]}]
            body = json.dumps({"status": "success", "data": {"result": result}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    window = (T0, T0 + timedelta(seconds=600))
    got = ranges.scan_logs(spark, url, loki.LogQuery("shop", *window), 5)
    assert got.rdd.getNumPartitions() == 5
    assert [r.message for r in got.orderBy("seq").collect()] == [f"ERROR at {t0 + k}" for k in range(600)]
    samples = ranges.scan_metrics(spark, url, prometheus.MetricQuery("up", *window, 15), 4)
    assert [int(r.ts.timestamp()) - t0 for r in samples.orderBy("ts").select(F.col("ts")).collect()] == list(range(0, 601, 15))
    with pytest.raises(Exception, match="limit"):
        ranges.scan_logs(spark, url, loki.LogQuery("shop", *window), 1).count()
    with pytest.raises(ValueError):
        ranges.scan_logs(spark, url, loki.LogQuery("shop", *window), 1, Limits(window=timedelta(minutes=5)))
    http.shutdown()
