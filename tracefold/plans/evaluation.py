"""What a snapshot saves and keeps: compression, retention and query telemetry."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..staging import scope
from .queries import retention, token_totals
from .snapshot import Request, _camel, build

STATES = ("NEW", "DISAPPEARED", "SPIKE", "DROP", "STABLE", "CHANGED")


def canonical_lines(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each event as one line of JSON: keys sorted, redacted, escaped to ASCII in length; with the columns in ``keep``."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', "$1")
    pairs = F.transform(F.array_sort(F.map_entries(T.sanitized(F.col("fields")))), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    ref = F.concat(F.lit('{"end":'), quoted(F.col("evidence.end")), F.lit(',"query_ref":'), quoted(F.col("evidence.queryRef")), F.lit(',"source":'), quoted(F.col("evidence.source")), F.lit(',"start":'), quoted(F.col("evidence.start")), F.lit("}"))
    line = F.concat(
        F.lit('{"evidence":'), ref, F.lit(',"fields":{'), F.array_join(pairs, ","), F.lit('},"message":'), quoted(T.normalize_message(F.col("message"))), F.lit(',"service":'), quoted(F.col("service")),
        F.lit(',"severity":'), quoted(F.upper(F.coalesce("severity", F.lit("")))), F.lit(',"timestamp":'), quoted(T.iso_z(F.col("ts").cast("timestamp"))), F.lit("}"),
    )
    # an escape \\uXXXX takes six characters for each UTF-16 unit
    wide = F.regexp_replace(line, r"[\x{10000}-\x{10FFFF}]", "------------")
    return events.select(*(keep or []), F.regexp_replace(wide, r"[^\x00-\x7F]", "------").alias("line"))


def telemetry(events: DataFrame, file_bytes: int | None, with_escalations: bool) -> dict:
    r = token_totals(canonical_lines(events)).first()
    ups = E.escalations(events).first()[0] if with_escalations else 0
    return {"lineCount": r.line_count, "normalizedBytes": r.normalized_bytes, "estimatedTokens": r.estimated_tokens, "escalations": ups, "fileBytes": file_bytes}


def evaluate(r: Request, label: str = "", file_bytes: int | None = None, baseline_bytes: int | None = None) -> dict:
    """The machine report, with the text for people under ``humanReport``."""
    with scope():
        return _evaluated(r, label, file_bytes, baseline_bytes)


def _evaluated(r: Request, label: str, file_bytes: int | None, baseline_bytes: int | None) -> dict:
    began = time.perf_counter()
    plan = build(r)
    s = plan.to_dict()
    latency = round((time.perf_counter() - began) * 1000, 3)
    raw = telemetry(r.events, file_bytes, True)
    base = None if r.baseline is None else telemetry(r.baseline, baseline_bytes, False)
    nothing = plan.patterns.select("fingerprint", F.lit("").alias("state")).limit(0)
    kept = {_camel(k): v for k, v in retention(plan.patterns, plan.retained, nothing if plan.deltas is None else plan.deltas).first().asDict().items()}
    kept["omittedPatterns"] = s["omittedPatternCount"]
    for name, table in (("rootCausePatterns", plan.patterns), ("rootCausePatternsRetained", plan.retained)):
        kept[name] = table.where("exception_fingerprint is not null").count()
    states = {k: sum(d["state"] == k for d in s["deltas"]) for k in STATES}
    out_tokens = s["compression"]["estimatedOutputTokens"]
    size = len(json.dumps(s, sort_keys=True, ensure_ascii=True, separators=(",", ":")))
    saved = raw["estimatedTokens"] - out_tokens
    report = {
        "scope": r.scope, "label": label, "generatedAt": s["generatedAt"], "processingLatencyMs": latency, "rawContext": raw, "baselineContext": base, "retention": kept,
        "compactContext": {
            "estimatedCompressionRatio": s["compression"]["estimatedCompressionRatio"], "retainedPatterns": len(s["patterns"]), "discoveredPatterns": s["compression"]["discoveredPatterns"], "omittedPatterns": s["omittedPatternCount"],
            "estimatedTokens": out_tokens, "estimatedBytes": size, "tokenBudget": s["tokenBudget"], "requiredTokens": s["requiredTokens"], "budgetExceeded": s["budgetExceeded"], "safetySourceCount": len(s["sources"]),
        },
        "queryTelemetry": {"totalQueryCount": sum(o["queryCount"] for o in r.observations), "sources": sorted(r.observations, key=lambda o: (o["source"], o["queryRef"]))},
        "deltaStates": states, "compactTokens": s["requiredTokens"], "compactCompressionRatio": s["compression"]["estimatedCompressionRatio"],
        "comparison": {
            "rawToCompactTokenRatio": round(raw["estimatedTokens"] / max(1, out_tokens), 4), "rawToCompactBytesRatio": round(raw["normalizedBytes"] / max(1, size), 4),
            "compactSavingsTokens": saved, "compactSavingsPercent": round(max(0, saved) / max(1, raw["estimatedTokens"]) * 100, 2),
        },
    }
    return report | {"humanReport": text_report(report)}


def text_report(x: dict) -> str:
    raw, base, kept, ratio = x["rawContext"], x["baselineContext"], x["retention"], x["comparison"]
    of = lambda k: f"{kept[k + 'Retained']}/{kept[k]}"
    states = ", ".join(f"{k}={x['deltaStates'][k]}" for k in ("NEW", "SPIKE", "DROP", "STABLE", "CHANGED", "DISAPPEARED"))
    return "\n".join([
        f"Incident telemetry for {x['scope']} [{x['label']}]",
        f"Raw lines: {raw['lineCount']} | file bytes: {raw['fileBytes'] or 0} | estimated tokens: {raw['estimatedTokens']}",
        f"Compact bytes: {x['compactContext']['estimatedBytes']} | compact tokens: {x['compactTokens']}",
        f"Safety pattern budget: {x['compactContext']['tokenBudget']} tokens",
        f"Compression ratio: {ratio['rawToCompactTokenRatio']:.4f}x | bytes ratio: {ratio['rawToCompactBytesRatio']:.4f}x",
        "No baseline context provided" if base is None else f"Baseline lines: {base['lineCount']} | baseline bytes: {base['normalizedBytes']} | baseline tokens: {base['estimatedTokens']}",
        f"Rare patterns retained: {of('rarePatterns')}, new patterns retained: {of('newPatterns')}, root-cause retained: {of('rootCausePatterns')}",
        f"Raw escalations: {raw['escalations']} | source query count: {x['queryTelemetry']['totalQueryCount']}",
        f"Delta states: {states}",
        f"Latency: {x['processingLatencyMs']:.2f} ms",
    ])
