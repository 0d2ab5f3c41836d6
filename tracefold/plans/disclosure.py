"""Progressive disclosure: a snapshot at level L0, L1 or L2 within a token budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "incident-context/investigation/v1"
#: Kept for the envelope around the sections.
RESERVE = 256
# Sections in the order of reporting, entries shown by level, and the most that may be asked for.
SECTIONS = ("patterns", "timeline", "stack_fingerprints", "correlations", "deltas", "metric_anomalies", "infrastructure_events", "grafana_references", "hypotheses")
SHOWN = {
    "L0": (0, 0, 0, 0, 0, 3, 2, 1, 0),
    "L1": (8, 4, 0, 3, 3, 4, 3, 2, 3),
    "L2": (12, 12, 8, 8, 8, 12, 12, 8, 8),
}
MOST = (50, 50, 20, 20, 20, 20, 20, 20, 20)
SAMPLES = {"L0": 0, "L1": 0, "L2": 2}
MOST_SAMPLES = 6
# The order in which sections spend, and what L1 leaves out.
SPENDING = ("patterns", "deltas", "timeline", "correlations", "stack_fingerprints", "metric_anomalies", "infrastructure_events", "grafana_references", "hypotheses")
HIDDEN_AT_L1 = {"patterns": ("samples", "evidence"), "timeline": ("metadata", "evidence")}


def tokens(value) -> int:
    return max(1, len(json.dumps(value, sort_keys=True, ensure_ascii=False)) // 4)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def pattern_hypotheses(patterns: DataFrame) -> DataFrame:
    """A hypothesis for each pattern that occurred."""
    n = F.col("count")
    confidence = F.when(n >= 3, F.least(F.lit(1.0), F.round(F.lit(0.55) + n / 25, 2))).otherwise(0.45)
    statement = F.concat(F.lit("Pattern '"), "template", F.lit("' is recurring and may indicate an active incident cause."))
    return patterns.where("count <> 0").select(F.col("fingerprint").alias("target"), statement.alias("statement"), confidence.alias("confidence"), F.when(n >= 3, "supported").otherwise("unverified").alias("state"))


def stack_hypotheses(stacks: DataFrame) -> DataFrame:
    """A hypothesis for each stack that occurred twice or more."""
    n = F.col("count")
    confidence = F.least(F.lit(1.0), F.round(F.lit(0.4) + n / 20, 2))
    statement = F.concat(F.lit("Exception type "), "exception_type", F.lit(" appears "), n, F.lit(" times across timeline-similar logs."))
    return stacks.where("count >= 2").select(F.col("fingerprint").alias("target"), statement.alias("statement"), confidence.alias("confidence"), F.when(confidence >= 0.7, "supported").otherwise("unverified").alias("state"))


def correlation_hypotheses(groups: DataFrame) -> DataFrame:
    """A hypothesis for each group of correlated events."""
    named = F.concat(F.lit("('"), F.array_join("services", "', '"), F.when(F.size("services") == 1, "',)").otherwise("')"))
    statement = F.concat(F.lit("Cross-service correlation in "), named, F.lit(" with "), "event_count", F.lit(" linked events."))
    confidence = F.least(F.lit(1.0), F.round("confidence", 2))
    return groups.select(F.col("correlation_ref").alias("target"), statement.alias("statement"), confidence.alias("confidence"), F.when(F.col("confidence") >= 0.6, "supported").otherwise("unverified").alias("state"))


def hypotheses(s: dict) -> list[dict]:
    """Hypotheses from a snapshot's patterns, repeated stacks and correlations."""
    one = lambda target, statement, confidence, state, refs: {"target": target, "statement": statement, "confidence": confidence, "state": state, "evidenceRefs": refs}
    out = []
    for p in s["patterns"]:
        if n := p["count"]:
            sure = n >= 3
            out.append(one(p["fingerprint"], f"Pattern '{p['template']}' is recurring and may indicate an active incident cause.", min(1.0, round(0.55 + n / 25, 2)) if sure else 0.45, "supported" if sure else "unverified", p["evidence"]))
    for t in s["stackFingerprints"]:
        if t["count"] >= 2:
            c = min(1.0, round(0.4 + t["count"] / 20, 2))
            out.append(one(t["fingerprint"], f"Exception type {t['exceptionType']} appears {t['count']} times across timeline-similar logs.", c, "supported" if c >= 0.7 else "unverified", t["evidence"]))
    for g in s["correlations"]:
        out.append(one(g["correlationRef"], f"Cross-service correlation in {tuple(g['services'])} with {g['eventCount']} linked events.", min(1.0, round(g["confidence"], 2)), "supported" if g["confidence"] >= 0.6 else "unverified", []))
    return out


def limits(level: str, directives: list[dict] | None) -> tuple[dict[str, int], int]:
    """Entries for each section and samples for each pattern; a directive has kind, limit and samplesPerPattern."""
    shown, samples = dict(zip(SECTIONS, SHOWN[level])), SAMPLES[level]
    most = dict(zip(SECTIONS, MOST))
    for d in directives or []:
        kind, limit, per = d["kind"], int(d.get("limit", 0)), int(d.get("samplesPerPattern", 0))
        if kind not in shown and kind != "samples_per_pattern":
            raise ValueError(f"unknown expansion kind: {kind}")
        if limit < 0 or per < 0:
            raise ValueError("directive limits must be non-negative")
        if kind == "samples_per_pattern":
            samples = min(MOST_SAMPLES, limit)
            continue
        shown[kind] = min(most[kind], limit)
        if kind == "patterns":
            samples = min(MOST_SAMPLES, per)
    return shown, samples


def disclose(s: dict, level: str = "L0", token_budget: int | None = None, directives: list[dict] | None = None, strict: bool = False) -> dict:
    """Sections of the snapshot ``s`` as far as the budget goes, and an account of each."""
    if level not in SHOWN:
        raise ValueError("disclosure level must be L0, L1 or L2")
    budget = int(s["tokenBudget"] if token_budget is None else token_budget)
    if budget < 64:
        raise ValueError("token budget must be at least 64")
    shown, samples = limits(level, directives)
    kept = s["compression"]["retainedPatterns"] or len(s["patterns"])
    summary = {
        "rawEventCount": s["rawEventCount"], "rawPatternCount": len(s["patterns"]), "retainedPatternCount": min(len(s["patterns"]), kept), "omittedPatternCount": s["omittedPatternCount"],
        "budgetExceeded": s["budgetExceeded"], "requiredTokens": s["requiredTokens"], "correlationCoverage": round(s["correlationSummary"]["coverage"], 4), "investigationConfidence": round(s["correlationSummary"]["confidence"], 4),
        "metricAnomalyCount": len(s["metricAnomalies"]), "infrastructureEventCount": len(s["infrastructureEvents"]),
    }
    used = tokens(summary) + RESERVE
    out, accounts = {}, {}
    for kind in SPENDING:
        rows = hypotheses(s) if kind == "hypotheses" else s[camel(kind)]
        chosen, spent = [], 0
        for row in rows[: shown[kind]]:
            if level == "L1":
                row = {k: v for k, v in row.items() if k not in HIDDEN_AT_L1.get(kind, ())}
            elif kind == "patterns" and samples:
                row = row | {"samples": row["samples"][:samples]}
            if used + spent + tokens(row) > budget:
                break
            spent += tokens(row)
            chosen.append(row)
        used += spent
        out[camel(kind)] = chosen
        accounts[kind] = {"kind": kind, "requested": min(shown[kind], len(rows)), "applied": len(chosen), "budgetSpent": spent}
    complete = used <= budget and all(a["applied"] >= a["requested"] for a in accounts.values())
    if strict and not complete:
        raise RuntimeError("disclosure budget exhausted")
    state = {
        "requestedLevel": level, "emittedLevel": level, "tokenBudget": budget, "tokensUsed": used, "tokensRemaining": max(0, budget - used), "complete": complete,
        "nextLevel": {"L0": "L1", "L1": "L2"}.get(level), "operations": [accounts[k] for k in SECTIONS],
    }
    return {"schemaVersion": SCHEMA_VERSION, "scope": s["scope"], "generatedAt": s["generatedAt"], "disclosure": level, "summary": summary, "state": state, **out}


def code_package(disclosed: dict, links: list[dict], token_budget: int) -> dict:
    """A disclosure (made with three quarters of the budget) with as many code references as fit."""
    if token_budget < 256:
        raise ValueError("combined context budget must be at least 256")
    size = lambda: len(json.dumps(out, sort_keys=True, ensure_ascii=False)) // 4
    out = {"schemaVersion": "incident-context/graphify/v1", "incident": disclosed, "codeRefs": [], "tokenBudget": token_budget, "estimatedTokens": 0, "complete": True}
    for link in links:
        out["codeRefs"].append(link)
        if size() > token_budget:
            out["codeRefs"].pop()
            out["complete"] = False
            break
    for _ in range(4):  # the estimate's own digits count too
        if out["estimatedTokens"] == (now := size()):
            break
        out["estimatedTokens"] = now
    return out
