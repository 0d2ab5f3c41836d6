"""Spark-native incident analytics and corpus preparation.

The names in ``__all__`` are loaded from their modules when they are first used.
"""

from importlib import import_module

__version__ = "0.2.0"

_MODULES = {
    "cli": ("run",),
    "operators.correlate": ("correlation_groups", "correlation_summary", "deltas", "pattern_entries", "pattern_refs", "timeline"),
    "operators.events": ("enrich", "escalations", "staged", "window_seconds"),
    "operators.patterns": ("discover", "ranked", "retained", "stack_groups", "within_budget", "within_prefix"),
    "operators.signals": ("baseline_and_peak", "code_links", "code_nodes", "evidence_recall", "incident_anomalies", "infrastructure_groups", "label_cardinality", "metric_anomalies", "narrowing", "top_infrastructure"),
    "plans.disclosure": ("code_package", "disclose", "hypotheses", "pattern_hypotheses"),
    "plans.evaluation": ("canonical_lines", "evaluate", "telemetry", "text_report"),
    "plans.incident": ("Catalog", "Source", "log_first", "metric_first", "protect"),
    "plans.quality": ("Report", "recall", "scenarios"),
    "plans.snapshot": ("Request", "Snapshot", "build"),
    "plans.windows": ("Cache", "Window", "around_alert", "before_baseline", "dashboard", "expanded", "redacted"),
    "service": ("Bounds", "Caller", "Keys", "Refused", "Service", "server"),
    "session": ("ship",),
    "sources.http": ("Backend", "Limits"),
    "sources.jsonl": ("from_rows", "read_lines"),
    "sources.loki": ("LogBackend", "LogQuery"),
    "sources.prometheus": ("MetricBackend", "MetricQuery"),
    "staging": ("placed", "stage"),
    "streaming.patterns": ("start", "windowed"),
}

_WHERE = {name: module for module, names in _MODULES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module 'tracefold' has no attribute '{name}'")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
