"""Baseline deltas, correlation groups and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Confidence of a shared id over several services, and within one.
CONFIDENCE = {"trace_id": (1.0, 0.7), "correlation_id": (0.9, 0.65), "request_id": (0.85, 0.6), "session_id": (0.7, 0.55)}
OTHER_CONFIDENCE = (0.6, 0.5)


def rate(n: Column, seconds: int) -> Column:
    return F.round(n * 60 / F.lit(seconds), 4)


def deltas(incident: DataFrame, baseline: DataFrame, incident_seconds: int, baseline_seconds: int) -> DataFrame:
    """Incident and baseline counts of each (template, severity) with rates and a state.

    Both sides are summed before the full outer join, so it moves one row for
    each pattern.
    """
    counted = lambda e, n: e.groupBy("template", "severity").agg(F.count("*").alias(n))
    both = counted(incident, "incident_count").join(counted(baseline, "baseline_count"), ["template", "severity"], "full").na.fill(0, ["incident_count", "baseline_count"])
    return compared(both, incident_seconds, baseline_seconds)


def compared(both: DataFrame, incident_seconds: int, baseline_seconds: int) -> DataFrame:
    i, b = F.col("incident_rate_per_minute"), F.col("baseline_rate_per_minute")
    out = both.withColumns({"incident_rate_per_minute": rate(F.col("incident_count"), incident_seconds), "baseline_rate_per_minute": rate(F.col("baseline_count"), baseline_seconds)})
    ratio = F.round(F.try_divide(i, b), 4)
    new, gone = F.col("baseline_count") == 0, F.col("incident_count") == 0
    out = out.withColumn("relative_change", F.when(new, F.lit(None).cast("double")).when(gone, 0.0).otherwise(ratio))
    r = F.col("relative_change")
    state = F.when(new, "NEW").when(gone, "DISAPPEARED").when(r >= 2, "SPIKE").when(r <= 0.5, "DROP").when(r == 1, "STABLE").otherwise("CHANGED")
    return out.select(
        T.pattern_id(F.col("template"), F.col("severity")).alias("fingerprint"), "template", "severity", "incident_count", "baseline_count",
        "incident_rate_per_minute", "baseline_rate_per_minute", F.round(i - b, 4).alias("absolute_rate_delta"), "relative_change", state.alias("state"),
    )


def confidence(id_type: Column, services: Column) -> Column:
    def table(k: int) -> Column:
        values = F.create_map(*(F.lit(x) for t, pair in CONFIDENCE.items() for x in (t, pair[k])))
        return F.coalesce(F.try_element_at(values, id_type), F.lit(OTHER_CONFIDENCE[k]))

    return F.when(services > 1, table(0)).otherwise(table(1))


def correlation_groups(enriched: DataFrame) -> DataFrame:
    """Ids that two or more events share."""
    ids = enriched.select("ts", "seq", "service", F.explode("ids").alias("x")).select("ts", "seq", "service", "x.*")
    found = ids.groupBy("id_type", "value").agg(F.count("*").alias("event_count"), F.array_sort(F.collect_set("service")).alias("services"), F.min("ts").alias("first"), F.max("ts").alias("last")).where("event_count >= 2")
    return found.select(
        T.correlation_ref(F.col("id_type"), F.col("value")).alias("correlation_ref"), "id_type", "event_count", "services",
        T.iso_z(F.col("first").cast("timestamp")).alias("first_seen"), T.iso_z(F.col("last").cast("timestamp")).alias("last_seen"), confidence(F.col("id_type"), F.size("services")).alias("confidence"),
    )


def correlated_refs(enriched: DataFrame, groups: DataFrame) -> DataFrame:
    """(fingerprint, seq, correlation_ref) of the events in a group."""
    refs = enriched.select("fingerprint", "seq", F.explode("ids").alias("x")).select("fingerprint", "seq", T.correlation_ref(F.col("x.id_type"), F.col("x.value")).alias("correlation_ref"))
    return refs.join(groups.select("correlation_ref"), "correlation_ref", "left_semi")


def correlation_summary(enriched: DataFrame, groups: DataFrame) -> DataFrame:
    """Coverage of all events, confidence weighted by events, and its level."""
    refs = enriched.select("seq", F.explode("ids").alias("x")).select("seq", T.correlation_ref(F.col("x.id_type"), F.col("x.value")).alias("correlation_ref"))
    covered = refs.join(groups.select("correlation_ref"), "correlation_ref", "left_semi").select("seq").distinct()
    counts = enriched.agg(F.count("*").alias("total_events")).select("total_events", F.lit(0).cast("long").alias("correlated_events"), F.lit(0.0).alias("weighted"), F.lit(0).cast("long").alias("n"))
    counts = counts.union(covered.agg(F.lit(0).cast("long"), F.count("*"), F.lit(0.0), F.lit(0).cast("long")))
    counts = counts.union(groups.agg(F.lit(0).cast("long"), F.lit(0).cast("long"), F.sum(F.col("confidence") * F.col("event_count")), F.sum("event_count")))
    one = counts.agg(*(F.sum(c).alias(c) for c in counts.columns))
    score = F.round(F.coalesce(F.try_divide("weighted", "n"), F.lit(0.0)), 4)
    return one.select(
        "total_events", "correlated_events", F.round(F.coalesce(F.try_divide("correlated_events", "total_events"), F.lit(0.0)), 4).alias("coverage"), score.alias("confidence"),
        F.when(score >= 0.85, "HIGH").when(score >= 0.6, "MEDIUM").when(score > 0, "LOW").otherwise("NONE").alias("level"),
    )


def pattern_refs(patterns: DataFrame, enriched: DataFrame, groups: DataFrame) -> DataFrame:
    """(fingerprint, correlation_ref), once each, of these patterns; a hot pattern has as many rows as there are groups."""
    return correlated_refs(enriched.join(patterns.select("fingerprint"), "fingerprint", "left_semi"), groups).select("fingerprint", "correlation_ref").distinct()


def pattern_entries(patterns: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Timeline entries of log patterns, with lists of the refs of their events if ``refs`` (``pattern_refs``) are given."""
    listed = patterns.withColumn("refs", F.array().cast("array<string>"))
    if refs is not None:
        listed = patterns.join(refs.groupBy("fingerprint").agg(F.array_sort(F.collect_list("correlation_ref")).alias("refs")), "fingerprint", "left")
    return listed.select(
        F.col("first_seen").alias("timestamp"), F.lit("log_pattern").alias("kind"), F.when(F.size("services") == 1, F.element_at("services", 1)).otherwise("multiple").alias("service"),
        F.substring("template", 1, 240).alias("summary"), "fingerprint", F.lit(None).cast("string").alias("version"),
        F.create_map(F.lit("count"), F.col("count").cast("string"), F.lit("severity"), F.concat(F.lit('"'), "severity", F.lit('"'))).alias("metadata"),
        F.coalesce("refs", F.array().cast("array<string>")).alias("correlation_refs"), "evidence",
    )


def timeline(*entries: DataFrame) -> DataFrame:
    """All entries, in the order of timestamp text, kind and service."""
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return out.orderBy("timestamp", "kind", "service")
