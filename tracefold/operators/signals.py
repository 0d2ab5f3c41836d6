"""Metric anomalies, infrastructure events, label cardinality, evidence recall and code links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Labels that are of high risk by name.
RISKY_LABELS = ("pod", "pod_name", "container_id", "instance", "trace_id", "request_id", "session", "user_id")


def metric_anomalies(samples: DataFrame, keys: list[str], z_threshold: float = 3.0) -> DataFrame:
    """The last sample of each series against all before it; ``samples`` has the keys, ord, ts and value.

    Series of fewer than three samples are left out; a NaN score stays.
    """
    last = samples.groupBy(*keys).agg(F.max("ord").alias("last_ord"), F.count("*").alias("n")).where("n >= 3")
    joined = samples.join(last, keys)
    before = F.when(F.col("ord") < F.col("last_ord"), F.col("value"))
    stats = joined.groupBy(*keys).agg(
        F.avg(before).alias("mean"), F.stddev_pop(before).alias("sigma"), F.max_by("value", "ord").alias("last"), F.max_by("ts", "ord").alias("seen"),
    )
    score = F.round(F.abs(F.col("last") - F.col("mean")) / F.greatest(F.col("sigma"), F.lit(1e-9)), 3)
    up = (F.col("last") > F.col("mean")) & ~F.isnan("last") & ~F.isnan("mean")
    return stats.withColumn("score", score).where(~(F.col("score") < z_threshold)).select(*keys, "score", F.when(up, "up").otherwise("down").alias("direction"), "seen")


def incident_anomalies(found: DataFrame) -> DataFrame:
    """Anomalies as a snapshot takes them; ``found`` has metric, labels, score, direction, first_seen and last_seen.

    The service is the first of the labels service, app and job that is there; its hash with the metric names the anomaly.
    """
    label = lambda k: F.nullif(F.try_element_at("labels", F.lit(k)), F.lit(""))
    up = F.col("direction") == "up"
    out = found.withColumn("service", F.coalesce(label("service"), label("app"), label("job"), F.lit("unknown")))
    return out.select(
        T.short_hash("MA-", 16, F.col("metric"), F.col("service")).alias("id"), "metric", "service", F.when(up, "SPIKE").otherwise("DROP").alias("state"), F.lit(None).cast("double").alias("baseline"),
        F.when(up, F.col("score")).otherwise(-F.col("score")).alias("peak"), F.col("first_seen").alias("start"), F.col("last_seen").alias("peak_at"), F.lit("point-deviation").alias("shape"), "labels",
    )


def baseline_and_peak(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of all samples but the last, and the sample furthest from it; the first one of equals."""
    last = samples.groupBy(*keys).agg(F.max("ord").alias("last_ord"))
    joined = samples.join(last, keys)
    mean = joined.groupBy(*keys).agg(F.avg(F.when(F.col("ord") < F.col("last_ord"), F.col("value"))).alias("mean"))
    far = samples.join(mean, keys).groupBy(*keys).agg(F.max_by(F.struct("value", "ts"), F.struct(F.abs(F.col("value") - F.col("mean")), -F.col("ord"))).alias("peak"), F.first("mean").alias("mean"))
    return far.select(*keys, F.round("mean", 6).alias("baseline"), F.round("peak.value", 6).alias("peak"), F.col("peak.ts").alias("peak_at"))


def narrowing(anomalies: DataFrame, label: str, max_apps: int = 5) -> DataFrame:
    """The first distinct safe apps in the anomalies' order (score falling, then label)."""
    safe = anomalies.where(F.col(label).rlike(r"^[A-Za-z0-9_.:-]+$"))
    best = safe.groupBy(label).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), label).limit(max_apps).select(label)


def infrastructure_groups(events: DataFrame) -> DataFrame:
    """Cluster events by object, reason, type and template; ``events`` has those columns, message, count, ts, seq."""
    out = events.withColumn("message_template", T.infrastructure_template(F.coalesce("message", F.lit(""))))
    keys = ["namespace", "object_kind", "object_name", "reason", "type", "message_template"]
    n = F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count"))
    grouped = out.groupBy(*keys).agg(F.sum(n).cast("long").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("seq").alias("seq"))
    return grouped.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("\0", *keys), 256), 1, 16))


def top_infrastructure(groups: DataFrame, most: int = 20) -> DataFrame:
    return groups.orderBy(F.desc("count"), "namespace", "object_kind", "object_name", "reason", "seq").limit(most)


def label_cardinality(labels: DataFrame, warn_at: int = 10, critical_at: int = 100) -> DataFrame:
    """Labels with many or risky values, critical ones first, then by falling number; ``labels`` has key and value, one row for each series.

    Values are made distinct before they are counted, and three examples come
    from a ranking that stops at three, so no set of values is collected.
    """
    values = labels.select("key", "value").distinct()
    counts = values.groupBy("key").agg(F.count("*").alias("unique_values"), F.bool_or(F.col("value").rlike("[0-9a-f]{12,}")).alias("digests"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    examples = values.withColumn("nth", nth).where("nth <= 3").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("examples"))
    risky = F.col("key").isin(*RISKY_LABELS) | F.col("digests")
    level = F.when((F.col("unique_values") >= critical_at) | (risky & (F.col("unique_values") >= warn_at)), "critical").when((F.col("unique_values") >= warn_at) | risky, "warn")
    reason = F.when(risky, "high cardinality label").otherwise("many unique label values")
    out = counts.withColumn("severity", level).where("severity is not null").join(examples, "key").select(F.col("key").alias("label"), "unique_values", "severity", reason.alias("reason"), "examples")
    return out.orderBy(*cardinality_order())


def cardinality_order() -> list:
    return [F.col("severity") != "critical", F.desc("unique_values"), F.col("label")]


def evidence_recall(expected: DataFrame, retained: DataFrame) -> DataFrame:
    """Missing and unexpected evidence ids; both tables have kind and id."""
    missing = expected.join(retained.select("id"), "id", "left_anti").select("id", "kind", F.lit("missing").alias("finding"))
    extra = retained.join(expected.select("id"), "id", "left_anti").select("id", "kind", F.lit("unexpected").alias("finding"))
    return missing.unionByName(extra)


def code_links(nodes: DataFrame, terms: DataFrame, most: int = 12) -> DataFrame:
    """Code nodes by shared terms; ``nodes`` has ord, name, source, location, community, line; ``terms`` has term.

    Of nodes alike in name, source and location the first counts.  Without a
    shared term a node still counts if its source is not a test's.
    """
    if not 0 <= most <= 50:
        raise ValueError("code reference limit must be between 0 and 50")
    identity = Window.partitionBy("name", "source", "location").orderBy("ord")
    first = nodes.withColumn("nth", F.row_number().over(identity)).where("nth = 1").drop("nth")
    words = F.array_distinct(F.flatten(F.array(*(T.terms(F.coalesce(c, F.lit(""))) for c in ("name", "source", "location", "community")))))
    shared = first.select("ord", F.explode(words).alias("term")).join(terms.select("term").distinct(), "term").groupBy("ord").agg(F.array_sort(F.collect_list("term")).alias("shared"))
    plain = F.coalesce(F.col("source") != "", F.lit(False)) & ~F.coalesce(F.lower("source").rlike("test|fixture|example"), F.lit(False))
    scored = first.join(shared, "ord", "left").withColumn("score", F.coalesce(F.size("shared"), F.lit(0)) * 10 + F.when(plain, 2).otherwise(0))
    revision = F.substring(F.sha2("line", 256), 1, 20)
    out = scored.where("score > 0").orderBy(F.desc("score"), "ord").limit(most)
    return out.select("ord", "score", F.concat(F.lit("graphify:"), revision).alias("id"), "name", revision.alias("revision"), "source", "location", "community", F.concat(F.lit("incident terms: "), F.coalesce(F.array_join("shared", ", "), F.lit(""))).alias("reason"))


def code_nodes(lines: DataFrame) -> DataFrame:
    """Nodes from lines ``NODE name [key=value ...]``; ``lines`` has ord and value."""
    text = T.strip(F.col("value"))
    pattern = r"^NODE\s+(.+?)\s+\[(.+)\]$"
    meta = F.filter(F.transform(F.filter(F.split(F.regexp_extract(text, pattern, 2), r"\s+"), lambda p: p.contains("=")), lambda p: F.split(p, "=", 2)), lambda p: F.element_at(p, 2) != "")

    def of(key: str):
        return F.element_at(F.try_element_at(F.filter(meta, lambda p: F.element_at(p, 1) == F.lit(key)), F.lit(-1)), 2)

    found = lines.where(text.rlike(pattern))
    return found.select("ord", T.strip(F.regexp_extract(text, pattern, 1)).alias("name"), of("source").alias("source"), of("location").alias("location"), of("community").alias("community"), text.alias("line"))
