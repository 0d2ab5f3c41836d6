"""The registered queries of the incident operators over the driver's tables, and their SQL.

``events`` is read as a log (see ``LOGS``), as metric series by user, as
cluster events and as labels; ``documents`` as messages to redact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import correlate, events, patterns, signals
from ..staging import placed, shared_dir, stage

#: Where the incident begins; events before it are the baseline.
SPLIT = "2024-01-16"
BUDGET = 900

LOGS = """
  SELECT event_id AS seq, ts, concat('svc-', user_id % 5) AS service,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity,
    concat(event_type, ' order=', event_id, ' duration=', cast(floor(value) AS bigint), 'ms request_id=r', user_id, ' shard=', user_id % 3,
           ' kind=', event_id % 7) AS message
  FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    message = F.concat(
        F.col("event_type"), F.lit(" order="), F.col("event_id"), F.lit(" duration="), F.floor("value").cast("long"), F.lit("ms request_id=r"), F.col("user_id"),
        F.lit(" shard="), F.col("user_id") % 3, F.lit(" kind="), F.col("event_id") % 7,
    )
    return e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"), kind.alias("severity"), message.alias("message"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as stack traces, all else as it is; each service has evidence of its own."""
    e = logs(spark, sf_dir).withColumn("evidence", F.struct(F.lit("loki").alias("source"), F.concat(F.lit("Q-"), "service").alias("queryRef"), F.lit("a").alias("start"), F.lit("b").alias("end")))
    trace = F.concat(
        F.lit("com.shop.Kind"), F.col("seq") % 3, F.lit("Exception: order="), "seq", F.lit(" failed after 1234 ms\n    at com.shop.Cart.add(Cart.java:"), F.col("seq") % 97,
        F.lit(")\n\n  at com.shop.Pay.run"), F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("seq") % 2), F.lit("(Pay.java:12)\n  ... 3 more\nCaused by: id="), F.col("seq") % 5, F.lit(" lost"),
    )
    return e.withColumn("message", F.when(F.col("severity") == "ERROR", trace).otherwise(F.col("message")))


# The redaction rules once more, as DuckDB writes them; not made from those of the functions, which they check.
_DUCK_RULES = (
    (r"\b(?:authorization|token|secret|password|api[_-]?key)=\S+", "<redacted>", "gi"),
    (r"\b(?:trace_id|span_id|request_id|correlation_id|session_id)=\S+", "<correlation>", "gi"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "<redacted>", "g"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>", "g"),
    (r"\b(duration|timeout|latency)=\d+(?:\.\d+)?(?:ms|s|m)?\b", r"\1=<duration>", "gi"),
    (r"\b(order|request_id|session_id|user_id|shard|id)=\d+\b", r"\1=<id>", "gi"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>", "g"),
)


def _duck_normalized(c: str) -> str:
    """The redaction rules as nested DuckDB calls, for ASCII texts."""
    out = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    for pattern, replacement, flags in _DUCK_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', '{flags}')"
    return f"regexp_replace({out}, '\\s+', ' ', 'g')"


_ISO = "concat(strftime({0}, '%Y-%m-%dT%H:%M:%S'), CASE WHEN extract(microseconds FROM {0}) % 1000000 <> 0 THEN concat('.', lpad(cast(extract(microseconds FROM {0}) % 1000000 AS varchar), 6, '0')) ELSE '' END, 'Z')"
_RANK = "CASE {0} WHEN 'FATAL' THEN 5 WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 WHEN 'WARNING' THEN 2 WHEN 'DEBUG' THEN 0 ELSE 1 END"
_LP = "concat('LP-', substr(sha256(concat(severity, chr(0), template)), 1, 12))"
_CTE = f"WITH logs AS ({LOGS}), e AS (SELECT *, {_duck_normalized('message')} AS template FROM logs), p AS (SELECT {_LP} AS fingerprint, template, severity, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM e GROUP BY template, severity)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's patterns, staged: a row for each, which several plans read."""
    return stage(patterns.discover(events.enrich(logs(spark, sf_dir))), "patterns")


@query(
    f"{_CTE} SELECT fingerprint, template, severity, count, {_ISO.format('first_ts')} AS first_seen, {_ISO.format('last_ts')} AS last_seen, services, "
    f"CASE WHEN severity = 'ERROR' THEN 'protected_severity' ELSE 'dominant_frequency' END AS retention_reason, cast(24 + (length(template) + CASE WHEN count = 1 THEN 1 ELSE 2 END * 0 + CASE WHEN count = 1 THEN length({_ISO.format('first_ts')}) + 31 ELSE length({_ISO.format('first_ts')}) + length({_ISO.format('last_ts')}) + 62 END) // 4 AS bigint) AS cost, "
    f"row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, count DESC, fingerprint) AS place FROM p"
)
def log_patterns(spark, sf_dir):
    """Patterns with their rank and cost."""
    out = found(spark, sf_dir)
    out = placed(out, *patterns.ranked(out))
    return out.select("fingerprint", "template", "severity", "count", "first_seen", "last_seen", F.array_join("services", ",").alias("services"), "retention_reason", "cost", "place")


_TRACE_TEMPLATE = "CASE WHEN severity = 'ERROR' THEN concat('com.shop.Kind', seq % 3, 'Exception: order=<id> failed after <id> ms') ELSE {0} END"


@query(
    f"WITH logs AS ({LOGS}), e AS (SELECT *, {_TRACE_TEMPLATE.format(_duck_normalized('message'))} AS template, CASE WHEN severity = 'ERROR' THEN CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 2 END END AS run FROM logs), "
    f"v AS (SELECT {_LP} AS fingerprint, severity, service, min(seq) AS first_seq, count(*) AS n FROM e GROUP BY ALL), "
    f"f AS (SELECT {_LP} AS fingerprint, count(DISTINCT run) AS stacks, min(seq % 3) AS kind FROM e GROUP BY 1), "
    "x AS (SELECT concat('STACK-', substr(sha256(concat('com.shop.Kind', k, 'Exception', chr(0), 'at com.shop.Cart.add(Cart.java:<line>)', chr(0), 'at com.shop.Pay.run0(Pay.java:<line>)', chr(0), 'Caused by: id=<id> lost')), 1, 16)) AS stack, k FROM (VALUES (0)) t(k)) "
    "SELECT v.fingerprint, severity, sum(n)::BIGINT AS count, string_agg(concat('Q-', service), ',' ORDER BY first_seq) AS evidence, any_value(CASE WHEN stacks = 1 THEN stack END) AS exception_fingerprint FROM v JOIN f USING (fingerprint) LEFT JOIN x ON x.k = f.kind GROUP BY ALL"
)
def pattern_evidence(spark, sf_dir):
    """A2, A3: distinct evidence in the order of its first event, and the stack of patterns that have one alone."""
    out = patterns.discover(events.enrich(traces(spark, sf_dir)))
    return out.select("fingerprint", "severity", "count", F.array_join(F.transform("evidence", lambda e: e["queryRef"]), ",").alias("evidence"), "exception_fingerprint")


def _messages(c: str) -> str:
    return f"SELECT doc_id, {c} AS redacted FROM documents"


@query(_messages(_duck_normalized("text")))
def redact_documents(spark, sf_dir):
    """T1 over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_message(F.col("text")).alias("redacted"))


@query(f"WITH logs AS ({LOGS}) SELECT severity, {_RANK.format('severity')} AS severity_rank, severity IN ('FATAL', 'CRITICAL', 'ERROR') AS protected, count(*) AS events FROM logs GROUP BY severity")
def severity_ranks(spark, sf_dir):
    """F1-F3."""
    s = T.severity(F.col("severity"))
    return logs(spark, sf_dir).groupBy(s.alias("severity")).agg(F.count("*").alias("events")).select("severity", T.severity_rank(F.col("severity")).alias("severity_rank"), T.is_protected(F.col("severity")).alias("protected"), "events")


_DELTAS = f"""WITH logs AS ({LOGS}), e AS (SELECT *, {_duck_normalized('message')} AS template FROM logs),
 i AS (SELECT template, severity, count(*) AS incident_count FROM e WHERE ts >= '{SPLIT}' AND NOT starts_with(message, 'signup') GROUP BY ALL),
 b AS (SELECT template, severity, count(*) AS baseline_count FROM e WHERE ts < '{SPLIT}' AND severity <> 'ERROR' GROUP BY ALL),
 j AS (SELECT coalesce(i.template, b.template) AS template, coalesce(i.severity, b.severity) AS severity, coalesce(incident_count, 0) AS incident_count, coalesce(baseline_count, 0) AS baseline_count FROM i FULL JOIN b USING (template, severity)),
 r AS (SELECT *, round(incident_count * 60 / 3600, 4) AS incident_rate_per_minute, round(baseline_count * 60 / 7200, 4) AS baseline_rate_per_minute FROM j),
 q AS (SELECT *, CASE WHEN baseline_count = 0 THEN NULL WHEN incident_count = 0 THEN 0.0 ELSE round(incident_rate_per_minute / nullif(baseline_rate_per_minute, 0), 4) END AS relative_change FROM r)
 SELECT {_LP} AS fingerprint, template, severity, incident_count, baseline_count, incident_rate_per_minute, baseline_rate_per_minute, round(incident_rate_per_minute - baseline_rate_per_minute, 4) AS absolute_rate_delta, relative_change,
 CASE WHEN baseline_count = 0 THEN 'NEW' WHEN incident_count = 0 THEN 'DISAPPEARED' WHEN relative_change >= 2 THEN 'SPIKE' WHEN relative_change <= 0.5 THEN 'DROP' WHEN relative_change = 1 THEN 'STABLE' ELSE 'CHANGED' END AS state FROM q"""


def _deltas(spark, sf_dir):
    e = events.enrich(logs(spark, sf_dir))
    incident = e.where((F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")) & ~F.startswith("message", F.lit("signup")))
    baseline = e.where((F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")) & (F.col("severity") != "ERROR"))
    return correlate.deltas(incident, baseline, 3600, 7200)


@query(f"SELECT *, row_number() OVER (ORDER BY template, severity) AS place FROM ({_DELTAS})")
def pattern_deltas(spark, sf_dir):
    """J1, U1, A7, O2 and the delta states: no sign-ups in the incident, no errors in the baseline."""
    return placed(_deltas(spark, sf_dir), "template", "severity")


@query(f"WITH d AS ({_DELTAS}) SELECT s.state, count(d.state) AS patterns FROM (VALUES ('NEW'), ('DISAPPEARED'), ('SPIKE'), ('DROP'), ('STABLE'), ('CHANGED')) s(state) LEFT JOIN d ON d.state = s.state GROUP BY s.state")
def delta_states(spark, sf_dir):
    """All six states, counted."""
    return state_counts(_deltas(spark, sf_dir))


def state_counts(deltas: DataFrame) -> DataFrame:
    states = ("NEW", "DISAPPEARED", "SPIKE", "DROP", "STABLE", "CHANGED")
    one = deltas.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("patterns")) for s in states))).alias("x")).select("x.*")


_CORR = f"""{LOGS}), ids AS (SELECT seq, ts, service, {_duck_normalized('message')} AS template, severity, 'request_id' AS id_type, regexp_extract(message, 'request_id=([A-Za-z0-9._:-]{{2,256}})', 1) AS value FROM logs),
 g AS (SELECT concat('CORR-', substr(sha256(concat(id_type, chr(0), value)), 1, 16)) AS correlation_ref, id_type, count(*) AS event_count, string_agg(DISTINCT service, ',' ORDER BY service) AS services, min(ts) AS first_ts, max(ts) AS last_ts,
   CASE WHEN count(DISTINCT service) > 1 THEN 0.85 ELSE 0.6 END AS confidence FROM ids WHERE value <> '' GROUP BY id_type, value HAVING count(*) >= 2)"""


@query(f"WITH logs AS ({_CORR} SELECT correlation_ref, id_type, event_count, services, {_ISO.format('first_ts')} AS first_seen, {_ISO.format('last_ts')} AS last_seen, cast(confidence AS double) AS confidence, row_number() OVER (ORDER BY confidence DESC, event_count DESC, correlation_ref) AS place FROM g")
def correlation_groups(spark, sf_dir):
    """A5, F5, O4."""
    out = correlate.correlation_groups(events.enrich(logs(spark, sf_dir))).withColumn("services", F.array_join("services", ","))
    return placed(out, F.desc("confidence"), F.desc("event_count"), "correlation_ref")


@query(
    f"WITH logs AS ({_CORR}, s AS (SELECT (SELECT count(*) FROM logs) AS total_events, (SELECT count(DISTINCT seq) FROM ids WHERE concat('CORR-', substr(sha256(concat(id_type, chr(0), value)), 1, 16)) IN (SELECT correlation_ref FROM g)) AS correlated_events, "
    "(SELECT cast(round(sum(confidence * event_count) / sum(event_count), 4) AS double) FROM g) AS confidence) "
    "SELECT total_events, correlated_events, round(correlated_events / total_events, 4) AS coverage, confidence, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' WHEN confidence > 0 THEN 'LOW' ELSE 'NONE' END AS level FROM s"
)
def correlation_summary(spark, sf_dir):
    """A6, J3."""
    e = stage(events.enrich(logs(spark, sf_dir)).select("seq", "ts", "service", "ids"), "ids")
    return correlate.correlation_summary(e, stage(correlate.correlation_groups(e), "groups"))


@query(f"WITH logs AS ({LOGS}), r AS (SELECT {_RANK.format('severity')} AS k, lag({_RANK.format('severity')}) OVER (ORDER BY ts, seq) AS before FROM logs) SELECT count(*) AS escalations FROM r WHERE k > before")
def escalations(spark, sf_dir):
    """W1."""
    return events.escalations(logs(spark, sf_dir))


@query("SELECT greatest(1, cast(floor(epoch_us(max(ts))::DOUBLE / 1e6 - epoch_us(min(ts))::DOUBLE / 1e6) AS bigint)) AS window_seconds FROM events")
def window_seconds(spark, sf_dir):
    """A20."""
    return events.window_seconds(logs(spark, sf_dir))


_TRACE = """concat('com.shop.Kind', seq % 3, 'Exception: order=', seq, ' failed after 1234 ms', chr(10), '    at com.shop.Cart.add(Cart.java:', seq % 97, ')', chr(10), chr(10), '  at com.shop.Pay.run', CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 2 END, '(Pay.java:12)', chr(10), '  ... 3 more', chr(10), 'Caused by: id=', seq % 5, ' lost')"""


@query(
    f"""WITH logs AS ({LOGS}), t AS (SELECT *, {_TRACE} AS trace FROM logs WHERE severity = 'ERROR'),
 l AS (SELECT seq, ts, service, regexp_extract(trace, '^[A-Za-z.0-9]+', 0) AS exception_type, list_filter(string_split(trace, chr(10)), lambda x: regexp_matches(x, '^\\s*(at\\s+|Caused by:).+')) AS lines FROM t),
 f AS (SELECT seq, ts, service, exception_type, list_transform(lines, lambda x: regexp_replace(regexp_replace(trim(x), '(\\.java:)\\d+', '\\1<line>', 'g'), '\\bid=\\d+\\b', 'id=<id>', 'g')) AS frames FROM l)
 SELECT concat('STACK-', substr(sha256(concat(exception_type, chr(0), array_to_string(frames, chr(0)))), 1, 16)) AS fingerprint, any_value(exception_type) AS exception_type, any_value(array_to_string(frames, ' | ')) AS frames, count(*) AS count, string_agg(DISTINCT service, ',' ORDER BY service) AS services, {_ISO.format('min(ts)')} AS first_seen, {_ISO.format('max(ts)')} AS last_seen,
 row_number() OVER (ORDER BY count(*) DESC, concat('STACK-', substr(sha256(concat(exception_type, chr(0), array_to_string(frames, chr(0)))), 1, 16))) AS place
 FROM f GROUP BY exception_type, frames"""
)
def stack_fingerprints(spark, sf_dir):
    """A4, T6, T7, O3."""
    out = placed(patterns.stack_groups(events.enrich(traces(spark, sf_dir))), F.desc("count"), "fingerprint")
    return out.select("fingerprint", "exception_type", F.array_join("frames", " | ").alias("frames"), "count", F.array_join("services", ",").alias("services"), "first_seen", "last_seen", "place")


_BUDGET_SQL = f"""{_CTE}, c AS (SELECT *, 24 + (length(template) + CASE WHEN count = 1 THEN length({_ISO.format('first_ts')}) + 31 ELSE length({_ISO.format('first_ts')}) + length({_ISO.format('last_ts')}) + 62 END) // 4 AS cost, row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, count DESC, fingerprint) AS place FROM p),
 o AS (SELECT fingerprint, cost, row_number() OVER (ORDER BY place) AS n FROM c WHERE severity <> 'ERROR'),"""


@query(
    _BUDGET_SQL.replace("WITH logs", "WITH RECURSIVE logs")
    + f""" w AS (SELECT 0::BIGINT AS n, (SELECT coalesce(sum(cost), 0)::BIGINT FROM c WHERE severity = 'ERROR') AS used, NULL::VARCHAR AS kept
 UNION ALL SELECT o.n, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN w.used + o.cost ELSE w.used END, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN o.fingerprint END FROM w JOIN o ON o.n = w.n + 1)
 SELECT fingerprint, severity, count FROM c WHERE severity = 'ERROR' OR fingerprint IN (SELECT kept FROM w WHERE kept IS NOT NULL)"""
)
def budget_greedy(spark, sf_dir):
    """Protected patterns, then those that still fit."""
    return patterns.retained(found(spark, sf_dir), BUDGET).select("fingerprint", "severity", "count")


@query(f"{_BUDGET_SQL.rstrip(',')}, s AS (SELECT fingerprint, cost, sum(cost) OVER (ORDER BY place) AS running_cost FROM c WHERE place <= 12) SELECT fingerprint, cost::BIGINT AS cost, running_cost::BIGINT AS running_cost FROM s WHERE running_cost <= 500")
def budget_prefix(spark, sf_dir):
    """The longest affordable prefix of the first twelve."""
    out = found(spark, sf_dir)
    return patterns.within_prefix(out, 500, patterns.ranked(out), 12).select("fingerprint", "cost", "running_cost")


_REFS = f"WITH logs AS ({_CORR}, e AS (SELECT *, {_LP} AS fingerprint FROM ids), refs AS (SELECT DISTINCT fingerprint, ref AS correlation_ref FROM (SELECT fingerprint, concat('CORR-', substr(sha256(concat(id_type, chr(0), value)), 1, 16)) AS ref FROM e) WHERE ref IN (SELECT correlation_ref FROM g))"


@query(
    f"{_REFS}, n AS (SELECT fingerprint, count(*) AS refs FROM refs GROUP BY 1), p AS (SELECT fingerprint, any_value(template) AS template, min(ts) AS first_ts, count(DISTINCT service) AS n, min(service) AS one FROM e GROUP BY fingerprint), "
    f"t AS (SELECT {_ISO.format('first_ts')} AS timestamp, 'log_pattern' AS kind, CASE WHEN n = 1 THEN one ELSE 'multiple' END AS service, substr(template, 1, 240) AS summary, coalesce(refs, 0) AS refs FROM p LEFT JOIN n USING (fingerprint) "
    f"UNION ALL SELECT {_ISO.format('o.d')} AS timestamp, 'deployment', 'svc-0', concat('release ', o.k), 0 FROM (SELECT cast(o_orderdate AS timestamp) AS d, count(*) AS k FROM orders GROUP BY 1) o) "
    "SELECT *, row_number() OVER (ORDER BY timestamp, kind, service, summary) AS place FROM t"
)
def timeline_union(spark, sf_dir):
    """Log patterns and deployment markers in one timeline, with the number of refs of each pattern."""
    e = events.staged(logs(spark, sf_dir))
    whole = stage(patterns.discover(e), "patterns")
    refs = correlate.pattern_refs(whole, e, stage(correlate.correlation_groups(e), "groups"))
    entries = correlate.pattern_entries(whole).join(refs.groupBy("fingerprint").agg(F.count("*").alias("refs")), "fingerprint", "left")
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("d")).agg(F.count("*").alias("k"))
    markers = day.select(T.iso_z(F.col("d")).alias("timestamp"), F.lit("deployment").alias("kind"), F.lit("svc-0").alias("service"), F.concat(F.lit("release "), "k").alias("summary"), F.lit(0).cast("long").alias("refs"))
    shown = entries.select("timestamp", "kind", "service", "summary", F.coalesce("refs", F.lit(0)).alias("refs"))
    return placed(shown.unionByName(markers), "timestamp", "kind", "service", "summary")


@query(f"{_REFS} SELECT * FROM refs")
def timeline_refs(spark, sf_dir):
    """The refs of each pattern's timeline entry, a row for each."""
    e = stage(events.enrich(logs(spark, sf_dir)).select("seq", "ts", "service", "fingerprint", "ids"), "ids")
    return correlate.pattern_refs(e.select("fingerprint").distinct(), e, stage(correlate.correlation_groups(e), "groups"))


_SERIES = "SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, count(*) OVER (PARTITION BY user_id) AS n FROM events"


def series(spark, sf_dir):
    """Metric samples: the values of each user in order."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "value", "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"))


_ANOMALY = f"""WITH s AS ({_SERIES}), b AS (SELECT user_id, avg(value) FILTER (ord < n) AS mean, stddev_pop(value) FILTER (ord < n) AS sigma, max(value) FILTER (ord = n) AS last, max(ts) FILTER (ord = n) AS seen FROM s WHERE n >= 3 GROUP BY user_id),
 a AS (SELECT user_id, round(abs(last - mean) / greatest(sigma, 1e-9), 3) AS score, CASE WHEN last > mean THEN 'up' ELSE 'down' END AS direction, seen FROM b)"""


@query(f"{_ANOMALY} SELECT user_id, score, direction, seen FROM a WHERE score >= 1.5")
def metric_anomalies(spark, sf_dir):
    """A8, F6, F7, W3."""
    return signals.metric_anomalies(series(spark, sf_dir), ["user_id"], 1.5)


@query(f"{_ANOMALY} SELECT user_id, concat('MA-', substr(sha256(concat('load', chr(0), 'svc-', user_id % 7)), 1, 16)) AS id, concat('svc-', user_id % 7) AS service, CASE direction WHEN 'up' THEN 'SPIKE' ELSE 'DROP' END AS state, CASE direction WHEN 'up' THEN score ELSE -score END AS peak, 'point-deviation' AS shape FROM a")
def anomaly_records(spark, sf_dir):
    """A10: anomalies in the form that a snapshot takes."""
    scored = signals.metric_anomalies(series(spark, sf_dir), ["user_id"], 0.0)
    labels = F.create_map(F.lit("app"), F.concat(F.lit("svc-"), F.col("user_id") % 7), F.lit("user"), F.col("user_id").cast("string"))
    shaped = scored.select(F.lit("load").alias("metric"), labels.alias("labels"), "score", "direction", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))
    return signals.incident_anomalies(shaped).select(F.col("labels.user").cast("long").alias("user_id"), "id", "service", "state", "peak", "shape")


@query(f"{_ANOMALY} SELECT user_id, score, direction FROM a ORDER BY score DESC, user_id LIMIT 10")
def anomaly_top(spark, sf_dir):
    """O6."""
    return signals.metric_anomalies(series(spark, sf_dir), ["user_id"], 0.0).orderBy(F.desc("score"), "user_id").limit(10).select("user_id", "score", "direction")


@query(f"{_ANOMALY} SELECT service FROM (SELECT concat('svc-', user_id % 7) AS service, max(score) AS score FROM a GROUP BY 1) ORDER BY score DESC, service LIMIT 5")
def metric_narrowing(spark, sf_dir):
    """The services whose logs are to be read."""
    found = signals.metric_anomalies(series(spark, sf_dir), ["user_id"], 0.0).withColumn("service", F.concat(F.lit("svc-"), F.col("user_id") % 7))
    return signals.narrowing(found, "service", 5)


@query(f"WITH s AS ({_SERIES}), m AS (SELECT user_id, avg(value) FILTER (ord < n) AS mean FROM s GROUP BY user_id), d AS (SELECT s.user_id, mean, value, row_number() OVER (PARTITION BY s.user_id ORDER BY abs(value - mean) DESC, ord) AS k FROM s JOIN m USING (user_id) WHERE n > 1) SELECT user_id, round(mean, 6) AS baseline, round(value, 6) AS peak FROM d WHERE k = 1")
def anomaly_peaks(spark, sf_dir):
    """A9, J4."""
    return signals.baseline_and_peak(series(spark, sf_dir), ["user_id"]).where("baseline is not null").select("user_id", "baseline", "peak")


@query(
    """WITH k AS (SELECT concat('ns-', user_id % 2) AS namespace, 'Pod' AS object_kind, concat('pod-', user_id % 4) AS object_name, event_type AS reason, 'Warning' AS type, trim(regexp_replace(concat(event_type, ' of ', event_id, ' failed'), '\\b[0-9a-f]{8,}\\b|\\d+', '?', 'g')) AS message_template, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END AS n, ts FROM events)
 SELECT namespace, object_kind, object_name, reason, type, message_template, sum(n)::BIGINT AS count, min(ts) AS first_seen, max(ts) AS last_seen, substr(sha256(concat_ws(chr(0), namespace, object_kind, object_name, reason, type, message_template)), 1, 16) AS fingerprint FROM k GROUP BY ALL"""
)
def infrastructure_groups(spark, sf_dir):
    """A11, T9."""
    return signals.infrastructure_groups(_cluster_events(spark, sf_dir)).drop("seq")


def _cluster_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("ns-"), F.col("user_id") % 2).alias("namespace"), F.lit("Pod").alias("object_kind"), F.concat(F.lit("pod-"), F.col("user_id") % 4).alias("object_name"), F.col("event_type").alias("reason"), F.lit("Warning").alias("type"),
        F.concat("event_type", F.lit(" of "), "event_id", F.lit(" failed")).alias("message"), (F.col("event_id") % 3).alias("count"), "ts", F.col("event_id").alias("seq"),
    )


@query(
    """WITH k AS (SELECT concat('ns-', user_id % 2) AS namespace, concat('pod-', user_id % 4) AS object_name, event_type AS reason, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END AS n FROM events),
 g AS (SELECT namespace, object_name, reason, sum(n)::BIGINT AS count FROM k GROUP BY ALL)
 SELECT *, row_number() OVER (ORDER BY count DESC, namespace, object_name, reason) AS place FROM g QUALIFY place <= 7"""
)
def infrastructure_top(spark, sf_dir):
    """The largest groups of cluster events, in order."""
    top = placed(signals.top_infrastructure(signals.infrastructure_groups(_cluster_events(spark, sf_dir)), 7), F.desc("count"), "namespace", "object_kind", "object_name", "reason", "seq")
    return top.select("namespace", "object_name", "reason", "count", "place")


@query(
    """WITH l AS (SELECT 'user_id' AS key, cast(user_id AS varchar) AS value FROM events UNION ALL SELECT 'type', event_type FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events UNION ALL SELECT 'day', cast(cast(ts AS date) AS varchar) FROM events),
 v AS (SELECT DISTINCT key, value FROM l WHERE value IS NOT NULL), c AS (SELECT key AS label, count(*) AS unique_values, key = 'user_id' OR bool_or(regexp_matches(value, '[0-9a-f]{12,}')) AS risky, array_to_string(list_sort(list(value))[1:3], ',') AS examples FROM v GROUP BY key)
 SELECT label, unique_values, CASE WHEN unique_values >= 100 OR (risky AND unique_values >= 10) THEN 'critical' ELSE 'warn' END AS severity, CASE WHEN risky THEN 'high cardinality label' ELSE 'many unique label values' END AS reason, examples,
 row_number() OVER (ORDER BY CASE WHEN unique_values >= 100 OR (risky AND unique_values >= 10) THEN 0 ELSE 1 END, unique_values DESC, label) AS place FROM c WHERE risky OR unique_values >= 10"""
)
def label_cardinality(spark, sf_dir):
    """A12, O8."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("day"), F.to_date("ts").cast("string"))
    out = signals.label_cardinality(e.select(F.explode(labels)).where("value is not null"))
    return placed(out.withColumn("examples", F.array_join("examples", ",")), *signals.cardinality_order())


@query(
    "WITH x AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'root_cause' ELSE 'code_reference' END AS kind FROM labels WHERE quality = 1), r AS (SELECT doc_id AS id, 'code_reference' AS kind FROM documents WHERE lang = 'en') "
    "SELECT id, kind, 'missing' AS finding FROM x WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, kind, 'unexpected' FROM r WHERE id NOT IN (SELECT id FROM x)"
)
def evidence_recall(spark, sf_dir):
    """Expected evidence (good labels) that is missing, and retained evidence (English texts) that is not expected."""
    kind = F.when(F.col("toxic") == 1, "root_cause").otherwise("code_reference")
    expected = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), kind.alias("kind"))
    retained = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("code_reference").alias("kind"))
    return signals.evidence_recall(expected, retained)


@query(
    """WITH n AS (SELECT p_partkey AS ord, p_name AS name, concat('src/', CASE WHEN p_partkey % 4 = 0 THEN 'test_' ELSE '' END, p_brand) AS source, p_type AS community FROM part),
 t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(concat(s_name, ' ', n_name, ' src'), '[A-Za-z][A-Za-z0-9_.$:-]{2,}'))) AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 w AS (SELECT DISTINCT ord, lower(unnest(list_concat(list_concat(regexp_extract_all(name, '[A-Za-z][A-Za-z0-9_.$:-]{2,}'), regexp_extract_all(source, '[A-Za-z][A-Za-z0-9_.$:-]{2,}')), regexp_extract_all(community, '[A-Za-z][A-Za-z0-9_.$:-]{2,}')))) AS term FROM n),
 k AS (SELECT ord, count(*) AS shared FROM w JOIN t USING (term) GROUP BY ord),
 d AS (SELECT *, row_number() OVER (PARTITION BY name, source ORDER BY ord) AS nth FROM n),
 s AS (SELECT d.ord, name, source, coalesce(shared, 0) * 10 + CASE WHEN regexp_matches(lower(source), 'test|fixture|example') THEN 0 ELSE 2 END AS score FROM d LEFT JOIN k USING (ord) WHERE nth = 1)
 SELECT ord, name, source, cast(score AS integer) AS score FROM s WHERE score > 0 ORDER BY score DESC, ord LIMIT 50"""
)
def code_links(spark, sf_dir):
    """J5, F15, O9, W7, U4, U5, T10."""
    source = F.concat(F.lit("src/"), F.when(F.col("p_partkey") % 4 == 0, "test_").otherwise(""), "p_brand")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), source.alias("source"), F.lit(None).cast("string").alias("location"), F.col("p_type").alias("community"), F.col("p_name").alias("line"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    terms = named.select(F.explode(T.terms(F.concat_ws(" ", "s_name", "n_name", F.lit("src")))).alias("term"))
    return signals.code_links(nodes, terms, 50).select("ord", "name", "source", "score")


@query(f"WITH logs AS ({LOGS}), j AS (SELECT length(concat(severity, message)) AS n, strlen(concat(severity, message)) AS b FROM logs) SELECT count(*) AS line_count, sum(b + 1)::BIGINT AS normalized_bytes, sum(greatest(1, n // 4) + 12)::BIGINT AS estimated_tokens FROM j")
def context_telemetry(spark, sf_dir):
    """Lines, bytes and estimated tokens."""
    line = F.concat("severity", "message")
    return token_totals(logs(spark, sf_dir).select(line.alias("line")))


def token_totals(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("line_count"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).cast("long").alias("normalized_bytes"), F.coalesce(F.sum(F.greatest(F.lit(1), F.floor(F.length("line") / 4)) + 12), F.lit(0)).cast("long").alias("estimated_tokens"))


@query(
    f"{_BUDGET_SQL.replace('WITH logs', 'WITH RECURSIVE logs')} w AS (SELECT 0::BIGINT AS n, (SELECT coalesce(sum(cost), 0)::BIGINT FROM c WHERE severity = 'ERROR') AS used, NULL::VARCHAR AS kept UNION ALL SELECT o.n, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN w.used + o.cost ELSE w.used END, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN o.fingerprint END FROM w JOIN o ON o.n = w.n + 1), "
    f"d AS ({_DELTAS}), k AS (SELECT *, severity = 'ERROR' OR fingerprint IN (SELECT kept FROM w WHERE kept IS NOT NULL) AS retained, fingerprint IN (SELECT fingerprint FROM d WHERE state = 'NEW') AS fresh FROM c) "
    "SELECT count(*) AS discovered_patterns, count(*) FILTER (retained) AS retained_patterns, count(*) FILTER (count = 1) AS rare_patterns, count(*) FILTER (count = 1 AND retained) AS rare_patterns_retained, count(*) FILTER (fresh) AS new_patterns, count(*) FILTER (fresh AND retained) AS new_patterns_retained FROM k"
)
def retention_telemetry(spark, sf_dir):
    """How many rare and new patterns the budget keeps."""
    whole = found(spark, sf_dir)
    return retention(whole, patterns.retained(whole, BUDGET), _deltas(spark, sf_dir))


def retention(discovered: DataFrame, retained: DataFrame, deltas: DataFrame) -> DataFrame:
    kept = retained.select("fingerprint", F.lit(True).alias("kept"))
    fresh = deltas.where("state = 'NEW'").select("fingerprint", F.lit(True).alias("fresh"))
    flagged = discovered.select("fingerprint", "count").join(kept, "fingerprint", "left").join(fresh, "fingerprint", "left")
    kept, fresh, rare = F.coalesce("kept", F.lit(False)), F.coalesce("fresh", F.lit(False)), F.col("count") == 1
    return flagged.agg(
        F.count("*").alias("discovered_patterns"), F.count_if(kept).alias("retained_patterns"), F.count_if(rare).alias("rare_patterns"), F.count_if(rare & kept).alias("rare_patterns_retained"),
        F.count_if(fresh).alias("new_patterns"), F.count_if(fresh & kept).alias("new_patterns_retained"),
    )


@query(
    f"{_CTE} SELECT fingerprint AS target, concat('Pattern ''', template, ''' is recurring and may indicate an active incident cause.') AS statement, CASE WHEN count >= 3 THEN least(1.0, round(0.55 + count / 25, 2)) ELSE 0.45 END::DOUBLE AS confidence, CASE WHEN count >= 3 THEN 'supported' ELSE 'unverified' END AS state FROM p"
)
def pattern_hypotheses(spark, sf_dir):
    """Hypotheses from patterns."""
    from .disclosure import pattern_hypotheses as hypotheses

    return hypotheses(found(spark, sf_dir))


@query(f"{_CTE}, k AS (SELECT *, row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, count DESC, fingerprint) AS place, count(*) OVER () AS available FROM p) SELECT fingerprint, available, least(available, 5)::BIGINT AS returned, available > 5 AS truncated FROM k WHERE place <= 5")
def section_read(spark, sf_dir):
    """The first five patterns, with what is available."""
    out = found(spark, sf_dir)
    return section(out, patterns.ranked(out), 5).select("fingerprint", "available", "returned", "truncated")


def section(rows: DataFrame, order: list, limit: int) -> DataFrame:
    most = max(1, min(50, limit))
    n = rows.agg(F.count("*").alias("available"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(n)).withColumns({"returned": F.least("available", F.lit(most)).cast("long"), "truncated": F.col("available") > most})


@query(f"SELECT event_id, {_ISO.format('ts')} AS iso FROM events")
def iso_timestamps(spark, sf_dir):
    """T2, T17."""
    return table(spark, sf_dir, "events").select("event_id", T.iso_z(F.col("ts").cast("timestamp")).alias("iso"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity FROM events")
def text_severity(spark, sf_dir):
    """Severity words in log lines."""
    line = F.concat(F.lit("at "), "event_id", F.when(F.col("event_type") == "error", " ERROR ").otherwise(" error "), "event_type")
    return table(spark, sf_dir, "events").select("event_id", T.severity_in_text(line).alias("severity"))


@query(f"{_CTE}, j AS (SELECT date_trunc('hour', ts) AS window_start, template, severity FROM e) SELECT window_start, template, severity, count(*) AS events FROM j GROUP BY ALL")
def windowed_patterns(spark, sf_dir):
    """Beyond the reference: pattern counts by the hour; ``streaming.patterns`` runs the same plan on a stream."""
    from ..streaming.patterns import windowed

    return windowed(logs(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_FIELDS = """concat('{"Authorization":"<redacted>","api-token":"<redacted>","note":', to_json(concat(event_type, ' order=<id> from <ip>'))::VARCHAR, ',"size":', event_id % 100, ',"user_id":"<redacted>"}')"""


@query(f"SELECT event_id, {_FIELDS} AS fields FROM events")
def sanitized_fields(spark, sf_dir):
    """T4: sensitive names redacted, texts normalised, nested values dropped."""
    text = F.concat(F.lit('"'), "event_type", F.lit(" order="), "event_id", F.lit(' from 10.0.0.7"'))
    fields = F.create_map(F.lit("Authorization"), F.lit('"Basic x"'), F.lit("api-token"), F.lit("1"), F.lit("nested"), F.col("props"), F.lit("note"), text, F.lit("size"), (F.col("event_id") % 100).cast("string"), F.lit("user_id"), F.col("user_id").cast("string"))
    clean = table(spark, sf_dir, "events").select("event_id", T.sanitized(fields).alias("f"))
    pairs = F.transform(F.array_sort(F.map_entries("f")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return clean.select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("fields"))


@query("WITH t AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.$:-]{2,}'))) AS term FROM documents) SELECT term, count(*) AS documents FROM t GROUP BY term HAVING count(*) >= 5")
def message_terms(spark, sf_dir):
    """Identifiers in texts."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return t.groupBy("term").agg(F.count("*").alias("documents")).where("documents >= 5")


def _quality_sql() -> str:
    from .quality import EVIDENCE, SCENARIOS

    quoted = lambda v: "'" + v + "'"
    s = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in SCENARIOS)
    e = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in EVIDENCE)
    form = lambda c: f"replace(replace({c}, '{{0}}', key), '{{1}}', scenario)"
    return f"SELECT scenario, kind, {form('id')} AS id, {form('description')} AS description, source, {form('query_ref')} AS query_ref FROM (VALUES {s}) s(scenario, key), (VALUES {e}) e(kind, id, description, source, query_ref)"


@query(_quality_sql())
def quality_scenarios(spark, sf_dir):
    """The expected evidence of the eight scenarios."""
    from .quality import scenarios

    return scenarios(spark)


_KIND = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(("first_failure", "rare_precursor", "root_cause", "code_reference", "metric_anomaly", "deployment_retention"))) + " END"


@query(
    f"""WITH x AS (SELECT source AS scenario, {_KIND} AS kind, cast(doc_id AS varchar) AS id, doc_id IN (SELECT doc_id FROM labels) OR coalesce(lang = 'en', false) AS kept FROM documents),
 k AS (SELECT scenario, kind, bool_and(kept) AS whole, count(*) FILTER (NOT kept) AS lost FROM x GROUP BY ALL)
 SELECT scenario, count(*) FILTER (whole) AS whole_kinds, sum(lost)::BIGINT AS missing, CASE WHEN count(*) FILTER (whole) + sum(lost) = 0 THEN 1.0 ELSE count(*) FILTER (whole) / (count(*) FILTER (whole) + sum(lost)) END::DOUBLE AS recall, sum(lost) = 0 AND count(*) FILTER (whole) = 6 AS passed FROM k GROUP BY scenario"""
)
def scenario_recall(spark, sf_dir):
    """Recall and verdict of each scenario (here: each source of the documents)."""
    from .quality import KINDS, recall

    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("first_failure", "rare_precursor", "root_cause", "code_reference", "metric_anomaly", "deployment_retention"))), (F.col("doc_id") % 6 + 1).cast("int"))
    expected = docs.select(F.col("source").alias("scenario"), kind.alias("kind"), F.col("doc_id").cast("string").alias("id"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    kept = labelled.union(docs.where("lang = 'en'")).select(F.col("source").alias("scenario"), F.col("doc_id").cast("string").alias("id"))
    found = recall(expected, kept)
    whole = sum((F.col(k).cast("int") for k in KINDS), F.lit(0))
    return found.select("scenario", whole.cast("long").alias("whole_kinds"), F.size("missing").cast("long").alias("missing"), F.col("recall").cast("double").alias("recall"), "passed")


def _built(spark, sf_dir):
    from .snapshot import Request, build

    e = logs(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    split = F.lit(SPLIT).cast("timestamp")
    return build(Request("shop", BUDGET, e.where(F.col("ts") >= split), e.where(F.col("ts") < split), 3600, 3600))


_SNAPSHOT = f"""WITH RECURSIVE logs AS ({LOGS}), i AS (SELECT *, {_duck_normalized('message')} AS template FROM logs WHERE ts >= '{SPLIT}'), e AS (SELECT *, {_LP} AS fingerprint, regexp_extract(message, 'request_id=([A-Za-z0-9._:-]{{2,256}})', 1) AS value FROM i),
 b AS (SELECT template, severity, count(*) AS baseline_count FROM (SELECT *, {_duck_normalized('message')} AS template FROM logs WHERE ts < '{SPLIT}') GROUP BY ALL),
 p AS (SELECT fingerprint, template, severity, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(DISTINCT service) AS n_services FROM e GROUP BY fingerprint, template, severity),
 c AS (SELECT *, 24 + (length(template) + CASE WHEN count = 1 THEN length({_ISO.format('first_ts')}) + 31 ELSE length({_ISO.format('first_ts')}) + length({_ISO.format('last_ts')}) + 62 END) // 4 AS cost, row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, count DESC, fingerprint) AS place FROM p),
 o AS (SELECT fingerprint, cost, row_number() OVER (ORDER BY place) AS n FROM c WHERE severity <> 'ERROR'),
 w AS (SELECT 0::BIGINT AS n, (SELECT coalesce(sum(cost), 0)::BIGINT FROM c WHERE severity = 'ERROR') AS used, NULL::VARCHAR AS kept
  UNION ALL SELECT o.n, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN w.used + o.cost ELSE w.used END, CASE WHEN w.used + o.cost <= {BUDGET - 36} THEN o.fingerprint END FROM w JOIN o ON o.n = w.n + 1),
 k AS (SELECT * FROM c WHERE severity = 'ERROR' OR fingerprint IN (SELECT kept FROM w WHERE kept IS NOT NULL)),
 d AS (SELECT coalesce(p.template, b.template) AS template, coalesce(p.severity, b.severity) AS severity, coalesce(count, 0) AS incident_count, coalesce(baseline_count, 0) AS baseline_count FROM p FULL JOIN b ON p.template = b.template AND p.severity = b.severity),
 x AS (SELECT *, round(incident_count * 60 / 3600, 4) / nullif(round(baseline_count * 60 / 3600, 4), 0) AS change FROM d),
 g AS (SELECT concat('CORR-', substr(sha256(concat('request_id', chr(0), value)), 1, 16)) AS ref, count(*) AS n, string_agg(DISTINCT service, ',' ORDER BY service) AS services, CASE WHEN count(DISTINCT service) > 1 THEN 0.85 ELSE 0.6 END AS confidence FROM e WHERE value <> '' GROUP BY value HAVING count(*) >= 2),
 r AS (SELECT fingerprint, count(DISTINCT concat('CORR-', substr(sha256(concat('request_id', chr(0), value)), 1, 16))) AS refs FROM e WHERE concat('CORR-', substr(sha256(concat('request_id', chr(0), value)), 1, 16)) IN (SELECT ref FROM g) GROUP BY 1),
 t AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT sum(greatest(1, length(message) // 4) + 12) FROM e) AS tokens, (SELECT max(ts) FROM e) AS last_ts, (SELECT count(*) FROM p) AS patterns, (SELECT count(*) FROM k) AS kept, (SELECT sum(cost) FROM k) AS cost, (SELECT count(*) FROM d) AS deltas, (SELECT count(*) FROM g) AS groups)
 """


@query(
    f"""{_SNAPSHOT} SELECT 'patterns' AS section, row_number() OVER (ORDER BY place) AS place, fingerprint AS id, concat_ws('|', severity, count, {_ISO.format('first_ts')}, {_ISO.format('last_ts')}, services, CASE WHEN severity = 'ERROR' THEN 'protected_severity' ELSE 'dominant_frequency' END) AS detail FROM k
 UNION ALL SELECT 'deltas', row_number() OVER (ORDER BY template, severity), {_LP}, concat_ws('|', incident_count, baseline_count, CASE WHEN baseline_count = 0 THEN 'NEW' WHEN incident_count = 0 THEN 'DISAPPEARED' WHEN round(change, 4) >= 2 THEN 'SPIKE' WHEN round(change, 4) <= 0.5 THEN 'DROP' WHEN round(change, 4) = 1 THEN 'STABLE' ELSE 'CHANGED' END) FROM x
 UNION ALL SELECT 'correlations', row_number() OVER (ORDER BY confidence DESC, n DESC, ref), ref, concat_ws('|', n, services) FROM g
 UNION ALL SELECT 'timeline', row_number() OVER (ORDER BY {_ISO.format('first_ts')}, CASE WHEN n_services = 1 THEN services ELSE 'multiple' END, fingerprint), fingerprint, concat_ws('|', CASE WHEN n_services = 1 THEN services ELSE 'multiple' END, substr(template, 1, 240), coalesce(refs, 0)) FROM k LEFT JOIN r USING (fingerprint)
 UNION ALL SELECT 'totals', 1, {_ISO.format('last_ts')}, concat_ws('|', n, patterns, kept, patterns - kept, tokens::BIGINT, (36 + cost + 20 * deltas + 18 * kept + 16 * groups)::BIGINT, patterns > kept) FROM t"""
)
def incident_snapshot(spark, sf_dir):
    """The snapshot's sections in their order, and its totals, as rows."""
    s = _built(spark, sf_dir)
    detail = {
        "patterns": ("fingerprint", ["severity", "count", "first_seen", "last_seen", F.array_join("services", ","), "retention_reason"]),
        "deltas": ("fingerprint", ["incident_count", "baseline_count", "state"]),
        "correlations": ("correlation_ref", ["event_count", F.array_join("services", ",")]),
        "stackFingerprints": ("fingerprint", ["count"]),
        "timeline": ("fingerprint", ["service", "summary", F.size("correlation_refs")]),
    }
    folder = f"{shared_dir(spark)}/tracefold/snapshot-{uuid.uuid4().hex}"
    whole = s.write(folder)
    rows = [
        spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("section"), "place", F.col(detail[name][0]).alias("id"), F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in detail[name][1])).alias("detail"))
        for name in s.sections()
    ]
    totals = [whole["rawEventCount"], whole["compression"]["discoveredPatterns"], whole["compression"]["retainedPatterns"], whole["omittedPatternCount"], whole["compression"]["estimatedInputTokens"], whole["requiredTokens"], str(whole["incomplete"]).lower()]
    out = spark.createDataFrame([("totals", 1, whole["generatedAt"], "|".join(map(str, totals)))], "section string, place long, id string, detail string")
    for table in rows:
        out = out.unionByName(table)
    return out


def _disclosure_sql(budget: int) -> str:
    """What each level spends: the JSON length of each section's rows, and sections one after another."""
    from .disclosure import RESERVE, SECTIONS, SHOWN, SPENDING

    text = lambda c: f"to_json({c})::VARCHAR"
    named = lambda *pairs: "length(concat('{', " + ", ', ', ".join(f"'\"{k}\": ', {v}" for k, v in pairs) + ", '}'))"
    listed = "concat('[\"', replace(services, ',', '\", \"'), '\"]')"
    iso = {k: f"concat('\"', {_ISO.format(k)}, '\"')" for k in ("first_ts", "last_ts")}
    reason = "CASE WHEN severity = 'ERROR' THEN '\"protected_severity\"' ELSE '\"dominant_frequency\"' END"
    sample = lambda k: f"'{{\"fields\": {{}}, \"timestamp\": ', {iso[k]}, '}}'"
    samples = f"CASE WHEN count = 1 THEN concat('[', {sample('first_ts')}, ']') ELSE concat('[', {sample('first_ts')}, ', ', {sample('last_ts')}, ']') END"
    short = [("count", "count"), ("exceptionFingerprint", "'null'"), ("fingerprint", text("fingerprint")), ("firstSeen", iso["first_ts"]), ("lastSeen", iso["last_ts"]), ("retentionReason", reason), ("services", listed), ("severity", text("severity")), ("template", text("template"))]
    pattern = {"L1": named(*short), "L2": named(*short, ("evidence", "'[]'"), ("samples", samples))}
    rate = lambda c: f"round({c} * 60 / 3600, 4)"
    delta = named(
        ("absoluteRateDelta", f"round({rate('incident_count')} - {rate('baseline_count')}, 4)"), ("baselineCount", "baseline_count"), ("baselineRatePerMinute", rate("baseline_count")), ("fingerprint", text(_LP)), ("incidentCount", "incident_count"), ("incidentRatePerMinute", rate("incident_count")),
        ("relativeChange", "CASE WHEN baseline_count = 0 THEN 'null' WHEN incident_count = 0 THEN '0.0' ELSE round(change, 4)::VARCHAR END"), ("severity", text("severity")),
        ("state", "CASE WHEN baseline_count = 0 THEN '\"NEW\"' WHEN incident_count = 0 THEN '\"DISAPPEARED\"' WHEN round(change, 4) >= 2 THEN '\"SPIKE\"' WHEN round(change, 4) <= 0.5 THEN '\"DROP\"' WHEN round(change, 4) = 1 THEN '\"STABLE\"' ELSE '\"CHANGED\"' END"), ("template", text("template")),
    )
    service = "CASE WHEN n_services = 1 THEN services ELSE 'multiple' END"
    refs = "CASE WHEN coalesce(refs, 0) = 0 THEN '[]' ELSE repeat('x', (refs * 25)::BIGINT) END"
    entry = [("correlationRefs", refs), ("fingerprint", text("fingerprint")), ("kind", "'\"log_pattern\"'"), ("service", text(service)), ("summary", text("substr(template, 1, 240)")), ("timestamp", iso["first_ts"]), ("version", "'null'")]
    line = {"L1": named(*entry), "L2": named(*entry, ("evidence", "'[]'"), ("metadata", "concat('{\"count\": ', count, ', \"severity\": ', to_json(severity)::VARCHAR, '}')"))}
    group = named(("confidence", "confidence::DOUBLE"), ("correlationRef", text("ref")), ("eventCount", "n"), ("firstSeen", iso["first_ts"]), ("idType", "'\"request_id\"'"), ("lastSeen", iso["last_ts"]), ("services", listed))
    sure = "CASE WHEN count >= 3 THEN least(1.0, round(0.55 + count / 25, 2)) ELSE 0.45 END::DOUBLE"
    guess = named(("confidence", sure), ("evidenceRefs", "'[]'"), ("state", "CASE WHEN count >= 3 THEN '\"supported\"' ELSE '\"unverified\"' END"), ("statement", text("concat('Pattern ''', template, ''' is recurring and may indicate an active incident cause.')")), ("target", text("fingerprint")))
    tables = {
        "patterns": ("k", "place", pattern), "deltas": ("x", "template, severity", {"L1": delta, "L2": delta}), "timeline": ("k LEFT JOIN r USING (fingerprint)", f"{_ISO.format('first_ts')}, {service}, fingerprint", line),
        "correlations": ("gt", "confidence DESC, n DESC, ref", {"L1": group, "L2": group}), "hypotheses": ("k", "place", {"L1": guess, "L2": guess}),
    }
    summary = named(
        ("budgetExceeded", f"CASE WHEN required > {BUDGET} THEN 'true' ELSE 'false' END"), ("correlationCoverage", "coverage"), ("infrastructureEventCount", "0"), ("investigationConfidence", "sure"), ("metricAnomalyCount", "0"), ("omittedPatternCount", "patterns - kept"), ("rawEventCount", "n"), ("rawPatternCount", "kept"), ("requiredTokens", "required"), ("retainedPatternCount", "kept"),
    )
    out = f"""{_SNAPSHOT}, gt AS (SELECT ref, n, services, confidence, first_ts, last_ts FROM g JOIN (SELECT concat('CORR-', substr(sha256(concat('request_id', chr(0), value)), 1, 16)) AS ref, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1) USING (ref)),
 z AS (SELECT t.*, (36 + cost + 20 * deltas + 18 * kept + 16 * groups)::BIGINT AS required, round((SELECT count(*) FROM e WHERE concat('CORR-', substr(sha256(concat('request_id', chr(0), value)), 1, 16)) IN (SELECT ref FROM g)) / n, 4)::DOUBLE AS coverage, (SELECT round(sum(confidence * n) / sum(n), 4)::DOUBLE FROM g) AS sure FROM t),
 u0 AS (SELECT {summary} // 4 + {RESERVE} AS used FROM z)"""
    parts = []
    for level, shown in SHOWN.items():
        most, before = dict(zip(SECTIONS, shown)), "u0"
        for kind in SPENDING:
            name = f"{level}_{kind}"
            if kind in tables and most[kind]:
                source, order, size = tables[kind]
                out += f""",
 {name}_rows AS (SELECT sum(greatest(1, size // 4)) OVER (ORDER BY place) AS spent, place FROM (SELECT {size[level]} AS size, row_number() OVER (ORDER BY {order}) AS place FROM {source}) WHERE place <= {most[kind]}),
 {name} AS (SELECT used + coalesce((SELECT max(spent) FROM {name}_rows, {before} b WHERE b.used + spent <= {budget}), 0) AS used, (SELECT count(*) FROM {name}_rows) AS requested, (SELECT count(*) FROM {name}_rows, {before} b WHERE b.used + spent <= {budget}) AS applied, coalesce((SELECT max(spent) FROM {name}_rows, {before} b WHERE b.used + spent <= {budget}), 0) AS budget_spent FROM {before})"""
                parts.append(f"SELECT '{level}' AS level, '{kind}' AS kind, requested::INT AS requested, applied::INT AS applied, budget_spent::INT AS budget_spent, {SECTIONS.index(kind) + 1} AS place FROM {name}")
                before = name
            else:
                parts.append(f"SELECT '{level}' AS level, '{kind}' AS kind, 0 AS requested, 0 AS applied, 0 AS budget_spent, {SECTIONS.index(kind) + 1} AS place")
    return out + " " + " UNION ALL ".join(parts)


@query(_disclosure_sql(2_000))
def disclosure_account(spark, sf_dir):
    """What each level shows of each section within 2,000 tokens."""
    from .disclosure import disclose

    s = _built(spark, sf_dir).to_dict()
    rows = [(level, o["kind"], o["requested"], o["applied"], o["budgetSpent"], place) for level in ("L0", "L1", "L2") for place, o in enumerate(disclose(s, level, 2_000)["state"]["operations"], 1)]
    return spark.createDataFrame(rows, "level string, kind string, requested int, applied int, budget_spent int, place int")


def _answers(spark, sf_dir, key: str, labels: DataFrame, value) -> DataFrame:
    """Recorded answers of a backend, one for each event, as JSON text."""
    return labels.select(F.to_json(F.array(F.struct(F.col("labels").alias(key), F.array(value).alias("values")))).alias("result"))


@query(f"SELECT event_id % 4294967296 AS line, ts, CASE WHEN user_id % 3 = 0 THEN concat('svc-', user_id % 5) WHEN user_id % 3 = 1 THEN concat('job-', user_id % 5) ELSE 'unknown' END AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, concat(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'ok' END, ' event ', event_id) AS message, to_json(cast(user_id AS varchar))::VARCHAR AS user_field, 'Q' AS query_ref FROM events")
def log_backend_lines(spark, sf_dir):
    """Recorded answers of a log backend as events; times in nanoseconds."""
    from ..sources import loki

    e = table(spark, sf_dir, "events")
    third = F.col("user_id") % 3
    labels = F.map_filter(F.create_map(F.lit("app"), F.when(third == 0, F.concat(F.lit("svc-"), F.col("user_id") % 5)), F.lit("job"), F.when(third == 1, F.concat(F.lit("job-"), F.col("user_id") % 5)), F.lit("user"), F.col("user_id").cast("string")), lambda k, v: v.isNotNull())
    line = F.concat(F.when(F.col("event_type") == "error", "ERROR").otherwise("ok"), F.lit(" event "), "event_id")
    nanos = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("789"))
    raw = _answers(spark, sf_dir, "stream", e.withColumn("labels", labels), F.array(nanos, line))
    out = loki.shape(raw, {"source": "loki", "queryRef": "Q", "start": "a", "end": "b"})
    return out.select(F.regexp_extract("message", r"(\d+)$", 1).cast("long").alias("line"), F.col("ts").cast("timestamp_ntz").alias("ts"), "service", "severity", "message", F.col("fields")["user"].alias("user_field"), F.col("evidence.queryRef").alias("query_ref"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'load' ELSE 'unknown_metric' END AS metric, user_id, 0 AS ord, ts, value FROM events")
def metric_backend_samples(spark, sf_dir):
    """Recorded answers of a metric backend as samples."""
    from ..sources import prometheus

    e = table(spark, sf_dir, "events")
    named = F.when(F.col("event_id") % 2 == 0, "load")
    labels = F.map_filter(F.create_map(F.lit("__name__"), named, F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string")), lambda k, v: v.isNotNull())
    seconds = F.format_string("%d.%06d", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"), F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000)))
    out = prometheus.shape(_answers(spark, sf_dir, "metric", e.withColumn("labels", labels), F.array(seconds, F.col("value").cast("string"))))
    return out.select(F.col("labels")["event"].cast("long").alias("event_id"), "metric", F.col("labels")["user"].cast("long").alias("user_id"), "ord", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN concat('ns-', user_id % 4) ELSE 'default' END AS namespace, 'Pod' AS object_kind, CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE concat('pod-', user_id % 4) END AS object_name, event_type AS reason, CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type, CASE WHEN event_type = 'view' THEN '' ELSE concat('event ', event_id) END AS message, event_id % 3 AS count, date_trunc('second', ts) AS ts FROM events")
def cluster_event_rows(spark, sf_dir):
    """Cluster events from JSON, with what is missing filled in."""
    from ..sources import kubernetes

    e = table(spark, sf_dir, "events")
    name = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("pod-"), F.col("user_id") % 4))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    some = F.col("event_id") % 2 == 0
    event = F.struct(
        F.struct(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("ns-"), F.col("user_id") % 4)).alias("namespace")).alias("metadata"), F.struct(F.lit("Pod").alias("kind"), name.alias("name")).alias("involvedObject"), F.col("event_type").alias("reason"),
        F.when(F.col("event_type") == "error", "Warning").alias("type"), F.when(F.col("event_type") != "view", F.concat(F.lit("event "), "event_id")).alias("message"), (F.col("event_id") % 3).alias("count"), F.when(some, when).alias("eventTime"), F.when(~some, when).alias("lastTimestamp"),
    )
    out = kubernetes.shape(e.select(F.col("event_id").alias("seq"), F.to_json(event).alias("event")))
    return out.select("seq", "namespace", "object_kind", "object_name", "reason", "type", "message", "count", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"SELECT event_id, ts, concat('svc-', user_id % 5) AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, concat('say \"', event_type, '\" ', event_id) AS message, cast(user_id AS varchar) AS user_field, concat('Q-', event_type) AS query_ref FROM events")
def json_lines(spark, sf_dir):
    """Events written as JSON lines and read again."""
    from ..sources import jsonl

    e = table(spark, sf_dir, "events")
    line = F.struct(
        T.iso_z(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"), F.when(F.col("event_type") == "error", "ERROR").alias("severity"), F.concat(F.lit('say "'), "event_type", F.lit('" '), "event_id").alias("message"),
        F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("event")).alias("fields"), F.struct(F.lit("loki").alias("source"), F.concat(F.lit("Q-"), "event_type").alias("query_ref"), F.lit("a").alias("start"), F.lit("b").alias("end")).alias("evidence"),
    )
    path = f"{shared_dir(spark)}/tracefold/lines-{uuid.uuid4().hex}"
    e.select(F.to_json(line).alias("value")).write.text(path)
    out = jsonl.read_lines(spark, path)
    return out.select(F.col("fields")["event"].cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "service", "severity", "message", F.col("fields")["user"].alias("user_field"), F.col("evidence.queryRef").alias("query_ref"))


@query("SELECT p_partkey AS ord, p_name AS name, concat('src/', replace(p_brand, '#', '')) AS source, CASE WHEN p_partkey % 2 = 0 THEN concat('L', p_size) END AS location, p_type AS community FROM part")
def code_node_lines(spark, sf_dir):
    """Code nodes from lines of text."""
    p = table(spark, sf_dir, "part")
    place = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" location=L"), "p_size")).otherwise(" location=")
    line = F.concat(F.lit("  NODE "), "p_name", F.lit("  [source=src/"), F.regexp_replace("p_brand", "#", ""), place, F.lit(" junk community="), "p_type", F.lit("] "))
    noise = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("EDGE "), "p_name").alias("value"))
    return signals.code_nodes(p.select(F.col("p_partkey").alias("ord"), line.alias("value")).union(noise)).select("ord", "name", "source", "location", "community")


@query(f"WITH logs AS ({LOGS}), e AS (SELECT *, {_duck_normalized('message')} AS template FROM logs) SELECT {_LP} AS fingerprint, severity, {_RANK.format('severity')} AS severity_rank, severity IN ('FATAL', 'CRITICAL', 'ERROR') AS protected, count(*) AS events FROM e GROUP BY ALL")
def sql_functions(spark, sf_dir):
    """The text functions called by name from SQL."""
    from ..functions import sql

    sql.register(spark)
    logs(spark, sf_dir).createOrReplaceTempView("tracefold_log_lines")
    return spark.sql(
        "SELECT pattern_id(normalize_message(message), canonical_severity(severity)) AS fingerprint, canonical_severity(severity) AS severity, severity_rank(canonical_severity(severity)) AS severity_rank, "
        "is_protected(canonical_severity(severity)) AS protected, count(*) AS events FROM tracefold_log_lines GROUP BY ALL"
    )


def _whole_events(spark, sf_dir) -> DataFrame:
    """Log events with fields and evidence."""
    e = logs(spark, sf_dir)
    fields = F.create_map(F.lit("pod"), F.concat(F.lit('"'), "service", F.lit('-0"')), F.lit("token"), F.lit("1"), F.lit("shard"), (F.col("seq") % 5).cast("string"))
    ref = F.struct(F.lit("loki").alias("source"), F.concat(F.lit("Q-"), "service").alias("queryRef"), F.lit("a").alias("start"), F.lit("b").alias("end"))
    return e.withColumn("fields", fields).withColumn("evidence", ref)


_LINE = f"""concat('{{"evidence":{{"end":"b","query_ref":"Q-', service, '","source":"loki","start":"a"}},"fields":{{"pod":"', service, '-0","shard":', seq % 5, ',"token":"<redacted>"}},"message":', to_json({_duck_normalized('message')})::VARCHAR, ',"service":"', service, '","severity":"', severity, '","timestamp":"', {_ISO.format('ts')}, '"}}')"""


@query(f"WITH logs AS ({LOGS}), l AS (SELECT seq, {_LINE} AS line FROM logs) SELECT seq, length(line) AS size, sha256(line) AS line FROM l")
def canonical_event_lines(spark, sf_dir):
    """Every event as the canonical line that telemetry measures."""
    from .evaluation import canonical_lines

    lines = canonical_lines(_whole_events(spark, sf_dir), keep=["seq"])
    return lines.select("seq", F.length("line").cast("long").alias("size"), F.sha2("line", 256).alias("line"))


_BARE_LINE = _LINE.replace("""{"pod":"', service, '-0","shard":', seq % 5, ',"token":"<redacted>"}""", "{}")
_SPLIT_LINES = f"SELECT sum(length(line) + 1)::BIGINT AS normalized_bytes, sum(greatest(1, length(line) // 4) + 12)::BIGINT AS estimated_tokens, count(*) AS line_count FROM (SELECT {_BARE_LINE} AS line FROM logs WHERE ts <op> '{SPLIT}')"


@query(
    f"""{_SNAPSHOT}, rk AS (SELECT {_RANK.format('severity')} AS k, lag({_RANK.format('severity')}) OVER (ORDER BY ts, seq) AS before FROM i), raw AS ({_SPLIT_LINES.replace('<op>', '>=')}), base AS ({_SPLIT_LINES.replace('<op>', '<')}),
 fresh AS (SELECT {_LP} AS fingerprint FROM x WHERE baseline_count = 0)
 SELECT 'raw_lines' AS figure, line_count::VARCHAR AS value FROM raw UNION ALL SELECT 'raw_bytes', normalized_bytes::VARCHAR FROM raw UNION ALL SELECT 'raw_tokens', estimated_tokens::VARCHAR FROM raw
 UNION ALL SELECT 'baseline_tokens', estimated_tokens::VARCHAR FROM base UNION ALL SELECT 'escalations', count(*)::VARCHAR FROM rk WHERE k > before
 UNION ALL SELECT 'discovered', patterns::VARCHAR FROM t UNION ALL SELECT 'retained', kept::VARCHAR FROM t UNION ALL SELECT 'omitted', (patterns - kept)::VARCHAR FROM t
 UNION ALL SELECT 'rare', count(*)::VARCHAR FROM p WHERE count = 1 UNION ALL SELECT 'rare_retained', count(*)::VARCHAR FROM k WHERE count = 1
 UNION ALL SELECT 'new', count(*)::VARCHAR FROM p WHERE fingerprint IN (SELECT fingerprint FROM fresh) UNION ALL SELECT 'new_retained', count(*)::VARCHAR FROM k WHERE fingerprint IN (SELECT fingerprint FROM fresh)"""
)
def evaluation_report(spark, sf_dir):
    """The figures of an evaluation report."""
    from .evaluation import evaluate
    from .snapshot import Request

    e = _whole_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("fields", F.create_map().cast("map<string,string>"))
    split = F.lit(SPLIT).cast("timestamp")
    x = evaluate(Request("shop", BUDGET, e.where(F.col("ts") >= split), e.where(F.col("ts") < split), 3600, 3600))
    raw, kept = x["rawContext"], x["retention"]
    figures = {
        "raw_lines": raw["lineCount"], "raw_bytes": raw["normalizedBytes"], "raw_tokens": raw["estimatedTokens"], "baseline_tokens": x["baselineContext"]["estimatedTokens"], "escalations": raw["escalations"],
        "discovered": kept["discoveredPatterns"], "retained": kept["retainedPatterns"], "omitted": kept["omittedPatterns"], "rare": kept["rarePatterns"], "rare_retained": kept["rarePatternsRetained"], "new": kept["newPatterns"], "new_retained": kept["newPatternsRetained"],
    }
    return spark.createDataFrame([(k, str(v)) for k, v in figures.items()], "figure string, value string")


@query(
    f"WITH logs AS ({_CORR} SELECT correlation_ref AS target, concat('Cross-service correlation in (''', replace(services, ',', ''', '''), CASE WHEN services LIKE '%,%' THEN ''')' ELSE ''',)' END, ' with ', event_count, ' linked events.') AS statement, "
    "confidence::DOUBLE AS confidence, CASE WHEN confidence >= 0.6 THEN 'supported' ELSE 'unverified' END AS state FROM g"
)
def correlation_hypotheses(spark, sf_dir):
    """Hypotheses from correlation groups."""
    from .disclosure import correlation_hypotheses as hypotheses

    return hypotheses(correlate.correlation_groups(events.enrich(logs(spark, sf_dir))))


@query(
    f"""WITH logs AS ({LOGS}), f AS (SELECT concat('com.shop.Kind', seq % 3, 'Exception') AS kind, concat('at com.shop.Cart.add(Cart.java:<line>)', chr(0), 'at com.shop.Pay.run', CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 2 END, '(Pay.java:<line>)', chr(0), 'Caused by: id=<id> lost') AS frames FROM logs WHERE severity = 'ERROR'),
 g AS (SELECT concat('STACK-', substr(sha256(concat(kind, chr(0), frames)), 1, 16)) AS target, kind, count(*) AS n FROM f GROUP BY kind, frames HAVING count(*) >= 2)
 SELECT target, concat('Exception type ', kind, ' appears ', n, ' times across timeline-similar logs.') AS statement, least(1.0, round(0.4 + n / 20, 2))::DOUBLE AS confidence, CASE WHEN least(1.0, round(0.4 + n / 20, 2)) >= 0.7 THEN 'supported' ELSE 'unverified' END AS state FROM g"""
)
def stack_hypotheses(spark, sf_dir):
    """Hypotheses from repeated stacks."""
    from .disclosure import stack_hypotheses as hypotheses

    return hypotheses(patterns.stack_groups(events.enrich(traces(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
