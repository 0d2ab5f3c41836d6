"""Message templates, redaction, severities, timestamps and ids as native expressions.

Patterns carry (?U), so that words, digits and white space are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The redaction rules in their order, and what each puts in.
REDACTIONS = (
    (r"(?iU)\b(?:authorization|token|secret|password|api[_-]?key)=\S+", "<redacted>"),
    (r"(?iU)\b(?:trace_id|span_id|request_id|correlation_id|session_id)=\S+", "<correlation>"),
    (r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "<redacted>"),
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"(?iU)\b(duration|timeout|latency)=\d+(?:\.\d+)?(?:ms|s|m)?\b", "$1=<duration>"),
    (r"(?iU)\b(order|request_id|session_id|user_id|shard|id)=\d+\b", "$1=<id>"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
)
# Field names that are redacted, and parts of names.
SENSITIVE_KEYS = ("authorization", "cookie", "password", "secret", "token", "access_token", "refresh_token", "api_key", "user_id", "email", "trace_id", "span_id", "request_id", "correlation_id", "session_id")
SENSITIVE_PARTS = ("password", "secret", "token")
# Words that mark a name or a value as secret.
SECRET_WORDS = ("token", "secret", "password", "authorization", "cookie", "apikey", "api_key")
# Severities by rank; unknown ones rank 1.
SEVERITY_RANKS = {"FATAL": 5, "CRITICAL": 4, "ERROR": 3, "WARN": 2, "WARNING": 2, "INFO": 1, "DEBUG": 0}
PROTECTED = ("FATAL", "CRITICAL", "ERROR")

# Line ends, the head of a stack trace, its frames, and (below) the parts of frames and ids that are replaced.
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
_EXCEPTION = r"(?U)^([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:Exception|Error))(?::|$)"
_FRAME = r'(?U)^\s*(?:(?:at\s+|Caused by:).+|File\s+"[^"]+",\s+line\s+\d+)'


def looks_secret(text: str) -> bool:
    return any(word in text.lower() for word in SECRET_WORDS)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_message(c: Column) -> Column:
    """The message with secrets, ids, durations and addresses replaced, white space single."""
    out = strip(c)
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, r"(?U)\s+", " ")


def severity(c: Column) -> Column:
    """Upper case, INFO for what is blank or null."""
    return F.coalesce(F.nullif(strip(F.upper(c)), F.lit("")), F.lit("INFO"))


def severity_rank(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SEVERITY_RANKS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), F.lit(1))


def is_protected(c: Column) -> Column:
    return c.isin(*PROTECTED)


def severity_in_text(c: Column) -> Column:
    """The first severity word of a log line, else INFO."""
    found = F.regexp_extract(c, r"\b(FATAL|CRITICAL|ERROR|WARN|WARNING|INFO|DEBUG|TRACE)\b", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("INFO"))


def iso_z(ts: Column) -> Column:
    """ISO 8601 in UTC with Z; six digits of microseconds only if there are any."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def parse_iso(c: Column) -> Column:
    """A timestamp from text with an offset or Z; null without one."""
    return F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def short_hash(prefix: str, length: int, *parts: Column) -> Column:
    """Prefix and the first hex digits of SHA-256 over the parts with NUL between them."""
    joined = F.concat_ws("\0", *parts) if len(parts) > 1 else parts[0]
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def pattern_id(template: Column, sev: Column) -> Column:
    return short_hash("LP-", 12, sev, template)


def correlation_ref(id_type: Column, value: Column) -> Column:
    return short_hash("CORR-", 16, id_type, value)


def infrastructure_template(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\b[0-9a-f]{8,}\b|\d+", "?"))


def terms(c: Column) -> Column:
    """Lower-cased identifiers of three characters or more."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_.$:-]{2,}"), 0), F.lower)


def _frame(line: Column) -> Column:
    numbered = F.regexp_replace(F.regexp_replace(strip(line), r"(?U)(?<=\.java:)\d+", "<line>"), r"(?U)(?<=line\s)\d+", "<line>")
    return normalize_message(numbered)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stack(message: Column) -> Column:
    """Struct of fingerprint, type, frames (20 at most) and template; null for what is no stack trace."""

    def parts(lines: Column) -> Column:
        head = strip(F.try_element_at(lines, F.lit(1)))
        frames = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(_FRAME))
        return F.struct(head.alias("head"), F.regexp_extract(head, _EXCEPTION, 1).alias("type"), F.transform(frames, _frame).alias("frames"))

    def whole(p: Column) -> Column:
        found = F.struct(
            short_hash("STACK-", 16, p["type"], F.array_join(p["frames"], "\0")).alias("fingerprint"),
            p["type"].alias("type"),
            F.slice(p["frames"], 1, 20).alias("frames"),
            F.regexp_replace(normalize_message(p["head"]), r"(?U)\b\d{2,}\b", "<id>").alias("template"),
        )
        return F.when((p["type"] != "") & (F.size(p["frames"]) > 0), found)

    # one line cannot be a stack, and most messages have one
    lines = F.filter(F.split(message, _LINE_ENDS), lambda x: x.rlike(r"(?U)\S"))
    return F.when(message.rlike(_LINE_ENDS), _let(_let(lines, parts), whole))


def template(message: Column, stack_column: Column) -> Column:
    return F.coalesce(stack_column["template"], normalize_message(message))


# The id fields that link events.
CORRELATION_KEYS = ("trace_id", "correlation_id", "request_id", "session_id")


def correlation_ids(message: Column, fields: Column | None = None) -> Column:
    """Array of (id_type, value): a field wins over the message's first mention."""
    out = []
    for key in CORRELATION_KEYS:
        said = F.nullif(F.regexp_extract(message, rf"(?iU)\b{key}=([A-Za-z0-9._:-]{{2,256}})", 1), F.lit(""))
        if fields is not None:
            named = F.filter(F.map_entries(fields), _named(key))
            plain = F.nullif(F.substring(strip(unquoted(F.try_element_at(named, F.lit(-1))["value"])), 1, 256), F.lit(""))
            said = F.coalesce(plain, said)
        out.append(F.struct(F.lit(key).alias("id_type"), said.alias("value")))
    return F.filter(F.array(*out), lambda x: x["value"].isNotNull())


def _named(key: str):
    return lambda e: F.regexp_replace(F.lower(e["key"]), "-", "_") == F.lit(key)


def unquoted(json_scalar: Column) -> Column:
    """Text of a JSON scalar; null for null."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), json_scalar, F.lit("}")), "$.v")
    return F.when(json_scalar != "null", text)


def sanitized(fields: Column) -> Column:
    """Fields as JSON scalars, sensitive ones redacted, texts normalised, nested values dropped."""
    name = lambda k: F.regexp_replace(F.lower(k), "-", "_")
    secret = lambda k: name(k).isin(*SENSITIVE_KEYS) | name(k).rlike("|".join(SENSITIVE_PARTS))
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    kept = F.map_filter(fields, lambda k, v: secret(k) | ~v.rlike(r"^\s*[\[{]"))
    return F.transform_values(kept, lambda k, v: F.when(secret(k), F.lit('"<redacted>"')).when(v.startswith('"'), quoted(normalize_message(unquoted(v)))).otherwise(v))
