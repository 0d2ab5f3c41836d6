"""The text functions by name in SQL: ``register(spark)``, then ``select normalize_message(message) from ...``.

They are SQL functions over built-in ones, so plans made of them are the same as
those of the Column functions in ``text``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normalized(argument: str) -> str:
    out = f"regexp_replace({argument}, {_literal(r'(?U)^\s+|\s+$')}, '')"
    for pattern, replacement in T.REDACTIONS:
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(replacement)})"
    return f"regexp_replace({out}, {_literal(r'(?U)\s+')}, ' ')"


def _ranked(argument: str) -> str:
    cases = " ".join(f"WHEN {_literal(k)} THEN {v}" for k, v in T.SEVERITY_RANKS.items())
    return f"CASE {argument} {cases} ELSE 1 END"


#: Name, parameters, type and body.
FUNCTIONS = (
    ("normalize_message", "m STRING", "STRING", _normalized("m")),
    ("canonical_severity", "s STRING", "STRING", f"coalesce(nullif(regexp_replace(upper(s), {_literal(r'(?U)^\s+|\s+$')}, ''), ''), 'INFO')"),
    ("severity_rank", "s STRING", "INT", _ranked("s")),
    ("is_protected", "s STRING", "BOOLEAN", f"s IN ({', '.join(map(_literal, T.PROTECTED))})"),
    ("pattern_id", "template STRING, severity STRING", "STRING", "concat('LP-', substring(sha2(concat(severity, char(0), template), 256), 1, 12))"),
    ("correlation_ref", "id_type STRING, id_value STRING", "STRING", "concat('CORR-', substring(sha2(concat(id_type, char(0), id_value), 256), 1, 16))"),
    ("infrastructure_template", "m STRING", "STRING", f"regexp_replace(regexp_replace(m, {_literal(r'(?U)\b[0-9a-f]{8,}\b|\d+')}, '?'), {_literal(r'(?U)^\s+|\s+$')}, '')"),
)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, under their own names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
