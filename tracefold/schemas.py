"""Schemas of the tables that operators read."""

from __future__ import annotations

EVIDENCE = "struct<source:string,queryRef:string,start:string,end:string>"
#: fields hold JSON scalars as text, so that their types survive.
EVENTS = f"seq bigint, ts timestamp, service string, severity string, message string, fields map<string,string>, evidence {EVIDENCE}"
SAMPLES = "series bigint, metric string, labels map<string,string>, ord int, ts timestamp, value double"
INFRASTRUCTURE = "namespace string, object_kind string, object_name string, reason string, type string, message string, count bigint, ts timestamp, seq bigint"
