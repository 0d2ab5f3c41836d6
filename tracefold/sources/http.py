"""JSON over HTTP for the log and metric backends, with bounds before and after the call."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlencode, urlparse
from urllib.request import Request, urlopen

#: (url, headers, seconds, bytes) -> a JSON object.
Transport = Callable[[str, Mapping[str, str], float, int], dict]


@dataclass(frozen=True)
class Limits:
    """Bounds of a scan."""

    window: timedelta = timedelta(hours=6)
    lines: int = 500
    points: int = 2_000
    seconds: float = 10.0
    response_bytes: int = 5_000_000


def get_json(url: str, headers: Mapping[str, str], seconds: float, most: int) -> dict:
    with urlopen(Request(url, headers=dict(headers)), timeout=seconds) as answer:
        body = answer.read(most + 1)
    if len(body) > most:
        raise ValueError("response exceeds the configured maximum")
    out = json.loads(body)
    if not isinstance(out, dict):
        raise ValueError("response is not a JSON object")
    return out


class Backend:
    """A base URL with transport, limits and headers; the same checks for every scan."""

    name = ""

    def __init__(self, base_url: str, transport: Transport = get_json, limits: Limits = Limits(), headers: Mapping[str, str] | None = None):
        url = urlparse(base_url)
        if url.scheme not in ("http", "https") or not url.netloc:
            raise ValueError("base URL must be absolute http or https")
        if url.username or url.password:
            raise ValueError("credentials are not allowed in the URL")
        self.base, self.transport, self.limits, self.headers = base_url.rstrip("/"), transport, limits, dict(headers or {})

    def check_window(self, start: datetime, end: datetime) -> None:
        if start.tzinfo is None or end.tzinfo is None:
            raise ValueError("query window must be timezone-aware")
        if end <= start:
            raise ValueError("query end must be after start")
        if end - start > self.limits.window:
            raise ValueError("query window exceeds configured maximum")

    def fetch(self, path: str, params: Mapping[str, str]) -> tuple[str, list]:
        """The query's reference and the result list."""
        digest = hashlib.sha256(f"{self.name}\0{path}\0{urlencode(sorted(params.items()))}".encode()).hexdigest()[:16]
        answer = self.transport(f"{self.base}{path}?{urlencode(params)}", self.headers, self.limits.seconds, self.limits.response_bytes)
        if answer.get("status") != "success":
            raise RuntimeError(f"{self.name} query failed")
        result = (answer.get("data") or {}).get("result", [])
        if not isinstance(result, list):
            raise RuntimeError(f"{self.name} query returned an invalid result")
        return f"{self.name.upper()}-{digest}", result


def iso(value: datetime) -> str:
    return value.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def observation(source: str, ref: str, scanned: int, retained: int, reason: str | None) -> dict:
    return {"source": source, "queryRef": ref, "complete": reason is None, "incompleteReason": reason, "queryCount": 1, "scannedItems": scanned, "retainedItems": retained}
