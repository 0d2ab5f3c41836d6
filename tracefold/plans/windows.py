"""Incident windows, dashboard links and a cache for query results: host-side helpers."""

from __future__ import annotations

import copy
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from typing import Any
from urllib.parse import urlencode, urlparse

from ..functions import text as T



def utc(value: datetime) -> datetime:
    if value.tzinfo is None:
        raise ValueError("timestamps must be timezone-aware")
    return value.astimezone(timezone.utc)


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime
    scope: str
    revision: str = ""

    def __post_init__(self):
        if utc(self.end) <= utc(self.start):
            raise ValueError("window end must be after start")


def around_alert(starts: datetime, ends: datetime | None, labels: Mapping[str, str], fingerprint: str, before=timedelta(minutes=15), after=timedelta(minutes=15), most=timedelta(hours=2)) -> Window:
    """The alert's time with a margin; beyond ``most``, that much about its middle."""
    a, b = utc(starts), utc(ends or starts)
    window = (a - before, b + after)
    if window[1] - window[0] > most:
        middle = a + (b - a) / 2
        window = (middle - most / 2, middle + most / 2)
    scope = next((labels[k] for k in ("namespace", "service", "app") if labels.get(k)), fingerprint)
    return Window(*window, scope, labels.get("revision") or labels.get("version") or "")


def expanded(w: Window, step: timedelta, most: timedelta, back: int = 0, forward: int = 0) -> Window:
    """The window grown by steps; what exceeds ``most`` is taken back from both sides in proportion."""
    if step <= timedelta(0) or most <= timedelta(0):
        raise ValueError("step and maximum must be positive")
    if back < 0 or forward < 0:
        raise ValueError("expansion steps must be non-negative")
    start, end = w.start - step * back, w.end + step * forward
    if (over := end - start - most) > timedelta(0):
        if not back + forward:
            raise ValueError("existing window exceeds hard maximum")
        start, end = start + over * (back / (back + forward)), end - over * (forward / (back + forward))
    return replace(w, start=start, end=min(end, start + most))


def before_baseline(start: datetime, end: datetime, minutes: int) -> tuple[datetime, datetime]:
    """A window of the same length that ends ``minutes`` before the start."""
    if minutes < 1:
        raise ValueError("baseline minutes must be positive")
    last = start - timedelta(minutes=minutes)
    return last - (end - start), last


def dashboard(base_url: str, uid: str, evidence: dict, panel: int | None = None, org: int | None = None, variables: Mapping[str, str] | None = None, start: datetime | None = None, end: datetime | None = None) -> dict:
    """A dashboard reference in wire form; variables that look secret are left out."""
    url = urlparse(base_url)
    if url.scheme not in ("http", "https") or not url.netloc:
        raise ValueError("dashboard base URL must be absolute http or https")
    if url.username or url.password:
        raise ValueError("dashboard URL credentials are not allowed")
    safe = {str(k): str(v) for k, v in sorted((variables or {}).items()) if not T.looks_secret(str(k)) and not T.looks_secret(str(v))}
    params = ({"orgId": str(org)} if org is not None else {}) | {f"var-{k}": v for k, v in safe.items()}
    params |= {k: str(int(utc(t).timestamp() * 1000)) for k, t in (("from", start), ("to", end)) if t}
    if panel is not None:
        params["viewPanel"] = str(panel)
    query = f"?{urlencode(params)}" if params else ""
    return {"dashboardUid": uid, "panelId": panel, "url": f"{url.scheme}://{url.netloc}/d/{uid}{query}", "variables": safe, "evidence": evidence}


def redacted(value: Any) -> Any:
    """A copy in which values under secret-looking keys are hidden, at any depth."""
    if isinstance(value, Mapping):
        return {k: "[REDACTED]" if T.looks_secret(str(k)) else redacted(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(redacted(v) for v in value)
    return copy.deepcopy(value)


class Cache:
    """Least recently used results with a time to live; values are redacted and copied."""

    def __init__(self, seconds: float, most: int = 128, clock: Callable[[], float] = time.monotonic):
        if seconds <= 0 or most < 1:
            raise ValueError("cache time and size must be positive")
        self.seconds, self.most, self.clock = seconds, most, clock
        self._held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    @staticmethod
    def key(source: str, query: str, window: Window, scope: str | None = None, revision: str | None = None) -> tuple[str, ...]:
        """What a query's result is held under; scope and revision are the window's unless given."""
        iso = lambda t: utc(t).isoformat().replace("+00:00", "Z")
        return source, query, iso(window.start), iso(window.end), scope or window.scope, window.revision if revision is None else revision

    @property
    def telemetry(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions}

    def get(self, key: Hashable) -> Any:
        found = self._held.get(key)
        if found and found[0] > self.clock():
            self.hits += 1
            self._held.move_to_end(key)
            return copy.deepcopy(found[1])
        self.misses += 1
        if found:
            self.evictions += 1
            del self._held[key]
        return None

    def set(self, key: Hashable, value: Any) -> None:
        self._held.pop(key, None)
        self._held[key] = (self.clock() + self.seconds, redacted(value))
        while len(self._held) > self.most:
            self._held.popitem(last=False)
            self.evictions += 1
