"""Turn user-facing parameter text into Python values on the driver (never per row)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

# Units of duration and size text.
DURATION_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
SIZE_BYTES = {"": 1, "B": 1, "KB": 2**10, "MB": 2**20, "GB": 2**30, "TB": 2**40}
FAULT_TYPES = ("error-spike", "service-down", "latency-spike")
ALERT_METRICS = ("logs_dropped", "drop_rate", "disk_pct", "logs_received")
ALERT_OPS = ("gt", "lt", "gte", "lte")


def parse_duration(text: str) -> timedelta:
    """``1h30m``, ``250ms``, ``1.5s``."""
    text = text.strip()
    units = "|".join(sorted(DURATION_SECONDS, key=len, reverse=True))
    if not re.fullmatch(rf"(?:\d+\.?\d*(?:{units}))+", text):
        raise ValueError(f"invalid duration {text!r}")
    return timedelta(seconds=sum(
        float(n) * DURATION_SECONDS[u] for n, u in re.findall(rf"(\d+\.?\d*)({units})", text)))


def parse_age(text: str) -> timedelta:
    """A duration, or days such as ``7d``."""
    text = text.strip().lower()
    if text.endswith("d"):
        try:
            return timedelta(days=float(text[:-1]))
        except ValueError:
            raise ValueError(f"invalid day duration {text!r}") from None
    return parse_duration(text)


def parse_size(text: str) -> int:
    """``50GB``, ``1.5 MB``, ``100``."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(KB|MB|GB|TB|B)?", text.strip(), re.IGNORECASE)
    if not m:
        raise ValueError(f"invalid size {text!r}")
    return int(float(m[1]) * SIZE_BYTES[(m[2] or "").upper()])


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def _instant(text: str) -> datetime | None:
    if not re.match(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", text):
        return None
    # Python keeps microseconds, so drop finer digits.
    text = re.sub(r"(\.\d{6})\d+", r"\1", text)
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return _utc(t) if t.tzinfo else None


def parse_time(text: str, ref_date: datetime, ref_time: datetime) -> datetime | None:
    """Full timestamp, ``HH:MM`` on the reference date, or ``-30m`` before the reference time."""
    text = text.strip()
    if not text:
        return None
    if (t := _instant(text)) is not None:
        return t
    if re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", text):
        return _utc(ref_date).replace(hour=int(text[:2]), minute=int(text[3:]), second=0, microsecond=0)
    if text.startswith("-"):
        return _utc(ref_time) - parse_duration(text[1:])
    raise ValueError(f"unrecognized time {text!r}")


def parse_slice_time(text: str, now: datetime) -> datetime:
    """The slice variant: everything relative is relative to now, and ``30m`` means 30m ago."""
    if (t := _instant(text)) is not None:
        return t
    if re.fullmatch(r"\d{1,2}:\d{2}", text):
        return parse_time(text.zfill(5), now, now)
    try:
        return _utc(now) - parse_duration(text.removeprefix("-"))
    except ValueError:
        raise ValueError(f"unsupported time {text!r}") from None


def parse_label(text: str) -> tuple[str, str]:
    key, sep, value = text.partition("=")
    if not sep or not key:
        raise ValueError(f"invalid label filter {text!r}: expected key=value")
    return key, value


@dataclass(frozen=True)
class Fault:
    type: str
    service: str | None = None
    at: datetime | None = None
    duration: timedelta = timedelta(0)


def parse_fault(text: str, at: datetime | None = None, duration: timedelta = timedelta(0)) -> Fault:
    """``error-spike``, ``service-down=<service>``, ``latency-spike=<service>``."""
    kind, sep, service = text.partition("=")
    if kind not in FAULT_TYPES:
        raise ValueError(f"unknown fault type {kind!r}")
    if kind == "error-spike":
        if sep:
            raise ValueError("error-spike takes no service")
        return Fault(kind, None, at, duration)
    if not service:
        raise ValueError(f"{kind} needs a service: {kind}=<service>")
    return Fault(kind, service, at, duration)


def parse_redact(text: str) -> tuple[bool, list[str]]:
    """Empty = off; ``true`` = all patterns; ``a,b`` = those patterns."""
    if not text:
        return False, []
    if text == "true":
        return True, []
    return True, [p.strip() for p in text.split(",")]


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    op: str
    threshold: float
    detail: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("alert rule without a name")
        if self.metric not in ALERT_METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.op not in ALERT_OPS:
            raise ValueError(f"unknown operator {self.op!r}")
