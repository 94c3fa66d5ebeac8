"""Control functions that need no data: schedules, delay, alert state, run locks, labels."""

from __future__ import annotations

import re
import threading
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, tzinfo
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a state is called; anything else is stopped.
LABELS = {"pending": "pending", "initializing": "initializing", "catching_up": "catching up", "cdc_running": "running", "paused": "paused", "completed": "completed", "failed": "failed", "stopped": "stopped"}
#: Hours after the first alert at which it is repeated, then never.
REPEATS = (0, 1, 3, 6)


def schedule_spec(kind: str, minutes: int = 0, cron: str = "") -> str:
    """What a scheduler is given: `@every 5m`, the cron text, or nothing for manual runs."""
    if kind == "interval":
        if minutes <= 0:
            raise ValueError("an interval has at least one minute")
        return f"@every {minutes}m"
    if kind == "cron":
        if not cron.strip():
            raise ValueError("a cron schedule needs its text")
        return cron.strip()
    if kind == "manual":
        return ""
    raise ValueError(f"no such schedule: {kind}")


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        else:
            first, dash, last = span.partition("-")
            a = int(first)
            b = int(last) if dash else (high if step else a)
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"out of range: {text}")
        out |= set(range(a, b + 1, int(step) if step else 1))
    return out


def next_runs(cron: str, after: datetime, count: int = 1) -> list[datetime]:
    """Next times of a five-field cron text (minute, hour, day, month, weekday; Sunday 0 or 7)."""
    fields = cron.split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    minute, hour, day, month = (_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12)), strict=False))
    weekday = {d % 7 for d in _field(fields[4], 0, 7)}
    any_day, any_week = fields[2] in ("*", "?"), fields[4] in ("*", "?")
    out, t = [], after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    stop = t + timedelta(days=366 * 8)
    while len(out) < count and t < stop:
        d, w = t.day in day, (t.weekday() + 1) % 7 in weekday
        if t.month not in month or not ((d and w) if any_day or any_week else (d or w)):
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        elif t.hour not in hour:
            t = t.replace(minute=0) + timedelta(hours=1)
        elif t.minute not in minute:
            t += timedelta(minutes=1)
        else:
            out.append(t)
            t += timedelta(minutes=1)
    return out


def current_delay(sync_type: str, runtime_status: str, delay_seconds: int) -> int:
    """The delay that counts: that of a running stream."""
    return delay_seconds if sync_type != "full" and runtime_status in ("cdc_running", "catching_up") else 0


@dataclass(frozen=True)
class AlertState:
    """Since when a task is above its threshold, and how many alerts it has sent since."""

    since: datetime | None = None
    sent: int = 0


def alert_step(state: AlertState, now: datetime, delay: int, threshold: int) -> tuple[AlertState, str | None]:
    """(new state, 'alert', 'recovered' or None). Alerts go out at once and after 1, 3 and 6 hours, then no more until recovery."""
    if threshold <= 0 or delay < threshold:
        return AlertState(), "recovered" if state.sent else None
    since = state.since or now
    if state.sent < len(REPEATS) and now - since >= timedelta(hours=REPEATS[state.sent]):
        return AlertState(since, state.sent + 1), "alert"
    return replace(state, since=since), None


def robot_key(text: str) -> str:
    """A bot's id, given plainly or as its webhook address with a `key`."""
    text = text.strip()
    if "://" in text:
        found = parse_qs(urlparse(text).query).get("key", [""])[0].strip()
        if not found:
            raise ValueError("the address has no key")
        return found
    if not text or any(c in text for c in "&=?/ "):
        raise ValueError("not a bot id")
    return text


def masked(column: Column) -> Column:
    """First and last four characters; short texts are hidden whole."""
    return F.when(F.length(column) > 8, F.concat(F.left(column, F.lit(4)), F.lit("****"), F.right(column, F.lit(4)))).otherwise(F.lit("****"))


def runtime_label(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), F.lit(LABELS["stopped"]))


_locks: dict[int, threading.Lock] = {}
_guard = threading.Lock()


@contextmanager
def run_lock(task: int):
    """One run a task at a time; a second one is refused."""
    with _guard:
        lock = _locks.setdefault(task, threading.Lock())
    if not lock.acquire(blocking=False):
        raise RuntimeError(f"task {task} is running")
    try:
        yield
    finally:
        lock.release()


def memory_bytes(text: str) -> int:
    """A size with a suffix: 512m, 4GiB, 1000."""
    text = text.strip().lower().removesuffix("ib").removesuffix("b")
    power = {"k": 1, "m": 2, "g": 3, "t": 4}.get(text[-1:], 0)
    number = float(text[:-1] if power else text)
    if number <= 0:
        raise ValueError("a size is above zero")
    return int(number * 1024**power)


#: Layouts of times that a caller may give besides RFC 3339, for metrics and for repair.
METRIC_TIMES = ("%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S")
REPAIR_TIMES = ("%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S")
_RFC3339 = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)\Z")


def _given_time(text: str, layouts: tuple[str, ...], zone: tzinfo | None) -> datetime:
    if _RFC3339.match(text):
        return datetime.fromisoformat(text)
    for layout in layouts:
        try:
            found = datetime.strptime(text, layout)
        except ValueError:
            continue
        return found.replace(tzinfo=zone) if zone else found.astimezone()
    raise ValueError(f"not a time: {text}")


def metric_time(text: str, zone: tzinfo | None = None) -> datetime | None:
    """A bound of a metric query; nothing for an empty text. Times without an offset are in `zone`, the local one by default."""
    return _given_time(text.strip(), METRIC_TIMES, zone) if text.strip() else None


def repair_time(text: str, zone: tzinfo | None = None) -> datetime:
    """A bound of a repair; it has to be given."""
    return _given_time(text, REPAIR_TIMES, zone)
