"""Life of a task: what a precheck leaves behind, and the states of an execution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from .control import run_lock
from .precheck import passed

#: Kinds of task that run as a stream.
STREAMS = ("cdc", "full_cdc")
#: Results of a precheck with which a task doesn't run.
UNCHECKED = ("pending", "failed")


class Paused(Exception):
    """Raised by work that was asked to pause; it goes on from its checkpoints."""


@dataclass
class Task:
    id: int
    name: str = ""
    kind: str = "full"
    enabled: bool = False
    validation: str = "pending"
    runtime_status: str = "stopped"
    last_run_status: str = ""
    message: str = ""
    last_run_at: datetime | None = None
    last_success_at: datetime | None = None
    rows_processed: int = 0
    rows_per_second: float = 0.0
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)  # table -> (source key, target key)
    checkpoints: dict[str, object] = field(default_factory=dict)


def conclude_precheck(task: Task, items: list[tuple], keys: dict[str, tuple[str, str]]) -> bool:
    """A pass stores the tables' keys and enables the task, a failure disables it and stores nothing. The runtime status stays as it is."""
    task.enabled = good = passed(items)
    task.validation = "passed" if good else "failed"
    if good:
        task.keys |= keys
    return good


def execute(
    task: Task,
    work: Callable[[Task], int],
    stream: Callable[[Task], object] | None = None,
    reachable: Callable[[Task], None] = lambda task: None,
    record: Callable[[str, str, str, int, int], None] = lambda event, status, message, rows, milliseconds: None,
    resolve: Callable[[int, str], None] = lambda task_id, kind: None,
    now: Callable[[], datetime] = datetime.now,
) -> object:
    """Run a task: streams are started, others run to their end. Returns what `stream` gives, or the rows that `work` wrote (None if it paused).

    Refused before anything changes: a task that runs, is disabled or has not passed its precheck, or whose ends `reachable` finds amiss (it
    raises). A full run starts without checkpoints. A pause is a success that goes on later; any other exception fails the task and is raised
    again. A success resolves the task's alerts of errors and delay. `record` writes the event log.
    """
    if task.kind in STREAMS:
        if stream is None:
            raise ValueError(f"a task of kind {task.kind} runs as a stream")
        return stream(task)
    with run_lock(task.id):
        if not task.enabled:
            raise RuntimeError(f"task {task.id} is disabled")
        if task.validation in UNCHECKED:
            raise RuntimeError(f"task {task.id} has not passed its precheck")
        reachable(task)
        if task.kind == "full":
            task.checkpoints.clear()
        began = task.last_run_at = now()
        task.last_run_status, task.runtime_status = "running", "initializing"
        record("snapshot_started", "running", "", 0, 0)
        took = lambda: round((now() - began).total_seconds() * 1000)
        try:
            rows = work(task)
        except Paused:
            task.last_run_status = task.runtime_status = "paused"
            task.message = "paused"
            record("snapshot_run", "success", task.message, 0, took())
            return None
        except Exception as e:
            task.last_run_status = task.runtime_status = "failed"
            task.message = str(e)
            record("snapshot_run", "failed", task.message, 0, took())
            raise
        spent = took()
        task.last_run_status, task.runtime_status, task.last_success_at = "success", "completed", now()
        task.rows_processed, task.rows_per_second = rows, rows * 1000 / spent if spent > 0 else 0.0
        task.message = f"{rows} rows"
        record("snapshot_run", "success", task.message, rows, spent)
        record("snapshot_completed", "success", "", rows, spent)
        for kind in ("error", "delay"):
            resolve(task.id, kind)
        return rows
