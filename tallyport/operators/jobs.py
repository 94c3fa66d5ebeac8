"""Compare and repair jobs: one a task at a time, cancelled through Spark's operation tags."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession

#: States of a job.
RUNNING, CANCELING, CANCELED, SUCCESS, FAILED = "running", "canceling", "canceled", "success", "failed"


@dataclass
class Job:
    task: int
    kind: str
    status: str = RUNNING
    message: str = ""
    result: object = None
    started: datetime = field(default_factory=datetime.now)
    finished: datetime | None = None
    tag: str = field(default_factory=lambda: f"tallyport-{uuid.uuid4().hex}")
    thread: threading.Thread | None = None


class Jobs:
    """Runs work in threads of their own; all Spark jobs that a work starts carry its tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._jobs: list[Job] = []

    def start(self, task: int, kind: str, work: Callable[[], object]) -> Job:
        """A second job of a running task is refused."""
        with self._lock:
            if any(j.task == task and j.status in (RUNNING, CANCELING) for j in self._jobs):
                raise RuntimeError(f"task {task} has a running job")
            job = Job(task, kind)
            self._jobs.append(job)
        job.thread = threading.Thread(target=self._run, args=(job, work), daemon=True)
        job.thread.start()
        return job

    def _run(self, job: Job, work: Callable[[], object]) -> None:
        context = self.spark.sparkContext
        context.addJobTag(job.tag)
        try:
            job.result = work()
            job.status = CANCELED if job.status == CANCELING else SUCCESS
        except Exception as e:
            job.status = CANCELED if job.status == CANCELING else FAILED
            job.message = str(e)[:500]
        finally:
            context.removeJobTag(job.tag)
            job.finished = datetime.now()

    def cancel(self, job: Job) -> None:
        if job.status == RUNNING:
            job.status = CANCELING
            self.spark.sparkContext.cancelJobsWithTag(job.tag)

    def newest(self, task: int, count: int = 10) -> list[Job]:
        return [j for j in reversed(self._jobs) if j.task == task][:count]
