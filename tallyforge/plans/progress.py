"""Runs that tell how far they are, how long they will take, and that can be called off.

All Spark jobs that a run starts carry its tag: their stages are its progress, and calling off the tag ends them wherever they are.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import SparkSession

ENOUGH = 2  # finished tasks before a time is estimated


@dataclass
class Progress:
    state: str  # running, done, failed, cancelled
    jobs: int
    tasks: int
    finished: int
    seconds: float
    remaining: float | None  # of the stages known so far


class Cancelled(RuntimeError):
    """The run was called off."""


def estimate(finished: int, tasks: int, seconds: float) -> float | None:
    """Seconds that the rest takes at the pace so far; null while too little is finished."""
    return seconds * (tasks - finished) / finished if finished >= ENOUGH else None


class Run:
    """``work`` in a thread of its own; ``result`` waits for it."""

    def __init__(self, spark: SparkSession, work: Callable[[], object]):
        self.spark, self.context, self.tag = spark, spark.sparkContext, f"tallyforge-{uuid.uuid4().hex}"
        self.began, self.ended, self.off = time.monotonic(), None, threading.Event()
        self.value: object = None
        self.error: BaseException | None = None
        self.thread = InheritableThread(target=self._run, args=(work,), session=spark)
        self.thread.start()

    def _run(self, work: Callable[[], object]) -> None:
        self.context.addJobTag(self.tag)
        try:
            self.value = work()
        except BaseException as error:  # noqa: BLE001  told by ``result``
            self.error = error
        finally:
            self.ended = time.monotonic()
            self.context.removeJobTag(self.tag)

    def progress(self) -> Progress:
        tracker = self.context._jsc.sc().statusTracker()
        jobs = list(tracker.getJobIdsForTag(self.tag))
        infos = [i.get() for i in (tracker.getJobInfo(j) for j in jobs) if i.isDefined()]
        stages = {s for i in infos for s in i.stageIds()}
        known = [i.get() for i in (tracker.getStageInfo(s) for s in stages) if i.isDefined()]
        tasks, finished = sum(s.numTasks() for s in known), sum(s.numCompletedTasks() for s in known)
        if self.ended is None:
            state = "running"
        else:
            state = "done" if self.error is None else "cancelled" if self.off.is_set() else "failed"
        seconds = (self.ended or time.monotonic()) - self.began
        return Progress(state, len(jobs), tasks, finished, seconds, estimate(finished, tasks, seconds) if state == "running" else None)

    def cancel(self) -> None:
        """End the run's jobs, and those that it goes on to start, until it is over."""
        self.off.set()
        while self.thread.is_alive():
            self.context.cancelJobsWithTag(self.tag)
            self.thread.join(0.2)

    def result(self, timeout: float | None = None):
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError
        if self.error is not None:
            if self.off.is_set():
                raise Cancelled(self.tag) from self.error
            raise self.error
        return self.value
