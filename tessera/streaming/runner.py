"""Control of a batch: start, pause, cancel one job or all. Jobs are Spark work under a tag of their own."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Runner:
    """Takes the next job from ``take`` (None: none waits) and runs ``work`` on it, ``workers`` jobs at once, one during the first
    ``soft`` seconds. ``done`` hears (job, status, message): completed, failed or cancelled. A failing job ends itself only."""

    def __init__(self, spark: SparkSession, take: Callable[[], str | None], work: Callable[[str], None], done: Callable[[str, str, str], None], workers: int = 2, soft: float = 8.0):
        self.spark, self.take, self.work, self.done, self.workers, self.soft = spark, take, work, done, workers, soft
        self.active: dict[str, threading.Thread] = {}
        self.cancelled: set[str] = set()
        self.lock, self.going, self.loop = threading.Lock(), threading.Event(), None

    def start(self) -> None:
        """Begin to schedule; nothing happens if it has begun."""
        with self.lock:
            if self.loop is not None and self.loop.is_alive():
                return
            self.going.set()
            self.loop = threading.Thread(target=self._schedule, daemon=True)
            self.loop.start()

    def pause(self) -> None:
        """Stop to schedule; jobs that run go on."""
        self.going.clear()
        if self.loop is not None:
            self.loop.join()

    def cancel(self, job: str) -> None:
        with self.lock:
            if job not in self.active:
                return
            self.cancelled.add(job)
        self.spark.sparkContext.cancelJobsWithTag(self._tag(job))

    def cancel_all(self) -> None:
        with self.lock:
            jobs = list(self.active)
        for job in jobs:
            self.cancel(job)

    @staticmethod
    def _tag(job: str) -> str:
        return "job-" + "".join(x if x.isalnum() else "_" for x in job)

    def _schedule(self) -> None:
        began = time.monotonic()
        while self.going.is_set():
            most = 1 if time.monotonic() - began < self.soft else self.workers
            with self.lock:
                free = len(self.active) < most
            job = self.take() if free else None
            if job is None:
                time.sleep(0.05)
                continue
            thread = InheritableThread(target=self._run, args=(job,), daemon=True)
            with self.lock:
                self.active[job] = thread
            thread.start()

    def _run(self, job: str) -> None:
        self.spark.sparkContext.addJobTag(self._tag(job))
        status, message = "completed", ""
        try:
            self.work(job)
        except Exception as problem:  # whatever a job raises is the job's
            status, message = "failed", str(problem)[:200]
        finally:
            self.spark.sparkContext.removeJobTag(self._tag(job))
        with self.lock:
            self.active.pop(job, None)
            status = "cancelled" if job in self.cancelled and status == "failed" else status
            self.cancelled.discard(job)
        self.done(job, status, message)
