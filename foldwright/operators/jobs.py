"""Work on the folds of a trial: several at once, in order of the folds, and stopped as a whole."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds to wait for threads to end once their jobs are cancelled; a thread that does not is left behind, unheard.
GRACE = 20.0


class TrialTimeout(Exception):
    """A trial took longer than it may."""


class FoldRun:
    """Results of ``work(0)`` to ``work(n - 1)`` in this order, with up to ``at_once`` folds under way.

    Each thread's Spark jobs are of the group ``group``, so that a trial can be stopped as a whole, and of a pool of the
    thread's own, so that a session with fair scheduling shares its cores among the folds. No fold begins before the one
    ``at_once`` places earlier was taken by the caller: with one at a time, a caller that stops after a fold has paid for
    none beyond it. Leaving the loop, by whatever way, cancels what is still under way.
    """

    def __init__(self, spark: SparkSession, group: str, n: int, work: Callable[[int], Any], at_once: int = 1, timeout: float | None = None):
        if at_once < 1:
            raise ValueError("at least one fold must run at a time")
        self.context, self.group, self.n, self.work, self.at_once = spark.sparkContext, group, n, work, at_once
        self.until = None if timeout is None else time.monotonic() + timeout
        self.changed, self.done = threading.Condition(), {}
        self.begun, self.taken, self.stopped = 0, 0, False
        self.threads = [InheritableThread(target=self._run, args=(slot,), daemon=True) for slot in range(min(at_once, n))]

    def _next(self) -> int | None:
        with self.changed:
            while not self.stopped and self.begun < self.n and self.begun >= self.taken + self.at_once:
                self.changed.wait()
            if self.stopped or self.begun >= self.n:
                return None
            self.begun += 1
            return self.begun - 1

    def _run(self, slot: int) -> None:
        self.context.setLocalProperty("spark.scheduler.pool", f"fold-{slot}")
        self.context.setJobGroup(self.group, f"{self.group}, thread {slot}", interruptOnCancel=True)
        while (i := self._next()) is not None:
            try:
                found = (True, self.work(i))
            except BaseException as e:  # noqa: BLE001  the caller gets it
                found = (False, e)
            with self.changed:
                self.done[i] = found
                self.changed.notify_all()

    def __iter__(self) -> Iterator[Any]:
        for t in self.threads:
            t.start()
        try:
            for i in range(self.n):
                with self.changed:
                    self.taken = i
                    self.changed.notify_all()
                    while i not in self.done:
                        left = None if self.until is None else self.until - time.monotonic()
                        if left is not None and left <= 0:
                            raise TrialTimeout(self.group)
                        self.changed.wait(1.0 if left is None else min(left, 1.0))
                    fine, value = self.done.pop(i)
                if not fine:
                    raise value
                yield value
        finally:
            self.stop()

    def stop(self) -> None:
        """Let no further fold begin and cancel the jobs until the threads have ended, GRACE seconds at most."""
        with self.changed:
            self.stopped = True
            self.changed.notify_all()
        until = time.monotonic() + GRACE
        while any(t.is_alive() for t in self.threads) and time.monotonic() < until:
            self.context.cancelJobGroup(self.group)
            for t in self.threads:
                t.join(0.1)
