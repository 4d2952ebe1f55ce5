"""A progress bar of Spark's running stages, beside the job that it shows."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import SparkSession

WIDTH = 30


def done_of(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and tasks known of the stages that run now, by Spark's tracker."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


class Bar:
    """Draws a line over itself. status gives (done, all); clock and out can be replaced."""

    def __init__(self, title: str, status: Callable[[], tuple[int, int]], out: TextIO | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.title, self.status, self.out, self.clock = title, status, out or sys.stderr, clock
        self.began, self.last = clock(), 0

    def line(self) -> str:
        done, all_ = self.status()
        full = WIDTH * done // all_ if all_ else 0
        return f"{self.title} [{'#' * full}{'.' * (WIDTH - full)}] {done}/{all_} tasks, {self.clock() - self.began:.0f} s"

    def draw(self) -> None:
        line = self.line()
        self.out.write("\r" + line.ljust(self.last))
        self.out.flush()
        self.last = len(line)

    def close(self) -> None:
        if self.last:
            self.out.write("\r" + " " * self.last + "\r")
            self.out.flush()


@contextmanager
def shown(spark: SparkSession, title: str, on: bool = True, every: float = 0.5, out: TextIO | None = None):
    """Shows the bar while the block runs; the polling thread ends with it, also if it fails."""
    if not on:
        yield None
        return
    bar, over = Bar(title, lambda: done_of(spark), out), threading.Event()

    def poll() -> None:
        while not over.wait(every):
            bar.draw()

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield bar
    finally:
        over.set()
        thread.join()
        bar.close()
