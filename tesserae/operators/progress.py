"""How far a Spark action is, on stderr.

Jobs started within form a group of their own; a thread asks the status tracker for
their stages and prints every further step of 5 % of the tasks known so far, once.
Later stages of an action are known only when they start, so the share is that of
the tasks known; it never goes back.
"""

from __future__ import annotations

import sys
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import SparkSession

#: Per cent between two lines, and seconds between two looks.
STEP, WAIT = 5, 0.5


class Steps:
    """Prints shares of a whole at every further ``STEP`` per cent, each once and in order."""

    def __init__(self, label: str, out: TextIO) -> None:
        self.label, self.out, self.last = label, out, 0

    def at(self, done: int, total: int) -> None:
        reached = 100 * done // total // STEP * STEP if total else 0
        if reached > self.last:
            self.last = reached
            print(f"{self.label}: {reached} %", file=self.out, flush=True)

    def end(self) -> None:
        self.at(1, 1)


@contextmanager
def progress(spark: SparkSession, label: str, on: bool = True, out: TextIO | None = None) -> Iterator[None]:
    """Report the actions within; ``on=False`` does nothing. A failed action ends without a last line."""
    if not on:
        yield
        return
    context, group, ended = spark.sparkContext, f"tesserae-{uuid.uuid4().hex}", threading.Event()
    steps, tracker = Steps(label, out or sys.stderr), context.statusTracker()
    stages: dict[int, tuple[int, int]] = {}

    def look() -> None:
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for k in info.stageIds if info else ():
                stage = tracker.getStageInfo(k)
                if stage and stage.numTasks:
                    stages[k] = (stage.numCompletedTasks, stage.numTasks)
        done, total = (sum(x[j] for x in stages.values()) for j in (0, 1))
        if done < total:
            steps.at(done, total)

    def watch() -> None:
        while not ended.wait(WAIT):
            look()

    names = ("spark.jobGroup.id", "spark.job.description")
    before = [context.getLocalProperty(x) for x in names]
    context.setJobGroup(group, label)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
        ok = True
    except BaseException:
        ok = False
        raise
    finally:
        ended.set()
        watcher.join()
        for name, value in zip(names, before):
            context.setLocalProperty(name, value)
        if ok:
            steps.end()
