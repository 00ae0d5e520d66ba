"""How far a job has come, told while it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


def watched(spark: SparkSession, action: Callable[[], T], report: Callable[[int, int], None], wait: float = 0.2) -> T:
    """Run ``action`` and call ``report(done, all)`` with the tasks of its jobs whenever more are done; a read of tars has one task for each of them.

    Gives what ``action`` gives, or raises what it raises. Counts are of the stages that have begun, so that ``all`` can grow.
    """
    context, group, result = spark.sparkContext, uuid.uuid4().hex, {}

    def run():
        context.setJobGroup(group, "watched")
        try:
            result["value"] = action()
        except BaseException as failed:  # noqa: BLE001  raised in the caller's thread
            result["failed"] = failed

    def counts() -> tuple[int, int]:
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for s in sorted({s for j in jobs if j for s in j.stageIds})]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    thread, last = InheritableThread(target=run), None
    thread.start()
    while True:
        thread.join(wait)
        now = counts()
        if now != last and now[1]:
            report(*now)
            last = now
        if not thread.is_alive():
            break
    if "failed" in result:
        raise result["failed"]
    return result["value"]
