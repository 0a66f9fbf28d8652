"""What a run reports about itself (AG13, AG14, UD2)."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame


def plan_mib(df: DataFrame) -> float:
    """AG14: the optimizer's estimate of the rows' size in MiB; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20


def with_progress(df: DataFrame, action: Callable[[DataFrame], object], on_progress: Callable[[int, int], None], every_s: float = 0.5) -> object:
    """UD2: runs an action and calls ``on_progress(done, total)`` with its tasks, at least once at the end."""
    sc, group, out = df.sparkSession.sparkContext, f"progress-{id(df)}", {}

    def run() -> None:
        sc.setJobGroup(group, "with progress")
        try:
            out["value"] = action(df)
        except Exception as error:
            out["error"] = error
        finally:
            done.set()

    done = threading.Event()
    worker = InheritableThread(target=run)
    worker.start()
    counts = (0, 0)
    while not done.wait(every_s):
        tracker = sc.statusTracker()
        infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        counts = (sum(i.numCompletedTasks for i in infos if i), sum(i.numTasks for i in infos if i))
        on_progress(*counts)
    worker.join()
    if "error" in out:
        raise out["error"]
    on_progress(max(counts[1], 1), max(counts[1], 1))
    return out["value"]
