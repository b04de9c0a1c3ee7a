"""What a piece of work costs: time, CPU, shuffled and spilled bytes of its stages, peak memory of the JVM and of Python workers."""
from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

_PAGE = os.sysconf("SC_PAGE_SIZE")


def stages(spark: SparkSession) -> dict[tuple[int, int], dict[str, float]]:
    """Figures of the stages that the application's status store still has, by stage and attempt."""
    sc = spark.sparkContext
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    out = {}
    for i in range(listed.size()):
        s = listed.apply(i)
        out[s.stageId(), s.attemptId()] = {
            "shuffle_bytes": s.shuffleWriteBytes(), "spill_bytes": s.diskBytesSpilled(), "cpu_s": s.executorCpuTime() / 1e9, "input_bytes": s.inputBytes(), "tasks": s.numCompleteTasks(), "task_peak_bytes": s.peakExecutionMemory(),
        }
    return out


def _descendants() -> dict[int, tuple[str, int]]:
    """Command and resident bytes of this process's descendants."""
    parent, found = {}, {}
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/stat") as f:
                name, _, rest = f.read().partition("(")[2].rpartition(")")
            with open(f"/proc/{pid}/statm") as f:
                found[int(pid)] = name, int(f.read().split()[1]) * _PAGE
            parent[int(pid)] = int(rest.split()[1])
        except (OSError, IndexError, ValueError):
            continue
    mine = {os.getpid()}
    while more := {p for p, q in parent.items() if q in mine and p not in mine}:
        mine |= more
    return {p: found[p] for p in mine - {os.getpid()}}


class _Peaks(threading.Thread):
    def __init__(self, every: float):
        super().__init__(daemon=True)
        self.every, self.done, self.jvm, self.workers, self.worker = every, threading.Event(), 0, 0, 0

    def run(self) -> None:
        while True:
            got = _descendants().values()
            python = [size for name, size in got if name.startswith("python")]
            self.jvm = max([self.jvm, *(size for name, size in got if name == "java")])
            self.workers, self.worker = max(self.workers, sum(python)), max([self.worker, *python])
            if self.done.wait(self.every):
                return


def measured(spark: SparkSession, work: Callable[[], object], every: float = 0.2) -> dict[str, float]:
    """Run work and return its seconds, the sums over its stages, and peaks in MB: of the JVM, of all Python workers together (pages that they share
    count for each), and of the largest one. Where there is no /proc, peaks are 0. On a cluster the peaks are the driver machine's."""
    before = stages(spark)
    peaks = _Peaks(every) if os.path.isdir("/proc") else None
    if peaks:
        peaks.start()
    began = time.perf_counter()
    work()
    seconds = time.perf_counter() - began
    if peaks:
        peaks.done.set()
        peaks.join()
    own = [s for k, s in stages(spark).items() if k not in before]
    out = {"seconds": round(seconds, 3), "stages": len(own), "tasks": sum(s["tasks"] for s in own), "cpu_s": round(sum(s["cpu_s"] for s in own), 2)}
    out |= {k: sum(s[k] for s in own) for k in ("input_bytes", "shuffle_bytes", "spill_bytes")}
    out["task_peak_mb"] = round(max([0, *(s["task_peak_bytes"] for s in own)]) / 1e6, 1)
    if peaks:
        out |= {"jvm_mb": round(peaks.jvm / 1e6), "workers_mb": round(peaks.workers / 1e6), "worker_mb": round(peaks.worker / 1e6)}
    return out
