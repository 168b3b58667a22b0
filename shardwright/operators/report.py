"""Reports from run tables, and samplers of the machine that runs them."""

from __future__ import annotations

import os
import platform
import subprocess
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import markdown
from . import metrics as M

MIB = 1048576.0


def single_run(rows: DataFrame) -> DataFrame:
    base = M.throughput_table(rows, "loader", "throughput", "steady_throughput")
    rest = rows.groupBy("loader").agg(F.avg(M.present(rows, "wait_fraction")).alias("wait"), F.avg(M.present(rows, "fetch_p99")).alias("fetch_p99"), (F.max(M.present(rows, "sys_rss_max")) / MIB).alias("max_rss_mib"))
    return base.join(rest, "loader").orderBy("loader")


def latency_table(rows: DataFrame) -> DataFrame:
    return M.mean_of(M.without_warmup(rows) if "warmup" in rows.columns else rows, ["loader"], {c: c for c in ("fetch_p50", "fetch_p95", "fetch_p99", "time_to_first_batch", "wait_fraction")}).orderBy("loader")


def mutation_report(rows: DataFrame) -> DataFrame:
    means = {"mean_latency": "mean_latency_s", "max_latency": "max_latency_s"}
    return M.grouped_table(rows, ["mode", "rate"], means=means, sums={"violations": "total", "attempted": "attempted", "failed": "failed"}).orderBy("mode", F.expr("try_cast(rate AS double)"))


def memory_table(rows: DataFrame) -> DataFrame:
    return rows.select("mode", *[M.present(rows, c).alias(c) for c in ("min", "max", "growth", "slope", "mean_drain")]).orderBy("mode")


def missing_table(rows: DataFrame) -> DataFrame:
    return rows.where("status <> 'ok'").select(*[c for c in ("loader", "format", "dataset", "status", "detail") if c in rows.columns])


def generate(tables: dict[str, DataFrame]) -> str:
    """A Markdown report: a section per table that has rows."""
    parts = ["# Report\n"]
    for title, df in tables.items():
        if not df.isEmpty():
            parts.append(f"## {title}\n\n{markdown(df)}")
    return "\n".join(parts)


def host_info(spark: SparkSession) -> DataFrame:
    """One row: platform, processors, memory, Python, Spark, commit."""
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=False).stdout.strip()
    except OSError:
        commit = ""
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return spark.createDataFrame([(platform.platform(), platform.machine(), os.cpu_count(), memory, platform.python_version(), spark.version, commit)], "platform string, machine string, cpus int, memory_bytes long, python string, spark string, commit string")


class Sampler(threading.Thread):
    """Rows (t, cpu_s, rss_bytes) of this process, every period seconds until stop()."""

    def __init__(self, period: float = 0.2) -> None:
        super().__init__(daemon=True)
        self.period, self.rows, self._end = period, [], threading.Event()

    def run(self) -> None:
        start = time.monotonic()
        while not self._end.wait(self.period):
            times = os.times()
            with open("/proc/self/statm") as f:
                pages = int(f.read().split()[1])
            self.rows.append((time.monotonic() - start, times.user + times.system, pages * os.sysconf("SC_PAGE_SIZE")))

    def stop(self, spark: SparkSession) -> DataFrame:
        self._end.set()
        self.join()
        return spark.createDataFrame(self.rows, "t double, cpu_s double, rss_bytes long")


def observed(df: DataFrame, name: str, size: str | None = None):
    """(df, observation) that counts rows and bytes while df is used; read observation.get after the action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")] + ([F.sum(size).alias("bytes")] if size else [])
    return df.observe(seen, *exprs), seen
