"""Timing harness of searches: warm-up, repeats, latencies as rows, efforts side by side."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.evaluation import latency_summary


def timed(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], repeat: int = 3, warmup: int = 1) -> tuple[dict[str, DataFrame], DataFrame]:
    """(last result of each run, latency summary per run). Results are deterministic, latencies are not."""
    results, rows = {}, []
    for name, run in runs.items():
        for i in range(warmup + repeat):
            began = time.perf_counter()
            results[name] = run()
            results[name].write.format("noop").mode("overwrite").save()
            if i >= warmup:
                rows.append((name, 1000 * (time.perf_counter() - began)))
    return results, latency_summary(spark.createDataFrame(rows, "run string, latency_ms double"), "latency_ms", ["run"])
