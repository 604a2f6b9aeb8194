"""Benchmarks of indicators on Spark, and advice from their figures."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidParams
from .operators import calculate
from .plans.pipeline import Pipeline

# From where a benchmark's figures call for advice.
MANY_BYTES_A_ROW = 1000
SLOW_MICROSECONDS = 100_000
RANK = {"low": 0, "medium": 1, "high": 2}


@dataclass(frozen=True)
class Benchmark:
    indicator: str
    rows: int
    iterations: int
    average_us: float
    least_us: float
    most_us: float
    memory_bytes: int = 0


@dataclass(frozen=True)
class PipelineBenchmark:
    stages: int
    dataset_sizes: tuple[int, ...]
    iterations: int
    total_us: float
    average_us: float
    rows_a_second: float
    memory_bytes: int
    runs: tuple[tuple[dict, float], ...]


@dataclass(frozen=True)
class MemoryProfile:
    """Bytes of the driver's JVM heap (all of Spark, on a local session) around an operation."""

    initial: int
    peak: int
    final: int
    collections: int
    result: Any

    @property
    def delta(self) -> int:
        return self.final - self.initial


def _run(df: DataFrame) -> float:
    """Microseconds that a whole evaluation takes; results go nowhere (noop sink)."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1e6


def memory_profile(spark: SparkSession, operation: Callable[[], Any]) -> MemoryProfile:
    """Run an operation and say what the heap did: before, at its peak, and after a collection."""
    if not callable(operation):
        raise InvalidParams("An operation must be callable without arguments", param="operation", value=operation, expected="function")
    factory = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    pools = [p for p in factory.getMemoryPoolMXBeans() if p.getType().name() == "HEAP"]
    beans = list(factory.getGarbageCollectorMXBeans())

    def used() -> int:
        return factory.getMemoryMXBean().getHeapMemoryUsage().getUsed()

    factory.getMemoryMXBean().gc()
    initial, before = used(), sum(b.getCollectionCount() for b in beans)
    for p in pools:
        p.resetPeakUsage()
    result = operation()
    peak = max(initial, sum(p.getPeakUsage().getUsed() for p in pools))
    factory.getMemoryMXBean().gc()
    return MemoryProfile(initial, peak, used(), sum(b.getCollectionCount() for b in beans) - before, result)


def benchmark_indicator(name: str, bars: DataFrame, iterations: int = 3, memory: bool = True, **params) -> Benchmark:
    """Time whole evaluations of an indicator, after one to warm up and to see what memory it takes."""
    df = calculate(name, bars, **params)
    profile = memory_profile(bars.sparkSession, lambda: _run(df)) if memory else None
    times = [_run(df) for _ in range(iterations)]
    return Benchmark(name, bars.count(), iterations, sum(times) / len(times), min(times), max(times), profile.peak - profile.initial if profile else 0)


def benchmark_pipeline(pipeline: Pipeline, datasets: list[DataFrame], iterations: int = 3, memory: bool = False) -> PipelineBenchmark:
    """Time whole runs of a pipeline over each dataset, after one run of each to warm up."""
    spark, sizes = datasets[0].sparkSession, tuple(d.count() for d in datasets)
    profile = memory_profile(spark, lambda: [_run(pipeline.run_wide(d)) for d in datasets])
    runs = []
    for _ in range(iterations):
        for d in datasets:
            done = pipeline.execute(d)
            runs.append((done.metrics(), _run(done.wide)))
    total = sum(t for _, t in runs)
    rate = sum(sizes) * iterations / (total / 1e6) if total else 0.0
    return PipelineBenchmark(len(pipeline.stages), sizes, iterations, total, total / len(runs), rate, max(0, profile.peak - profile.initial) if memory else 0, tuple(runs))


def advise(results: list[Benchmark]) -> list[dict[str, str]]:
    """Recommendations, the weightiest first."""
    out = []
    if any(r.memory_bytes > MANY_BYTES_A_ROW * max(1, r.rows) for r in results):
        out.append({"type": "memory", "description": "High memory usage: stream the data or split it", "impact": "high", "effort": "medium"})
    if any(r.average_us > SLOW_MICROSECONDS for r in results):
        out.append({"type": "cpu", "description": "Slow execution: add partitions or fuse indicators in one pipeline", "impact": "high", "effort": "high"})
    if len(results) > 1:
        out.append({"type": "caching", "description": "Several runs over the same bars: persist them", "impact": "medium", "effort": "low"})
    return sorted(out, key=lambda r: (-RANK[r["impact"]], RANK[r["effort"]]))


def enable_caching(bars: DataFrame) -> DataFrame:
    return bars.persist()


def disable_caching(bars: DataFrame) -> DataFrame:
    return bars.unpersist()


def clear_caches(spark: SparkSession) -> None:
    """Drop all frames that the session has persisted."""
    spark.catalog.clearCache()


def cache_stats(bars: DataFrame) -> dict[str, object]:
    level = bars.storageLevel
    return {"cached": level.useMemory or level.useDisk, "memory": level.useMemory, "disk": level.useDisk}
