"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime re-planning, skewed joins, times without zones, broadcast only below a checked size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def resource_settings(memory_mb: int, cores: int, heap_share: float = 0.6) -> dict[str, str]:
    """Caps of an executor: the heap's share of its memory, the rest for Python workers, and its cores. Impossible values fall back to the least that works."""
    memory_mb, cores = max(memory_mb, 1024), max(cores, 1)
    heap = int(memory_mb * min(max(heap_share, 0.2), 0.9))
    return {"spark.executor.memory": f"{heap}m", "spark.executor.memoryOverhead": f"{memory_mb - heap}m", "spark.executor.cores": str(cores)}


def shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Partitions of a shuffle so that each is of the target size, and no core is idle."""
    return max(cores, -(-input_bytes // target_bytes))


def session(name: str = "corvina", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
