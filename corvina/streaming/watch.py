"""Save events: debounced batches, the index that follows them, sweeps for moved heads, and progress."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import predicates, state


def debounced(events: DataFrame, gap: str, time_col: str = "ts", key_col: str | None = None, path_col: str = "path", watermark: str | None = None) -> DataFrame:
    """One row for each quiet-bounded run of events: the gap restarts with every event. Works on batches and streams."""
    rows = events.withWatermark(time_col, watermark) if watermark else events
    # A stream's sessions need a key besides the window; without one all events share the empty text.
    keys = [F.session_window(time_col, gap).alias("w"), F.col(key_col) if key_col else F.substring(path_col, 1, 0).alias("__all")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("events"), F.sort_array(F.collect_set(path_col)).alias("paths"))
    return out.select(*([key_col] if key_col else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")


@dataclass
class Progress:
    """What a caller polls while a run is under way: counts of changes begun, and the last file."""

    running: bool = False
    total: int = 0
    done: int = 0
    file: str = ""
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def start(self, total: int) -> None:
        with self._lock:
            self.running, self.total, self.done, self.file = True, total, 0, ""

    def step(self, files: list[str]) -> None:
        with self._lock:
            self.done += len(files)
            self.file = files[-1] if files else self.file

    def finish(self) -> None:
        with self._lock:
            self.running = False

    def read(self) -> dict:
        with self._lock:
            return {"running": self.running, "total": self.total, "done": self.done, "file": self.file}


def incremental(states: DataFrame, paths: DataFrame, now: DataFrame, repo: str, branch: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(file states after an index run over given paths (file), its outcomes). What is there now: (file, hash). The commit of the index does not move."""
    changed = state.explicit_changes(paths, now).withColumn("from_path", F.lit(None).cast("string"))
    outcomes = state.applied_changes(states, changed, now, repo, branch, model)
    return state.saved_states(states, outcomes, repo, branch, model), outcomes


def indexed_stream(events: DataFrame, gap: str, index: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "10 seconds", progress: Progress | None = None):
    """Hand the distinct paths (file) of each batch of debounced runs to `index`; a path that is gone from disk is a deletion to it."""

    def batch(rows: DataFrame, number: int) -> None:
        files = rows.select(F.explode("paths").alias("file")).distinct()
        if progress is not None:
            progress.start(files.count())
        index(files, number)
        if progress is not None:
            last = files.agg(F.max("file").alias("file"), F.count("*").alias("n")).first()
            progress.done, progress.file = last["n"], last["file"] or ""
            progress.finish()

    return debounced(events, gap, watermark=watermark).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(projects: DataFrame, heads: DataFrame, reindex: Callable[[str, str], None]) -> list[str]:
    """Index every active project whose head has moved since, by name; one that fails does not keep the others from it."""
    done = []
    for r in predicates.stale_projects(projects, heads).select("name", "path").orderBy("name").toLocalIterator():
        try:
            reindex(r["name"], r["path"])
        except Exception:  # noqa: BLE001 - a sweep goes on; the project stays stale and is tried again
            continue
        done.append(r["name"])
    return done


def sweep_stream(spark: SparkSession, tables: Callable[[], tuple[DataFrame, DataFrame]], reindex: Callable[[str, str], None], every: str, checkpoint: str):
    """Sweep (projects, heads), read anew each time, at a fixed interval."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda rows, number: sweep(*tables(), reindex) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
