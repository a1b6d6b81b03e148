"""Notes of an earlier SQLite store, by the driver in Python's standard library."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import columns as C

FIELDS = ["title", "content", "memory_type", "scope", "project", "topic_key", "tags", "author", "repo", "branch", "files", "created_at"]
#: Rows that are fetched at a time.
ROWS = 5000


def old_notes(spark: SparkSession, path: str) -> DataFrame:
    """(pos, fields of a note) of all live notes in a SQLite file that executors can reach; one task reads it, in parts of ROWS rows."""
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for place in b.column(0).to_pylist():
                con = sqlite3.connect(f"file:{place}?mode=ro", uri=True)
                rows = con.execute(f"SELECT {', '.join(FIELDS)} FROM memories WHERE deleted_at IS NULL OR deleted_at = '' ORDER BY id")
                at = 0
                while part := rows.fetchmany(ROWS):
                    columns = [pa.array([None if v is None else str(v) for v in c], pa.string()) for c in zip(*part)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), *columns], ["pos", *FIELDS])
                    at += len(part)
                con.close()

    schema = "pos long, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([(path,)], "path string").mapInArrow(read, schema).withColumn("topic_key", F.coalesce("topic_key", F.lit("")))


def migrated(old: DataFrame, project: str, group: str = "", keep_project: bool = False) -> DataFrame:
    """Save events of old notes (project, topic, content, at, …) for `operators.memory.remembered`.

    A note of global scope goes to the group where one is configured, else stays global; an empty repository is named by
    the note's project.
    """
    own = F.when(F.col("project") != "", F.col("project")).otherwise(project) if keep_project else F.lit(project)
    scope = F.when(F.lower("scope").isin("global", "shared"), F.lit("group" if group else "global")).otherwise(F.col("scope"))
    rows = old.withColumn("scope", scope).withColumn("repo", F.when(F.coalesce("repo", F.lit("")) == "", F.col("project")).otherwise(F.col("repo")))
    return rows.withColumn("project", C.identity_project(F.col("scope"), F.lit(group), own)).withColumnRenamed("topic_key", "topic").withColumn("at", F.struct("created_at", "pos"))
