"""Parquet tables, shared folders and JSON-lines transfer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, per_task: int = 20_000) -> DataFrame:
    """The rows of slim columns dealt evenly to tasks of about `per_task` rows, for what is costly to make of each.

    A small table lies in few row groups, and a row group is read by one task.
    """
    return rows.repartition(max(1, -(-rows.count() // per_task)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place, on one machine only: a cluster's executors would
    not see it, so there ValueError is raised.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvina-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, in partitions by some columns if given, and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rewritten(spark: SparkSession, path: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """A table after all its rows were written anew beside the old ones, in files of an even size.

    The old files stay until the caller swaps the folders, so a reader never sees half a table.
    """
    target = f"{path.rstrip('/')}.rebuilt-{uuid.uuid4().hex}"
    spark.read.parquet(path).write.option("maxRecordsPerFile", rows_per_file).parquet(target)
    return spark.read.parquet(target)


def upserted(current: DataFrame, incoming: DataFrame, key: list[str], dim: int | None = None) -> DataFrame:
    """The snapshot after an upsert: rows of `current` whose key comes again are replaced. Vectors of a wrong width are refused."""
    if dim is not None and not incoming.where(F.size("vector") != dim).isEmpty():
        raise ValueError(f"vectors must have {dim} components")
    return current.join(incoming, key, "left_anti").unionByName(incoming)


def export_lines(memories: DataFrame, scope: str | None = None) -> DataFrame:
    """One JSON line for each memory."""
    rows = memories.where(F.col("project") == scope) if scope else memories
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def import_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed columns and `corrupt`: the text of a line that does not parse."""
    parsed = F.from_json("value", schema + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select(*(c for c in lines.columns if c != "value"), parsed.alias("x")).select(*(c for c in lines.columns if c != "value"), "x.*")


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(file, line, value) of the lines that are not blank of texts (file, text); lines count from 1."""
    rows = texts.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"))
    return rows.where(F.trim("value") != "").select("file", (F.col("pos") + 1).alias("line"), "value")


def grouped_imports(texts: DataFrame, schema: str, destination: str = "project") -> DataFrame:
    """(destination, file, notes, errors): parsed notes of JSON-lines texts by where they go, and under a null destination the places of lines that do not parse."""
    rows = import_lines(numbered_lines(texts), schema)
    bad = F.col("corrupt").isNotNull()
    place = F.struct("line", F.col("corrupt").alias("value"))
    # One row for each destination and file: what is gathered is bounded by the file.
    return rows.groupBy(F.when(~bad, F.col(destination)).alias("destination"), "file").agg(F.count_if(~bad).alias("notes"), F.array_sort(F.collect_list(F.when(bad, place))).alias("errors"))



def read_lines(files: DataFrame, start: int, stop: int) -> DataFrame:
    """Lines start to stop, from 1, both included, of (file, text)."""
    lines = F.split("text", "\n", -1)
    return files.withColumn("text", F.array_join(F.slice(lines, start, stop - start + 1), "\n"))


def capped_lines(files: DataFrame, tokens: int) -> DataFrame:
    """Whole leading lines within 4 * tokens bytes, and how many lines are missing. The first line always stays."""
    lines = F.split("text", "\n", -1)
    fold = F.aggregate(
        lines, F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"] | ((a["n"] > 0) & (a["bytes"] + F.octet_length(x) + 1 > 4 * tokens)), F.struct(a["bytes"].alias("bytes"), a["n"].alias("n"), F.lit(True).alias("full")))
        .otherwise(F.struct((a["bytes"] + F.octet_length(x) + 1).cast("long").alias("bytes"), (a["n"] + 1).alias("n"), F.lit(False).alias("full"))),
    )
    rows = files.withColumn("__n", fold["n"])
    return rows.select(*[c for c in files.columns if c != "text"], F.array_join(F.slice(lines, 1, F.col("__n")), "\n").alias("text"), (F.size(lines) - F.col("__n")).cast("long").alias("missing"))
