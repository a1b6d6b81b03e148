"""Call-graph operators over edges (source, target, kind, file, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C
from corvina.sources.tables import written


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("target") == symbol).select(F.col("source").alias("symbol")).distinct()


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("source") == symbol).select(F.col("target").alias("symbol")).distinct()


def references(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("target") == symbol).orderBy("file", "line", "source")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (file, source, target, kind): the one of the lowest line."""
    return edges.groupBy("file", "source", "target", "kind").agg(F.min("line").alias("line"))


def export(edges: DataFrame, kind: str | None = None, file: str | None = None, limit: int = 0) -> DataFrame:
    if kind:
        edges = edges.where(F.col("kind") == kind)
    if file:
        edges = edges.where(F.col("file") == file)
    return edges.orderBy("source", "target", "kind", "file", "line").limit(limit or 2000)


#: Symbols of a level that are sent to every task, and steps that a task gets when there are more.
SMALL_LEVEL, TASK_STEPS = 100_000, 1_000_000


def impact(edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(direction, symbol, depth) of all that reaches the start and all it reaches, at the least depth, up to `depth`.

    Breadth-first, a join for each level; levels are written to the shared folder so that lineage stays short.
    """
    spark = edges.sparkSession
    # Both directions from one pass over the edges, written once: each level reads the steps, which may be costly to make.
    # A step may come more than once; what a level reaches does not.
    ways = F.array(F.struct(F.lit("down").alias("direction"), F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.lit("up").alias("direction"), F.col("target").alias("a"), F.col("source").alias("b")))
    steps = written(edges.select(F.explode(ways).alias("x")).select("x.*"), "steps")
    seen = spark.createDataFrame([("down", start, 0), ("up", start, 0)], "direction string, symbol string, depth int")
    frontier, size = None, 0
    for level in range(1, depth + 1):
        if frontier is None:
            found = steps.where(F.col("a") == start)
        else:
            asked = frontier.withColumnRenamed("symbol", "a")
            if size <= SMALL_LEVEL:
                found = steps.join(F.broadcast(asked), ["direction", "a"])
            else:
                tasks = max(1, -(-steps.count() // TASK_STEPS))
                found = steps.repartition(tasks, "direction", "a").join(asked.repartition(tasks, "direction", "a"), ["direction", "a"])
        reached = found.select("direction", F.col("b").alias("symbol")).distinct()
        fresh = reached.join(seen, ["direction", "symbol"], "left_anti")
        if level == depth:
            return seen.unionByName(fresh.withColumn("depth", F.lit(level))).where("depth > 0")
        fresh = written(fresh, f"bfs-{level}")
        size = fresh.count()
        if not size:
            break
        seen = seen.unionByName(fresh.withColumn("depth", F.lit(level)))
        frontier = fresh
    return seen.where("depth > 0")


def assembled_nodes(edges: DataFrame, hide_synthetic: bool = True, hide_external: bool = False) -> DataFrame:
    """(id, label, file, external): nodes of a graph; a node is external when no edge starts at it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("file").alias("file"), F.lit(1).alias("starts")), F.struct(F.col("target").alias("id"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("starts")))).alias("x")).select("x.*")
    nodes = ends.groupBy("id").agg(F.min("file").alias("file"), (F.max("starts") == 0).alias("external")).withColumn("label", C.short_label(F.col("id")))
    if hide_synthetic:
        nodes = nodes.where(~C.synthetic(F.col("id")))
    return nodes.where("NOT external") if hide_external else nodes


def numbered_edges(edges: DataFrame, hide_synthetic: bool = True) -> DataFrame:
    """Edge ids by their place in the exported list, before anything is hidden."""
    n = F.row_number().over(Window.orderBy("source", "target", "kind", "file", "line")) - 1
    rows = edges.withColumn("edge_id", F.concat(F.lit("e"), n.cast("string")))
    return rows.where(~C.synthetic(F.col("source")) & ~C.synthetic(F.col("target"))) if hide_synthetic else rows
