"""Filters over points, routes, memories and projects."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_filter(repo: str | None = None, branch: str | None = None, languages: list[str] = (), levels: list[str] = (), memory_type: str | None = None) -> Column:
    """All given conditions; an empty one is none. Deleted points never pass."""
    parts = [~F.col("is_deletion")]
    parts += [F.col("repo") == repo] if repo else []
    parts += [F.col("branch") == branch] if branch else []
    parts += [F.col("language").isin(list(languages))] if languages else []
    parts += [F.col("level").isin(list(levels))] if levels else []
    parts += [F.col("memory_type") == memory_type] if memory_type else []
    return functools.reduce(operator.and_, parts)


#: What a hit shows of a point.
HIT = ("id", "file", "start_line", "symbol", "level", "text")


def hits(points: DataFrame, score: str | None = None) -> DataFrame:
    """The columns of a hit, live points only."""
    return points.where(~F.col("is_deletion")).select(*HIT, *([score] if score else []))


def scrolled(points: DataFrame, where: Column, columns: list[str], after: tuple | None = None, limit: int | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows that pass a filter, without a score; a page of `limit` rows after a key, if given."""
    rows = points.where(where)
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(v).cast(points.schema[c].dataType).alias(c) for c, v in zip(order, after))))
    return (rows.orderBy(*order).limit(limit) if limit else rows).select(*columns)


def vector_by_id(points: DataFrame, ids: list) -> DataFrame:
    return points.where(F.col("id").isin(ids)).select("id", "vector")


def is_code(level: Column) -> Column:
    """Whether a point is code, not the vector of a note."""
    return ~level.isin("memory", "memory_chunk")


def narrowed_branch(points: DataFrame, repo: str, checked_out: str, default: str | None) -> str | None:
    """The checked-out branch if it has rows, else the default if that has, else none."""
    for branch in (checked_out, default):
        if branch and not points.where((F.col("repo") == repo) & (F.col("branch") == branch)).isEmpty():
            return branch
    return None


def search_routes(routes: DataFrame, method: str | None = None, part: str | None = None) -> DataFrame:
    if method:
        routes = routes.where(F.upper("http_method") == method.upper())
    return routes.where(F.contains("path", F.lit(part))) if part else routes


def routes_for_handler(routes: DataFrame, handler: str) -> DataFrame:
    return routes.where((F.col("handler_symbol") == handler) | (F.col("handler_method") == handler))


def definitions(points: DataFrame, name: str, limit: int, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Exact symbols of a repository and branch; only if there is none, symbols that end in the name. One scan, the best tier stays."""
    points = points.where(F.col("repo") == repo) if repo else points
    points = points.where(F.col("branch") == branch) if branch else points
    symbol = F.col("symbol")
    tier = F.when(symbol == name, 1).when(symbol.endswith("." + name) | symbol.endswith("::" + name), 2)
    found = points.where(~F.col("is_deletion")).withColumn("tier", tier).where("tier IS NOT NULL")
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).orderBy("file", "start_line", "id").limit(limit).drop("best")


def mentioning(memories: DataFrame, label: str, limit: int) -> DataFrame:
    if len(label.encode()) < 3:
        return memories.limit(0)
    hit = F.contains("content", F.lit(label)) | F.contains("files", F.lit(label))
    return memories.where(F.col("deleted_at").isNull() & hit).orderBy(F.desc("updated_at"), "id").limit(limit)


def shared_memories(memories: DataFrame, limit: int = 0) -> DataFrame:
    rows = memories.where(F.col("deleted_at").isNull() & ((F.col("project") == "@global") | F.col("project").startswith("@group:"))).orderBy(F.desc("updated_at"), "id")
    return rows.limit(limit) if limit else rows


def stale_projects(projects: DataFrame, heads: DataFrame) -> DataFrame:
    return projects.where("active").join(heads, "name").where("head <> last_commit")


def tracked(branch: Column, branches: list[str]) -> Column:
    return branch.isin(branches) if branches else F.lit(True)


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")
