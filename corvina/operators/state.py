"""Index state: change detection, copies between branches, cascades and the project registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_status(lines: DataFrame) -> DataFrame:
    """(status, path, from_path) of `git diff --name-status` lines; other letters are dropped."""
    part = F.split("value", "\t")
    letter = F.substring(part[0], 1, 1)
    status = F.when(letter.isin("A", "C"), "added").when(letter.isin("M", "T"), "modified").when(letter == "D", "deleted").when(letter == "R", "renamed")
    two = letter.isin("C", "R")
    rows = lines.select(status.alias("status"), F.when(two, F.try_element_at(part, F.lit(3))).otherwise(F.try_element_at(part, F.lit(2))).alias("path"), F.when(letter == "R", F.try_element_at(part, F.lit(2))).alias("from_path"))
    return rows.where("status IS NOT NULL AND path IS NOT NULL")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, status) of two snapshots (file, hash) in one pass."""
    b, n = before.select("file", F.col("hash").alias("old")), now.select("file", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return b.join(n, "file", "full_outer").select("file", status.alias("status"))


def pruned(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select("file").distinct().join(now.select("file").distinct(), "file", "left_anti")


def copy_sources(states: DataFrame, branch: str) -> DataFrame:
    """(file, hash, from_branch): where a file of `branch` can be copied from, same content and model on another branch."""
    own = states.where(F.col("branch") == branch).select("file", "hash", "model")
    other = states.where(F.col("branch") != branch).groupBy("file", "hash", "model").agg(F.min("branch").alias("from_branch"))
    return own.join(other, ["file", "hash", "model"]).select("file", "hash", "from_branch")


def copied_points(points: DataFrame, files: DataFrame, branch: str) -> DataFrame:
    """Points of the files, filed again under another branch."""
    rows = points.join(files.select("file", F.col("from_branch").alias("branch")), ["file", "branch"], "left_semi")
    return rows.withColumn("id", F.concat("id", F.lit("@" + branch))).withColumn("branch", F.lit(branch))


def refiled(rows: DataFrame, files: DataFrame, branch: str) -> DataFrame:
    """Edges or routes after files (repo, file, from_branch) were copied to a branch: what it held of these files goes, the rows of the source branch come."""
    to = files.select("repo", "file", F.lit(branch).alias("branch"))
    kept = rows.join(to, ["repo", "file", "branch"], "left_anti")
    source = files.select("repo", "file", F.col("from_branch").alias("branch"))
    return kept.unionByName(rows.join(source, ["repo", "file", "branch"], "left_semi").withColumn("branch", F.lit(branch)))


def copied_branch(points: DataFrame, edges: DataFrame, routes: DataFrame, files: DataFrame, branch: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, edges, routes) after files (repo, file, from_branch) were copied to a branch without being read again, and (file, language, symbols, chunks) of each."""
    new = copied_points(points, files, branch)
    old = points.join(new.select("id"), "id", "left_anti")
    told = new.groupBy("file").agg(F.min("language").alias("language"), F.count_distinct(F.when(F.col("symbol") != "", F.col("symbol"))).alias("symbols"), F.count("*").alias("chunks"))
    return old.unionByName(new), refiled(edges, files, branch), refiled(routes, files, branch), told


def dropped_branch(tables: dict[str, DataFrame], repo: str, branch: str, repo_columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All given tables without the rows of a branch of a repository; repo_columns names the repository's column where it is not `repo`."""
    named = repo_columns or {}
    return {name: rows.where(~((F.col(named.get(name, "repo")) == repo) & (F.col("branch") == branch))) for name, rows in tables.items()}


def symbols_per_file(points: DataFrame) -> DataFrame:
    return points.groupBy("file").agg(F.count_distinct(F.when(F.col("symbol") != "", F.col("symbol"))).alias("symbols"), F.count("*").alias("chunks"))


def index_totals(states: DataFrame) -> DataFrame:
    return states.groupBy("repo", "branch").agg(F.count("*").alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """A table after the cascade delete of (repo, branch, file) rows."""
    return rows.join(files.select("repo", "branch", "file").distinct(), ["repo", "branch", "file"], "left_anti")


def renamed_files(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """A table after files (repo, branch, file) of `moves` took the name new_file."""
    to = moves.groupBy("repo", "branch", "file").agg(F.min("new_file").alias("__to"))
    return rows.join(to, ["repo", "branch", "file"], "left").withColumn("file", F.coalesce("__to", "file")).drop("__to").select(*rows.columns)


def untracked_branches(states: DataFrame, tracked: list[str], current: str) -> DataFrame:
    """Branches to drop: indexed, not tracked, not the current one; none when the list is empty."""
    rows = states.select("branch").distinct()
    return rows.where(~F.col("branch").isin([*tracked, current])) if tracked else rows.limit(0)


def replaced_routes(routes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Routes after the files of `incoming` were read again; the first of a (framework, method, path, repo, branch) wins across files."""
    kept = routes.join(incoming.select("repo", "branch", "file").distinct(), ["repo", "branch", "file"], "left_anti").withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    key = ["framework", "http_method", "path", "repo", "branch"]
    first = F.min_by(F.struct("file", "handler_symbol", "handler_method", "line"), F.struct("__new", "file", "line"))
    return kept.groupBy(*key).agg(first.alias("x")).select(*key, "x.*")


def needs_full_index(incremental: bool, record: dict | None, model: str, dim: int, commit_known: bool, explicit_paths: bool = False) -> bool:
    if explicit_paths:
        return False
    return not incremental or record is None or record["model"] != model or record["dim"] != dim or not commit_known


def index_record(records: DataFrame, repo: str, branch: str) -> DataFrame:
    """The record of a branch's index, no row where it was never made."""
    return records.where((F.col("repo") == repo) & (F.col("branch") == branch))


def indexed_files(states: DataFrame, repo: str, branch: str) -> DataFrame:
    return states.where((F.col("repo") == repo) & (F.col("branch") == branch)).select("file").distinct()


def saved(rows: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """A table of file states or index records after some were saved: a key that comes again is replaced."""
    return rows.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming)


def explicit_changes(paths: DataFrame, present: DataFrame) -> DataFrame:
    """(file, status) of a list of paths: one that is gone from disk is deleted, any other is modified."""
    here = present.select("file").distinct().withColumn("here", F.lit(True))
    return paths.select("file").distinct().join(here, "file", "left").select("file", F.when(F.col("here"), "modified").otherwise("deleted").alias("status"))


def applied_changes(states: DataFrame, changed: DataFrame, now: DataFrame, repo: str, branch: str, model: str, full: bool = False) -> DataFrame:
    """(file, outcome, hash) of changes (file, status, from_path) against what is indexed and what is there now (file, hash).

    Outcomes: deleted; renamed and indexed, for a move; copied, where another branch holds the same content for the same
    model; skipped, where the content is as indexed; indexed. In a full run what is indexed and no longer there is pruned.
    """
    own = states.where((F.col("repo") == repo) & (F.col("branch") == branch)).select("file", F.col("hash").alias("old"), F.col("model").alias("old_model"))
    elsewhere = states.where((F.col("repo") == repo) & (F.col("branch") != branch) & (F.col("model") == model)).select("file", "hash").distinct().withColumn("elsewhere", F.lit(True))
    moved = changed.where("from_path IS NOT NULL").select(F.col("from_path").alias("file"), F.lit("renamed").alias("outcome"), F.lit(None).cast("string").alias("hash"))
    there = changed.join(now.select("file", "hash"), "file", "left").join(own, "file", "left").join(elsewhere, ["file", "hash"], "left")
    same = (F.col("old") == F.col("hash")) & (F.col("old_model") == model)
    outcome = F.when((F.col("status") == "deleted") | F.col("hash").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "skipped").when(F.col("elsewhere"), "copied").otherwise("indexed")
    out = there.select("file", outcome.alias("outcome"), "hash").unionByName(moved)
    if full:
        gone = own.select("file").distinct().join(now.select("file"), "file", "left_anti").join(out.select("file"), "file", "left_anti")
        out = out.unionByName(gone.select("file", F.lit("pruned").alias("outcome"), F.lit(None).cast("string").alias("hash")))
    return out


def saved_states(states: DataFrame, outcomes: DataFrame, repo: str, branch: str, model: str) -> DataFrame:
    """File states (repo, branch, file, hash, model) after a run: rows of files that went are gone, rows of files that were read or copied are new."""
    touched = outcomes.where("outcome <> 'skipped'").select(F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), "file").distinct()
    new = outcomes.where("outcome IN ('indexed', 'copied')").select(F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), "file", "hash", F.lit(model).alias("model"))
    kept = states.select("repo", "branch", "file", "hash", "model").join(touched, ["repo", "branch", "file"], "left_anti")
    return kept.unionByName(new)


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row of counters over the outcomes of a run."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == k).alias(f"files_{k}") for k in ("indexed", "skipped", "deleted", "pruned", "renamed", "copied")))


def next_record(record: dict | None, commit: str, explicit_paths: bool, **counts) -> dict:
    """The index record that a run saves: a run over given paths covers no commit, so it keeps the one before."""
    return {"last_commit": record["last_commit"] if explicit_paths and record else commit, **counts}


def default_branch(branches: list[str], configured: list[str] = ()) -> str | None:
    """The first branch that is configured; else main, else master, if there is such a branch; else none."""
    return next(iter(configured), next((b for b in ("main", "master") if b in branches), None))


def registered(projects: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after projects (name, path, …) registered again: one row a path, renamed if the name is another.

    Empty fields are inherited, active is set. A name that another path holds is refused.
    """
    other = incoming.select("name", F.col("path").alias("new_path")).join(projects.select("name", "path"), "name").where("new_path <> path")
    if not other.isEmpty():
        raise ValueError("a project of that name lives at another path")
    old = projects.select("path", *(F.col(c).alias("__" + c) for c in projects.columns if c != "path"))
    both = incoming.join(old, "path", "left")
    new = both.select(*(F.col("path") if c == "path" else F.lit(True).alias("active") if c == "active" else F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("__" + c)).alias(c) for c in projects.columns))
    return projects.join(incoming.select("path"), "path", "left_anti").unionByName(new)


def refreshed(projects: DataFrame, names: list[str], configured: DataFrame) -> DataFrame:
    """The registry after projects were registered again from their own configuration (path and settings). An unknown name is refused."""
    known = {r["name"] for r in projects.where(F.col("name").isin(names)).select("name").collect()}
    if missing := sorted(set(names) - known):
        raise ValueError(f"unknown projects: {', '.join(missing)}")
    chosen = projects.where(F.col("name").isin(names))
    settings = [c for c in configured.columns if c != "path" and c in projects.columns]
    new = configured.select("path", *(F.col(c).alias("__" + c) for c in settings))
    fields = [F.col("__" + c).alias(c) if c in settings else F.col(c) for c in projects.columns]
    return registered(projects, chosen.join(new, "path").select(*fields))


def deactivated(projects: DataFrame, name: str) -> DataFrame:
    return projects.withColumn("active", F.col("active") & (F.col("name") != name))


def removed(projects: DataFrame, name: str) -> DataFrame:
    return projects.where(F.col("name") != name)


def with_index_stats(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """The registry after runs reported their figures by path; a path that is not registered has nowhere to report."""
    fields = [c for c in stats.columns if c != "path"]
    new = stats.select("path", F.lit(True).alias("__hit"), *(F.col(c).alias("__" + c) for c in fields))
    rows = projects.join(new, "path", "left")
    return rows.select(*(F.when(F.col("__hit"), F.col("__" + c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in projects.columns))


def reindex_targets(projects: DataFrame, names: list[str] | None, everything: bool, current: str) -> DataFrame:
    if everything:
        return projects.where("active")
    wanted = names or [current]
    known = {r["name"] for r in projects.where(F.col("name").isin(wanted)).select("name").collect()}
    if missing := sorted(set(wanted) - known):
        raise ValueError(f"unknown projects: {', '.join(missing)}")
    return projects.where(F.col("name").isin(wanted))
