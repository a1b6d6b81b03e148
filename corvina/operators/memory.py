"""The life of notes: saving, revising, importing, linking, moving and forgetting them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C


def remembered(events: DataFrame) -> DataFrame:
    """Notes after a batch of save events (project, topic, content, at), where notes are told apart by topic, else content.

    Within a key events are taken by `at`: the first creates, an event that repeats the current content is a duplicate,
    another one revises. Each key's fold is two window functions, so keys spread over tasks.
    """
    hashed = C.normalized_hash(F.col("content"))
    rows = events.withColumn("hash", hashed).withColumn("key", F.when(F.col("topic") != "", F.concat(F.lit("t:"), "topic")).otherwise(F.concat(F.lit("c:"), "hash")))
    order = Window.partitionBy("project", "key").orderBy("at", "hash")
    rows = rows.withColumn("before", F.lag("hash").over(order))
    rows = rows.withColumn("outcome", F.when(F.col("before").isNull(), "created").when(F.col("before") == F.col("hash"), "duplicate").otherwise("revised"))
    last = F.max_by("content", F.struct("at", "hash"))
    return rows.groupBy("project", "key").agg(
        C.memory_id(F.first(F.col("project")), F.min_by("hash", F.struct("at", "hash"))).alias("id"), last.alias("content"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
        F.count_if(F.col("outcome") == "revised").alias("revisions"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
    )


def stats(memories: DataFrame) -> DataFrame:
    """Live notes by type and in all (type null), most first."""
    live = memories.where("deleted_at IS NULL")
    return live.rollup("memory_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "memory_type")


def without_project(vectors: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    """Vectors that stay when a project's notes are purged."""
    gone = memories.where(F.col("project") == project).select(F.col("id").alias("base"))
    return vectors.withColumn("base", C.base_memory_id(F.col("id"))).join(gone, "base", "left_anti").drop("base")


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids, "id", "left_anti")


def soft_deleted(memories: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = memories.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("__hit"), F.coalesce("deleted_at", F.lit(at))).otherwise(F.col("deleted_at"))).drop("__hit")


def import_outcomes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (project, hash, topic, pos) with outcome: present, topic_collision or added; earlier lines count as existing."""
    w = Window.partitionBy("project", "hash").orderBy("pos")
    rows = incoming.withColumn("again", F.row_number().over(w) > 1)
    held = existing.select("project", "hash").distinct().withColumn("held", F.lit(True))
    topics = existing.where("topic <> ''").select("project", "topic").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(held, ["project", "hash"], "left").withColumn("present", F.coalesce("held", F.lit(False)) | F.col("again"))
    earlier = F.max(F.when(~F.col("present") & (F.col("topic") != ""), 1)).over(Window.partitionBy("project", "topic").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("earlier", earlier).join(topics, ["project", "topic"], "left")
    clash = (F.col("topic") != "") & (F.coalesce("taken", F.lit(False)) | F.col("earlier").isNotNull())
    return rows.select("project", "hash", "topic", "pos", F.when(F.col("present"), "present").when(clash, "topic_collision").otherwise("added").alias("outcome"))


def moved(memories: DataFrame, ids: DataFrame, project: str) -> DataFrame:
    """Notes after some moved to another project: their ids follow from the new project."""
    stay = memories.join(ids, "id", "left_anti")
    go = memories.join(ids, "id", "left_semi").withColumn("project", F.lit(project)).withColumn("id", C.memory_id(F.lit(project), C.normalized_hash(F.col("content"))))
    return stay.unionByName(go).dropDuplicates(["id"])


def merged_recent(local: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    return local.unionByName(shared).orderBy(F.desc("updated_at"), "id").limit(limit)


def by_ids(ids: DataFrame, local: DataFrame, central: DataFrame) -> DataFrame:
    """Live notes of the ids, the local one before the central one, newest first."""
    both = local.withColumn("rank", F.lit(0)).unionByName(central.withColumn("rank", F.lit(1))).where("deleted_at IS NULL").join(ids.distinct(), "id", "left_semi")
    first = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return both.withColumn("__k", first).where("__k = 1").drop("__k", "rank").orderBy(F.desc("updated_at"), "id")


def note_texts(memories: DataFrame) -> DataFrame:
    """(id, memory_id, level, text) of notes (id, topic, content): the introduction, then the windows, each under the topic."""
    intro = memories.select("id", F.col("id").alias("memory_id"), F.lit("memory").alias("level"), C.with_title(F.col("topic"), F.col("content")).alias("text"))
    parts = memories.select(F.col("id").alias("memory_id"), F.posexplode(C.memory_windows(F.col("content"), F.col("topic"))).alias("pos", "text"))
    return intro.unionByName(parts.select(F.concat("memory_id", F.lit("_c"), (F.col("pos") + 1).cast("string")).alias("id"), "memory_id", F.lit("memory_chunk").alias("level"), "text"))


def reindexed(vectors: DataFrame, memories: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Vectors (id, vector) after notes (id, topic, content) were written again: all old ones of a note go, then its introduction and windows come."""
    kept = vectors.withColumn("__base", C.base_memory_id(F.col("id"))).join(memories.select(F.col("id").alias("__base")).distinct(), "__base", "left_anti").select("id", "vector")
    return kept.unionByName(note_texts(memories).select("id", embed(F.col("text")).alias("vector")))


def file_refs(memories: DataFrame) -> DataFrame:
    """A link row for each file that a note states."""
    stated = memories.where("deleted_at IS NULL").select(F.col("id").alias("memory_id"), "repo", "branch", F.explode(C.list_column(F.col("files"))).alias("file"))
    return stated.distinct().select("memory_id", F.lit("").alias("symbol"), "file", F.lit(0).alias("line"), "repo", "branch", F.lit("files-field").alias("source"))


def mentioned_symbols(memories: DataFrame, points: DataFrame) -> DataFrame:
    """Symbols of a note's files whose short label its content names as a whole identifier: an equi-join on the file, then the text test.

    A link row carries the repository and branch of the symbol, or the note's own where the symbol has none.
    """
    stated = memories.where("deleted_at IS NULL").select(F.col("id").alias("memory_id"), "content", F.col("repo").alias("own_repo"), F.col("branch").alias("own_branch"), F.explode(C.list_column(F.col("files"))).alias("file")).distinct()
    named = points.where("NOT is_deletion AND symbol <> ''").select("file", "symbol", "start_line", "repo", "branch")
    first = F.min(F.struct(F.col("start_line").alias("line"), "repo", "branch"))
    named = named.groupBy("file", "symbol").agg(first.alias("x")).select("file", "symbol", "x.line", "x.repo", "x.branch", C.short_label(F.col("symbol")).alias("label"))
    named = named.where(~C.synthetic(F.col("symbol")) & (F.octet_length("label") >= 3))
    hit = stated.join(named, "file").where(C.mentions(F.col("content"), F.col("label")))
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"own_{c}")).alias(c)
    return hit.select("memory_id", "symbol", "file", "line", own("repo"), own("branch"), F.lit("content-mention").alias("source")).dropDuplicates(["memory_id", "symbol", "file"])


def rebuilt_links(refs: DataFrame, memories: DataFrame, points: DataFrame) -> DataFrame:
    """The link table after notes were linked again: all old rows of these notes go, stated files and named symbols come. A note that is deleted or states no file has none."""
    new = file_refs(memories).unionByName(mentioned_symbols(memories, points))
    return refs.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(new.columns).unionByName(new)


def backfilled(memories: DataFrame, points: DataFrame, from_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """((memory_id, outcome, resolved, from_text, rows, linked) of live notes, the link rows that they get).

    Stated files are resolved to those of the index; only a note that states none is read for paths in its prose, and only
    where `from_text` asks for it. Links go to resolved names. A dry run is a caller that looks at the first table only.
    """
    live = memories.where("deleted_at IS NULL").withColumn("stated", C.list_column(F.coalesce("files", F.lit(""))))
    none = F.size("stated") == 0
    prose = C.prose_paths(F.coalesce("content", F.lit(""))) if from_text else F.array().cast("array<string>")
    named = live.select("id", "content", "repo", "branch", none.alias("none"), F.when(none, prose).otherwise(F.col("stated")).alias("paths"))
    wanted = named.select("id", F.explode("paths").alias("path"))
    known = resolved_files(wanted, points.where("NOT is_deletion").select("file"))
    found = wanted.join(known, "path").groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("found"))
    rows = named.join(found, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    hit = rows.where(F.size("found") > 0).select("id", "content", "repo", "branch", F.lit(None).cast("string").alias("deleted_at"), F.array_join("found", ",").alias("files"))
    links = file_refs(hit).unionByName(mentioned_symbols(hit, points))
    counted = links.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("rows"), (F.count_if(F.col("symbol") != "") > 0).alias("linked"))
    outcome = F.when(F.size("found") > 0, "matched").when(F.col("none"), "without_files").otherwise("not_in_repo")
    told = rows.join(counted, "id", "left").select(F.col("id").alias("memory_id"), outcome.alias("outcome"), F.size("found").alias("resolved"), (F.col("none") & (F.size("found") > 0)).alias("from_text"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("linked", F.lit(False)).alias("linked"))
    return told, links


def backfill_report(told: DataFrame) -> DataFrame:
    """One row of counters over the outcomes of `backfilled`."""
    count = lambda c: F.count_if(c)
    return told.agg(
        F.count("*").alias("examined"), count(F.col("outcome") == "matched").alias("matched"), count(F.col("linked")).alias("linked"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        count(F.col("outcome") == "without_files").alias("without_files"), count(F.col("from_text")).alias("from_text"), count(F.col("outcome") == "not_in_repo").alias("not_in_repo"),
    )


def import_report(outcomes: DataFrame) -> DataFrame:
    """One row of counters over the outcomes of `import_outcomes`."""
    return outcomes.agg(F.count("*").alias("seen"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("added", "present", "topic_collision")))


def resolved_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): an exact match, else the only file of that name, else the only file the path is an end of."""
    paths = candidates.select("path").distinct()
    known = files.select("file").distinct().withColumn("base", C.basename(F.col("file")))
    same = known.withColumn("n", F.count("*").over(Window.partitionBy("base")))
    hit = paths.withColumn("base", C.basename(F.col("path"))).join(same, "base")
    end = (F.col("path") != F.col("base")) & F.col("file").endswith(F.concat(F.lit("/"), F.col("path")))
    tier = F.when(F.col("file") == F.col("path"), 1).when((F.col("path") == F.col("base")) & (F.col("n") == 1), 2).when(end, 3)
    rows = hit.withColumn("tier", tier).where("tier IS NOT NULL")
    best = rows.groupBy("path", "tier").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("tier = 1 OR n = 1")
    return best.groupBy("path").agg(F.min_by("file", "tier").alias("file"))


def link_sources(refs: DataFrame, by: str) -> DataFrame:
    """(memory_id, key, sources): the distinct sources of each note's links to a symbol or file, sorted."""
    return refs.groupBy("memory_id", by).agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))


def linked_or_inferred(refs: DataFrame, memories: DataFrame, symbol: str, limit: int, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Notes linked to a symbol; only if there is none, notes whose text names it, tagged `inference`. One plan, best tier."""
    own = F.col("symbol") == symbol
    own = own & (F.col("repo") == repo) if repo else own
    own = own & (F.col("branch") == branch) if branch else own
    return _tiered(refs.where(own), memories, symbol.split("::")[-1] if "::" in symbol else symbol.split("/")[-1], limit)


def notes_of_file(refs: DataFrame, memories: DataFrame, file: str, limit: int, files: DataFrame | None = None) -> DataFrame:
    """Notes linked to a file, else notes whose text names it. A bare name is taken for the only file of the index that has it."""
    to = F.col("file") == file
    if files is not None and "/" not in file:
        known = resolved_files(refs.sparkSession.createDataFrame([(file,)], "path string"), files).select("file")
        by_name = refs.join(F.broadcast(known), "file", "left_semi")  # one row at most
        refs = refs.where(to).withColumn("t", F.lit(0)).unionByName(by_name.where(~to).withColumn("t", F.lit(1)))
        best = refs.agg(F.min("t").alias("best"))
        refs = refs.join(F.broadcast(best), F.col("t") == F.col("best")).drop("t", "best")
    else:
        refs = refs.where(to)
    return _tiered(refs, memories, file, limit)


def _tiered(refs: DataFrame, memories: DataFrame, label: str, limit: int) -> DataFrame:
    from corvina.operators.predicates import mentioning

    live = memories.where("deleted_at IS NULL")
    direct = refs.select(F.col("memory_id").alias("id"), "source").groupBy("id").agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources")).join(live, "id").withColumn("tier", F.lit(1))
    inferred = mentioning(live, label, limit).withColumn("sources", F.lit("inference")).withColumn("tier", F.lit(2))
    both = direct.unionByName(inferred.select(direct.columns))
    best = both.agg(F.min("tier").alias("best"))
    return both.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best", "tier").orderBy(F.desc("updated_at"), "id").limit(limit)


def refs_of(refs: DataFrame, memory_id: str) -> DataFrame:
    return refs.where(F.col("memory_id") == memory_id).orderBy("source", "file", "symbol")
