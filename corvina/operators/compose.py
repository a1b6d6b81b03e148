"""Compositions: the search tool, recall over scopes, the brief for a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C
from corvina.functions import models
from corvina.operators import budget, predicates, retrieval

SCOPES = ("local", "group", "global")


class NoKeywordIndex(Exception):
    """There is no keyword index and none can be made."""


def tool_search(
    points: DataFrame, text: str, vector: list[float] | None, mode: str = "vector", limit: int = 10, language: str | None = None, rerank: str | None = None,
    keyword_index: Callable[[], retrieval.KeywordIndex] | None = None, with_notes: bool = False,
) -> DataFrame:
    """(id, score, score_kind) of the search tool: no deleted points, no vectors of notes unless asked for, one language if given.

    The keyword index is made when it is first needed. If that fails with NoKeywordIndex, keyword search fails, hybrid
    search is by vectors alone. A reranker takes the pool of a vector or hybrid search, never of a keyword search.
    """
    if mode not in ("vector", "keyword", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    live = points.where("NOT is_deletion")
    live = live if with_notes or "level" not in points.columns else live.where(predicates.is_code(F.col("level")))
    kept = live.where(F.col("language") == language) if language else live
    pool = retrieval.pool_size(limit)
    depth = pool if mode == "hybrid" or rerank else limit
    words = None
    if mode != "vector":
        try:
            index = (keyword_index or (lambda: retrieval.build_keyword_index(points.select("id", "text"))))()
        except NoKeywordIndex:
            if mode == "keyword":
                raise
        else:
            words = retrieval.bm25_indexed(index, text).join(kept.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(depth)
    if mode == "keyword":
        return words.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", F.lit("bm25").alias("score_kind"))
    near = retrieval.knn(kept, vector, depth).select("id", "score")
    found = retrieval.rrf([near, words], depth).select("id", "score") if words is not None else near
    kind = "rrf" if words is not None else "cosine"
    if rerank:
        found, kind = models.reranked(found.join(points.select("id", "text"), "id"), text, limit, rerank), rerank
    return found.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", F.lit(kind).alias("score_kind"))


def scopes_of(scope: str, group: str = "") -> list[str]:
    """The tiers that a scope asks for: a single one, or for any other word all; the group only where one is configured."""
    wanted = [scope] if scope in SCOPES else list(SCOPES)
    return [s for s in wanted if s != "group" or group]


def recalled_scopes(tiers: dict[str, DataFrame], scope: str, group: str, limit: int, tokens: int) -> DataFrame:
    """(id, score, scope, content, outcome, rank) of notes recalled over scopes and fitted to a budget.

    tiers: ranked top-k lists (id, score, content) by scope, each with whatever further columns. They are fused by rank,
    local before group before global on a tie; a note that several hold bears the first one's scope.
    """
    chosen = scopes_of(scope, group)
    lists = [tiers[s] for s in chosen]
    fused = retrieval.rrf([t.select("id", "score") for t in lists], limit)
    texts = None
    for k, t in enumerate(lists):
        one = t.drop("score").withColumn("list", F.lit(k))
        texts = one if texts is None else texts.unionByName(one)
    rows = fused.join(texts, ["id", "list"])
    rows = rows.withColumn("scope", F.element_at(F.array(*map(F.lit, chosen)), F.col("list") + 1)).drop("list")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most `limit` rows
    return budget.fitted(ranked, tokens)


def _appended(state, items, heading: str, limit_bytes: int, stop: bool):
    """A fold that appends blocks (text, file) which fit; the heading rides with the first one that does."""

    def step(s, x):
        head = F.when(F.size(s["parts"]) == s["before"], heading).otherwise("")
        block = F.concat(head, x["text"])
        fits = ~s["ended"] & (s["used"] + F.octet_length(block) <= limit_bytes)
        ended = s["ended"] | (~fits if stop else F.lit(False))
        missed = ~fits & ~s["ended"]
        visited = F.when(s["ended"] | F.array_contains(s["visited"], x["file"]), s["visited"]).otherwise(F.concat(s["visited"], F.array(x["file"])))
        return F.struct(
            (s["used"] + F.when(fits, F.octet_length(block)).otherwise(0)).cast("bigint").alias("used"), F.when(missed, F.concat(s["dropped"], F.array(x["name"]))).otherwise(s["dropped"]).alias("dropped"),
            F.when(fits, F.concat(s["parts"], F.array(block))).otherwise(s["parts"]).alias("parts"), ended.alias("ended"), visited.alias("visited"), s["before"].alias("before"),
        )

    start = F.struct(state["used"].alias("used"), state["dropped"].alias("dropped"), state["parts"].alias("parts"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("visited"), F.size(state["parts"]).alias("before"))
    return F.aggregate(items, start, step)


def brief(recalled: DataFrame, hits: DataFrame, noted: DataFrame, tokens: int, files: int = 5, each: int = 5) -> DataFrame:
    """One row (text, used, dropped, dropped_names): a brief of at most 4 * tokens bytes for a question.

    recalled: notes (rank, title, content, files); hits: code (rank, file, line, text); noted: notes linked to files (file,
    id, title, content, sources, updated_at). First the recalled notes, where what does not fit is skipped. Then code of
    files that no recalled note states, which ends at the first misfit. Then up to `each` notes of the first `files`
    files of the code that was looked at, each note once; misfits are skipped. A last line counts the misfits; their titles and places are a column.
    All lists are short by their limits, so each is one array.
    """
    room = 4 * tokens
    item = lambda text, file, name, *order: F.struct(*order, text.alias("text"), file.alias("file"), name.alias("name"))
    title = F.coalesce("title", F.lit(""))
    note = F.concat(F.lit("[note] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    notes = recalled.agg(F.array_sort(F.collect_list(item(note, F.lit(""), title, "rank"))).alias("notes"))
    stated = recalled.select(F.explode(C.list_column(F.coalesce("files", F.lit("")))).alias("file")).distinct()
    block = F.concat(F.lit("// "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    code = hits.join(stated, "file", "left_anti").agg(F.array_sort(F.collect_list(item(block, F.col("file"), F.concat("file", F.lit(":"), F.col("line").cast("string")), "rank"))).alias("code"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("dropped"), F.array().cast("array<string>").alias("parts"))
    one = notes.crossJoin(code).select(_appended(empty, F.col("notes"), "## Known already\n\n", room, False).alias("s"), "code")
    one = one.select(_appended(F.col("s"), F.col("code"), "## Code\n\n", room, True).alias("s"))
    looked = one.select(F.posexplode(F.slice("s.visited", 1, files)).alias("pos", "file"))
    close = noted.join(F.broadcast(looked), "file")  # at most `files` rows
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("updated_at"), "id"))
    close = close.withColumn("place", place).where(F.col("place") <= each)
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos", "place"))
    close = close.withColumn("first", first).where("first = 1")
    about = F.concat(F.lit("[note · "), F.col("sources"), F.lit(" · about "), F.col("file"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    last = close.agg(F.array_sort(F.collect_list(item(about, F.col("file"), title, "pos", "place"))).alias("about"))
    done = one.crossJoin(last).select(_appended(F.col("s"), F.col("about"), "## Recorded about this code\n\n", room, False).alias("s"))
    footer = F.when(F.size("s.dropped") > 0, F.concat(F.lit("\n"), F.size("s.dropped").cast("string"), F.lit(f" further item(s) did not fit in {tokens} tokens.\n"))).otherwise("")
    text = F.concat(F.array_join("s.parts", ""), footer)
    return done.select(F.when(text == "", "Nothing indexed matched this query.\n").otherwise(text).alias("text"), F.col("s.used").alias("used"), F.size("s.dropped").alias("dropped"), F.col("s.dropped").alias("dropped_names"))
