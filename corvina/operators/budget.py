"""Fitting ranked text into a budget: ordered folds over arrays, no row-at-a-time Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import columns as C

LEAST_SHARE, SHORTENED = 128, 3


def label(title: Column, ident: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(ident, F.lit("")), F.lit("(untitled)"))


def fitted(memories: DataFrame, tokens: int, by: str | None = None) -> DataFrame:
    """Ranked notes (id, rank, content) with outcome: kept within its share, shortened for the first oversize ones, else dropped.

    With `by` each group is a list of its own with the whole budget. A share is counted in bytes; a budget of 0 keeps all.
    """
    group = [by] if by else []
    share = F.greatest(F.floor(F.lit(tokens) / F.count("*").over(Window.partitionBy(*group))), F.lit(LEAST_SHARE))
    rows = memories.withColumn("share", share).withColumn("over", F.coalesce(F.floor(F.octet_length("content") / 4), F.lit(0)) > F.col("share"))
    rows = rows.withColumn("over", F.col("over") & F.lit(tokens > 0))
    place = F.sum(F.col("over").cast("int")).over(Window.partitionBy(*group).orderBy("rank", "id"))
    return rows.withColumn("outcome", F.when(~F.col("over"), "kept").when(place <= SHORTENED, "shortened").otherwise("dropped"))


def shortened_note(content: Column, share: Column, summary: Column | None = None) -> Column:
    """A note cut to its share: its summary clipped to 4 * share characters if there is one, else whole leading lines; marked either way."""
    cut = shortened(content, share)
    if summary is None:
        return cut
    clipped = F.when(F.octet_length(summary) > 4 * share, F.substring(summary, F.lit(1), (4 * share).cast("int"))).otherwise(summary)
    return F.coalesce(F.concat(clipped, F.lit("\n… (summarized)")), cut)


def packed(rows: DataFrame, budget: int, stop: bool = False, most: int = 1000) -> DataFrame:
    """(grp, id, rank, taken) of ranked lists (grp, rank, id, bytes): each block is taken if it fits what is left.

    With `stop` the first misfit ends its list, and the places follow from running sums in a window, for lists of any
    length. Without, a misfit is skipped, which is a fold over the list: lists of over `most` blocks raise an error.
    """
    if stop:
        order = Window.partitionBy("grp").orderBy("rank", "id")
        return rows.select("grp", "id", "rank", (F.sum("bytes").over(order) <= budget).alias("taken"))
    some = F.slice(F.array_sort(F.collect_list(F.struct("rank", "id", "bytes"))), 1, most)
    listed = rows.groupBy("grp").agg(F.count("*").alias("n"), some.alias("x"))
    listed = listed.select("grp", F.when(F.col("n") <= most, F.col("x")).otherwise(F.raise_error(F.lit(f"a list of over {most} blocks"))).alias("x"))
    # The fold adds up what was taken; the flags come from the sums before and after each block.
    start = F.array().cast("array<bigint>")

    def step(sums, x):
        used = F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))
        return F.concat(sums, F.array(F.when(used + x["bytes"] <= budget, used + x["bytes"]).otherwise(used)))

    done = listed.select("grp", "x", F.aggregate("x", start, step).alias("sums"))
    taken = F.transform("x", lambda x, k: F.struct(x["id"].alias("id"), x["rank"].alias("rank"), (F.coalesce(F.get("sums", k - 1), F.lit(0)) + x["bytes"] == F.get("sums", k)).alias("taken")))
    return done.select("grp", F.explode(taken).alias("z")).select("grp", "z.id", "z.rank", "z.taken")


def anchored_sentences(texts: DataFrame, embed, query: str | None = None, digits: int | None = None) -> DataFrame:
    """(id, content, scored) of texts (id, text), a row for each: its sentences (pos, sentence, score) in order.

    A score is the cosine of the sentence with the query, else with the first sentence, rounded to `digits` if given.
    """
    rows = texts.select("id", F.col("text").alias("content"), C.sentences(F.col("text")).alias("s"))
    anchor = F.lit(query) if query is not None else F.get("s", F.lit(0))
    rows = rows.select("id", "content", "s", embed(anchor).alias("a"))

    def one(sentence, pos):
        score = C.bound(embed(sentence), lambda v: C.cosine(v, F.col("a")))
        return F.struct(pos.alias("pos"), sentence.alias("sentence"), (F.round(score, digits) if digits is not None else score).alias("score"))

    return rows.select("id", "content", F.transform("s", one).alias("scored"))


def extractive(scored: DataFrame, target_tokens: int) -> DataFrame:
    """(id, summary) of texts with scored sentences (id, content, scored), a row for each; texts stay where they are.

    The best sentence is always taken; a sentence that does not fit is skipped; once the target is reached nothing more
    is; order is restored. A text of one sentence, or within the target, stays whole but for white space around it.
    """
    item = lambda v: F.struct((-v["score"]).alias("s"), v["pos"].alias("pos"), v["sentence"].alias("t"), C.token_estimate(v["sentence"]).cast("long").alias("n"))
    texts = scored.select("id", "content", F.coalesce(F.sort_array(F.transform("scored", item)), F.array()).alias("x"))
    # Sentences of no token are taken as long as there is room, so their places follow from `room`; `kept` holds the others' places, as many as the target has tokens at most.
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"), F.lit(0).alias("room"))

    def step(a, x):
        room = a["used"] < target_tokens
        take = (a["at"] == 0) | (room & (x["n"] > 0) & (a["used"] + x["n"] <= target_tokens))
        return F.struct(
            F.when(take, a["used"] + x["n"]).otherwise(a["used"]).alias("used"), F.when(take, F.concat(a["kept"], F.array(a["at"]))).otherwise(a["kept"]).alias("kept"),
            (a["at"] + 1).alias("at"), (a["room"] + room.cast("int")).alias("room"),
        )

    def joined(a):
        marked = F.transform("x", lambda v, at: F.struct(v["pos"].alias("pos"), v["t"].alias("t"), (F.array_contains(a["kept"], at) | ((v["n"] == 0) & (at < a["room"]))).alias("taken")))
        return F.array_join(F.transform(F.sort_array(F.filter(marked, lambda v: v["taken"])), lambda v: v["t"]), " ")

    whole = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    picked = C.bound(F.aggregate("x", start, step), joined)
    return texts.select("id", F.when((F.size("x") <= 1) | (C.token_estimate(F.col("content")) <= target_tokens), whole).otherwise(picked).alias("summary"))


def shortened(text: Column, share: Column, marker: str = "… (shortened)") -> Column:
    """Whole leading lines within 4 * share bytes, and a marker."""
    lines = F.split(text, "\n", -1)
    fold = F.aggregate(
        lines, F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("n"), F.lit(False).alias("e")),
        lambda a, x: F.when(a["e"] | (a["b"] + F.octet_length(x) + 1 > 4 * share), F.struct(a["b"].alias("b"), a["n"].alias("n"), F.lit(True).alias("e"))).otherwise(F.struct((a["b"] + F.octet_length(x) + 1).cast("long").alias("b"), (a["n"] + 1).alias("n"), F.lit(False).alias("e"))),
    )
    return F.concat_ws("\n", F.nullif(F.array_join(F.slice(lines, 1, fold["n"]), "\n"), F.lit("")), F.lit(marker))
