"""Removal of repeated runs of lines, with DataFrame functions only.

Lines with a word are taken in order; every three consecutive ones form a window. Windows are hashed (two 64-bit
hashes of their lines), equal windows are found over the whole table, and every window that is not the first of its
kind is removed: the first one stands in the document of the least id, at the least position. Removed windows overlap,
so the covered line positions are merged before the text is put together again; blank lines between covered lines go
with them.

A window is sent once for each document that holds it, counts are combined before they are shuffled, and only windows
found twice or more are joined back. Texts are joined to removed positions by id and text hash.

Cases: null text counts as empty. Documents of fewer than three lines with a word stay as they are. Rows with equal
ids are one document and do not remove one another's lines. A row without an id keeps what no earlier window of its
own repeats. A document that is removed whole stays with the empty text. An empty table gives no rows. Other columns
stay as they are, whatever their names. Work and memory follow the length of a text, not its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import quoted, written

#: A line with a word holds something besides ASCII white space.
WORD = r"[^\x20\x09-\x0D]"


def line_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, a, b, start, stop, first): every three-line window, first: the first of its kind in its document."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    lines = F.filter(
        F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.rlike(WORD).alias("word"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))), lambda x: x["word"]
    )
    some = df.select(df[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), lines.alias("l")).where(F.size("l") >= 3)
    window = lambda k: F.struct(
        F.xxhash64(F.col("l")[k]["a"], F.col("l")[k + 1]["a"], F.col("l")[k + 2]["a"]).alias("a"),
        F.xxhash64(F.col("l")[k]["b"], F.col("l")[k + 1]["b"], F.col("l")[k + 2]["b"]).alias("b"),
        F.col("l")[k]["i"].alias("start"), F.col("l")[k + 2]["i"].alias("stop"),
    )
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("l") - 3), window))
    placed = some.select("id", "text_hash", windows.alias("w"))
    # Sorted by hash, then position: a window repeats in its document if the one before it has the same hashes.
    marked = F.transform("w", lambda x, k: x.withField("first", (k == 0) | (x["a"] != F.col("w")[k - 1]["a"]) | (x["b"] != F.col("w")[k - 1]["b"])))
    return placed.select("id", "text_hash", F.explode(marked).alias("w")).select("id", "text_hash", "w.*")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(a, b, first_id): windows that two documents or more hold."""
    counted = windows.where("first").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return counted.where("n > 1").select("a", "b", "first_id")


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): the other columns of every row as a struct, so that none of their names matters, and its cleaned text."""
    windows = written(line_windows(df, id_col, text_col), "line-windows")
    repeated = written(repeated_windows(windows), "line-repeats")
    later = windows.where("first").join(repeated, ["a", "b"]).where(F.col("id") > F.col("first_id")).select("id", "text_hash", "start", "stop")
    again = windows.where("NOT first").select("id", "text_hash", "start", "stop")
    covered = later.unionByName(again).groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    covered = covered.withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"})
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    others = F.struct(F.lit(None).cast("void").alias("__none"), *(df[quoted(c)] for c in df.columns if c != text_col))
    rows = df.select(others.alias("row"), df[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(covered, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"]))))
    lines = F.split("text", "\n", -1)
    # The lines are bound as the only element of an array: an expression inside a lambda is computed for each element.
    kept = lambda one: F.transform(F.array_except(F.sequence(F.lit(0), F.size(one) - 1), gone), lambda i: one[i])
    clean = F.array_join(F.element_at(F.transform(F.array(lines), kept), 1), "\n")
    none = F.col("spans").isNull()
    return joined.select("row", F.when(none, F.col("text")).otherwise(clean).alias("text"), F.size(lines).alias("n_lines"), F.when(none, F.lit(0)).otherwise(F.size(gone)).alias("n_removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of df with its cleaned text in the text column, and __n_lines and __n_removed besides, which replace columns of that name."""
    done, counts = cleaned(df, id_col, text_col), ("__n_lines", "__n_removed")
    own = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c not in counts]
    return done.select(*own, F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))
