"""Exact length histogram.

Documents are encoded and aggregated by their encoded length. The histogram has one row for each length that occurs,
and running sums over it answer, for every context limit, how many tokens there are, where the quantiles lie and how
many tokens remain when every document is cut at the limit.

Running sums are taken in two levels, inside blocks of lengths and over the blocks, so that no task sees all lengths
of a corpus whose documents are very long.

Cases: null and empty texts have length 0 and are counted. An empty table gives an empty histogram, whose totals are 0
and whose quantiles are null. No limits or shares give no rows, repeated ones a row each. Equal rows are counted each.
Columns other than the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.bpe import definition, loaded
from corvina.llm.common import chunks, written

#: Lengths in one block of the running sums.
BLOCK = 1024


def lengths(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(length long) of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(bpe.encode_batch(b.column(0).to_pylist())[1]))], ["length"])

    return df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "length long")


def histogram(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs, docs_longer, tokens_longer, docs_upto, tokens_upto, tokens_cut_here), a row for each length.

    docs_longer and tokens_longer are the suffix sums over longer documents; tokens_cut_here is the total that is left
    when this length is the context limit.
    """
    counted = lengths(df, path, text_col).groupBy("length").agg(F.count("*").alias("n_docs"))
    # Written once: the sums below read the counts several times, and encoding is the cost.
    return with_sums(written(counted, "lengths"))


def with_sums(counted: DataFrame) -> DataFrame:
    """Suffix and prefix sums for a table (length, n_docs)."""
    rows = counted.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("d").over(after)).alias("da"), zero(F.sum("t").over(after)).alias("ta"), zero(F.sum("d").over(before)).alias("db"), zero(F.sum("t").over(before)).alias("tb"))
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block").select(
        "length", "n_docs",
        (zero(F.sum("n_docs").over(longer)) + F.col("da")).alias("docs_longer"), (zero(F.sum("tokens").over(longer)) + F.col("ta")).alias("tokens_longer"),
        (F.sum("n_docs").over(upto) + F.col("db")).alias("docs_upto"), (F.sum("tokens").over(upto) + F.col("tb")).alias("tokens_upto"),
    )
    return out.withColumn("tokens_cut_here", F.col("tokens_upto") + F.col("length") * F.col("docs_longer"))


def totals(hist: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens)."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0)).alias("n_tokens"))


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_tokens), a row for each limit given, repeated ones too: what is left when every document is cut at it."""
    if not limits:
        return hist.sparkSession.createDataFrame([], "limit long, n_tokens long")
    one = hist.agg(*(F.sum(F.col("n_docs") * F.least("length", F.lit(int(k)).cast("long"))).alias(f"t{i}") for i, k in enumerate(limits)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(int(k)).cast("long").alias("limit"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("n_tokens")) for i, k in enumerate(limits)))).alias("x")).select("x.*")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length), a row for each share given: the least length that so large a share of the documents does not exceed.

    A share counts as the decimal number it is written as, so 0.07 of 100 documents are 7.
    """
    if not shares:
        return hist.sparkSession.createDataFrame([], "share double, length long")
    whole = (F.col("docs_upto") + F.col("docs_longer")).cast("decimal(19,0)")
    exact = [Fraction(str(q)) for q in shares]
    enough = lambda q: F.col("docs_upto").cast("decimal(19,0)") * F.lit(q.denominator).cast("decimal(18,0)") >= whole * F.lit(q.numerator).cast("decimal(18,0)")
    one = hist.agg(*(F.min(F.when(enough(q), F.col("length"))).alias(f"q{k}") for k, q in enumerate(exact)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("length")) for k, q in enumerate(shares)))).alias("x")).select("x.*")
