"""Connected components over a table of links, by alternating large and small stars.

Each round is two joins and two aggregations on the links alone; the links are written to the shared folder after
each, so nothing is gathered on the driver but one count and one checksum a round. Minima are combined before they are
shuffled, and the table of minima is written before the join, so a node with very many links is a skewed join that
the optimizer splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cleared, mark, written


def _signature(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
    return r["n"], r["s"]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id that each id of a link (u, v) reaches. An empty table gives no rows."""
    spark, began = links.sparkSession, mark()
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = _signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        # Large star: the larger neighbours of every node are tied to the least of its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        # Small star: every node and its smaller neighbours are tied to the least of them.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
        cleared(spark, began)
        before, seen = seen, _signature(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = written(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    cleared(spark, began)
    return found
