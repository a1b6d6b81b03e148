"""Documents to packed training sequences, in five stages. Each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvina.llm import pipeline_stages as stages
from corvina.llm.common import cleared, mark, table, written

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("language_id", stages.language_id),
    ("line_dedup", stages.dedup_lines),
    ("minhash_near_dedup", stages.minhash_near_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: SQL can express neither the tokenizer nor the learned language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        began = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The stage's own tables have served; its result is the last one written.
        cleared(spark, began)
    return docs
