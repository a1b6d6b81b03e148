"""The stages that the corpus pipeline is made of; each takes and returns the documents table, the last one returns places.

Cases, for all of them: extra columns stay as they are, whatever their names. Null and empty texts fail the quality
rules; later stages leave them to language identification, which rejects what has no letter. Rows that repeat an id are
separate rows, but near-duplicate removal takes them together: an id that is not kept goes with all its rows. A row
without an id stays. Texts of any length are read whole. An empty table gives an empty one. Ties go to the least id.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import langid, line_dedup, minhash, packing, quality
from corvina.llm.queries import CAPACITY, END_ID, tokenizer

#: A document goes when its language cannot be told, or only with a lower score than this.
LEAST_SCORE = 0.35


OWN = ("doc_id", "text", "lang", "n_chars")


def apart(stage):
    """A stage that sees columns it does not know under names of no meaning, and gives them back under their own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(docs.toDF(*(c if c in OWN else f"__other_{k}" for k, c in enumerate(names)))).toDF(*names)

    return run


@apart
def quality_rules(docs: DataFrame) -> DataFrame:
    """Failed lines go; documents that the rules reject go."""
    return quality.cleaned_documents(docs)


@apart
def language_id(docs: DataFrame) -> DataFrame:
    """Documents without a recognizable language go. The model is fitted on the labelled rows of this stage's input."""
    model = langid.train(docs, ~langid.held_out(docs))
    told = langid.told(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.drop("lang_pred", "score")


@apart
def dedup_lines(docs: DataFrame) -> DataFrame:
    """Later occurrences of repeated lines go; a document that they leave fewer words than the quality rules ask for goes with them.

    Of a near copy only the lines that differ are left, which are no document of their own.
    """
    left = F.regexp_count("text", F.lit(line_dedup.WORD + "+"))
    done = line_dedup.cleaned(docs).where((F.col("n_removed") == 0) | (left >= quality.MIN_WORDS))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


@apart
def minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates stays: the one of the least id."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    return packing.pack(docs, tokenizer(), CAPACITY, END_ID).withColumnRenamed("id", "doc_id")
