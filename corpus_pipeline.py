"""From raw documents to a training mix: five stages, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, mixing, nearcopies, pii, quality
from quire.llm.common import fold, small_batches, table, written
from quire.llm.queries import LABELLED


def _changed(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text, and the count of its characters if there is such a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier scores below 0.5; it learns from the labels outside the held-out third."""
    known = quality.labelled(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1, LABELLED)
    trees = quality.train(known, "text", "label", F.col("order"), LABELLED)
    return docs.where(quality.score(F.col("text"), trees) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, four fifths of them shared."""
    return nearcopies.one_of_each(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten words in a row of a benchmark item (or a shorter item as a whole)."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the kind of each span of personal data in its place."""
    small_batches(spark)
    return _changed(docs, pii.redact(F.col("text"), pii.train(pii.pieces(docs))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with how often each is taken (copies) and the words that are (taken); those not taken go."""
    return mixing.mixed(docs).where("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("mixing", mix),
]

#: Boosted trees, MinHash bands and the cube method have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
