"""Aggregates over a document's blocks: the size of body text, the band of heading sizes, quartiles, numbered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import BODY_SIZE


def modal(df: DataFrame, key: str, value: str, order: str, alias: str) -> DataFrame:
    """(key, alias): the value that most rows have, of equals the one first seen by order. Nulls don't count.

    Counts are aggregated before they are shuffled, so a key of any size is a few rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(alias))


def sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size, band_low, band_high): the modal size of body text (11 without sizes), and the heading band around
    the modal size over 1.25 and up to 2.4 times that; null without one."""
    sized = blocks.where(F.col("is_paragraph") & ~F.col("is_empty") & (F.coalesce(F.col("max_size"), F.lit(0)) != 0))
    body = blocks.select("doc_id").distinct().join(modal(sized, "doc_id", "max_size", "index", "mode"), "doc_id", "left").select("doc_id", F.coalesce("mode", F.lit(BODY_SIZE)).alias("body_size"))
    large = sized.join(body, "doc_id").where((F.col("max_size") > 1.25 * F.col("body_size")) & (F.col("max_size") <= 2.4 * F.col("body_size")))
    heading = modal(large, "doc_id", "max_size", "index", "heading")
    return body.join(heading, "doc_id", "left").select("doc_id", "body_size", (F.col("heading") - 1).alias("band_low"), (F.col("heading") + 2).alias("band_high"))


def runs(df: DataFrame, key: str, order: str, gap: int, alias: str = "run") -> DataFrame:
    """alias: the number, from 0, of the run of rows whose order values lie at most gap apart."""
    w = Window.partitionBy(key).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(alias, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def list_starts(blocks: DataFrame, gap: int = 5, tail: float = 3.0) -> DataFrame:
    """(doc_id, index): where numbered list items of the top level stand alone, as chapters do.

    Items at most `gap` blocks apart are a list and don't count. Documents with fewer than two left have none, nor those where
    more than `tail` times the span they cover comes after the last.
    """
    totals = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    items = runs(blocks.where(F.col("num.ilvl") == 0).select("doc_id", "index"), "doc_id", "index", gap)
    alone = items.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("index")).where("n = 1")
    spans = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.min("index").alias("first"), F.max("index").alias("last")).join(totals, "doc_id")
    covered = F.col("last") - F.col("first")
    good = spans.where((F.col("kept") >= 2) & ~((covered > 0) & (F.col("n_blocks") - F.col("last") - 1 > tail * covered)))
    return alone.join(good.select("doc_id"), "doc_id", "left_semi").select("doc_id", "index")


def first_by(value: Column, order: Column) -> Column:
    """The value of the least order among rows where it is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value != ""), order))
