"""Splitting books: files in, chapter files and a report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assemble
from .plans.segment import segment
from .sources import books
from .sources.archives import Limits, read_files
from .sources.tables import written


@dataclass(frozen=True)
class Result:
    """report: a row for each file. chapters, manifest and files (with data) as tables; nothing is written to a folder yet."""

    report: DataFrame
    chapters: DataFrame
    manifest: DataFrame
    files: DataFrame


def split(spark: SparkSession, *paths: str, level: str = "auto", pattern: str | None = None, min_confidence: float = 0.5, yes: bool = False, dry_run: bool = False, limits: Limits = Limits()) -> Result:
    """Finds the chapters of all books below the paths and makes a file of each.

    Books that abstain, and without `yes` those with a chapter below min_confidence, get no files (report: skipped). With
    dry_run none do. A file that isn't a book, or is damaged or unsafe, is a row of the report with its code and message.
    """
    content = read_files(spark, *paths)
    read = books.read_books(content, limits)
    plan = segment(read.blocks, read.toc_entries, read.titles, level)
    chapters, plans = written(plan.chapters, "chapters"), written(plan.plans, "plans")
    weak = assemble.triage(chapters, min_confidence).select("doc_id", "weak").distinct()
    docs = read.status.join(plans, "doc_id", "left").join(weak, "doc_id", "left").withColumn("weak", F.coalesce("weak", F.lit(0)))
    low = ~F.coalesce("abstained", F.lit(True)) & (F.col("weak") > 0) & F.lit(not yes)
    skipped = F.when(F.col("code") != "ok", "unreadable").when(F.coalesce("abstained", F.lit(True)), "abstained").when(F.lit(dry_run), "dry_run").when(low, "low_confidence")
    docs = written(docs.withColumn("skipped", skipped), "docs")
    named = books.chapter_names(chapters.join(docs.where("skipped is null").select("doc_id"), "doc_id", "left_semi"), read.status, pattern)
    listed = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "level", "confidence", "start", "end", "role"))).alias("chapters"))
    report = docs.join(listed, "doc_id", "left").join(assemble.role_counts(chapters), "doc_id", "left")
    return Result(report, chapters, books.manifest(named), books.chapter_files(content, named))
