"""Which blocks may be headings, and runs of them as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.divisions import match_division
from ..functions.text import collapse, norm_title, word_count
from .features import first_by, runs

c = F.col


def precise_gate() -> Column:
    """A paragraph that looks like a heading: by style, wording, number or size. Needs division and the size band."""
    role = c("division.role")
    few = c("word_count") <= 12
    numeric = (c("word_count") <= 15) & c("text").rlike(L.NUMERIC_LINE) & ~c("text").rlike(L.HINDI_DATE)
    worded = few & (role.isin("labeled", "ordinal_label") | ((role == "bare") & (c("word_count") <= 3)))
    sized = few & (c("max_size") != 0) & c("max_size").between(c("band_low"), c("band_high"))
    lines = c("text").rlike(L.CHAPTER_LINE) | c("text").rlike(L.PART_LINE) | c("text").rlike(L.ROMAN_LINE)
    any_of = [c("style_level") == 0, F.lower("style_id").contains("chapter"), lines, numeric, worded, sized]
    return c("is_paragraph") & ~c("is_empty") & F.coalesce(F.greatest(*(F.coalesce(x, F.lit(False)) for x in any_of)), F.lit(False))


def structural_gate() -> Column:
    """A short line that is no sentence and is set apart: by a page or section start, bold, centred or isolated."""
    apart = c("page_break_before") | c("starts_page") | c("starts_section") | c("starts_spine") | c("bold") | F.coalesce(c("alignment") == "center", F.lit(False)) | c("is_isolated")
    return c("is_paragraph") & ~c("is_empty") & (c("word_count") <= 12) & ~c("text").rlike("[.?!।॥]$") & apart


def gated(blocks: DataFrame, bands: DataFrame, fallback: bool = True) -> DataFrame:
    """Blocks that pass the precise gate; in documents with fewer than two of those, the ones that pass the structural gate.

    Without fallback a document keeps what passes the precise gate, also where that is one block or none.

    Only paragraphs of a few words, or with a style, have their wording looked at.
    """
    worth = c("is_paragraph") & ~c("is_empty")
    rows = blocks.where(worth).join(bands, "doc_id").withColumn("division", F.when(c("word_count") <= 15, match_division(c("text"))))
    if not fallback:
        return rows.where(precise_gate()).drop("division")
    rows = rows.withColumns({"__precise": precise_gate(), "__structural": structural_gate()}).where("__precise or __structural")
    many = F.sum(c("__precise").cast("int")).over(Window.partitionBy("doc_id")) >= 2
    return rows.withColumn("__many", many).where(F.when(c("__many"), c("__precise")).otherwise(c("__structural"))).drop("__precise", "__structural", "__many", "division")


def merge_runs(rows: DataFrame, gap: int = 2) -> DataFrame:
    """Candidates at most `gap` blocks apart as one: texts joined, the least style level, the largest size, any flag.

    The run has its first member's place, and what holds of that place alone (contents, page, section and spine starts,
    isolation).
    """
    numbered = runs(rows, "doc_id", "index", gap)
    own = lambda name: F.min_by(name, "index").alias(name)
    texts = F.transform(F.array_sort(F.collect_list(F.when(c("text") != "", F.struct("index", "text")))), lambda x: x["text"])
    merged = numbered.groupBy("doc_id", "run").agg(
        F.min("index").alias("index"),
        F.array_join(texts, " ").alias("text"),
        first_by(c("style_id"), c("index")).alias("style_id"),
        F.min("style_level").alias("style_level"),
        F.bool_or("bold").alias("bold"),
        F.bool_or("all_caps_prop").alias("all_caps_prop"),
        F.max(F.nullif("max_size", F.lit(0))).alias("max_size"),
        first_by(c("alignment"), c("index")).alias("alignment"),
        F.bool_or("page_break_before").alias("page_break_before"),
        own("starts_page"),
        own("starts_section"),
        own("starts_spine"),
        own("is_isolated"),
        own("body_size"),
        own("band_low"),
        own("band_high"),
    )
    shaped = merged.drop("run").withColumn("text", collapse(c("text")))
    return shaped.withColumns({"word_count": word_count(c("text")), "norm": norm_title(c("text")), "division": match_division(c("text")), "is_paragraph": F.lit(True), "is_empty": F.lit(False)})
