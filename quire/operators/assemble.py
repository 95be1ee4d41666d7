"""Chapters from boundaries: ranges, roles, views, and what needs a second look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.text import norm_role

c = F.col


def ranges(boundaries: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapters (doc_id, ordinal, title, start, end, level, confidence, ...): from each boundary to the next or the end, and Front
    Matter before the first. totals: (doc_id, n_blocks)."""
    w = Window.partitionBy("doc_id").orderBy("index")
    rows = boundaries.join(totals, "doc_id").withColumns({"end": F.coalesce(F.lead("index").over(w), "n_blocks"), "__n": F.row_number().over(w)})
    body = rows.select("doc_id", "title", c("index").alias("start"), "end", F.coalesce("div_type", "level").alias("level"), "confidence", "fired", "depth", "div_type", "number", "explanation")
    null = {f.name: F.lit(None).cast(f.dataType) for f in body.schema.fields if f.name in ("fired", "depth", "div_type", "number", "explanation")}
    front = rows.where("__n = 1 and index > 0").select("doc_id", F.lit("Front Matter").alias("title"), F.lit(0).alias("start"), c("index").alias("end"), F.lit("front").alias("level"), F.lit(1.0).alias("confidence"), *(null[k].alias(k) for k in ("fired", "depth", "div_type", "number", "explanation")))
    return body.unionByName(front).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1)


def roles(chapters: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """role: front_matter, body or back_matter, by level, back-matter words in the title, the type, and the document's own title
    (titles: doc_id, title) before the first body chapter."""
    rows = chapters if titles is None else chapters.join(titles.select("doc_id", norm_role(c("title")).alias("__book")), "doc_id", "left")
    if titles is None:
        rows = rows.withColumn("__book", F.lit(""))
    title = norm_role(c("title"))
    marked = reduce(lambda a, b: a | b, (title.contains(m) for m in L.BACK_MARKERS))
    kind = F.lower(F.coalesce("div_type", F.lit("")))
    fixed = F.when(c("level") == "front", "front_matter").when(marked, "back_matter").when(kind.isin(L.BACK), "back_matter").when(kind.isin(L.FRONT), "front_matter")
    own = (F.coalesce("__book", F.lit("")) != "") & (title == c("__book"))
    rows = rows.withColumns({"__fixed": fixed, "__own": own})
    w = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((c("__fixed").isNull() & ~c("__own")).cast("int")).over(w) == 1, F.lit(False))
    return rows.withColumn("role", F.coalesce("__fixed", F.when(c("__own") & ~seen, "front_matter").otherwise("body"))).drop("__fixed", "__own", "__book")


def view(chapters: DataFrame, role: str) -> DataFrame:
    """The chapters of a role: body, front_matter or back_matter."""
    return chapters.where(c("role") == role)


def role_counts(chapters: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(c("role") == r).alias(r)
    return chapters.groupBy("doc_id").agg(count("front_matter"), count("body"), count("back_matter"))


def triage(chapters: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The chapters below the threshold, the weakest first within their document (weakness, from 1), with the document's totals."""
    w = Window.partitionBy("doc_id")
    rows = chapters.withColumns({"total": F.count(F.lit(1)).over(w), "weak": F.count_if(c("confidence") < threshold).over(w)}).where(c("confidence") < threshold)
    return rows.withColumn("weakness", F.row_number().over(w.orderBy("confidence", "ordinal")))


def containing(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Blocks with the ordinal of the chapter they are in: the last start at or before them, in one pass over each document."""
    starts = chapters.select("doc_id", c("start").alias("index"), "ordinal")
    marked = blocks.join(starts, ["doc_id", "index"], "left")
    w = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("ordinal", F.last("ordinal", ignorenulls=True).over(w))


def explanation(accepted_by: Column) -> Column:
    return F.struct("title", "index", "level", "div_type", "depth", "number", "confidence", "band", accepted_by.alias("accepted_by"), "fired")
