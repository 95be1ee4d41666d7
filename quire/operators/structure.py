"""The levels of divisions among candidates, and the level at which a document splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.divisions import match_division
from ..functions.text import lookup
from ..sources.tables import written

c = F.col
# What counts in favour of a level, and when a choice is doubtful.
FREQUENCY, PROGRESSION, REGULARITY, CONTENTS = 0.35, 0.30, 0.20, 0.15
DOUBTFUL, CLOSE = 0.45, 0.08
MOST_TITLES = 20_000


def divided(rows: DataFrame, title: str = "title", most: int = MOST_TITLES) -> DataFrame:
    """Adds division, the title's. Up to `most` different titles are each looked at once and broadcast; beyond that every row's is
    looked at by itself. The rows are read twice, so they should be cheap to make."""
    few = written(rows.select(title).distinct().limit(most + 1), "titles")
    if few.count() > most:
        return rows.withColumn("division", match_division(c(title)))
    known = written(few.select(c(title).alias("__title"), match_division(c(title)).alias("division")), "divisions")
    return rows.join(F.broadcast(known), c(title).eqNullSafe(c("__title")), "left").drop("__title")


def classify(candidates: DataFrame, title: str = "title") -> DataFrame:
    """Adds div_type, rank, number, system, is_matter: by the title's label or number (division, if it is there), else by its
    style level."""
    m = c("division") if "division" in candidates.columns else match_division(c(title))
    rows = candidates.withColumn("__m", m)
    bare = c("__m.role") == "bare"
    styled = F.when(F.coalesce(c("style_level"), F.lit(0)) == 0, "chapter").otherwise("section")
    kind = F.when(c("__m").isNull(), styled).when(bare, "unit").otherwise(c("__m.type"))
    matter = F.coalesce(~bare & ((c("__m.role") == "matter") | c("__m.type").isin(L.MATTER)), F.lit(False))
    rows = rows.withColumns({"div_type": kind, "number": c("__m.number"), "system": c("__m.system"), "is_matter": matter})
    return rows.withColumn("rank", F.when(c("div_type") == "unit", 3).otherwise(F.coalesce(lookup(L.RANKS, c("div_type")), F.lit(L.OTHER_RANK)))).drop("__m")


def depths(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """depth: the ranks that a document has, without holes, from 0."""
    return candidates.withColumn("depth", F.dense_rank().over(Window.partitionBy(key).orderBy("rank")) - 1)


def progression(df: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """(keys, progression): of consecutive numbers, the share that goes up by one or back to one; 0.5 with fewer than two."""
    last = F.lag(number).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.where(c(number).isNotNull()).withColumn("__last", last)
    good = ((c(number) == c("__last") + 1) | (c(number) == 1)).cast("double")
    return steps.groupBy(*keys).agg(F.coalesce(F.avg(F.when(c("__last").isNotNull(), good)), F.lit(0.5)).alias("progression"))


def regularity(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, count, regularity): 1 / (1 + deviation over mean) of the distances; 0.5 with fewer than three rows, 0 if all are 0."""
    gap = F.lead(order).over(Window.partitionBy(*keys).orderBy(order)) - c(order)
    per = df.withColumn("__gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg("__gap").alias("__mean"), F.stddev_pop("__gap").alias("__sd"))
    value = F.when(c("count") < 3, 0.5).when(c("__mean") == 0, 0.0).otherwise(1 / (1 + c("__sd") / F.nullif(c("__mean"), F.lit(0.0))))
    return per.select(*keys, "count", value.alias("regularity"))


def levels(candidates: DataFrame) -> DataFrame:
    """A row for each document and type that isn't front or back matter: count, progression, regularity, numbering, toc_aligned."""
    body = candidates.where(~c("is_matter"))
    keys = ["doc_id", "div_type"]
    counts = regularity(body, keys, "index").withColumn("regularity", F.round("regularity", 3))
    more = body.groupBy(*keys).agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("system")).alias("__systems"), F.round(F.avg(c("in_toc").cast("double")), 3).alias("toc_aligned"))
    steps = progression(body, keys, "index", "number").withColumn("progression", F.round("progression", 3))
    named = F.when(F.size("__systems") == 0, F.array(F.lit("named"))).otherwise(c("__systems"))
    return counts.join(more, keys).join(steps, keys, "left").withColumns({"progression": F.coalesce("progression", F.lit(0.5)), "numbering": named}).drop("__systems")


def real_levels(of: DataFrame) -> DataFrame:
    """(doc_id, div_type) of the levels that form a series; numbers by themselves need more of one."""
    series = (c("count") >= 2) & ((c("progression") >= 0.5) | (c("regularity") >= 0.5) | (c("toc_aligned") >= 0.3))
    bare = (c("count") >= 3) & (c("progression") >= 0.6)
    return of.where(F.when(c("div_type") == "unit", bare).otherwise(series) | (c("toc_aligned") >= 0.3)).select("doc_id", "div_type")


def prune_levels(candidates: DataFrame) -> DataFrame:
    """Without candidates of levels that aren't real; matter stays, and all of documents whose contents are authoritative."""
    real = real_levels(levels(candidates)).withColumn("__real", F.lit(True))
    kept = candidates.join(real, ["doc_id", "div_type"], "left")
    return kept.where(c("is_matter") | c("toc_authoritative") | F.coalesce(c("__real"), F.lit(False))).drop("__real")


def split_score() -> Column:
    most = F.max("count").over(Window.partitionBy("doc_id"))
    return F.round(FREQUENCY * c("count") / most + PROGRESSION * c("progression") + REGULARITY * c("regularity") + CONTENTS * c("toc_aligned"), 4)


def split_levels(of: DataFrame, has_toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, split_level, split_rank, split_score, confidence, margin, hierarchy, flags): the level with the highest score.

    Of equal scores the deeper rank, then the type by name. A volume counts as rank 3 when splitting, as ever.
    """
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("rank"), "div_type")
    scored = of.withColumn("score", split_score()).withColumns({"__n": F.row_number().over(w), "__next": F.lead("score").over(w)})
    hierarchy = scored.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "div_type"))), lambda x: F.initcap(x["div_type"])), " > ").alias("hierarchy"))
    best = scored.where("__n = 1").join(hierarchy, "doc_id")
    toc = best.withColumn("__toc", F.lit(False)) if has_toc is None else best.join(has_toc.select("doc_id", F.lit(True).alias("__toc")), "doc_id", "left")
    confidence = F.round(F.least(F.lit(1.0), 0.6 * c("score") + 0.4 * c("progression")), 3)
    rows = toc.withColumns({"margin": F.round(c("score") - F.coalesce("__next", F.lit(0.0)), 4), "confidence": confidence})
    flags = F.array_compact(
        F.array(
            F.when(c("__next").isNotNull() & (c("margin") < CLOSE), "ambiguous_split_level"),
            F.when(c("confidence") < DOUBTFUL, "low_split_confidence"),
            F.when((c("progression") < 0.5) & ~F.coalesce("__toc", F.lit(False)), "broken_numbering_progression"),
        )
    )
    return rows.select("doc_id", c("div_type").alias("split_level"), c("rank").alias("split_rank"), c("score").alias("split_score"), "confidence", "margin", "hierarchy", F.array_join(flags, ",").alias("flags"))
