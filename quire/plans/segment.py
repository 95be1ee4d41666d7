"""From blocks to chapters: the whole plan for a corpus of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm_title
from ..operators import assemble, decide, features, signals, structure, toc
from ..operators.candidates import gated, merge_runs
from ..sources.tables import written

c = F.col
WHOLE, AUTHORITY = "(whole document)", 5


@dataclass(frozen=True)
class Plan:
    """chapters: a row for each chapter. plans: a row for each document (abstained, reason, method, threshold and so on)."""

    chapters: DataFrame
    plans: DataFrame


def _toc_candidates(matched: DataFrame) -> DataFrame:
    norm = norm_title(c("title"))
    return matched.select(
        "doc_id",
        "index",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"),
        norm.alias("norm"),
        F.when(c("level") == 0, "part").otherwise("chapter").alias("level"),
        F.round(0.6 + 0.4 * c("ratio"), 3).alias("confidence"),
        F.create_map(F.lit("TOC_MATCH"), F.lit(1.0)).alias("fired"),
        F.when(c("level") == 0, 0).alias("style_level"),
        F.lit(True).alias("in_toc"),
        F.lit(True).alias("toc_authoritative"),
        F.lit(None).cast("int").alias("toc_start"),
        F.lit(None).cast("int").alias("toc_end"),
    )


def scored_candidates(blocks: DataFrame, matched: DataFrame | None = None, region: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """Candidates with their signals' confidence; those inside the contents and those without any confidence are left out."""
    merged = merge_runs(written(gated(blocks, features.sizes(blocks), fallback), "gated"))
    return _scored(merged, matched, region)


def _scored(merged: DataFrame, matched: DataFrame | None, region: DataFrame | None) -> DataFrame:
    rows = merged
    if matched is not None:
        rows = rows.join(matched.select("doc_id", "index", F.lit(True).alias("in_toc")).distinct(), ["doc_id", "index"], "left")
        rows = rows.withColumn("in_toc", F.coalesce("in_toc", F.lit(False)))
    else:
        rows = rows.withColumn("in_toc", F.lit(False))
    if region is not None:
        rows = rows.join(region, "doc_id", "left").where(~F.coalesce(c("index").between(c("toc_start"), c("toc_end")), F.lit(False)))
    else:
        rows = rows.withColumns({"toc_start": F.lit(None).cast("int"), "toc_end": F.lit(None).cast("int")})
    scored = written(signals.score(written(rows, "looked-up")).drop("division", "families"), "scored").where("confidence > 0")
    title = F.coalesce(F.nullif("text", F.lit("")), F.lit("(untitled)"))
    return scored.select("doc_id", "index", title.alias("title"), "norm", "level", "confidence", "fired", "style_level", "in_toc", F.lit(False).alias("toc_authoritative"), "toc_start", "toc_end")


def decisions(candidates: DataFrame, level: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(boundaries, one row for each document with candidates): headers, levels, threshold, validators in their order, abstention."""
    rows = written(structure.classify(decide.drop_repeated(candidates)), "classified")
    rows = written(structure.depths(structure.prune_levels(rows)), "levels")
    has_toc = rows.where("in_toc").select("doc_id").distinct()
    split = written(structure.split_levels(structure.levels(rows), has_toc), "split")
    auth = c("toc_authoritative")
    cut = decide.adaptive_threshold(rows.where(~auth))
    passed = rows.join(cut.select("doc_id", "accept", "method", "separation"), "doc_id", "left").where(auth | (c("confidence") >= c("accept")))
    passed = passed.withColumns({"accept": F.when(auth, 0.0).otherwise(c("accept")), "method": F.when(auth, "toc_authority").otherwise(c("method"))})
    kept = written(decide.prune_numbering(decide.min_distance(decide.drop_duplicates(passed))), "kept")
    wrong = decide.violations(kept)
    final = decide.keep_split_level(decide.guard_oversplit(kept), split)
    counted = final.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gated"))
    docs = candidates.groupBy("doc_id").agg(F.max("toc_authoritative").alias("toc_authoritative"))
    docs = docs.join(cut, "doc_id", "left").join(split, "doc_id", "left").join(wrong.select("doc_id", c("hierarchy").alias("hierarchy_violations"), c("numbering").alias("numbering_violations"), c("act_scene").alias("act_scene_violations"), c("toc").alias("toc_contradictions")), "doc_id", "left")
    docs = docs.join(counted, "doc_id", "left").withColumn("n_gated", F.coalesce("n_gated", F.lit(0)))
    n, separation = c("n_gated"), F.coalesce("separation", F.lit(0.0))
    loose = ~auth & (separation < decide.DOMINANT_GAP)
    contradicts = F.coalesce(c("toc_contradictions") > decide.CONTENTS, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(c("split_level").isNull(), "no_structure_discovered"),
            F.when(loose, "insufficient_confidence_separation"),
            F.when(n < 2, "too_few_validated_boundaries"),
            F.when(~auth & F.coalesce(c("hierarchy_violations") > decide.HIERARCHY, F.lit(False)), "inconsistent_hierarchy"),
            F.when(contradicts, "contradictory_toc_alignment"),
        )
    )
    abstains = (n < 2) | (~auth & ((loose & (n < 3)) | contradicts))
    method = F.when(auth, "toc_authority").otherwise(F.coalesce("method", F.lit("empty")))
    docs = docs.withColumns({"method": method, "__reasons": reasons, "__abstains": abstains})
    levelled = decide.filter_level(final, level)
    left = levelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_boundaries"))
    docs = docs.join(left, "doc_id", "left").withColumn("n_boundaries", F.coalesce("n_boundaries", F.lit(0)))
    docs = docs.withColumns({"abstained": c("__abstains") | (c("n_boundaries") < 2), "reason": F.coalesce(F.nullif(F.array_join("__reasons", "; "), F.lit("")), F.lit("insufficient validated structure"))})
    by = F.when(auth, "toc_authority").otherwise(F.concat(F.lit("score>="), c("accept").cast("string"), F.lit(" via "), c("method")))
    explained = levelled.withColumn("band", signals.band(c("confidence"))).withColumn("explanation", assemble.explanation(by))
    explained = written(explained, "boundaries")
    return explained, docs.drop("__reasons", "__abstains", "toc_authoritative")


def segment(blocks: DataFrame, toc_entries: DataFrame | None = None, titles: DataFrame | None = None, level: str = "auto", fallback: bool = True) -> Plan:
    """Chapters and plans of all documents of the blocks.

    Tables of candidates are written between the steps (they are small beside the blocks, of which the plan makes a few scans;
    blocks that are costly to make should be written before).

    toc_entries: (doc_id, index, title, level) where the source knows them; documents without any have their contents looked
    for in the text. titles: (doc_id, title). level: part, chapter or section keeps boundaries of that level only.
    fallback: whether documents with fewer than two precise candidates get structural ones (see gated).
    """
    totals = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_blocks"))
    bands = features.sizes(blocks)
    merged = written(merge_runs(written(gated(blocks, bands, fallback), "gated")), "merged")
    region = toc.regions(blocks)
    if toc_entries is not None:
        region = region.join(toc_entries, "doc_id", "left_anti")
    region = written(region, "regions")
    listed = written(toc.entries(blocks, region), "entries")
    found = written(toc.match_to_body(listed, merged, region), "found")
    n_entries = listed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    strong = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).join(n_entries, "doc_id").where((c("k") >= AUTHORITY) & (c("k") >= 0.5 * c("n"))).select("doc_id")
    matched = found
    if toc_entries is not None:
        given = toc_entries.select("doc_id", "index", F.coalesce("title", F.lit("")).alias("title"), "level", F.lit(1.0).alias("ratio"))
        matched = found.unionByName(given)
        strong = strong.unionByName(given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("doc_id"))
    authoritative = _toc_candidates(matched.join(strong, "doc_id", "left_semi"))
    lists = features.list_starts(blocks).join(strong, "doc_id", "left_anti")
    scored = _scored(merged.join(strong, "doc_id", "left_anti"), matched, region)
    lists = written(lists, "lists")
    candidates = written(scored.unionByName(authoritative).join(lists.select("doc_id").distinct(), "doc_id", "left_anti"), "candidates")
    boundaries, docs = decisions(candidates, level)
    plans = totals.join(bands, "doc_id", "left").join(docs, "doc_id", "left").join(lists.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_list")), "doc_id", "left")
    listed_doc = c("n_list").isNotNull()
    plans = plans.withColumns(
        {
            "abstained": F.when(listed_doc, False).otherwise(F.coalesce("abstained", F.lit(True))),
            "method": F.when(listed_doc, "list_numbering").otherwise(F.coalesce("method", F.lit("empty"))),
            "reason": F.when(listed_doc, F.lit(None)).when(c("reason").isNull(), "no_structure_discovered; insufficient_confidence_separation; too_few_validated_boundaries").otherwise(c("reason")),
        }
    ).withColumn("reason", F.when(c("abstained"), c("reason"))).drop("n_list")
    split = boundaries.join(plans.where(~c("abstained")).select("doc_id"), "doc_id", "left_semi")
    by_list = lists.join(blocks.select("doc_id", "index", "text"), ["doc_id", "index"])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("index"))
    by_list = by_list.withColumn("__n", nth).select(
        "doc_id",
        "index",
        F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("Section "), c("__n").cast("string"))).alias("title"),
        F.lit("chapter").alias("level"),
        F.lit(0.80).alias("confidence"),
        F.create_map(F.lit("LIST_NUMBERED"), F.lit(1.0)).alias("fired"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("div_type"),
        F.lit(None).cast("bigint").alias("number"),
        F.lit(None).cast(split.schema["explanation"].dataType).alias("explanation"),
    )
    cut = split.select(*by_list.columns).unionByName(by_list)
    chapters = assemble.roles(assemble.ranges(cut, totals), titles)
    whole = plans.where("abstained").select("doc_id", F.lit(WHOLE).alias("title"), F.lit(0).alias("start"), c("n_blocks").alias("end"), F.lit("chapter").alias("level"), F.lit(0.0).alias("confidence"), F.lit(0).alias("ordinal"), F.lit("body").alias("role"))
    return Plan(chapters.unionByName(whole, allowMissingColumns=True), plans)
