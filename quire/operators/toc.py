"""Contents: where they stand, what they list, and which blocks that is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.divisions import match_division
from ..functions.text import is_contents_line, lookup, norm_toc, strip, strip_page_number

c = F.col
# How like a heading must be to its entry, what a common beginning counts, and for entries of a contents field.
LIKE, BEGINS, FIELD_LIKE, CONTAINER_RANK = 0.72, 0.92, 0.9, 2


def regions(blocks: DataFrame) -> DataFrame:
    """(doc_id, toc_start, toc_end): from the first contents line or contents style to the last block of such a style, or, without
    styles, to the last of a run of short lines (14 words, no full stop) with four empty blocks between them at most."""
    styled = F.coalesce(c("style_id").isin(L.TOC_STYLES), F.lit(False))
    opens = styled | (c("is_paragraph") & is_contents_line(c("text")))
    start = blocks.where(opens).groupBy("doc_id").agg(F.min("index").alias("toc_start"))
    after = blocks.join(start, "doc_id").where(c("index") > c("toc_start"))
    last_styled = after.where(styled).groupBy("doc_id").agg(F.max("index").alias("__styled"))
    # the manual run ends at the first block that is neither empty nor short, or at a fifth empty block in a row
    w = Window.partitionBy("doc_id").orderBy("index")
    short = ~c("is_empty") & (c("word_count") <= 14) & ~c("text").endswith(".")
    filled = F.max(F.when(~c("is_empty"), c("index"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    blanks = c("index") - F.coalesce(filled, c("toc_start"))
    stops = F.when(c("is_empty"), blanks > 4).otherwise(~short)
    run = after.withColumn("__stops", stops).withColumn("__stopped", F.max(c("__stops").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    manual = run.where((c("__stopped") == 0) & short).groupBy("doc_id").agg(F.max("index").alias("__manual"))
    ends = start.join(last_styled, "doc_id", "left").join(manual, "doc_id", "left")
    return ends.select("doc_id", "toc_start", F.coalesce("__styled", "__manual", "toc_start").alias("toc_end"))


def entries(blocks: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, ord, title, norm, level): the lines of a contents region, without page numbers; level 0 for containers."""
    inside = blocks.join(of, "doc_id").where(c("index").between(c("toc_start"), c("toc_end")) & ~c("is_empty") & ~is_contents_line(c("text")))
    titled = inside.withColumn("title", strip(strip_page_number(c("text")))).where("title <> ''").withColumn("__m", match_division(c("title")))
    rank = F.coalesce(lookup(L.RANKS, c("__m.type")), F.lit(L.OTHER_RANK))
    container = c("__m.type").isNotNull() & (c("__m.role") != "matter") & (rank <= CONTAINER_RANK)
    return titled.select("doc_id", c("index").alias("ord"), "title", norm_toc(c("title")).alias("norm"), F.when(F.coalesce(container, F.lit(False)), 0).otherwise(1).alias("level"))


def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def align(wanted: list[dict], pool: list[dict]) -> list[dict]:
    """Entries to the headings after them in order: the likest heading not before the last match, if it is like enough."""
    out, at = [], 0
    for entry in wanted:
        best, place = 0.0, -1
        for k in range(at, len(pool)):
            a, b = entry["norm"], pool[k]["norm"]
            like = likeness(a, b)
            if a and (a.startswith(b) or b.startswith(a)):
                like = max(like, BEGINS)
            if like > best:
                best, place = like, k
        if best >= LIKE:
            out.append({"index": pool[place]["index"], "title": entry["title"], "level": entry["level"], "ratio": round(best, 3)})
            at = place + 1
    return out


def align_field(wanted: list[dict], pool: list[dict]) -> list[dict]:
    """Entries of a contents field to the first heading after the last match that is equal, begins alike or is very like."""
    pool = [p for p in pool if p["norm"]]
    top = min((p["level"] for p in pool), default=0)
    out, at = [], 0
    for entry in wanted:
        a = entry["norm"]
        for k in range(at, len(pool) if a else at):
            b = pool[k]["norm"]
            if b.startswith(a) or a.startswith(b) or likeness(a, b) >= FIELD_LIKE:
                out.append({"index": pool[k]["index"], "title": entry["title"], "level": 0 if pool[k]["level"] <= top else 1, "ratio": 1.0})
                at = k + 1
                break
    return out if len(out) >= 2 else []


_FOUND = pa.list_(pa.struct([("index", pa.int32()), ("title", pa.string()), ("level", pa.int32()), ("ratio", pa.float64())]))


def _aligned(of: DataFrame, pool: DataFrame, how: Callable[[list[dict], list[dict]], list[dict]]) -> DataFrame:
    """of: (doc_id, ord, title, norm, level); pool: (doc_id, index, norm, level). Lists of a document's entries and headings."""
    wanted = of.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "norm", "level"))).alias("wanted"))
    heads = pool.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "norm", "level"))).alias("pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], names=["doc_id", "found"])

    kind = of.schema["doc_id"].dataType.simpleString()
    made = wanted.join(heads, "doc_id").select("doc_id", "wanted", "pool").mapInArrow(run, f"doc_id {kind}, found array<struct<index:int,title:string,level:int,ratio:double>>")
    return made.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def match_to_body(of: DataFrame, candidates: DataFrame, region: DataFrame) -> DataFrame:
    """(doc_id, index, title, level, ratio) of the entries that a candidate after the contents is like."""
    pool = candidates.join(region, "doc_id").where(c("index") > c("toc_end")).select("doc_id", "index", "norm", F.lit(0).alias("level"))
    return _aligned(of, pool, align)


def resolve_field(field: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, index, title, level, ratio): titles of a contents field (doc_id, ord, title) at styled headings (doc_id, index,
    text, style_level); documents with fewer than two have none."""
    titled = field.withColumn("title", strip(strip_page_number(c("title")))).where((c("title") != "") & ~is_contents_line(c("title")))
    of = titled.select("doc_id", "ord", "title", norm_toc(c("title")).alias("norm"), F.lit(0).alias("level"))
    pool = headings.where((c("text") != "") & ~is_contents_line(c("text"))).select("doc_id", "index", norm_toc(c("text")).alias("norm"), c("style_level").alias("level"))
    return _aligned(of, pool, align_field)


def resolve_anchors(bookmarks: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, index, title, level): bookmarks (doc_id, index, anchor) with the title and level of the contents entry (doc_id, ord,
    anchor, title, level) that links there last; else the block's text and level 0. Documents need one of each."""
    last = links.groupBy("doc_id", "anchor").agg(F.max_by(F.struct("title", "level"), "ord").alias("e"))
    both = bookmarks.join(links.select("doc_id").distinct(), "doc_id", "left_semi").join(last, ["doc_id", "anchor"], "left")
    titled = both.join(blocks.select("doc_id", "index", "text"), ["doc_id", "index"], "left")
    return titled.select("doc_id", "index", F.coalesce(F.nullif("e.title", F.lit("")), "text", F.lit("")).alias("title"), F.coalesce("e.level", F.lit(0)).alias("level"))


def resolve_hrefs(nav: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, index, title, level): navigation entries (doc_id, ord, title, level, href) at blocks.

    files: (doc_id, file, index) with the first block of each file; anchors: (doc_id, file, anchor, index). A file is found by
    its whole name, else by its last part; an anchor that isn't there falls back to the file's first block. Of entries at one
    block the highest stays; documents with fewer than two have none.
    """
    decode = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    base = lambda x: F.regexp_replace(x, "^.*/", "")
    split = nav.withColumns({"__file": decode(F.substring_index("href", "#", 1)), "__anchor": F.when(c("href").contains("#"), decode(F.regexp_replace("href", "^[^#]*#", "")))})
    names = files.groupBy("doc_id", "file").agg(F.min("index").alias("index"))
    short = names.groupBy("doc_id", base(c("file")).alias("__name")).agg(F.min_by("file", "index").alias("__short"))
    found = split.join(names.select("doc_id", c("file").alias("__file"), c("file").alias("__whole")), ["doc_id", "__file"], "left").withColumn("__name", base(c("__file")))
    found = found.join(short, ["doc_id", "__name"], "left").withColumn("file", F.coalesce("__whole", "__short")).where(c("file").isNotNull() & (c("__file") != ""))
    at = anchors.groupBy("doc_id", "file", c("anchor").alias("__anchor")).agg(F.min("index").alias("__at"))
    placed = found.join(at, ["doc_id", "file", "__anchor"], "left").join(names.select("doc_id", "file", c("index").alias("__first")), ["doc_id", "file"], "left")
    resolved = placed.withColumn("index", F.coalesce("__at", "__first")).where("index is not null")
    n = F.row_number().over(Window.partitionBy("doc_id", "index").orderBy("level", "ord"))
    one = resolved.withColumn("__n", n).where("__n = 1")
    enough = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) >= 2
    return one.withColumn("__enough", enough).where("__enough").select("doc_id", "index", "title", "level")
