"""Blocks from text and web pages with built-in functions only.

A block is one paragraph-level piece of a document: doc_id, index (from 0), and what detection needs to know of it (COLUMNS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, strip, word_count

COLUMNS = (
    "doc_id BIGINT, index INT, tag STRING, is_paragraph BOOLEAN, is_table BOOLEAN, text STRING, is_empty BOOLEAN, word_count INT, style_id STRING, "
    "style_level INT, bold BOOLEAN, all_caps_prop BOOLEAN, max_size INT, alignment STRING, page_break_before BOOLEAN, num STRUCT<num_id: INT, ilvl: INT>, "
    "anchor_id STRING, starts_page BOOLEAN, starts_section BOOLEAN, starts_spine BOOLEAN, is_isolated BOOLEAN"
)
_DEFAULTS = {"style_id": "string", "style_level": "int", "max_size": "int", "alignment": "string", "num": "struct<num_id:int,ilvl:int>", "anchor_id": "string"}
_FLAGS = ("is_table", "bold", "all_caps_prop", "page_break_before", "starts_page", "starts_section", "starts_spine", "is_isolated")

# The kinds of HTML elements.
PARAGRAPHS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre"]
CONTAINERS = ["div", "section", "article", "main"]
WHOLE = ["nav", "ul", "ol", "dl", "footer", "header", "aside", "form", "figure"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def completed(blocks: DataFrame) -> DataFrame:
    """All columns of a block; those that the source doesn't have are null, or false for flags."""
    have = set(blocks.columns)
    extra = {c: F.lit(None).cast(t) for c, t in _DEFAULTS.items() if c not in have} | {c: F.lit(False) for c in _FLAGS if c not in have}
    wide = blocks.withColumns(extra) if extra else blocks
    return wide.select(*(F.col(c.strip().split(" ")[0]) for c in COLUMNS.replace("STRUCT<num_id: INT, ilvl: INT>", "X").split(",")))


def isolation(blocks: DataFrame, key: str = "doc_id", order: str = "index") -> DataFrame:
    """is_isolated: a paragraph of 12 words at most after an empty block, with one of over 16 words among the next three."""
    w = Window.partitionBy(key).orderBy(order)
    after = F.max(F.col("is_paragraph") & (F.col("word_count") > 16)).over(w.rowsBetween(1, 3))
    short = F.col("is_paragraph") & ~F.col("is_empty") & (F.col("word_count") <= 12)
    return blocks.withColumn("is_isolated", short & F.coalesce(F.lag("is_empty").over(w), F.lit(False)) & F.coalesce(after, F.lit(False)))


def blocks_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A block for each line. Null texts have none; an empty text is one empty block."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("index", "line"))
    made = lines.select("doc_id", "index", F.lit("p").alias("tag"), F.lit(True).alias("is_paragraph"), strip("line").alias("text"))
    return completed(made.withColumns({"is_empty": F.col("text") == "", "word_count": word_count(F.col("text"))}))


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def inner_text(html: Column) -> Column:
    """The text between tags, pieces joined by a space."""
    return collapse(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def html_pieces(html: Column) -> Column:
    """Of the body, without comments, scripts and styles: the pieces that begin with a start tag of block level.

    Elements that aren't descended (lists, navigation, footers) become one piece without text. A piece goes up to the next
    start or end tag of block level, also where a paragraph isn't closed.
    """
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>", "")
    body = F.regexp_replace(body, r"(?is)^.*?<body\b[^>]*>", "")
    for tag in WHOLE:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", f"<{tag}></{tag}>")
    tags = "|".join([*PARAGRAPHS, "table", *CONTAINERS, *WHOLE])
    cut = F.regexp_replace(body, rf"(?i)<(/?)({tags})\b", "\x01<$1$2")
    return F.filter(F.split(cut, "\x01", -1), lambda x: x.rlike(r"^<[a-zA-Z]"))


def blocks_from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", doc: Column | None = None, item: Column | None = None) -> DataFrame:
    """A block for each block element of the pages of a document, the pages in the order of item (each a document's part).

    doc: which document a page belongs to (by default each its own). Containers that hold block elements are descended, other
    elements than paragraphs and tables have no text. h1 to h6 have the style levels 0 to 5; the first block of a page
    starts a part of the spine.
    """
    own = pages.select((F.col(id_col) if doc is None else doc).alias("doc_id"), (F.col(id_col) if item is None else item).alias("item"), html_pieces(F.col(html_col)).alias("pieces"))
    rows = own.select("doc_id", "item", F.posexplode(F.expr("transform(pieces, (x, i) -> struct(x AS html, get(pieces, i + 1) AS next))")).alias("place", "piece"))
    rows = rows.select("doc_id", "item", "place", F.col("piece.html").alias("html"), F.col("piece.next").alias("next")).withColumn("tag", F.lower(F.regexp_extract("html", r"^<([a-zA-Z0-9]+)", 1)))
    inside = F.coalesce(inner_text(F.col("html")) == "", F.lit(True)) & F.col("next").isNotNull() & ~F.lower(F.regexp_extract("next", r"^<([a-zA-Z0-9]+)", 1)).isin(WHOLE)
    rows = rows.where(~(F.col("tag").isin(CONTAINERS) & inside))
    paragraph = F.col("tag").isin(PARAGRAPHS)
    text = F.when(paragraph | (F.col("tag") == "table"), inner_text(F.col("html"))).otherwise("")
    w = Window.partitionBy("doc_id").orderBy("item", "place")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int") - 1)
    made = rows.withColumn("text", text).select(
        "doc_id",
        (F.row_number().over(w) - 1).alias("index"),
        "tag",
        paragraph.alias("is_paragraph"),
        (F.col("tag") == "table").alias("is_table"),
        "text",
        (F.col("text") == "").alias("is_empty"),
        word_count(F.col("text")).alias("word_count"),
        level.alias("style_level"),
        F.col("html").rlike(r"(?i)<(b|strong)\b").alias("bold"),
        F.nullif(F.regexp_extract("html", r"""(?i)^<[a-z0-9]+[^>]*?\bid\s*=\s*["']?([^"'\s>]+)""", 1), F.lit("")).alias("anchor_id"),
        (F.row_number().over(Window.partitionBy("doc_id", "item").orderBy("place")) == 1).alias("starts_spine"),
    )
    return completed(isolation(made))
