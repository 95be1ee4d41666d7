"""Queries of single rules over rows of the tables that are made to show all their cases, and their SQL, written from the rules.

The tables give numbers; titles, labels and layout follow from them in the same way on both sides. What the SQL says of a title
(its division, rank or which signals see it) is stated for each kind of title, not computed by the lexicon.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decide, signals, structure, toc
from ..sources.tables import written

c = F.col
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def _pick(n: Column, of: tuple) -> Column:
    return reduce(lambda a, kv: a.when(n == kv[0], kv[1]), enumerate(of[1:], 1), F.when(n == 0, of[0]))


# -- signals ------------------------------------------------------------------------------------------------------------------

#: Titles; by kind: words, chapter line, part line, numeric line, Roman line, labelled, capitals, ends a sentence.
LINES = (
    ("Chapter 4", 2, 1, 0, 0, 0, 1, 0, 0),
    ("Part Two", 2, 0, 1, 0, 0, 1, 0, 0),
    ("12. The mill", 3, 0, 0, 1, 0, 0, 0, 0),
    ("IV", 1, 0, 0, 0, 1, 0, 1, 0),
    ("The old mill by the river", 6, 0, 0, 0, 0, 0, 0, 0),
    ("It was a long day, and nobody came home before it was dark.", 13, 0, 0, 0, 0, 0, 0, 1),
    ("THE MILL", 2, 0, 0, 0, 0, 0, 1, 0),
    ("Chapter ix and more", 4, 1, 0, 0, 0, 1, 0, 0),
    ("it was late and the wind came over the hills from the sea so nobody went out to look", 18, 0, 0, 0, 0, 0, 0, 0),
    ("II.", 1, 0, 0, 0, 1, 2, 1, 1),
)


def seg_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals, families, confidence, level and band over a candidate for each row of lineitem."""
    kind = (c("l_partkey") + c("l_linenumber")) % len(LINES)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        _pick(kind, tuple(x[0] for x in LINES)).alias("text"),
        _pick(kind, tuple(x[1] for x in LINES)).alias("word_count"),
        (c("l_partkey") % 10 == 0).alias("in_toc"),
        F.when(c("l_suppkey") % 4 < 2, c("l_suppkey") % 4).cast("int").alias("style_level"),
        F.when(c("l_quantity") % 7 == 0, "MyChapterTitle").otherwise("Normal").alias("style_id"),
        F.when(c("l_quantity") < 5, 0).otherwise(c("l_quantity")).cast("int").alias("max_size"),
        F.lit(20).alias("band_low"),
        F.lit(30).alias("band_high"),
        F.when(c("l_returnflag") == "R", "center").otherwise("left").alias("alignment"),
        (c("l_linestatus") == "O").alias("bold"),
        (c("l_suppkey") % 11 == 0).alias("all_caps_prop"),
        (c("l_linenumber") == 4).alias("page_break_before"),
        (c("l_linenumber") == 5).alias("starts_page"),
        (c("l_linenumber") == 3).alias("starts_section"),
        (c("l_linenumber") == 1).alias("starts_spine"),
        (c("l_linenumber") == 2).alias("is_isolated"),
    )
    found = signals.score(structure.divided(rows, "text"))
    names = F.array_join(F.array_sort(F.map_keys("fired")), ",")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "confidence", "level", "band", *(c(f"families.{f}").alias(f) for f in signals.FAMILIES), names.alias("fired"), F.round(F.aggregate(F.map_values("fired"), F.lit(0.0), lambda a, x: a + x), 3).alias("strength"))


_KINDS = ", ".join(f"({k}, '{t[0]}', {', '.join(map(str, t[1:]))})" for k, t in enumerate(LINES))
_FIRED = {  # strength times weight
    "TOC_MATCH": "CASE WHEN l_partkey % 10 = 0 THEN 1.0 * 0.97 ELSE 0 END",
    "HEADING_STYLE": "CASE l_suppkey % 4 WHEN 0 THEN 1.0 * 0.90 WHEN 1 THEN 0.55 * 0.90 ELSE 0 END",
    "OUTLINE_LEVEL": "CASE WHEN l_suppkey % 4 = 0 THEN 0.6 * 0.85 ELSE 0 END",
    "CUSTOM_CHAPTER_STYLE": "CASE WHEN l_quantity % 7 = 0 THEN 1.0 * 0.90 ELSE 0 END",
    "CHAPTER_KEYWORD": "CASE WHEN chapter = 1 THEN 1.0 * 0.95 ELSE 0 END",
    "PART_KEYWORD": "CASE WHEN part = 1 THEN 1.0 * 0.80 ELSE 0 END",
    "DIVISION_LABEL": "CASE label WHEN 1 THEN 1.0 * 0.88 WHEN 2 THEN 0.6 * 0.88 ELSE 0 END",
    "NUMERIC_CHAPTER": "CASE WHEN numeric_ = 1 THEN 0.6 * 0.55 ELSE 0 END",
    "ROMAN_NUMERAL": "CASE WHEN roman = 1 THEN 0.9 * 0.50 ELSE 0 END",
    "FONT_SIZE": "CASE WHEN l_quantity < 5 OR l_quantity < 20 THEN 0 WHEN l_quantity <= 30 THEN 1.0 * 0.62 ELSE 0.2 * 0.62 END",
    "CENTERED": "CASE WHEN l_returnflag = 'R' THEN 0.6 * 0.32 ELSE 0 END",
    "ALL_CAPS": "CASE WHEN caps = 1 OR l_suppkey % 11 = 0 THEN 0.7 * 0.30 ELSE 0 END",
    "BOLD": "CASE WHEN l_linestatus = 'O' THEN 1.0 * 0.28 ELSE 0 END",
    "SHORT_TEXT": "CASE WHEN words <= 12 AND ends = 0 THEN 0.5 * 0.20 ELSE 0 END",
    "PAGE_BREAK_BEFORE": "CASE WHEN l_linenumber IN (4, 5) THEN 0.8 * 0.48 ELSE 0 END",
    "SECTION_BREAK": "CASE WHEN l_linenumber = 3 THEN 0.7 * 0.48 ELSE 0 END",
    "SPINE_START": "CASE WHEN l_linenumber = 1 THEN 0.8 * 0.48 ELSE 0 END",
    "ISOLATION": "CASE WHEN l_linenumber = 2 THEN 0.6 * 0.40 ELSE 0 END",
}
_GROUPS = {"authority": 4, "lexical": 5, "typographic": 5, "layout": 4}
_names, _strongest = [*_FIRED], {}
for _family, _n in _GROUPS.items():
    _strongest[_family], _names = _names[:_n], _names[_n:]
_SIGNALS = f"""
WITH kinds(kind, title, words, chapter, part, numeric_, roman, label, caps, ends) AS (VALUES {_KINDS}),
x AS (SELECT lineitem.*, kinds.* FROM lineitem JOIN kinds ON kind = (l_partkey + l_linenumber) % {len(LINES)}),
y AS (SELECT *, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _FIRED.items())} FROM x),
z AS (SELECT *, {", ".join(f"greatest({', '.join(v)}) AS {k}" for k, v in _strongest.items())},
      list_sort([n FOR n IN [{", ".join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in _FIRED)}] IF n IS NOT NULL]) AS names FROM y),
w AS (SELECT *, round((1 - (1 - authority) * (1 - lexical) * (1 - typographic) * (1 - layout)) * CASE WHEN words > 8 AND ends = 1 THEN CAST(0.4 AS DOUBLE) ELSE 1 END * CASE WHEN words > 16 THEN CAST(0.3 AS DOUBLE) ELSE 1 END, 3) AS confidence FROM z)
SELECT l_orderkey, l_linenumber, l_partkey, confidence,
       CASE WHEN part = 1 THEN 'part' WHEN l_partkey % 10 = 0 OR chapter = 1 OR l_quantity % 7 = 0 OR FONT_SIZE > 0 OR l_suppkey % 4 = 0 THEN 'chapter' ELSE 'section' END AS level,
       CASE WHEN confidence >= 0.90 THEN 'very_high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band,
       round(authority, 4) AS authority, round(lexical, 4) AS lexical, round(typographic, 4) AS typographic, round(layout, 4) AS layout,
       array_to_string(names, ',') AS fired, round({" + ".join(f"round({k}, 3)" for k in _FIRED)}, 3) AS strength FROM w"""

# -- levels -------------------------------------------------------------------------------------------------------------------

#: Kinds of headings: title (n, r: its number, Arabic or Roman), type, rank, number's system, matter.
HEADS = (
    ("Chapter {n}", "chapter", 3, "arabic", False),
    ("Part {r}", "part", 2, "roman", False),
    ("{n}.", "unit", 3, "arabic", False),
    ("Volume {n}", "volume", 0, "arabic", False),
    ("Act {r}", "act", 2, "roman", False),
    ("Scene {n}", "scene", 4, "arabic", False),
    ("Prologue", "prologue", 3, None, True),
    ("Winter light", None, None, None, False),
    ("Book {n}", "book", 1, "arabic", False),
    ("Section {r}", "section", 4, "roman", False),
)
DOCS = 211


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading for each row of orders; documents have three kinds each, numbers in series with slips."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (c("o_custkey") % DOCS).cast("long").alias("doc_id"))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    rows = orders.withColumn("k", row).withColumn("kind", ((c("doc_id") + c("k") % 3) % len(HEADS)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("k"))
    rows = rows.withColumn("n", F.when(c("o_orderkey") % 17 == 0, 1).when(c("doc_id") % 5 == 0, c("o_orderkey") % 12 + 1).otherwise((nth - 1) % 12 + 1).cast("int"))

    def titled(form: str) -> Column:
        before, *after = form.replace("{r}", "{n}").split("{n}")
        number = _pick(c("n") - 1, ROMAN) if "{r}" in form else c("n").cast("string")
        return F.concat(F.lit(before), number, F.lit(after[0])) if after else F.lit(form)

    return rows.select(
        "doc_id",
        (c("k") * 3 + c("o_orderkey") % 3).cast("int").alias("index"),
        _pick(c("kind"), tuple(titled(h[0]) for h in HEADS)).alias("title"),
        F.when(c("o_orderkey") % 3 == 0, 1).cast("int").alias("style_level"),
        (c("o_orderkey") % 4 == 0).alias("in_toc"),
        (c("doc_id") % 50 == 0).alias("toc_authoritative"),
        F.when(c("doc_id") % 2 == 0, 10).alias("toc_start"),
        F.when(c("doc_id") % 2 == 0, 40).alias("toc_end"),
        _pick(c("kind") % 3, ("part", "chapter", "section")).alias("level"),
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.depths(structure.classify(structure.divided(written(heads(spark, sf_dir), "heads")))).drop("division")


def seg_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "index", "title", "div_type", "rank", "depth", c("number").cast("long").alias("number"), "system", "is_matter")


def seg_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.levels(_classified(spark, sf_dir)).select("doc_id", "div_type", c("count").alias("n"), "rank", "progression", "regularity", "toc_aligned", F.array_join("numbering", ",").alias("numbering"))


def seg_real_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.prune_levels(_classified(spark, sf_dir)).select("doc_id", "index", "div_type")


def seg_split_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    found = structure.split_levels(structure.levels(rows), rows.where("toc_authoritative").select("doc_id").distinct())
    return found.select("doc_id", "split_level", "split_rank", "split_score", "confidence", "margin", "hierarchy", "flags")


def seg_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.violations(_classified(spark, sf_dir)).select("doc_id", c("hierarchy").alias("orphans"), "numbering", "act_scene", "toc")


def seg_kept_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return decide.keep_split_level(rows, structure.split_levels(structure.levels(rows))).select("doc_id", "index")


def seg_filtered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(heads(spark, sf_dir), "heads")
    return reduce(DataFrame.unionByName, (decide.filter_level(rows, level).select(F.lit(level).alias("wanted"), "doc_id", "index", "level") for level in ("auto", "part", "chapter", "section")))


def _sql(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_ROMAN = "[" + ", ".join(f"'{r}'" for r in ROMAN) + "]"
_HEAD_KINDS = ", ".join("(" + ", ".join(map(_sql, (k, *h))) + ")" for k, h in enumerate(HEADS))
_HEADS = f"""
kinds(kind, form, type, rank_, system_, matter) AS (VALUES {_HEAD_KINDS}),
o1 AS (SELECT o_orderkey AS o, CAST(o_custkey % {DOCS} AS BIGINT) AS doc_id FROM orders),
o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM o1),
o3 AS (SELECT *, (doc_id + k % 3) % {len(HEADS)} AS kind FROM o2),
o4 AS (SELECT *, CASE WHEN o % 17 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN o % 12 + 1 ELSE (row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) - 1) % 12 + 1 END AS n FROM o3),
h0 AS (SELECT doc_id, CAST(k * 3 + o % 3 AS INTEGER) AS index, replace(replace(form, '{{n}}', CAST(n AS VARCHAR)), '{{r}}', {_ROMAN}[n]) AS title,
       coalesce(type, CASE WHEN o % 3 = 0 THEN 'section' ELSE 'chapter' END) AS div_type, coalesce(rank_, CASE WHEN o % 3 = 0 THEN 4 ELSE 3 END) AS rank,
       CASE WHEN system_ IS NOT NULL THEN CAST(n AS BIGINT) END AS number, system_ AS system, matter AS is_matter, o % 4 = 0 AS in_toc, ['part', 'chapter', 'section'][kind % 3 + 1] AS level
       FROM o4 JOIN kinds USING (kind)),
h AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS INTEGER) AS depth FROM h0)"""
_LEVELS = f"""{_HEADS},
body AS (SELECT * FROM h WHERE NOT is_matter),
gaps AS (SELECT doc_id, div_type, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sd FROM (SELECT *, lead(index) OVER (PARTITION BY doc_id, div_type ORDER BY index) - index AS gap FROM body) GROUP BY ALL),
steps AS (SELECT doc_id, div_type, round(coalesce(avg(CASE WHEN last IS NOT NULL THEN CASE WHEN number = last + 1 OR number = 1 THEN 1.0 ELSE 0.0 END END), 0.5), 3) AS progression
          FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id, div_type ORDER BY index) AS last FROM body WHERE number IS NOT NULL) GROUP BY ALL),
more AS (SELECT doc_id, div_type, min(rank) AS rank, round(avg(CASE WHEN in_toc THEN 1.0 ELSE 0.0 END), 3) AS toc_aligned, list_sort(list(DISTINCT system) FILTER (system IS NOT NULL)) AS systems FROM body GROUP BY ALL),
levels AS (SELECT doc_id, div_type, n, CAST(rank AS INTEGER) AS rank, coalesce(progression, 0.5) AS progression, round(CASE WHEN n < 3 THEN 0.5 WHEN mean = 0 THEN 0.0 ELSE 1 / (1 + sd / mean) END, 3) AS regularity, toc_aligned,
           CASE WHEN coalesce(len(systems), 0) = 0 THEN 'named' ELSE array_to_string(systems, ',') END AS numbering FROM gaps JOIN more USING (doc_id, div_type) LEFT JOIN steps USING (doc_id, div_type))"""
#: Rounds half up what a number is written as, not what it is in binary.
_HALF_UP = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(30, 20)), {1}) AS DOUBLE)"
_SCORE = "CAST(0.35 AS DOUBLE) * n / max(n) OVER (PARTITION BY doc_id) + CAST(0.30 AS DOUBLE) * progression + CAST(0.20 AS DOUBLE) * regularity + CAST(0.15 AS DOUBLE) * toc_aligned"
_SURE = "least(1.0, CAST(0.6 AS DOUBLE) * score + CAST(0.4 AS DOUBLE) * progression)"
_SPLIT = f"""{_LEVELS},
s1 AS (SELECT *, {_HALF_UP.format(_SCORE, 4)} AS score FROM levels),
s2 AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, rank DESC, div_type)),
tree AS (SELECT doc_id, string_agg(upper(div_type[1]) || div_type[2:], ' > ' ORDER BY rank, div_type) AS hierarchy FROM levels GROUP BY doc_id),
split AS (SELECT doc_id, div_type AS split_level, rank AS split_rank, score AS split_score, progression, next, {_HALF_UP.format(_SURE, 3)} AS confidence,
          round(score - coalesce(next, 0.0), 4) AS margin, hierarchy FROM s2 JOIN tree USING (doc_id) WHERE place = 1)"""

# -- contents -----------------------------------------------------------------------------------------------------------------


def contents_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each brand and type of part: contents from block 3 on, in every other one marked by styles, then sentences."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.xxhash64("p_brand").alias("b"), F.concat_ws("/", "p_brand", "p_type").alias("doc_id"), "p_size")
    rows = parts.withColumn("index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("p_partkey")) - 1).cast("int"))
    listed = c("index").between(4, 12)
    text = (
        F.when(c("index") == 3, "Contents")
        .when(c("index") == 5, "Part II ..... 9")
        .when(c("index") == 6, "Prologue 3")
        .when(c("index") == 7, "")
        .when(listed, F.concat("p_name", F.lit(" … "), c("index").cast("string")))
        .when(c("index") == 13, F.concat("p_name", F.lit(" came home.")))
        .otherwise(c("p_name"))
    )
    styled = F.when(listed & (F.length("doc_id") % 2 == 0) & (c("index") <= 10), "TOC1")
    rows = rows.select("doc_id", "index", text.alias("text"), styled.alias("style_id"), F.lit(True).alias("is_paragraph"))
    return rows.withColumns({"is_empty": c("text") == "", "word_count": F.size(F.array_remove(F.split("text", " "), ""))})


def seg_contents_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.regions(contents_blocks(spark, sf_dir)).select("doc_id", "toc_start", "toc_end")


def seg_contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contents_blocks(spark, sf_dir)
    return toc.entries(blocks, toc.regions(blocks)).select("doc_id", "ord", "title", "norm", "level")


_CONTENTS = r"""
p AS (SELECT *, p_brand || '/' || p_type AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand || '/' || p_type ORDER BY p_partkey) - 1 AS INTEGER) AS index FROM part),
b AS (SELECT doc_id, index, CASE WHEN index = 3 THEN 'Contents' WHEN index = 5 THEN 'Part II ..... 9' WHEN index = 6 THEN 'Prologue 3' WHEN index = 7 THEN '' WHEN index BETWEEN 4 AND 12 THEN p_name || ' … ' || index
      WHEN index = 13 THEN p_name || ' came home.' ELSE p_name END AS text, length(doc_id) % 2 = 0 AND index BETWEEN 4 AND 10 AS styled, p_name FROM p),
r AS (SELECT doc_id, 3 AS toc_start, CASE WHEN max(index) FILTER (styled) IS NOT NULL THEN max(index) FILTER (styled)
      ELSE coalesce(max(index) FILTER (text <> '' AND index > 3 AND index < 13), 3) END AS toc_end FROM b GROUP BY doc_id HAVING max(index) >= 3)"""

ORACLE: dict[str, str] = {
    "seg_signals": _SIGNALS,
    "seg_classified": f"WITH {_HEADS} SELECT doc_id, index, title, div_type, CAST(rank AS INTEGER) AS rank, depth, number, system, is_matter FROM h",
    "seg_levels": f"WITH {_LEVELS} SELECT * FROM levels",
    "seg_real_levels": f"""WITH {_LEVELS},
real_ AS (SELECT doc_id, div_type FROM levels WHERE toc_aligned >= 0.3 OR CASE WHEN div_type = 'unit' THEN n >= 3 AND progression >= 0.6 ELSE n >= 2 AND (progression >= 0.5 OR regularity >= 0.5) END)
SELECT doc_id, index, div_type FROM h WHERE is_matter OR doc_id % 50 = 0 OR (doc_id, div_type) IN (SELECT (doc_id, div_type) FROM real_)""",
    "seg_split_levels": f"""WITH {_SPLIT}
SELECT doc_id, split_level, split_rank, split_score, confidence, margin, hierarchy,
       concat_ws(',', CASE WHEN next IS NOT NULL AND margin < 0.08 THEN 'ambiguous_split_level' END, CASE WHEN confidence < 0.45 THEN 'low_split_confidence' END,
                 CASE WHEN progression < 0.5 AND doc_id % 50 <> 0 THEN 'broken_numbering_progression' END) AS flags FROM split""",
    "seg_violations": f"""WITH {_HEADS},
v AS (SELECT *, min(depth) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM h),
w AS (SELECT doc_id, round(avg(CASE WHEN number <= last THEN 1.0 ELSE 0.0 END), 3) AS numbering FROM
      (SELECT doc_id, number, lag(number) OVER (PARTITION BY doc_id, div_type ORDER BY index) AS last FROM h WHERE number IS NOT NULL AND NOT is_matter) WHERE last IS NOT NULL GROUP BY doc_id)
SELECT doc_id, round(avg(CASE WHEN depth > 0 AND NOT coalesce(above < depth, false) AND NOT is_matter THEN 1.0 ELSE 0.0 END), 3) AS orphans, coalesce(any_value(numbering), 0.0) AS numbering, CAST(0 AS DOUBLE) AS act_scene,
       round(avg(CASE WHEN doc_id % 2 = 0 AND index BETWEEN 10 AND 40 THEN 1.0 ELSE 0.0 END), 3) AS toc FROM v LEFT JOIN w USING (doc_id) GROUP BY doc_id""",
    "seg_kept_levels": f"""WITH {_SPLIT},
m AS (SELECT h.doc_id, index, is_matter OR CASE WHEN rank = 0 THEN 3 ELSE rank END <= coalesce(split_rank, 3) AS inside FROM h LEFT JOIN split USING (doc_id)),
n AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY doc_id) AS k FROM m)
SELECT doc_id, index FROM n WHERE inside OR k < 2""",
    "seg_filtered_levels": f"""WITH {_HEADS},
w AS (SELECT unnest(['auto', 'part', 'chapter', 'section']) AS wanted),
x AS (SELECT wanted, doc_id, index, level, count(*) FILTER (level = wanted) OVER (PARTITION BY wanted, doc_id) AS k FROM h, w)
SELECT wanted, doc_id, index, level FROM x WHERE k = 0 OR level = wanted""",
    "seg_contents_regions": f"WITH {_CONTENTS} SELECT doc_id, toc_start, toc_end FROM r",
    "seg_contents_entries": f"""WITH {_CONTENTS}
SELECT doc_id, index AS ord, CASE index WHEN 5 THEN 'Part II' WHEN 6 THEN 'Prologue' ELSE p_name END AS title, CASE index WHEN 5 THEN 'part ii' WHEN 6 THEN 'prologue' ELSE lower(p_name) END AS norm,
       CASE WHEN index = 5 THEN 0 ELSE 1 END AS level FROM b JOIN r USING (doc_id) WHERE index > toc_start AND index <= toc_end AND text <> ''""",
}

_ALL = (seg_signals, seg_classified, seg_levels, seg_real_levels, seg_split_levels, seg_violations, seg_kept_levels, seg_filtered_levels, seg_contents_regions, seg_contents_entries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
