"""The signals of a heading, their weights and families, and the confidence they make together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import all_caps

c = F.col
FAMILIES = ("authority", "lexical", "typographic", "layout")


@dataclass(frozen=True)
class Signal:
    """Its strength over a candidate (0: it doesn't fire), its weight, and the family of which only the strongest counts."""

    name: str
    strength: Column
    weight: float
    family: str


def _when(condition: Column, strength: float) -> Column:
    return F.when(condition, strength).otherwise(0.0)


def registry() -> list[Signal]:
    """All signals. One more needs one more entry here."""
    role = c("division.role")
    size_in_band = c("max_size").between(c("band_low"), c("band_high"))
    fixed = [  # fixed values: strengths and weights
        ("TOC_MATCH", _when(c("in_toc"), 1.0), 0.97, "authority"),
        ("HEADING_STYLE", F.when(c("style_level") == 0, 1.0).when(c("style_level").isNotNull(), 0.55).otherwise(0.0), 0.90, "authority"),
        ("OUTLINE_LEVEL", _when(c("style_level") == 0, 0.6), 0.85, "authority"),
        ("CUSTOM_CHAPTER_STYLE", _when(F.lower("style_id").contains("chapter"), 1.0), 0.90, "authority"),
        ("CHAPTER_KEYWORD", _when(c("text").rlike(L.CHAPTER_LINE), 1.0), 0.95, "lexical"),
        ("PART_KEYWORD", _when(c("text").rlike(L.PART_LINE), 1.0), 0.80, "lexical"),
        ("DIVISION_LABEL", F.when(role.isin("labeled", "ordinal_label"), 1.0).when(role == "bare", 0.6).otherwise(0.0), 0.88, "lexical"),
        ("NUMERIC_CHAPTER", _when(c("text").rlike(L.NUMERIC_LINE), 0.6), 0.55, "lexical"),
        ("ROMAN_NUMERAL", _when(c("text").rlike(L.ROMAN_LINE), 0.9), 0.50, "lexical"),
        ("FONT_SIZE", F.when((c("max_size") != 0) & size_in_band, 1.0).when((c("max_size") != 0) & (c("max_size") > c("band_high")), 0.2).otherwise(0.0), 0.62, "typographic"),
        ("CENTERED", _when(c("alignment") == "center", 0.6), 0.32, "typographic"),
        ("ALL_CAPS", _when(all_caps(c("text")) | c("all_caps_prop"), 0.7), 0.30, "typographic"),
        ("BOLD", _when(c("bold"), 1.0), 0.28, "typographic"),
        ("SHORT_TEXT", _when((c("word_count") <= 12) & ~c("text").rlike("[.?!]$"), 0.5), 0.20, "typographic"),
        ("PAGE_BREAK_BEFORE", _when(c("page_break_before") | c("starts_page"), 0.8), 0.48, "layout"),
        ("SECTION_BREAK", _when(c("starts_section"), 0.7), 0.48, "layout"),
        ("SPINE_START", _when(c("starts_spine"), 0.8), 0.48, "layout"),
        ("ISOLATION", _when(c("is_isolated"), 0.6), 0.40, "layout"),
    ]
    return [Signal(*x) for x in fixed]


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "very_high").when(confidence >= 0.75, "high").when(confidence >= 0.55, "medium").otherwise("low")


def combine(families: list[Column], text: Column, words: Column) -> Column:
    """1 minus the product of what each family leaves, dampened for sentences and long lines, to three places."""
    left = reduce(lambda a, b: a * b, (F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), f)) for f in families))
    sentence = F.when((words > 8) & text.rlike("[.?!।॥]$"), 0.4).otherwise(1.0)
    return F.round((F.lit(1.0) - left) * sentence * F.when(words > 16, 0.3).otherwise(1.0), 3)


def score(candidates: DataFrame) -> DataFrame:
    """Adds fired (name to weighted strength), families, confidence, level and band."""
    signals = registry()
    named = candidates.withColumns({f"__{s.name}": F.coalesce(s.strength, F.lit(0.0)) * s.weight for s in signals})
    strongest = {f: F.greatest(*(c(f"__{s.name}") for s in signals if s.family == f)) for f in FAMILIES}
    fired = F.map_filter(F.create_map(*(x for s in signals for x in (F.lit(s.name), F.round(c(f"__{s.name}"), 3)))), lambda k, v: v > 0)
    scored = named.withColumn("families", F.struct(*(F.round(v, 4).alias(f) for f, v in strongest.items())))
    scored = scored.withColumns({"fired": fired, "confidence": combine([c(f"families.{f}") for f in FAMILIES], c("text"), c("word_count"))})
    chapter = (c("__TOC_MATCH") > 0) | (c("__CHAPTER_KEYWORD") > 0) | (c("__CUSTOM_CHAPTER_STYLE") > 0) | (c("__FONT_SIZE") > 0) | F.coalesce(c("style_level") == 0, F.lit(False))
    scored = scored.withColumns({"level": F.when(c("__PART_KEYWORD") > 0, "part").when(chapter, "chapter").otherwise("section"), "band": band(c("confidence"))})
    return scored.drop(*(f"__{s.name}" for s in signals))
