"""Numbers and division labels in headings, as expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import edge_trim, let, lookup, norm_token, strip, strip_accents, tokens

NUMBER = "struct<system:string,value:bigint>"
DIVISION = "struct<type:string,number:bigint,system:string,role:string,surface:string>"


def _number(system: str, value: Column) -> Column:
    return F.struct(F.lit(system).alias("system"), value.cast("bigint").alias("value")).cast(NUMBER)


def roman_value(text: Column) -> Column:
    """Roman letters from the right, those smaller than any before them subtracted; no check that they make a proper number."""
    letters = F.reverse(F.split(text, ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(state: Column, letter: Column) -> Column:
        value = lookup(L.ROMAN, letter)
        return F.struct((state["total"] + F.when(value < state["most"], -value).otherwise(value)).alias("total"), F.greatest(state["most"], value).alias("most"))

    return F.when(text.rlike("^[ivxlcdm]+$"), F.nullif(F.aggregate(letters, start, step, lambda s: s["total"]), F.lit(0)))


def parse_number(token: Column) -> Column:
    """struct(system, value) of a token that is a number in digits of any script, letters or words; else null."""
    none = F.lit(None).cast(NUMBER)

    def foreign(raw: Column) -> Column:
        system = F.lit("indic")
        for name, zero in L.ZEROS.items():
            system = F.when(raw.rlike(f"^[{chr(zero)}-{chr(zero + 9)}]+$"), F.lit(name)).otherwise(system)
        value = F.translate(raw, *L.decimal_digits()).try_cast("bigint")
        return F.when(raw.rlike(r"^\p{Nd}+$") & (value >= 1), F.struct(system.alias("system"), value.alias("value")).cast(NUMBER))

    def word(low: Column) -> Column:
        french = F.regexp_extract(low, "^([0-9]+)(?:er|ere|re|eme|e|nde?|ieme)$", 1)
        english = F.regexp_extract(low, "^([0-9]+)(?:st|nd|rd|th)$", 1)
        digits = low.try_cast("bigint")
        letter = F.when((F.char_length(low) == 1) & low.rlike(r"\p{L}"), F.ascii(low) - 96)
        return (
            F.when(french != "", _number("fr_ordinal", french.try_cast("bigint")))
            .when(english != "", _number("en_ordinal", english.try_cast("bigint")))
            .when(low.rlike("^[0-9]+$"), F.when(digits >= 1, _number("arabic", digits)))
            .when(roman_value(low).isNotNull(), _number("roman", roman_value(low)))
            .when(lookup(L.ORDINAL_WORDS, low).isNotNull(), _number("ordinal_word", lookup(L.ORDINAL_WORDS, low)))
            .when(lookup(L.CARDINAL_WORDS, low).isNotNull(), _number("cardinal_word", lookup(L.CARDINAL_WORDS, low)))
            .when(lookup(L.german_ordinals(), low).isNotNull(), _number("de_ordinal", lookup(L.german_ordinals(), low)))
            .when(letter.isNotNull(), _number("alpha", letter))
        )

    def parsed(raw: Column) -> Column:
        digits = raw.rlike(r"^[\p{Nd}\p{No}]+$") & raw.rlike(r"[^\x00-\x7F]")
        return F.when(raw == "", none).when(digits, foreign(raw)).otherwise(let(F.lower(strip_accents(raw)), word))

    return let(edge_trim(strip(F.coalesce(token, F.lit("")))), parsed)


def _division(kind: Column, number: Column | None, role: str, surface: Column) -> Column:
    null = F.lit(None)
    value, system = (null, null) if number is None else (number["value"], number["system"])
    return F.struct(kind.cast("string").alias("type"), value.cast("bigint").alias("number"), system.cast("string").alias("system"), F.lit(role).alias("role"), surface.alias("surface")).cast(DIVISION)


def _first_known(table: dict[str, str], words: Column) -> Column:
    return F.get(F.filter(words, lambda w: lookup(table, w).isNotNull()), F.lit(0))


def _labelled(kind: Column, next_number: Column, surface: Column) -> Column:
    return (
        F.when(kind.isin(L.MATTER), _division(kind, None, "matter", surface))
        .when(next_number.isNotNull(), _division(kind, next_number, "labeled", surface))
        .otherwise(_division(kind, None, "named", surface))
    )


def match_division(text: Column) -> Column:
    """The division of a heading (see _division_of). The expression over a plain column is built once and used again."""
    name = str(text._jc.toString())
    return _of_column(name, id(SparkContext._gateway)) if re.fullmatch(r"[a-z_]+", name) else _division_of(text)


@lru_cache(16)
def _of_column(name: str, gateway: int) -> Column:
    return _division_of(F.col(name))


def _division_of(text: Column) -> Column:
    """struct(type, number, system, role, surface) of a heading: roles labeled, ordinal_label, named, matter and bare; else null.

    A label first (Chapter IV), a number before a label (1ere nuit), or a number by itself. Indic labels are compared as they
    are written, others without accents and case. A letter or a Roman number leads only with punctuation after it.
    """
    latin, indic = L.surfaces(), L.indic_surfaces()
    none = F.lit(None).cast(DIVISION)

    def of(v: Column) -> Column:
        tok, n0, n1, line = v["tok"], v["n0"], v["n1"], v["line"]
        t0 = F.get(tok, F.lit(0))
        raw0 = strip(edge_trim(t0))
        rest = F.slice(tok, F.lit(2), F.lit(1 << 20))
        near = F.slice(tok, F.lit(2), F.lit(2))
        near_indic = _first_known(indic, F.transform(near, lambda x: strip(edge_trim(x))))
        own = lookup(indic, raw0)
        script = (
            F.when(own.isNotNull(), _labelled(own, n1, raw0))
            .when(n0.isNotNull() & near_indic.isNotNull(), _division(lookup(indic, near_indic), n0, "ordinal_label", near_indic))
            .when(n0.isNotNull(), _division(F.lit(None), n0, "bare", t0))
        )
        joined = F.array_join(F.transform(F.slice(tok, F.lit(1), F.lit(3)), norm_token), " ")
        contents = none
        for form in reversed(L.FORMS["contents"]):
            contents = F.when(joined.startswith(form), _division(F.lit("contents"), None, "matter", F.lit(form))).otherwise(contents)
        first = norm_token(t0)
        kind = lookup(latin, first)
        leads = n0.isNotNull() & (~n0["system"].isin("alpha", "roman") | t0.rlike(r"[.)\]:]$"))
        near_latin = _first_known(latin, F.transform(near, norm_token))
        late = F.get(F.filter(F.transform(F.transform(rest, norm_token), lambda x: lookup(latin, x)), lambda x: x.isNotNull() & ~x.isin(L.MATTER)), F.lit(0))
        numbered = (
            F.when(near_latin.isNotNull(), _division(lookup(latin, near_latin), n0, "ordinal_label", near_latin))
            .when(late.isNotNull(), _division(late, n0, "ordinal_label", late))
            .when(F.size(tok) <= 2, _division(F.lit(None), n0, "bare", t0))
        )
        plain = F.coalesce(contents, F.when(kind.isNotNull(), _labelled(kind, n1, first)).when(leads, numbered))
        return F.when(F.size(tok) == 0, none).otherwise(F.coalesce(F.when(line.rlike(L.INDIC), script), plain))

    def numbered(tok: Column) -> Column:
        return let(F.struct(tok.alias("tok"), parse_number(F.try_element_at(tok, F.lit(1))).alias("n0"), parse_number(F.try_element_at(tok, F.lit(2))).alias("n1"), F.array_join(tok, " ").alias("line")), of)

    return let(tokens(text), numbered)
