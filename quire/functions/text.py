"""Expressions over titles and lines: all of them built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def lookup(table: dict[str, object], key: Column) -> Column:
    """The table's value for the key, else null. The table is one literal, so that plans stay small."""
    found = F.try_element_at(F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x03")), key)
    return found.cast("int") if all(isinstance(v, int) for v in table.values()) else found


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """What Unicode white space separates."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda x: x != "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def norm_title(text: Column) -> Column:
    """Lower case, colons as spaces, white space collapsed."""
    return collapse(F.replace(F.lower(text), F.lit(":"), F.lit(" ")))


def norm_role(text: Column) -> Column:
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def all_caps(text: Column) -> Column:
    """At least one letter, and every letter an upper-case one."""
    return F.coalesce(text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]"), F.lit(False))


def strip_accents(text: Column) -> Column:
    return F.translate(text, *L.unaccented())


def edge_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[.:);,\-–—]+|[.:);,\-–—]+$", "")


def norm_token(token: Column) -> Column:
    return edge_trim(F.lower(strip_accents(token)))


def strip_page_number(text: Column) -> Column:
    return F.regexp_replace(text, L.PAGE_NUMBER, "")


def norm_toc(text: Column) -> Column:
    """A contents entry for comparison: no page number, lower case, letters, digits and underscores, single spaces."""
    return collapse(F.regexp_replace(F.lower(strip_page_number(text)), r"(?U)[^\p{L}\p{N}_\s]", " "))


def is_contents_line(text: Column) -> Column:
    return F.coalesce(text.rlike(L.CONTENTS_LINE), F.lit(False))


def sanitize(title: Column, longest: int = 60) -> Column:
    """A title as a file name's stem; never empty."""
    clean = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\x00-\x1f]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r'[<>:"/\\|?*]', "_"), r"(?U)[\s_]+", "_")
    clean = F.regexp_replace(clean, r"^[_.]+|[_.]+$", "")
    clean = F.regexp_replace(F.substring(clean, 1, longest), r"[_.]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("untitled"))


def file_name(ordinal: Column, title: Column, extension: str, pattern: str = "{index:02d}_{title}") -> Column:
    """pattern with {index} (or {index:0Nd}) and {title} filled in, and the extension if it isn't there yet (in any case)."""
    import re

    out: list[Column] = []
    stem = sanitize(F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("chapter_"), ordinal.cast("string"))))
    for part in re.split(r"(\{[^}]*\})", pattern):
        if part == "{title}":
            out.append(stem)
        elif found := re.fullmatch(r"\{index(?::0?(\d+)d)?\}", part):
            number = ordinal.cast("string")
            width = int(found[1] or 0)
            out.append(F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0")) if width else number)
        elif part.startswith("{"):
            raise ValueError(f"unknown field {part}")
        elif part:
            out.append(F.lit(part))
    name = F.concat(*out)
    return F.when(F.endswith(F.lower(name), F.lit(extension.lower())), name).otherwise(F.concat(name, F.lit(extension)))


def slug(title: Column, fallback: Column, longest: int = 48) -> Column:
    """Word characters, spaces and hyphens only, lower case, underscores for white space."""
    s = F.lower(strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\p{L}\p{N}_\s\-]", "")))
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, SPACE, "_"), 1, longest), F.lit("")), fallback)


def web_slug(title: Column, fallback: Column, longest: int = 60) -> Column:
    """As slug, with hyphens as underscores and none at the ends."""
    s = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s\-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_\-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, longest), F.lit("")), fallback)


def xml_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def resolve_href(base: Column, ref: Column) -> Column:
    """A reference against the folder of base, as a normalised path; empty for references to elsewhere."""
    clean = strip(F.regexp_replace(F.coalesce(ref, F.lit("")), r"(?s)[#?].*$", ""))
    folder = F.regexp_replace(base, r"[^/]*$", "")
    joined = F.when(clean.startswith("/"), clean).otherwise(F.concat(folder, clean))
    path = normal_path(joined)
    return F.when((clean == "") | clean.rlike(r"^(https?://|data:|//)"), "").otherwise(path)


def normal_path(path: Column) -> Column:
    """A relative or absolute path without empty, . and .. parts, as far as they can be resolved; "." if nothing is left."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = part == ".."
        pops = up & (F.size(done) > 0) & (F.coalesce(last, F.lit("")) != "..")
        drop = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array().cast("array<string>"))
        return F.when(pops, drop).when(up & absolute, done).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    text = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(done, "/"))
    return F.when(text == "", ".").otherwise(text)


def is_safe_member(name: Column) -> Column:
    """Whether an archive member's name stays inside the archive."""
    bad = F.coalesce(name, F.lit("")) == ""
    bad |= name.rlike(r"^[/\\]") | F.substring_index(name, "/", 1).contains(":")
    path = normal_path(F.replace(name, F.lit("\\"), F.lit("/")))
    return ~(bad | (path == "..") | path.startswith("../"))
