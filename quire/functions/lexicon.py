"""Words, numbers and patterns by which divisions of a book are told apart."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Division types and their surface forms in English, French and German.
FORMS: dict[str, list[str]] = {
    "volume": ["volume", "tome", "band", "vol"],
    "book": ["book", "livre", "buch"],
    "part": ["part", "partie", "teil"],
    "act": ["act", "acte", "akt", "aufzug"],
    "day": ["day", "journee", "tag"],
    "chapter": ["chapter", "chapitre", "kapitel", "chap"],
    "letter": ["letter", "lettre", "brief"],
    "story": ["story", "conte", "geschichte", "novella", "tale"],
    "night": ["night", "nuit", "nacht"],
    "canto": ["canto", "gesang"],
    "lecture": ["lecture", "vorlesung"],
    "lesson": ["lesson", "lecon", "lektion"],
    "essay": ["essay", "essai"],
    "paper": ["paper"],
    "work": ["work", "werk", "oeuvre"],
    "scene": ["scene", "szene", "auftritt"],
    "section": ["section", "abschnitt"],
    "subsection": ["subsection"],
    "preface": ["preface", "vorwort", "avant-propos"],
    "introduction": ["introduction", "einleitung"],
    "prologue": ["prologue", "prolog"],
    "epilogue": ["epilogue", "epilog"],
    "interlude": ["interlude", "zwischenspiel"],
    "appendix": ["appendix", "appendice", "anhang"],
    "foreword": ["foreword"],
    "afterword": ["afterword", "nachwort"],
    "conclusion": ["conclusion", "schluss"],
    "contents": ["contents", "sommaire", "inhalt", "inhaltsverzeichnis", "table des matieres"],
}

# Division types and their surface forms in Indic scripts. A form of two types counts for the later one.
INDIC_FORMS: dict[str, list[str]] = {
    "chapter": ["அத்தியாயம்", "அதிகாரம்", "अध्याय", "पाठ", "অধ্যায়", "পাঠ", "ଅଧ୍ୟାୟ", "అధ్యాయం", "ಅಧ್ಯಾಯ", "അദ്ധ്യായം", "പാഠം", "પ્રકરણ", "ਅਧਿਆਇ"],
    "part": ["பாகம்", "பகுதி", "பிரிவு", "भाग", "हिस्सा", "ভাগ", "অংশ", "ଭାଗ", "భాగం", "ಭಾಗ", "ഭാഗം", "ભાગ"],
    "section": ["खंड", "अनुभाग", "খণ্ড", "অনুচ্ছেদ", "பிரிவு", "విభాగం", "ವಿಭಾಗ", "വിഭാഗം"],
    "volume": ["தொகுதி", "खंड", "সংখ্যা", "ਜਿਲਦ", "ഗ്രന്ഥം"],
    "preface": ["முன்னுரை", "प्रस्तावना", "ভূমিকা", "ముందుమాట", "ಮುನ್ನುಡಿ", "അവതാരിക", "પ્રસ્તાવના", "ਭੂਮਿਕਾ"],
    "introduction": ["அறிமுகம்", "परिचय", "পরিচিতি", "పరిచయం", "ಪರಿಚಯ", "ആമുഖം"],
    "conclusion": ["முடிவுரை", "निष्कर्ष", "উপসংহার", "ముగింపు", "ಉಪಸಂಹಾರ", "ഉപസംഹാരം"],
    "appendix": ["இணைப்பு", "परिशिष्ट", "পরিশিষ্ট", "అనుబంధం", "ಅನುಬಂಧ", "അനുബന്ധം"],
    "foreword": ["प्राक्कथन", "প্রাক্কথন"],
}

# How high a division stands (0: the highest). Types without a rank here have 3.
RANKS = {"volume": 0, "book": 1, "part": 2, "act": 2, "day": 2, "chapter": 3, "letter": 3, "story": 3, "canto": 3, "night": 3, "essay": 3, "lecture": 3, "lesson": 3, "paper": 3, "work": 3, "scene": 4, "section": 4, "subsection": 5}
OTHER_RANK = 3

# Front and back matter.
FRONT = ["contents", "preface", "foreword", "introduction", "prologue"]
BACK = ["appendix", "afterword", "conclusion", "epilogue"]
MATTER = [*FRONT, *BACK, "interlude"]
BACK_MARKERS = ["gutenberg", "license", "licence", "copyright", "colophon", "transcriber", "errata", "end of the project"]

# Number words.
ORDINAL_WORDS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "twentieth": 20, "premier": 1, "premiere": 1, "deuxieme": 2, "seconde": 2, "troisieme": 3, "quatrieme": 4, "cinquieme": 5, "sixieme": 6, "septieme": 7, "huitieme": 8, "neuvieme": 9, "dixieme": 10, "onzieme": 11, "douzieme": 12}
CARDINAL_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "funf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10}
GERMAN_STEMS = {"erst": 1, "zweit": 2, "dritt": 3, "viert": 4, "funft": 5, "sechst": 6, "siebt": 7, "siebent": 7, "acht": 8, "neunt": 9, "zehnt": 10, "elft": 11, "zwolft": 12}
GERMAN_ENDINGS = ["", "e", "em", "en", "er", "es"]
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

# The digit zero of each script whose numbers are told apart.
ZEROS = {"devanagari": 0x0966, "bengali": 0x09E6, "tamil": 0x0BE6, "kannada": 0x0CE6, "telugu": 0x0C66, "malayalam": 0x0D66, "gujarati": 0x0AE6, "gurmukhi": 0x0A66, "odia": 0x0B66}

# Patterns.
EDGE = ".:);,-–—"
INDIC = r"[\x{0900}-\x{0D7F}]"
ROMAN_LINE = r"(?iU)^\s*([IVXLCDM]{1,7})\s*[.:)]?\s*$"
CHAPTER_LINE = r"(?iU)^\s*(chapter|chap\.?)\s+([0-9]+|[ivxlcdm]+)\b"
PART_LINE = r"(?iU)^\s*(part|book|section|volume)\s+([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)\b"
NUMERIC_LINE = r"(?U)^\s*(\d{1,3})([.:)]\s+\S|\s+\S)"
HINDI_DATE = r"(?U)^\s*\d{1,2}\s+(?:जनवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितम्बर|सितंबर|सितम्मर|अक्तूबर|अक्टूबर|नवम्बर|नवंबर|नवम्मर|दिसम्बर|दिसंबर)"
CONTENTS_LINE = r"(?iU)^\s*(table of contents|contents|table des mati|sommaire|inhaltsverzeichnis|inhalt)\b"
PAGE_NUMBER = r"(?U)[\s.\x{2026}]+\d{1,4}\s*$"
TOC_STYLES = [f"{name}{k}" for name in ("TOC", "toc ") for k in range(1, 10)]
BODY_SIZE = 11


def surfaces() -> dict[str, str]:
    return {form: kind for kind, forms in FORMS.items() for form in forms}


def indic_surfaces() -> dict[str, str]:
    return {form: kind for kind, forms in INDIC_FORMS.items() for form in forms}


def german_ordinals() -> dict[str, int]:
    return {stem + ending: value for ending in GERMAN_ENDINGS for stem, value in GERMAN_STEMS.items()}


@lru_cache
def unaccented() -> tuple[str, str]:
    """For translate(): the characters whose decomposition is one character and combining marks, and those; the marks go."""
    pairs, marks = [], []
    for point in range(0x80, 0x3000):
        c = chr(point)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@lru_cache
def decimal_digits() -> tuple[str, str]:
    """For translate(): all digits beyond ASCII and their values."""
    digits = [chr(p) for p in range(0x80, 0x10000) if unicodedata.category(chr(p)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)
