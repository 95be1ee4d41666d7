"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import low_enough

KINDS = ("email", "ip", "card", "phone")
#: With what only the method finds: tokens, keys and passwords.
ALL = (*KINDS, "secret")
#: Pieces of documents that the trees learn context from, and their characters.
PIECES, PIECE = 4000, 240
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _email(text: str) -> Iterator[Span]:
    """From each @ to both sides: the same as matching from the left, without trying every start of a long run."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base(text: str) -> dict[str, list[Span]]:
    """The spans that are always redacted: matches of the four patterns, leftmost and without overlap within a kind."""
    out: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        out["email"] = [*_email(text)]
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_AT = r"(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\s@\s?|@\s)"
_DOT = r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.|\sdot\s|\s\.\s)"
_GENERATORS: dict[str, re.Pattern[str]] = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]{{2,}}+)+", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{3,6}){2,4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?:\.[A-Za-z0-9_-]{10,}+)*=*"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}(?:\([0-9]{2,5}\)|[0-9]{2,8})){1,5}(?![0-9A-Za-z])"),
}
#: What is given to a name of a secret, whatever it looks like: overlaps the other generator's spans.
_ASSIGNED = re.compile(r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential)s?[\x22']?\s{0,3}(?:[=:]|:=|is)\s{0,3}[\x22']?([^\s\x22',;<>]{6,})")
_KEYED = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
_MARK = re.compile(r"[(\[{]\s?at\s?[)\]}]|\s@|@\s", re.I)
_HINTS = {
    "email": re.compile(r"mail|write|contact|kontakt|correo|schreib|écri", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|direcci|adresse|v6", re.I),
    "card": re.compile(r"card|visa|master|carte|karte|tarjeta|credit|kredit|pay", re.I),
    "secret": re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|clave|contrase|schl.ssel|kennwort|jeton|mot de passe", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|handy|ruf|llam|appel|dial|sms|whatsapp", re.I),
}
_AGAINST = re.compile(r"order|version|isbn|date|datum|fecha|\bno\b|\bnr\b|\bid\b|ref|page|seite|invoice|case|score|price|total|ratio|range|serial|build|commit|sha|md5|checksum|hash|uuid|path|url|https?:", re.I)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data though the base patterns don't take them; they may overlap."""
    kinds = [*(["email"] if "@" in text or _MARK.search(text) else ()), *(["ip", "card", "phone"] if _DIGIT.search(text) else ())]
    for kind in kinds:
        for m in _GENERATORS[kind].finditer(text):
            yield kind, m.start(), m.end()
    if any(len(w) >= 16 for w in text.split()):
        for m in _GENERATORS["secret"].finditer(text):
            if not m[0].isalpha():
                yield "secret", m.start(), m.end()
    low = text.lower()
    if any(name in low for name in _KEYED):
        for m in _ASSIGNED.finditer(text):
            yield "secret", *m.span(1)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Numbers on a candidate's format and on the 32 characters before it."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    times = np.unique(np.frombuffer(span.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(span)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9A-Fa-f]+" if kind == "ip" else r"[0-9]+", span)]
    separators = re.sub(r"[0-9A-Za-z]", "", span)
    year = bool(re.match(r"(?:19|20)[0-9]{2}$", re.findall(r"[0-9]+", span)[0]) if digits else False) or bool(re.search(r"(?:19|20)[0-9]{2}$", span)) and len(digits) <= 8
    return [
        ALL.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        len(set(separators)),
        float(bool(digits) and len(digits) >= 13 and luhn(digits)),
        float("(" in span),
        float(year),
        float("::" in span),
        float(bool(re.search(r"[(\[{]\s?(?:at|dot|\.)\s?[)\]}]", span, re.I))),
        float(bool(re.search(r"(?:dot|\.)\s?[)\]}]?\s?(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", span, re.I))),
        float(bool(_HINTS[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(len(set(digits))),
        float(span[:1] == "0"),
        float(-(times * np.log2(times)).sum()),
        changes / len(span),
        sum(c in "abcdefABCDEF0123456789" for c in span) / len(span),
        sum(c.isupper() for c in span) / len(span),
        sum(c in "-_/+." for c in span) / len(span),
        float(text[start - 1 : start] in ("'", '"') and text[end : end + 1] in ("'", '"')) if start else 0.0,
        float(bool(re.search(r"[=:][\s\x22']*$", before))),
    ]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", count: int = PIECES) -> list[str]:
    """Pieces of up to so many documents, the first by a hash of id and text, each from a place of that hash: bounded, for train()."""
    text = F.col(text_col)
    h = F.xxhash64(id_col, text_col)
    keyed = docs.where((F.octet_length(text) > 0) & low_enough(h, count, docs.count())).select(h.alias("h"), text.alias("t"))
    cut = F.substring("t", F.pmod(F.col("h"), F.length("t")).cast("int") + 1, F.lit(PIECE))
    return [r.p for r in keyed.select("h", cut.alias("p")).distinct().orderBy(F.shiftrightunsigned("h", 11), "p").limit(count).collect()]


def examples(count: int = 4000, seed: int = 11, carriers: list[str] | None = None) -> list[tuple[str, bool]]:
    """Lines with one made-up span each, half of them personal data: there are no labels for it in the corpus.

    Each stands between words of a carrier, a piece of a real document; without carriers between made-up words.
    """
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def valid(n: int) -> str:
        stem = d(n - 1)
        return next(stem + c for c in "0123456789" if luhn(stem + c))

    def mixed(n: int) -> str:
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 1)) + r.choice("0123456789")

    def given(value: str) -> str:
        name, quote = r.choice(["token", "api_key", "secret", "password", "pwd", "access key", "auth", "bearer", "key", "credential", "client_secret"]), r.choice(["", '"', "'"])
        return f"{r.choice([name, name.upper(), name.capitalize()])}{r.choice([' = ', ': ', '=', ' is '])}{quote}{value}{quote}"

    def cut(s: str, sizes: tuple[int, ...], by: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(s[at : at + n])
            at += n
        return by.join(out)

    yes: list[Callable[[], str]] = [
        lambda: f"{word()}{r.choice(['(at)', ' [at] ', ' (at) ', '{at}'])}{word()}{r.choice(['.', '(dot)', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}",
        lambda: f"{word()} @ {word()}.{r.choice(['com', 'org', 'net', 'fr'])}",
        lambda: f"({d(3)}) {d(3)}-{d(4)}",
        lambda: cut(d(10), (3, 3, 4), r.choice("-.")),
        lambda: f"00{d(2)} {d(3)} {d(7)}",
        lambda: f"{r.choice(['tel', 'phone', 'call', 'Tel.', 'fax'])} 0{d(3)} {d(6)}",
        lambda: cut(valid(16), (4, 4, 4, 4), r.choice([".", "  ", "/", "_"])),
        lambda: ":".join(h(4) for _ in range(8)),
        lambda: f"{h(4)}:{h(4)}::{h(3)}:{h(2)}",
        lambda: "[.]".join(str(r.randint(1, 255)) for _ in range(4)),
        lambda: given(r.choice([h(r.choice([32, 40, 64])), mixed(r.randint(20, 44)), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), f"eyJ{mixed(20)}.{mixed(40)}.{mixed(30)}"])),
        lambda: given(r.choice([word() + d(r.randint(2, 4)) + "!", mixed(r.randint(8, 14)), word().capitalize() + "#" + d(3)])),
        lambda: r.choice([mixed(r.randint(24, 44)), "ghp_" + mixed(36), f"eyJ{mixed(20)}.{mixed(40)}.{mixed(30)}"]),
    ]
    no: list[Callable[[], str]] = [
        lambda: f"{word()} @ {word()}.{r.choice(['Then', 'The', 'And', 'we'])}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1990, 2030)}",
        lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
        lambda: f"{d(r.randint(2, 4))}-{d(r.randint(2, 4))}",
        lambda: f"order {cut(d(12), (4, 4, 4), r.choice('- /'))}",
        lambda: cut(d(16), (4, 4, 4, 4), r.choice([".", "/", "_"])),
        lambda: f"isbn {cut(d(13), (3, 5, 5), '-')}",
        lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{d(2)}.{d(2)}",
        lambda: f"{d(5)} {d(5)} {d(5)}",
        lambda: " ".join(d(r.randint(2, 4)) for _ in range(r.randint(2, 6))),
        lambda: f"{r.choice(['commit', 'sha1', 'md5', 'checksum', 'etag'])}{r.choice([' ', ': ', ' = '])}{h(r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['https://', 'www.', '/'])}{'/'.join(word() for _ in range(r.randint(2, 5)))}{r.choice(['', '-' + d(4), '/' + d(6)])}",
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + r.choice(["", "-" + d(2)]),
        lambda: d(r.randint(16, 30)),
        lambda: f"{r.choice(['token', 'key', 'secret', 'password'])} {r.choice(['is', ':'])} {word()}{word()}",
        lambda: r.choice("=-_+") * r.randint(16, 60),
    ]

    def around() -> tuple[str, str]:
        if not carriers:
            return f"{word()} {word()}", word()
        words = _NAMED.sub(" ", r.choice(carriers)).split() or [word()]
        at = r.randrange(len(words) + 1)
        return " ".join(words[max(0, at - 8) : at]), " ".join(words[at : at + 6])

    out = []
    for k in range(count):
        before, after = around()
        out.append((f"{before} {r.choice(yes if k % 2 else no)()} {after}", bool(k % 2)))
    return out


#: Runs with digits or signs of a carrier go: what they are isn't known.
_NAMED = re.compile(r"\S*[0-9@=_]\S*")


@dataclass
class Selector:
    trees: Trees
    threshold: dict[str, float]

    def added(self, text: str, taken: dict[str, list[Span]]) -> dict[str, list[Span]]:
        """The candidates over their kind's threshold, the likeliest first, that overlap no other span taken."""
        out: dict[str, list[Span]] = {kind: [] for kind in ALL}
        found = [*{*candidates(text)}] if text else []
        if not found:
            return out
        covered = bytearray(len(text))
        for spans in taken.values():
            for start, end in spans:
                covered[start:end] = b"\1" * (end - start)
        found = [c for c in found if covered.find(1, c[1], c[2]) < 0]
        if not found:
            return out
        p = self.trees.probability(np.array([features(text, *c) for c in found], float))
        for q, (kind, start, end) in sorted(zip(p.tolist(), found, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
            if q >= self.threshold[kind] and covered.find(1, start, end) < 0:
                covered[start:end] = b"\1" * (end - start)
                out[kind].append((start, end))
        return out

    def spans(self, text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
        """(base spans, all spans) by kind, by start."""
        first = base(text)
        more = self.added(text, first)
        return first, {kind: sorted(first.get(kind, []) + more[kind]) for kind in ALL}


def train(carriers: list[str] | None = None, precision: float = 0.99, count: int = 8000) -> Selector:
    """Trees from three quarters of the examples; each kind's threshold is the least that reaches the precision on the rest.

    carriers: pieces of the documents (see pieces), that context is learned from; their own runs with digits or signs are left
    out, as nobody has said what they are, so that all candidates of a line are of what was put into it.
    """
    rows = [(k, features(text, *c), good) for k, (text, good) in enumerate(examples(count, carriers=carriers)) for c in sorted({*candidates(text)})]
    x, y = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])
    held = np.array([r[0] % 8 < 2 for r in rows])  # whole pairs of examples: both labels
    trees = fit(x[~held], y[~held], trees=80, depth=5)
    p, kind = trees.probability(x[held]), x[held, 0]
    threshold = {}
    for k, name in enumerate(ALL):
        q, good = p[kind == k], y[held][kind == k]
        order = np.argsort(-q, kind="stable")
        exact = np.cumsum(good[order]) / np.arange(1, len(q) + 1)
        enough = np.flatnonzero(exact >= precision)
        threshold[name] = max(0.5, float(q[order][enough[-1]])) if len(enough) else 2.0
    return Selector(trees, threshold)


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in ALL for s, e in spans.get(kind, ()))


def find(text: Column, selector: Selector) -> Column:
    """struct of the numbers of base spans by kind, base and spans (each kind:start:end, in code points), number of added spans. Null is empty."""

    @F.arrow_udf("struct<n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [selector.spans(t or "") for t in texts.to_pylist()]
        counts = [pa.array([len(first[kind]) for first, _ in rows], pa.int64()) for kind in KINDS]
        return pa.StructArray.from_arrays([*counts, pa.array([listed(first) for first, _ in rows], pa.string()), pa.array([listed(every) for _, every in rows], pa.string()), pa.array([sum(map(len, every.values())) - sum(map(len, first.values())) for first, every in rows], pa.int64())], ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])

    return found(text)


def redact(text: Column, selector: Selector) -> Column:
    """The text with <KIND> in place of each run of overlapping spans (of the first one's kind); null stays null."""

    def cover(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for start, end, kind in sorted((s, e, kind) for kind, spans in selector.spans(t)[1].items() for s, e in spans):
            if start >= at:
                out += [t[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*out, t[at:]])

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([cover(t) for t in texts.to_pylist()], pa.string())

    return redacted(text)
