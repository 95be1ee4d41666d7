"""Language identification: prediction by partial matching with frozen per-language byte statistics."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8_arrays

#: Longest context in bytes; contexts of that length are kept if seen so often in some language.
ORDER, SEEN = 3, 3
PIECE = 1 << 20
#: Texts to learn from, of all languages together.
TEXTS = 20_000
NO_LETTER = "und"


@dataclass
class Coder:
    """Code lengths under each language's context tree, as tables.

    Bytes that no tree has seen share a symbol: their cost is the same in any context. symbol: of a byte (0 stands before
    a text). state: by the last three symbols, the longest context that the trees keep. cost: state x symbol x language,
    bits of that symbol there.
    """

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    cost: np.ndarray

    def bits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Exact code length of each whole text (rows) in each language (columns)."""
        n = self.cost.shape[1]
        out = np.zeros((len(starts) - 1, len(self.languages)))
        begin = 0
        while begin < len(flat):
            end = min(len(flat), begin + PIECE)
            lo = max(0, begin - ORDER)
            s = np.concatenate([np.zeros(ORDER - (begin - lo), np.uint8), self.symbol[flat[lo:end]]]).astype(np.int32)
            first, last = int(np.searchsorted(starts, begin, "right")) - 1, int(np.searchsorted(starts, end, "left"))
            heads = starts[first:last]
            inside = np.arange(begin, end)
            context = [s[ORDER - k : len(s) - k] for k in range(1, ORDER + 1)]
            near = heads[(heads > begin - ORDER) & (heads < end)]
            for k in range(1, ORDER + 1):
                context[k - 1] = context[k - 1].copy()
                for j in range(k):  # the j-th byte of a text has j before it
                    at = near + j - begin
                    context[k - 1][at[(at >= 0) & (at < end - begin)]] = 0
            key = (context[2] * n + context[1]) * n + context[0]
            bits = self.cost[self.state[key], s[ORDER:]]
            owner = np.searchsorted(starts, inside[[0, -1]], "right") - 1
            rows = np.unique(np.searchsorted(starts, np.concatenate([[begin], heads[(heads >= begin) & (heads < end)]]), "right") - 1)
            cuts = np.maximum(starts[rows], begin) - begin
            assert rows[0] == owner[0] and rows[-1] == owner[-1]
            out[rows] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
            begin = end
        return out


Tree = list[dict[bytes, Counter]]
_COUNTS = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _grams(text: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of order + 1 bytes of a text, as numbers, and how often each occurs."""
    a = np.frombuffer(text, np.uint8)
    key = np.zeros(max(0, len(a) - order), np.int64)
    for j in range(order + 1):
        key = key * 256 + a[j : j + len(key)]
    return np.unique(key, return_counts=True)


def _tree(grams: Iterable[tuple[int, int, int]]) -> Tree:
    """(order, gram, count) -> by length of context: the counts of the bytes that follow each context."""
    out: Tree = [defaultdict(Counter) for _ in range(ORDER + 1)]
    for order, gram, n in grams:
        out[order][(gram >> 8).to_bytes(order, "big")][gram & 255] += n
    return [dict(level) for level in out]


def tree_of(texts: list[str]) -> Tree:
    """The context tree of some texts."""
    return _tree((order, int(g), int(n)) for t in texts for order in range(ORDER + 1) for g, n in zip(*_grams(t.encode(), order), strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (lang, text): the grams of each batch with their counts."""
    for batch in batches:
        found: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for order in range(ORDER + 1):
                found[lang, order].append(_grams(text.encode(), order))
        for (lang, order), parts in found.items():
            gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), order), pa.int32()), pa.array(gram, pa.int64()), pa.array(n)], schema=_COUNTS)


def train(samples: dict[str, Tree]) -> Coder:
    """Freezes the context trees of the languages. Escape probabilities are method C: kinds seen / (kinds + symbols seen)."""
    languages = sorted(samples)
    trees = [samples[x] for x in languages]
    seen = sorted({b for tree in trees for b in tree[0].get(b"", ())})
    symbol = np.full(256, 1, np.uint8)  # 1: seen by no tree
    if len(seen) > 200:  # the table of states is cubic in the symbols: rare bytes share the unseen one
        total = Counter()
        for tree in trees:
            total.update(tree[0].get(b"", {}))
        seen = sorted(b for b, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:200])
    for k, b in enumerate(seen, 2):
        symbol[b] = k
    n = len(seen) + 2
    contexts = [[b""], *(sorted({c for tree in trees for c, f in tree[k].items() if (k < ORDER or f.total() >= SEEN) and all(symbol[x] > 1 for x in c)}) for k in range(1, ORDER + 1))]
    number = {c: i for i, c in enumerate(c for level in contexts for c in level)}
    cost = np.zeros((len(number), n, len(languages)), np.float32)
    for j, tree in enumerate(trees):
        memo: dict[bytes, np.ndarray] = {}
        for level in contexts:
            for c in level:
                lower = memo[c[1:]] if c else np.full(n, 1 / 256)
                counts = tree[len(c)].get(c)
                if counts:
                    total, kinds = counts.total(), len(counts)
                    p = np.zeros(n)
                    for b, f in counts.items():
                        if symbol[b] > 1:
                            p[symbol[b]] += f
                    p = (p + kinds * lower) / (total + kinds)
                else:
                    p = lower  # a context that this language hasn't: the next shorter one, at no cost
                memo[c] = p
                cost[number[c], :, j] = -np.log2(p)
    state = np.zeros(n**3, np.int32)
    for c, i in number.items():  # shorter ones first, longer ones over them
        s = [int(symbol[x]) for x in c]
        if len(c) == 0:
            state[:] = i
        elif len(c) == 1:
            state.reshape(n, n, n)[:, :, s[0]] = i
        elif len(c) == 2:
            state.reshape(n, n, n)[:, s[0], s[1]] = i
        else:
            state[(s[0] * n + s[1]) * n + s[2]] = i
    return Coder(languages, symbol, state, cost)


def sample(docs: DataFrame, wanted: Column, each: int = 300, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", longest: int = 200_000) -> dict[str, Tree]:
    """The context tree of each language, of up to `each` whole texts of it, those first by the hash of their id.

    Counted on the executors: the driver gets counts of runs of four bytes at most. Only texts of `longest` bytes at most, and
    with over TEXTS / each languages fewer texts of each, so that what is collected has a bound; texts and languages that are
    null don't count. Counts by language come first, so that only rows whose hash lies low enough to be chosen are ranked.
    """
    known = docs.where(wanted & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= longest))
    keyed = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc"), F.xxhash64(id_col).alias("order"))
    counts = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    each = max(1, min(each, TEXTS // max(1, languages)))
    low = F.broadcast(counts.select("lang", ((4 * each + 100) / F.col("n")).alias("share"))) if languages <= TEXTS else counts.select("lang", ((4 * each + 100) / F.col("n")).alias("share"))
    keyed = keyed.join(low, "lang").where(F.shiftrightunsigned("order", 11) / float(1 << 53) < F.col("share"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc"))).where(F.col("n") <= each).select(F.col("doc").alias("chosen"))
    texts = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc")).join(F.broadcast(first.distinct()), F.col("doc") == F.col("chosen"), "left_semi")
    grams = texts.select("lang", "text").mapInArrow(_counted, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    by_language: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for lang, order, gram, n in zip(*(c.to_pylist() for c in grams.toArrow().columns), strict=True):
        by_language[lang].append((order, gram, n))
    return {lang: _tree(rows) for lang, rows in by_language.items()}


def predict(text: Column, coder: Coder) -> Column:
    """struct(lang_pred, score): the language that codes the whole text in the fewest bits, and how far it is ahead.

    score: its share of the languages' probabilities, whose code lengths are first divided by the root of the text's bytes (as
    bytes aren't independent, plain shares of long texts would all be 0 or 1).
    Null texts, texts without a letter, and all texts if no language was learned: `und` with score 0. Ties: the first by name.
    """

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predicted(texts: pa.Array) -> pa.Array:
        if not coder.languages:
            return pa.StructArray.from_arrays([pa.array([NO_LETTER] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))], ["lang_pred", "score"])
        flat, starts = utf8_arrays(texts)
        bits = coder.bits(flat, starts)
        best = bits.argmin(1)
        ahead = (bits - bits.min(1, keepdims=True)) * math.log(2)
        chance = 1 / np.exp(-np.minimum(ahead / np.sqrt(np.maximum(np.diff(starts), 1))[:, None], 700)).sum(1)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        hits = np.concatenate([[0], np.cumsum(ascii_letter[flat], dtype=np.int64)])
        letter = hits[starts[1:]] > hits[starts[:-1]]
        for k in np.flatnonzero(~letter).tolist():
            letter[k] = any(map(str.isalpha, texts[k].as_py() or ""))
        names = [coder.languages[k] if has else NO_LETTER for k, has in zip(best.tolist(), letter.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letter, chance, 0.0))], ["lang_pred", "score"])

    return predicted(text)
