"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose counts a worker remembers, and symbols that are merged at once.
REMEMBERED, AT_ONCE = 600_000, 1_000_000
#: Of the table of pairs; the rank of a pair that isn't merged.
SLOT_BITS, NONE = 19, np.iinfo(np.int32).max


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


class Merger:
    """The merges of a piece model as arrays: which symbols there are, and what a pair of them becomes at which rank."""

    def __init__(self, model: bytes):
        pieces: dict[str, float] = {}
        self.prefix = True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) in (1, 4):
                    pieces[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave the text as it is, but for spaces, are supported")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes across a space")
        symbols = {s: i for i, s in enumerate(sorted({*pieces, *(c for p in pieces for c in p)}))}
        scores = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {(symbols[p[:k]], symbols[p[k:]]): symbols[p] for p in pieces for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.size = len(symbols)
        self.symbols, self.known = symbols, pieces
        rank = np.full(self.size, NONE, np.int32)
        for p, score in pieces.items():
            rank[symbols[p]] = scores[score]
        self.rank = rank
        keys = np.array([a * self.size + b for a, b in pairs], np.uint64)
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.made = keys[order], np.array([*pairs.values()], np.int32)[order]
        self.first = np.searchsorted(slots[order], np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.single = np.zeros(self.size, bool)  # symbols that are no pieces: spelt in bytes
        self.single[[i for s, i in symbols.items() if s not in pieces]] = True
        self.lone = {c for c in ("\n", "\r", "\t") if ord(c) < 128 and not any(c in p for p in pieces)}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols become, and at which rank (none: -1 and NONE)."""
        key = a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)  # a symbol that no piece has is -1: a key of no pair
        slot = self._slot(key)
        made, rank = np.full(len(key), -1, np.int32), np.full(len(key), NONE, np.int32)
        begin, end = self.first[slot], self.first[slot + np.uint64(1)]
        some = np.flatnonzero((begin < end) & (a >= 0) & (b >= 0))
        for k in range(self.deepest):
            at = begin[some] + k
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key[some]
            hit &= at < end[some]
            made[some[hit]] = self.made[at[hit]]
            some = some[~hit]
        found = np.flatnonzero(made >= 0)
        rank[found] = self.rank[made[found]]
        return made, rank

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, the words being merged apart from each other."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = 0
        while begin < len(words):
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), AT_ONCE, "right")))
            out[begin:end] = self._counts(words[begin:end], lengths[begin:end])
            begin = end
        return out

    def _counts(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.of_char[points]  # a copy
        spelt = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)  # bytes of each character
        owner = np.repeat(np.arange(len(words)), lengths)
        cost = np.where((symbols < 0) | self.single[symbols], spelt, 1)
        total = np.bincount(owner, cost, len(words)).astype(np.int64)
        made, rank = np.full(len(symbols), -1, np.int32), np.full(len(symbols), NONE, np.int32)  # of the pair that begins at a symbol
        same = np.flatnonzero(owner[:-1] == owner[1:])
        made[same], rank[same] = self._pairs(symbols[same], symbols[same + 1])
        last_rank, last_merges = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        again: list[np.ndarray] = []
        while len(where := np.flatnonzero(rank < NONE)):
            words_at, ranks = owner[where], rank[where]
            heads = np.flatnonzero(np.r_[True, words_at[1:] != words_at[:-1]])
            touched = words_at[heads]
            least = np.full(len(words), NONE, np.int64)
            least[touched] = np.minimum.reduceat(ranks, heads)
            pick = ranks == least[words_at]
            at, of = where[pick], words_at[pick]
            run = np.r_[True, at[1:] != at[:-1] + 1]  # of pairs that overlap the first, the third, ... are merged
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at, of = at[since % 2 == 0], of[since % 2 == 0]
            bad = np.zeros(len(words), bool)
            bad[touched] = (least[touched] <= last_rank[touched]) & (last_merges[touched] > 1)
            close = np.flatnonzero((at[1:] == at[:-1] + 2) & (of[1:] == of[:-1]))  # a merge whose right neighbour merges too
            if len(close):
                _, next_rank = self._pairs(made[at[close]], symbols[at[close] + 2])
                bad[of[close][next_rank <= least[of[close]]]] = True
            if bad.any():  # merging one by one would go another way there
                again.append(np.flatnonzero(bad))
                at, of = at[~bad[of]], of[~bad[of]]
            merges = np.bincount(of, minlength=len(words))
            last_rank, last_merges = np.where(merges > 0, least, last_rank), np.where(merges > 0, merges, last_merges)
            lost = np.where(self.single[symbols[at]], spelt[at], 1) + np.where(self.single[symbols[at + 1]], spelt[at + 1], 1) - 1
            total -= np.bincount(of, lost, len(words)).astype(np.int64)
            symbols[at] = made[at]
            stays = np.zeros(len(words), bool)
            stays[touched] = True
            stays[bad] = False
            left = stays[owner]
            left[at + 1] = False
            now = (np.cumsum(left) - 1)[at]
            symbols, owner, spelt, made, rank = (v[left] for v in (symbols, owner, spelt, made, rank))
            made[now], rank[now] = -1, NONE
            new = np.concatenate([now, now[now > 0] - 1])
            new = new[new < len(symbols) - 1]
            new = new[owner[new] == owner[new + 1]]
            made[new], rank[new] = self._pairs(symbols[new], symbols[new + 1])
        for k in np.concatenate(again).tolist() if again else []:
            total[k] = self.one_by_one(words[k])
        return total

    def one_by_one(self, word: str) -> int:
        """Tokens of a word by the best pair first, the leftmost among equals, with a heap."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i < len(parts) and parts[i] is not None and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.known:
                    heapq.heappush(heap, (-self.known[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return sum(1 if p in self.known else len(p.encode("utf-8", "surrogatepass")) for p in parts if p is not None)


class Memory(dict):
    """Counts by word; notes the words that it doesn't have, as 0."""

    missed: list[str]

    def __missing__(self, word: str) -> int:
        self.missed.append(word)
        return 0


class Counter:
    """Counts tokens of texts; remembers the counts of words."""

    def __init__(self, model: bytes):
        self.merger = Merger(model)
        self.memory = Memory({"": 0})
        lone = "".join(sorted(self.merger.lone))
        #: A word: its spaces with what follows, up to the next space; characters that no merge takes stand alone.
        self.words = re.compile(f"[{re.escape(lone)}]|{SPACE}*[^{SPACE}{re.escape(lone)}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.merger.prefix else "") + text.replace(" ", SPACE)
        if SPACE + SPACE in text:
            return self.words.findall(text)
        text = text.replace(SPACE, " " + SPACE)
        for c in self.merger.lone:
            if c in text:
                text = text.replace(c, f" {c} ")
        return text.split(" ")

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for begin in range(0, len(texts), 512):
            unknown: list[tuple[int, list[str]]] = []
            for text in texts[begin : begin + 512]:
                self.memory.missed = []
                out.append(sum(map(self.memory.__getitem__, self.split(text or ""))))
                if self.memory.missed:
                    unknown.append((len(out) - 1, self.memory.missed))
            new = list(set().union(*(words for _, words in unknown)))
            counted = dict(zip(new, self.merger.counts(new).tolist(), strict=True))
            for k, words in unknown:
                out[k] += sum(map(counted.__getitem__, words))
            if len(self.memory) + len(new) > REMEMBERED:
                self.memory.clear()
            self.memory.update(counted)
            self.memory[""] = 0
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    with open(path, "rb") as f:
        return Counter(f.read())


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text under the piece model at path (a file that each executor has, as libraries are installed there).

    Null and empty texts have 0. Texts of any length count as a whole: they are cut only where no merge can go across,
    between a character and a space and around characters that are in no longer piece. Words of a batch that are new to
    the worker are merged together, each round applying every word's lowest-rank pair at all its places; a word where
    that could differ from merging one by one (a new pair of the same or a better rank) is merged one by one.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).counts(texts.to_pylist()), pa.int64())

    return count(text)
