"""Suffix-array dedup by bytes: two-stage sorting, then common prefixes of neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from .repeats import Scheme

_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**64, 256, np.uint64)


class _Packed:
    """Several symbols as one number, for comparing runs from given places on; nothing counts after a separator (0)."""

    def __init__(self, x: np.ndarray):
        self.bits = max(1, int(x.max(initial=1)).bit_length())
        self.each = 63 // self.bits
        self.x = np.concatenate([x, np.zeros(2 * self.each + 1, x.dtype)])
        self.last = len(self.x) - self.each - 1
        full = np.zeros(len(self.x) - self.each, np.int64)
        alive = np.ones(len(full), bool)
        for k in range(self.each):
            s = self.x[k : k + len(full)]
            alive &= s > 0
            full <<= self.bits
            full |= np.where(alive, s, 0)
        self.full, self.whole = full, alive

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.full[np.minimum(place, self.last)]

    def goes_on(self, place: np.ndarray) -> np.ndarray:
        return self.whole[np.minimum(place, self.last)]


def _sort(places: np.ndarray, packed: _Packed, depth: int) -> np.ndarray:
    """The places by the text from there on, up to depth at least."""
    key = packed.at(places)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    change = np.r_[True, key[1:] != key[:-1]]
    done = packed.each
    slots = np.arange(len(places))
    group = np.cumsum(change)
    while done < depth and len(slots):
        tied = ~(change & np.r_[change[1:], True])
        tied &= packed.goes_on(places[slots] + done - packed.each)
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        key = packed.at(places[slots] + done)
        order = np.lexsort((key, group))
        places[slots] = places[slots][order]
        key, group = key[order], group[order]
        change = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        group = np.cumsum(change)
        done += packed.each
    return places


def suffix_array(x: np.ndarray, depth: int, packed: _Packed | None = None) -> np.ndarray:
    """All places of x by the text from there on, up to a separator (0) or up to depth at least. x ends with a separator.

    Only suffixes that are smaller than their successor are sorted. The others follow: bucket by bucket of the first symbol, a
    scan over what is in order puts the place before each, if its symbol is larger, at the end of that symbol's bucket; the
    same symbol again and again within the bucket comes round by round.
    """
    packed = packed or _Packed(x)
    step = np.sign(np.diff(x.astype(np.int32), append=0))
    turn = np.where(step != 0, np.arange(len(x)), len(x) - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = (step[turn] > 0) & (x > 0)
    direct = _sort(np.flatnonzero(smaller), packed, depth)
    cuts = np.searchsorted(x[direct], np.arange(int(x.max(initial=0)) + 2))
    coming: list[list[np.ndarray]] = [[] for _ in range(len(cuts))]
    out: list[np.ndarray] = []
    for symbol in range(len(cuts) - 1):
        if symbol == 0:
            bucket = np.flatnonzero(x == 0)
        else:
            parts = coming[symbol]
            rounds = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            parts = [rounds]
            while len(rounds):
                rounds = rounds[rounds > 0] - 1
                rounds = rounds[x[rounds] == symbol]
                parts.append(rounds)
            bucket = np.concatenate([*parts, direct[cuts[symbol] : cuts[symbol + 1]]])
            coming[symbol] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = x[before]
        before, first = before[first > symbol], first[first > symbol]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        heads = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for part in np.split(before, heads[1:]) if len(heads) else []:
            coming[int(x[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(places: np.ndarray, packed: _Packed, depth: int) -> np.ndarray:
    """Whether each place after the first has `depth` symbols in common with the one before it."""
    same = np.arange(1, len(places))
    for done in range(0, depth, packed.each):
        at = done if done + packed.each <= depth else max(0, depth - packed.each)
        same = same[packed.at(places[same] + at) == packed.at(places[same - 1] + at)]
    out = np.zeros(max(len(places) - 1, 0), bool)
    out[same - 1] = True
    return out


@dataclass(frozen=True)
class Bytes(Scheme):
    window: int = 100
    seed: int = 32

    def parse(self, data: bytes) -> Sequence:
        return data

    def hashes(self, symbols: Sequence) -> np.ndarray:
        return _TABLE[np.frombuffer(symbols, np.uint8)]

    def join(self, symbols: Sequence) -> bytes:
        return symbols

    def kept(self, data: bytes, symbols: Sequence, removed: np.ndarray) -> bytes:
        return np.frombuffer(data, np.uint8)[~removed].tobytes() if removed.any() else data

    def repeats(self, fragments: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
        """One suffix array over all the fragments; neighbours that share a window's length are the same window."""
        sizes = np.array([*map(len, fragments)])
        used = np.unique(np.frombuffer(b"".join(fragments), np.uint8))
        number = np.zeros(256, np.uint16)
        number[used] = np.arange(1, len(used) + 1)
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        x = np.zeros(int(ends[-1]), np.uint16)
        inside = np.ones(len(x), bool)
        inside[ends - 1] = False
        x[inside] = number[np.frombuffer(b"".join(fragments), np.uint8)]
        packed = _Packed(x)
        order = suffix_array(x, self.window, packed)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        starts = np.repeat(ends - 1 - self.window, sizes + 1) >= np.arange(len(x))  # where a whole window is left
        places = order[starts[order]]
        same = common_prefixes(places, packed, self.window)
        group = np.cumsum(np.r_[True, ~same])
        several = np.r_[False, same] | np.r_[same, False]
        places, group = places[several], group[several]
        fragment = owner[places]
        offset = places - begins[fragment]
        order = np.lexsort((start[fragment] + offset, doc[fragment], group))
        later = order[1:][group[order[1:]] == group[order[:-1]]]
        return fragment[later], offset[later]
