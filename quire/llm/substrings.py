"""Substring dedup by words: seed and extend."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import compress

import numpy as np
import xxhash

from .repeats import Scheme, grams


def _classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs; -1 for pairs that only one has: those match nothing."""
    out = np.full(len(a), -1, np.int64)
    some = np.flatnonzero((a >= 0) & (b >= 0))
    if len(some):
        key = a[some] * (int(b[some].max()) + 1) + b[some]
        _, name, times = np.unique(key, return_inverse=True, return_counts=True)
        out[some] = np.where(times[name] > 1, name, -1)
    return out


@dataclass(frozen=True)
class Words(Scheme):
    """Symbols are the runs of what isn't ASCII white space."""

    window: int = 20
    seed: int = 5

    def parse(self, data: bytes) -> Sequence[bytes]:
        return data.split()

    def hashes(self, symbols: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, symbols), np.uint64, len(symbols))

    def join(self, symbols: Sequence[bytes]) -> bytes:
        return b" ".join(symbols)

    def kept(self, data: bytes, symbols: Sequence[bytes], removed: np.ndarray) -> bytes:
        return b" ".join(compress(symbols, (~removed).tolist()) if removed.any() else symbols)

    def repeats(self, fragments: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
        """Fragments meet at their anchors and extend to the left and right, word by word, as long as another goes along.

        After d words to one side those that agree share a class. A window with o words to the left of the anchor is as far to
        the left as class o and to the right as the class of the rest: fragments with both in common have the same window.
        """
        split = [f.split() for f in fragments]
        names: dict[bytes, int] = {}
        flat = np.array([names.setdefault(w, len(names)) for words in split for w in words], np.int64)
        hashes = self.hashes([*names])[flat]
        ends = np.cumsum([*map(len, split)])
        begins = np.r_[0, ends[:-1]]
        reach = self.window - self.seed
        low = grams(hashes, self.seed) >> np.uint64(18)
        place = begins + low[begins[:, None] + np.arange(reach + 1)].argmin(1)
        _, group = np.unique(anchor, return_inverse=True)
        for k in range(self.seed):
            group = _classes(group, flat[place + k])
        left, right = [group], [group]
        for d in range(1, reach + 1):
            for side, at in ((left, place - d), (right, place + self.seed - 1 + d)):
                inside = (at >= begins) & (at < ends)
                side.append(_classes(side[-1], np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], -1)))
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        for o in range(reach + 1):
            both = _classes(left[o], right[reach - o])
            some = np.flatnonzero(both >= 0)
            offset = (place - o - begins)[some]
            order = np.lexsort((start[some] + offset, doc[some], both[some]))
            later = order[1:][both[some][order[1:]] == both[some][order[:-1]]]
            out.append((some[later], offset[later]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
