"""Removal of what occurred earlier in the corpus: the exchange that the two substring operators share.

A window is a run of `window` symbols (bytes or words). Of each window the lowest seed gram (`seed` symbols, by a hash) is its
anchor, so equal windows have equal anchors at the same place. The windows of a document that share an anchor stand side by
side; the stretch they cover is a fragment. Four steps, each a shuffle by number of a partition, with no key in one place:

ask      each task drops its own exact copies and asks, once for each anchor, whether another text has it too
answer   the anchors that other texts have, and the whole texts that are copies, go back to their documents
fragment documents send the fragments of those anchors, equal ones of a task once; for very frequent anchors, which many
         unlike fragments share, each window goes by itself, by its own hash, so that no anchor fills a task
judge    equal fragments leave the earliest; anchors with unlike fragments go to the method (Scheme.repeats)

and the windows found go back to their documents, where the symbols that they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spread_join, utf8_arrays, written

#: Symbols that are hashed together (their places fit into PLACE), fragments and anchors that a task holds before it sends.
CHUNK, PLACE, HELD = 1 << 17, np.uint64((1 << 18) - 1), 1_500_000
#: An anchor is very frequent if it occurs so often, and more often than this share of what its task has been asked.
HOT, HOT_SHARE = 1000, 0.02

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROW = "bucket long, kind int, doc long, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()), *((x, pa.binary()) for x in "abcde")])
#: Kinds of rows, in the order in which a task needs them.
ASKED, TEXTS, ANSWERS, HOT_ANCHORS, FRAGMENTS, WINDOWS, REMOVED, COPIES, DOCUMENT = range(9)


@dataclass(frozen=True)
class Scheme:
    """What symbols are, and the method that finds equal windows of unlike fragments."""

    window: int
    seed: int

    def parse(self, data: bytes) -> Sequence:
        """The symbols."""
        raise NotImplementedError

    def hashes(self, symbols: Sequence) -> np.ndarray:
        raise NotImplementedError

    def join(self, symbols: Sequence) -> bytes:
        """Symbols to bytes from which parse() makes them again."""
        raise NotImplementedError

    def kept(self, data: bytes, symbols: Sequence, removed: np.ndarray) -> bytes:
        raise NotImplementedError

    def repeats(self, fragments: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
        """(fragment, offset) of each window that also starts earlier, by doc and start, in a fragment of the same anchor."""
        raise NotImplementedError


def _packed(x: np.ndarray) -> bytes:
    """Integers as zstd of the byte planes of their differences."""
    x = np.asarray(x, np.int64)
    return zstandard.compress(np.ascontiguousarray(np.diff(x, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes(), 1) if len(x) else b""


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> np.uint64(31))) * _M1
    z += y * _M2
    z ^= z >> np.uint64(32)
    return z


def _bucket(x: np.ndarray, parts: int) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64, copy=False)
    z = (x ^ (x >> np.uint64(33))) * _M2
    z = (z ^ (z >> np.uint64(29))) * _M1
    return ((z >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def grams(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` symbols, from those of runs of 1, 2, 4, ..."""
    out, made, power, size = None, 0, h, 1
    while True:
        if length & size:
            n = len(h) - (made + size) + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = power[:n] if out is None else _mix(power[:n], out[size : size + n])
            made += size
        if 2 * size > length:
            return out
        if len(power) <= size:
            return np.zeros(0, np.uint64)
        power, size = _mix(power[:-size], power[size:]), 2 * size


def anchors(h: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of their anchor) of the runs of windows with one anchor.

    h: hashes of symbols of several pieces, piece k from begins[k] to ends[k]; windows stay inside a piece. Of equal lowest
    grams the first is the anchor.
    """
    none = np.zeros(0, np.int64)
    sizes = np.maximum(ends - begins - window + 1, 0)
    if not sizes.any():
        return none, none, none.astype(np.uint64)
    g = grams(h, seed)
    low = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    span, size = window - seed + 1, 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    steps = np.ones(int(sizes.sum()), np.int64)
    some = np.flatnonzero(sizes)
    heads = np.cumsum(sizes[some]) - sizes[some]
    steps[heads] = begins[some]
    steps[heads[1:]] -= begins[some][:-1] + sizes[some][:-1] - 1
    at = np.cumsum(steps)
    place = (low[at] & PLACE).astype(np.int64)
    first = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]
    first[heads] = True
    run = np.flatnonzero(first)
    return at[run], np.diff(np.r_[run, len(at)]), g[place[run]]


class _Pieces:
    """Documents in pieces, hashed together: yields (document's number, start, windows, anchor) of runs."""

    def __init__(self, scheme: Scheme):
        self.scheme, self.waiting, self.size = scheme, [], 0

    def add(self, number: int, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        step = CHUNK - self.scheme.window
        for begin in range(0, max(1, len(hashes) - self.scheme.window + 1), step):
            part = hashes[begin : begin + step + self.scheme.window - 1]
            if self.size + len(part) > CHUNK:
                yield from self.flush()
            self.waiting.append((number, begin, part))
            self.size += len(part)

    def flush(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.waiting:
            number, offset = (np.array([w[k] for w in self.waiting], np.int64) for k in (0, 1))
            ends = np.cumsum([len(w[2]) for w in self.waiting])
            begins = np.r_[0, ends[:-1]]
            at, n, anchor = anchors(np.concatenate([w[2] for w in self.waiting]), begins, ends, self.scheme.window, self.scheme.seed)
            piece = np.searchsorted(ends, at, "right")
            self.waiting, self.size = [], 0
            yield number[piece], at - begins[piece] + offset[piece], n, anchor


def _rows(bucket: Any, kind: int, doc: Any = 0, **columns: list) -> pa.RecordBatch:
    n = len(bucket)
    data = [pa.array(bucket, pa.int64()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.broadcast_to(np.asarray(doc, np.int64), n))]
    return pa.RecordBatch.from_arrays([*data, *(pa.array(columns[c], pa.binary()) if c in columns else pa.nulls(n, pa.binary()) for c in "abcde")], schema=_SCHEMA)


def _dealt(keys: np.ndarray, bucket: np.ndarray, kind: int, by: np.ndarray, **columns: tuple[np.ndarray, Any]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with the columns' values there, ordered by `by`. columns: (values, how they become bytes)."""
    if not len(bucket):
        return
    order = np.lexsort((by, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[cuts[1:], len(bucket)]
    sorted_ = {c: (v[order], how) for c, (v, how) in columns.items()}
    for begin in range(0, len(cuts), 256):
        some = list(zip(cuts[begin : begin + 256].tolist(), ends[begin : begin + 256].tolist(), strict=True))
        yield _rows(keys[bucket[cuts[begin : begin + 256]]], kind, **{c: [how(v[i:j]) for i, j in some] for c, (v, how) in sorted_.items()})


_raw = lambda v: np.ascontiguousarray(v).tobytes()


def _digest(data: bytes) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(data), 1 << 64)


def _ask(scheme: Scheme, keys: np.ndarray):
    """(doc, text) -> what the task asks, and what it knows by itself."""
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[int, int], list[int]] = {}  # the documents that have a text
        numbers: list[tuple[int, int]] = []
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        pieces = _Pieces(scheme)

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal texts, numbers, found, held
            found += pieces.flush()
            least = {t: min(docs) for t, docs in texts.items()}
            copies = np.array([d for t, docs in texts.items() for d in {*docs} if d != least[t]], np.int64)
            yield from _dealt(keys, _bucket(copies, parts), COPIES, copies, a=(copies, _packed))
            owner = np.array([least[t] for t in numbers], np.int64)
            text = np.array(numbers, np.uint64).reshape(-1, 2)
            yield from _dealt(keys, _bucket(text[:, 0], parts), TEXTS, owner, a=(text[:, 0], _raw), b=(text[:, 1], _raw), c=(owner, _packed))
            if found:
                number, anchor = (np.concatenate([f[k] for f in found]) for k in (0, 3))
                order = np.argsort(anchor, kind="stable")
                number, anchor = number[order], anchor[order]
                cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                times = np.diff(np.r_[cuts, len(anchor)])
                alone = times == 1
                doc = np.where(alone, owner[number[cuts]], 0)
                name = np.where(alone, text[number[cuts], 1], np.uint64(0))
                yield from _dealt(keys, _bucket(anchor[cuts], parts), ASKED, doc, a=(anchor[cuts], _raw), b=(doc, _packed), c=(name, _raw), d=(times, _packed))
                again = np.repeat(~alone, times)
                doc = owner[number[again]]
                yield from _dealt(keys, _bucket(doc, parts), ANSWERS, doc, a=(doc, _packed), b=(anchor[again].astype(np.uint32), _raw))
            texts, numbers, found, held = {}, [], [], 0

        for batch in batches:
            flat, starts = utf8_arrays(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                data = flat[starts[k] : starts[k + 1]].tobytes()
                if len(data) < scheme.window:
                    continue
                symbols = scheme.parse(data)
                if len(symbols) < scheme.window:
                    continue
                name = _digest(scheme.join(symbols))
                docs = texts.setdefault(name, [])
                docs.append(doc)
                if len(docs) == 1:
                    numbers.append(name)
                    for f in pieces.add(len(numbers) - 1, scheme.hashes(symbols)):
                        found.append(f)
                        held += len(f[0])
                if held >= HELD or len(numbers) >= HELD:
                    yield from send()
        yield from send()

    return run


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as tuples, the documents' text apart from Python's memory until it is asked for."""
    bucket, kind, doc = (batch.column(k).to_pylist() for k in range(3))
    for k in range(batch.num_rows):
        yield bucket[k], kind[k], doc[k], *(batch.column(c)[k].as_py() for c in range(3, 8))


def _passed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _answer(keys: np.ndarray):
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[np.ndarray, ...]] = []
        texts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            through = []
            for row in _columns(batch):
                a, b, c, d = row[3:7]
                if row[1] == ASKED:
                    asked.append((np.frombuffer(a, np.uint64), _unpacked(b), np.frombuffer(c, np.uint64), _unpacked(d)))
                elif row[1] == TEXTS:
                    texts.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), _unpacked(c)))
                else:
                    through.append(row)
            if through:
                yield _passed(through)
        if texts:
            a, b, doc = (np.concatenate([t[k] for t in texts]) for k in range(3))
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
            copies = np.unique(doc[doc != least])
            yield from _dealt(keys, _bucket(copies, parts), COPIES, copies, a=(copies, _packed))
        if asked:
            anchor, doc, name, times = (np.concatenate([t[k] for t in asked]) for k in range(4))
            order = np.argsort(anchor, kind="stable")
            anchor, doc, name, times = anchor[order], doc[order], name[order], times[order]
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sizes = np.diff(np.r_[cuts, len(anchor)])
            total = np.add.reduceat(times, cuts)
            again = (np.maximum.reduceat(times, cuts) > 1) | (np.maximum.reduceat(name, cuts) != np.minimum.reduceat(name, cuts))
            reply = np.repeat(again, sizes) & (times == 1)
            doc = doc[reply]
            yield from _dealt(keys, _bucket(doc, parts), ANSWERS, doc, a=(doc, _packed), b=(anchor[reply].astype(np.uint32), _raw))
            hot = anchor[cuts][again & (total > max(HOT, HOT_SHARE * len(anchor)))]
            if len(hot):
                yield _rows(keys, HOT_ANCHORS, a=[_raw(hot)] * parts)

    return run


def _document(parts_keys: np.ndarray):
    """(doc, text) -> a row for the document's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            flat, starts = utf8_arrays(batch.column(1))
            doc = batch.column(0).to_numpy()
            for begin in range(0, len(doc), 1000):
                some = range(begin, min(begin + 1000, len(doc)))
                texts = [compressor.compress(flat[starts[k] : starts[k + 1]]) if starts[k] < starts[k + 1] else b"" for k in some]
                yield _rows(keys_of(parts_keys, doc[begin : begin + 1000]), DOCUMENT, doc[begin : begin + 1000], a=texts)

    return run


def keys_of(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return keys[_bucket(doc, len(keys))]


def _text(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


def _sorted_by(rows: list[tuple[np.ndarray, ...]], columns: int) -> tuple[np.ndarray, ...]:
    """The columns of all rows, ordered by the first."""
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(columns))
    joined = [np.concatenate([r[k] for r in rows]) for k in range(columns)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(c[order] for c in joined)


def _fragment(scheme: Scheme, keys: np.ndarray):
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple[np.ndarray, ...]] = []
        copies: list[tuple[np.ndarray]] = []
        hot: list[np.ndarray] = []
        ready = None
        pieces = _Pieces(scheme)
        texts: list[tuple[int, Sequence]] = []
        seen: set[int] = set()
        found: list[tuple[int, int, int, int, bytes]] = []  # doc, start, windows, anchor, content
        windows: list[tuple[int, int, tuple[int, int]]] = []

        def runs(some: Iterator[tuple[np.ndarray, ...]]) -> None:
            for number, start, n, anchor in some:
                wanted = np.zeros(len(number), bool)
                for k in np.unique(number).tolist():
                    lo, hi = np.searchsorted(number, [k, k + 1])
                    i, j = np.searchsorted(ready[0], [texts[k][0], texts[k][0] + 1])
                    wanted[lo:hi] = np.isin(anchor[lo:hi].astype(np.uint32), ready[1][i:j])
                at = np.flatnonzero(wanted)
                often = np.isin(anchor[at], ready[3])
                for k, s, m, x, h in zip(number[at].tolist(), start[at].tolist(), n[at].tolist(), anchor[at].tolist(), often.tolist(), strict=True):
                    doc, symbols = texts[k]
                    if h:
                        windows.extend((doc, s + o, _digest(scheme.join(symbols[s + o : s + o + scheme.window]))) for o in range(m))
                    else:
                        found.append((doc, s, m, x, scheme.join(symbols[s : s + m - 1 + scheme.window])))

        def send() -> Iterator[pa.RecordBatch]:
            runs(pieces.flush())
            found.sort(key=lambda f: f[:2])
            windows.sort(key=lambda w: w[:2])
            first: dict[Any, int] = {}
            kept, gone = [], []
            for k, f in enumerate(found):
                (kept if first.setdefault(f[3:], k) == k else gone).append(k)
            out = [np.array([found[k][c] for k in kept], np.uint64 if c == 3 else np.int64) for c in range(4)]
            if kept:
                bucket = _bucket(out[3], parts)
                order = np.lexsort((out[1], out[0], bucket))
                cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
                for group in np.split(order, cuts[1:]):
                    content = [found[kept[k]][4] for k in group.tolist()]
                    yield _rows(keys[bucket[group[:1]]], FRAGMENTS, a=[_packed(out[0][group])], b=[_packed(out[1][group])], c=[_raw(out[3][group].astype(np.uint32))], d=[_packed(np.array([*map(len, content)]))], e=[zstandard.compress(b"".join(content), 1)])
            seen_windows: dict[tuple[int, int], int] = {}
            single, removed = [], [found[k][:3] for k in gone]
            for k, (doc, s, name) in enumerate(windows):
                if seen_windows.setdefault(name, k) == k:
                    single.append(k)
                else:
                    removed.append((doc, s, 1))
            if single:
                name = np.array([windows[k][2] for k in single], np.uint64)
                doc, start = (np.array([windows[k][c] for k in single], np.int64) for c in (0, 1))
                yield from _dealt(keys, _bucket(name[:, 0], parts), WINDOWS, doc, a=(name[:, 0], _raw), b=(name[:, 1], _raw), c=(doc, _packed), d=(start, _packed))
            yield from _removed(keys, removed)
            found.clear()
            windows.clear()
            texts.clear()

        for batch in batches:
            for row in _columns(batch):
                if row[1] == ANSWERS:
                    answers.append((_unpacked(row[3]), np.frombuffer(row[4], np.uint32)))
                elif row[1] == COPIES:
                    copies.append((_unpacked(row[3]),))
                    yield _passed([row])
                elif row[1] == HOT_ANCHORS:
                    hot.append(np.frombuffer(row[3], np.uint64))
                else:
                    if ready is None:
                        ready = (*_sorted_by(answers, 2), {*np.concatenate([c[0] for c in copies]).tolist()} if copies else set(), np.concatenate(hot) if hot else np.zeros(0, np.uint64))
                        answers.clear()
                    doc = row[2]
                    i, j = np.searchsorted(ready[0], [doc, doc + 1])
                    if i == j or doc in ready[2] or doc in seen:
                        continue
                    seen.add(doc)
                    symbols = scheme.parse(_text(row[3]))
                    texts.append((doc, symbols))
                    runs(pieces.add(len(texts) - 1, scheme.hashes(symbols)))
                    if len(found) + len(windows) >= HELD // 5 or len(texts) >= 2000:
                        yield from send()
        if ready is not None:
            yield from send()

    return run


def _removed(keys: np.ndarray, runs: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """runs: (doc, first window, windows)."""
    if runs:
        doc, start, n = np.array(sorted(runs), np.int64).T
        yield from _dealt(keys, _bucket(doc, len(keys)), REMOVED, np.arange(len(doc)), a=(doc, _packed), b=(start, _packed), c=(n, _packed))


def _judge(scheme: Scheme, keys: np.ndarray, at_once: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        content: list[bytes] = []
        windows: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            through = []
            for row in _columns(batch):
                if row[1] == FRAGMENTS:
                    sizes = _unpacked(row[6])
                    data, ends = zstandard.decompress(row[7]), np.cumsum(sizes).tolist()
                    content += [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
                    parts.append((_unpacked(row[3]), _unpacked(row[4]), np.frombuffer(row[5], np.uint32)))
                elif row[1] == WINDOWS:
                    windows.append((np.frombuffer(row[3], np.uint64), np.frombuffer(row[4], np.uint64), _unpacked(row[5]), _unpacked(row[6])))
                else:
                    through.append(row)
            if through:
                yield _passed(through)
        if windows:
            a, b, doc, start = (np.concatenate([w[k] for w in windows]) for k in range(4))
            order = np.lexsort((start, doc, b, a))
            a, b = a[order], b[order]
            later = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
            yield from _removed(keys, [(d, s, 1) for d, s in zip(doc[later].tolist(), start[later].tolist(), strict=True)])
        if not content:
            return
        doc, start, anchor = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((start, doc, anchor))
        cuts = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        gone: list[tuple[int, int, int]] = []
        unlike: list[int] = []
        size = 0
        for group in np.split(order, cuts[1:]):
            if len(group) > 1:
                first: dict[bytes, int] = {}
                for k in group.tolist():
                    if first.setdefault(content[k], k) != k:
                        gone.append((int(doc[k]), int(start[k]), len(scheme.parse(content[k])) - scheme.window + 1))
                if len(first) > 1:
                    unlike += first.values()
                    size += sum(map(len, first))
            if size > at_once:
                gone += _unlike(scheme, unlike, content, anchor, doc, start)
                unlike, size = [], 0
            if len(gone) > HELD:
                yield from _removed(keys, gone)
                gone = []
        gone += _unlike(scheme, unlike, content, anchor, doc, start)
        yield from _removed(keys, gone)

    return run


def _unlike(scheme: Scheme, rows: list[int], content: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    if not rows:
        return []
    at = np.array(rows)
    fragment, offset = (np.asarray(v, np.int64) for v in scheme.repeats([content[k] for k in rows], anchor[at], doc[at], start[at]))
    order = np.lexsort((offset, fragment))
    fragment, offset = fragment[order], offset[order]
    first = np.flatnonzero(np.r_[True, (fragment[1:] != fragment[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(fragment) else np.zeros(0, int)
    n = np.diff(np.r_[first, len(fragment)])
    k = at[fragment[first]]
    return list(zip(doc[k].tolist(), (start[k] + offset[first]).tolist(), n.tolist(), strict=True))


def _finish(scheme: Scheme, with_text: bool):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed: list[tuple[np.ndarray, ...]] = []
        copies: list[np.ndarray] = []
        ready = None
        for batch in batches:
            out = []
            for row in _columns(batch):
                if row[1] == REMOVED:
                    removed.append((_unpacked(row[3]), _unpacked(row[4]), _unpacked(row[5])))
                    continue
                if row[1] == COPIES:
                    copies.append(_unpacked(row[3]))
                    continue
                if ready is None:
                    ready = (*_sorted_by(removed, 3), {*np.concatenate(copies).tolist()} if copies else set())
                    removed.clear()
                data = _text(row[3])
                symbols = scheme.parse(data)
                n = len(symbols)
                gone = np.zeros(n, bool)
                i, j = np.searchsorted(ready[0], [row[2], row[2] + 1])
                if row[2] in ready[3]:
                    gone[:] = True
                elif i < j:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, np.minimum(ready[1][i:j], n), 1)
                    np.add.at(change, np.minimum(ready[1][i:j] + ready[2][i:j] + scheme.window - 1, n), -1)
                    gone = np.cumsum(change[:-1]) > 0
                count = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if count else 0
                kept = scheme.kept(data, symbols, gone)
                out.append((row[2], n, count, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def partition_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """A long for each of so many hash partitions that is dealt there: then no two buckets meet in one by chance."""
    rows = spark.range(0, 24 * parts + 200, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r.p: r.id for r in rows}
    return np.array([found[p] for p in sorted(found)], np.int64)


#: Bytes of text for each partition at most: what its tasks hold in memory follows from that.
PARTITION_BYTES = 1 << 27


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame | None]:
    """(doc, text) with numbers in order of the ids, the bytes of all texts, and (doc, id) unless doc is the id itself.

    Integer ids that each have one text are numbers already. Else the distinct ids and texts are sorted over all partitions
    and numbered there.
    """
    id_, text = F.col(id_col), F.col(text_col)
    rows = docs.select(id_.alias("id"), text.cast("binary").alias("text"), F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(text, id_, F.lit(1)).alias("b")).alias("key"))
    by_id = rows.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    several, size = by_id.agg(F.count_if((F.col("low") != F.col("high")) | F.col("id").isNull()), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not several and docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return rows.select(F.col("id").cast("long").alias("doc"), "text"), size, None
    distinct = rows.groupBy("key").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("id").asc_nulls_last(), "key")
    numbers = written(distinct.select(F.monotonically_increasing_id().alias("doc"), "key", "id", "rows"), "numbers")
    total = numbers.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    placed = spread_join(rows.select("key", "text").withColumn("at", F.monotonically_increasing_id()), numbers, ["key"], "rows", total, by="at")
    return written(placed.select("doc", "text"), "texts"), size, numbers.select("doc", "id")


def remove_repeats(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n (symbols), n_removed, n_spans (maximal removed runs), kept_sha256, kept (null without with_text).

    Removed is each symbol inside a window that also starts earlier: in a document of a smaller id, or in the same one before.
    Windows are judged on the input. Null texts have no symbols. Rows that share an id are one document: its distinct texts
    stand one after the other, in order of a hash, and no window crosses them; repeated rows (same id and text) are one text and
    have equal results. Ids can be of any type that has an order; null ids come after all others. Lost executors cost the step
    they are in: what is asked, answered and judged is written to the shared folder, and each task gets its rows in a total
    order, so that a task that runs again does the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, size, ids = _numbered(docs, id_col, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    keys = partition_keys(spark, parts)
    dealt = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("kind", "doc")
    texts = rows.mapInArrow(_document(keys), ROW)
    asked = rows.mapInArrow(_ask(scheme, keys), ROW)
    answered = written(dealt(asked).mapInArrow(_answer(keys), ROW), "answered")
    fragments = dealt(answered.unionByName(texts)).mapInArrow(_fragment(scheme, keys), ROW)
    judged = written(dealt(fragments).mapInArrow(_judge(scheme, keys), ROW), "judged")
    found = dealt(judged.unionByName(texts)).mapInArrow(_finish(scheme, with_text), "doc long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if ids is None:
        return found.withColumnRenamed("doc", "id").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    counts = ids.join(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")), "doc")
    return spread_join(found.withColumn("at", F.monotonically_increasing_id()), counts, ["doc"], "rows", rows.count(), by="at").select("id", *found.columns[1:])
