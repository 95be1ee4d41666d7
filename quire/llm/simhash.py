"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .graph import components

SEED = 42
#: Rows of a bucket that are compared in one task; larger buckets go to pairs of blocks of about that size.
HEAVY = 4096
#: Up to this size buckets are compared side by side, larger ones each by itself.
SMALL = 48
#: Rows in memory at once.
CHUNK = 1 << 18


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (A-Z in lower case, ASCII white space between), repeats included."""
    parts = text.encode().lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    begins = [0, *(ends[: n - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)], np.uint64, n - words + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit by bit: set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The 64 bits as a long. Null and texts without words: zero."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(shingle_hashes(t or "", words)) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return made(text)


def _planes(x: np.ndarray) -> np.ndarray:
    """64 x words: bit b of 64 rows of x to a word."""
    n = -(-len(x) // 64) * 64
    bits = np.unpackbits(np.pad(x, (0, n - len(x))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


class _Counter:
    """Distances as vertical counters of some bits, one more bit than the radius needs for what exceeds it."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius, self.bits = radius, [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for bit in self.bits:
            new = bit & carry
            np.bitwise_xor(bit, carry, out=bit)
            carry = new
        self.over |= carry

    def exceeded(self) -> np.ndarray:
        """Which distances are over the radius so far."""
        more, same = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                same &= self.bits[k]
            else:
                more |= same & self.bits[k]
                same &= ~self.bits[k]
        return more | self.over

    def keep(self, blocks: np.ndarray) -> None:
        self.bits, self.over = [b[blocks] for b in self.bits], self.over[blocks]


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")


def near_ahead(x: np.ndarray, group: np.ndarray, radius: int, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group (equal numbers, in a row) at a distance up to the radius: each row with those after it.

    Row i meets row i + s for all i at once, for s = 1, 2, ...: planes against the same planes moved by s. A block of words
    is abandoned once all of its pairs exceed the radius.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows, s = np.arange(len(x)), 0
    while True:
        s += 1
        if s > 1:  # only groups that are that large go on
            sizes = np.bincount(np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1) if len(group) else np.zeros(0, int)
            left = np.repeat(sizes > s, sizes)
            x, group, rows = x[left], group[left], rows[left]
        if len(x) <= s:
            break
        wanted = group[:-s] == group[s:]
        if not wanted.any():
            continue
        first, second = _planes(x[:-s]), _planes(x[s:])
        want = np.packbits(np.pad(wanted, (0, first.shape[1] * 64 - len(wanted))), bitorder="little").view(np.uint64)
        pad = -first.shape[1] % block
        first, second, want = (np.pad(v, [(0, 0)] * (v.ndim - 1) + [(0, pad)]) for v in (first, second, want))
        first, second, want = first.reshape(64, -1, block), second.reshape(64, -1, block), want.reshape(-1, block)
        alive, count = np.arange(want.shape[0]), _Counter(want.shape, radius)
        for plane in range(64):
            count.add(first[plane, alive] ^ second[plane, alive])
            if plane % 8 == 7:
                on = (want[alive] & ~count.exceeded()).any(1)
                if not on.all():
                    alive = alive[on]
                    count.keep(on)
                if not len(alive):
                    break
        if len(alive):
            near = np.zeros_like(want)
            near[alive] = want[alive] & ~count.exceeded()
            at = np.flatnonzero(_unpacked(near.ravel())[: len(wanted)])
            a.append(rows[at])
            b.append(rows[at + s])
    return np.concatenate(a), np.concatenate(b)


def near_each(x: np.ndarray, y: np.ndarray, radius: int, queries: int = 64, block: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) at a distance up to the radius, a few rows of x against all planes of y at a time."""
    planes = _planes(y)
    planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % block)))
    words = planes.shape[1] // block
    shaped = planes.reshape(64, words, block)
    for begin in range(0, len(x), queries):
        some = x[begin : begin + queries]
        alive = np.stack(np.meshgrid(np.arange(len(some)), np.arange(words), indexing="ij"), -1).reshape(-1, 2)
        count = _Counter((len(alive), block), radius)
        for plane in range(64):
            flip = np.uint64(0) - ((some >> np.uint64(plane)) & np.uint64(1))
            count.add(shaped[plane, alive[:, 1]] ^ flip[alive[:, 0], None])
            if plane % 8 == 7:
                on = (~count.exceeded()).any(1)
                if not on.all():
                    alive = alive[on]
                    count.keep(on)
                if not len(alive):
                    break
        if len(alive):
            k, bit = np.nonzero(_unpacked(~count.exceeded()).reshape(len(alive), -1))
            q, at = begin + alive[k, 0], alive[k, 1] * block * 64 + bit
            yield q[at < len(y)], at[at < len(y)]


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For n rows with links a - b: the least row of each one's component."""
    root = np.arange(n) if root is None else root
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (deeper := root[root])).any():
            root = deeper
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _bucket_links(x: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near within the groups, a tree of each component instead of all its pairs.

    side: 0 for rows that meet all rows of their group, else 1 and 2: those of 1 meet those of 2.
    """
    if not len(x):
        return x, x
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[cuts, len(x)])
    small = np.repeat((sizes <= SMALL) & (side[cuts] == 0), sizes)
    root = np.arange(len(x))
    at = np.flatnonzero(small)
    a, b = near_ahead(x[at], group[at], radius)
    root = _roots(len(x), at[a], at[b], root)
    for cut, size in zip(cuts.tolist(), sizes.tolist(), strict=True):
        if small[cut]:
            continue
        rows = np.arange(cut, cut + size)
        left, right = (rows, rows) if side[cut] == 0 else (rows[side[rows] == 1], rows[side[rows] == 2])
        if len(left) and len(right):
            for a, b in near_each(x[left], x[right], radius):
                root = _roots(len(x), left[a], right[b], root)
    moved = np.flatnonzero(root != np.arange(len(x)))
    return x[moved], x[root[moved]]


def _links(radius: int):
    """mapInArrow over (band, key, side, fp) sorted by all: links (u, v), u > v, within buckets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)]) if rows.shape[1] else np.zeros(0, np.int64)
            u, v = _bucket_links(rows[3].view(np.uint64), rows[2], group, radius)
            u, v = u.view(np.int64), v.view(np.int64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=schema)

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= CHUNK:
                rows = np.concatenate(held, 1)
                last = int(np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)])[-1])  # that bucket may go on
                if last:
                    yield from made(rows[:, :last])
                held = [rows[:, last:].copy()]
        if held:
            yield from made(np.concatenate(held, 1))

    return run


def links(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints (column fp) that give the components of all pairs up to the radius.

    Of `blocks` blocks of bits, two such fingerprints have all but `radius` in common: each fingerprint goes to a bucket for
    each choice of those. A bucket of one row ends there; one of more than HEAVY rows is dealt out as pairs of blocks. Buckets
    are counted by partial sums, and none comes to one task before it is dealt out.
    """
    blocks = blocks or radius + 4
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for drop in combinations(range(blocks), radius):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks) if k not in drop)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks)))).select(F.col("pos").alias("band"), F.col("col").alias("key"), "fp")
    sized = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = spread_join(keyed, sized, ["band", "key"], "n", prints.count() * len(masks), by="fp")
    parts = F.ceil(F.col("n") / HEAVY).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp")), F.col("parts")).cast("int")
    dealt = counted.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high, one = F.least("own", "other"), F.greatest("own", "other"), F.col("parts") == 1
    side = F.when(one | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    key = F.when(one, F.col("key")).otherwise(F.xxhash64("key", low, high))
    band = F.col("band") + F.when(one, 0).otherwise(len(masks))
    dealt = dealt.select(band.cast("long").alias("band"), key.alias("key"), side.cast("long").alias("side"), "fp")
    return dealt.repartition("band", "key").sortWithinPartitions("band", "key", "side", "fp").mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: its id, fp (64 bits as a long), component_id: the smallest id reachable over links.

    Documents are linked if their fingerprints differ in `radius` bits at most; those without words (null, empty) have
    fingerprint zero and are linked like any other. Repeated rows stay. A null id is never the smallest, unless all are null.
    Links, components and fingerprints stay distributed: only distinct fingerprints are compared, each standing for any
    number of documents, and a fingerprint or component of very many is dealt out over tasks when rows get their component.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    placed = written(distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = spread_join(placed, first, ["root"], "members", distinct.count(), by="fp").select("fp", "rows", "component_id")
    return spread_join(prints, named, ["fp"], "rows", prints.count(), by="id").select("id", "fp", "component_id")
