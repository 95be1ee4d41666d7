"""Near copies of documents: bit-sliced SimHash comparison in buckets, then exact resemblance of all that is left in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, spread_join, written
from .graph import components
from .repeats import _packed, _unpacked
from .simhash import fingerprint_of, near_ahead, near_each, shingle_hashes

#: Bands of so many least values: a pair that resembles 0.8 shares none with probability 3.2e-6, one of 0.85 with 2e-8.
BANDS, LEAST = 24, 4
#: Pairs of fingerprints up to this distance are looked at first (texts that resemble 0.8 differ in 10 bits or so). Pairs beyond aren't lost.
RADIUS = 20
#: Pairs of a node that are looked at first (it is in one of each band at most).
FIRST = 2
#: Rows and shingles of a block: what a task compares at once. Larger buckets are dealt out as blocks.
ROWS, SHINGLES = 1 << 12, 1 << 20
#: Up to so many keys are sent to every executor (24 bytes each); more are joined by a shuffle.
KEYS = 500_000
#: Up to this size buckets are compared side by side, larger ones each by itself: a matter of speed, not of results.
SMALL = 48
_RNG = np.random.Generator(np.random.PCG64(7))
_TIMES, _PLUS = (_RNG.integers(0, 2**32, BANDS * LEAST, np.uint32) | np.uint32(1)), _RNG.integers(0, 2**32, BANDS * LEAST, np.uint32)


def _bands(hashes: np.ndarray) -> list[int]:
    """A number for each band: LEAST least values of the set under as many functions."""
    least = np.full(BANDS * LEAST, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for begin in range(0, len(short), 512):
        least = np.minimum(least, (short[begin : begin + 512, None] * _TIMES + _PLUS).min(0))
    return [int(xxhash.xxh3_64_intdigest(least[k : k + LEAST].tobytes(), k)) - (1 << 63) for k in range(0, BANDS * LEAST, LEAST)]


def _described(words: int):
    @F.arrow_udf("struct<digest binary, fp bigint, bands array<bigint>, n bigint>")
    def described(texts: pa.Array) -> pa.Array:
        digest, fp, bands, n = [], [], [], []
        for k in range(len(texts)):
            text = texts[k].as_py() or ""
            hashes = np.unique(shingle_hashes(text, words))  # as sets: fingerprints and bands like resemblance
            digest.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())))
            fp.append(fingerprint_of(hashes))
            bands.append(_bands(hashes) if len(hashes) else [])
            n.append(len(hashes))
        return pa.StructArray.from_arrays([pa.array(digest, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["digest", "fp", "bands", "n"])

    return described


def _sketch(words: int):
    @F.arrow_udf("binary")
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.array([_packed(np.unique(shingle_hashes(texts[k].as_py() or "", words)).view(np.int64)) for k in range(len(texts))], pa.binary())

    return sketch


def _leaders(fp: np.ndarray, radius: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, leader): each row that is near an earlier leader with the first such one; the others lead."""
    lead = np.zeros(0, np.int64)
    for begin in range(0, len(fp), step):
        rows = np.arange(begin, min(begin + step, len(fp)))
        best = np.full(len(rows), -1, np.int64)
        for q, at in near_each(fp[rows], fp[lead], radius) if len(lead) else ():
            order = np.lexsort((at, q))
            first = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(order) else order
            best[q[first]] = lead[at[first]]
        open_ = rows[best < 0]
        new: list[int] = []
        for row in open_.tolist():  # few: what is near no leader so far
            far = np.bitwise_count(fp[new] ^ fp[row]) if new else np.zeros(0)
            if len(far) and far.min() <= radius:
                best[row - begin] = new[int((far <= radius).argmax())]
            else:
                new.append(row)
        lead = np.concatenate([lead, np.array(new, np.int64)])
        hit = best >= 0
        yield rows[hit], best[hit]


def _bucket_pairs(node: np.ndarray, fp: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes to look at first, one for a row at most: with the first row that is near, or the first leader in large buckets.

    The first, not the nearest: the same row is first in most buckets of a group, so that few different pairs come about.
    """
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[cuts, len(fp)])
    small = sizes <= SMALL
    at = np.flatnonzero(np.repeat(small, sizes))
    a, b = near_ahead(fp[at], group[at], RADIUS)
    order = np.lexsort((a, b))
    first = order[np.r_[True, b[order][1:] != b[order][:-1]]] if len(order) else order
    yield node[at[a[first]]], node[at[b[first]]]
    for cut, size in zip(cuts[~small].tolist(), sizes[~small].tolist(), strict=True):
        rows = slice(cut, cut + size)
        for a, b in _leaders(fp[rows], RADIUS):
            yield node[rows][a], node[rows][b]


def _by_block(columns: int, made, schema: pa.Schema, at_once: int):
    """mapInArrow over (place, ...) sorted by place: made(numbers, other column) is called with whole places, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array | None]] = []
        size, open_ = 0, None

        def joined() -> tuple[np.ndarray, pa.Array | None]:
            return np.concatenate([h[0] for h in held], 1), pa.concat_arrays([h[1] for h in held]) if held[0][1] is not None else None

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:columns]])
            held.append((numbers, batch.column(columns) if batch.num_columns > columns else None))
            size += batch.num_rows
            if size >= at_once and (open_ != numbers[0, -1] or numbers[0, 0] != numbers[0, -1]):
                rows, other = joined()
                last = int(np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])[-1])  # that place may go on
                if last:
                    yield from made(rows[:, :last], None if other is None else other[:last])
                held = [(rows[:, last:].copy(), None if other is None else other[last:])]
                size = rows.shape[1] - last
            open_ = int(numbers[0, -1])
        if held:
            yield from made(*joined())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in run(batches):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], schema=schema)

    return pairs


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _candidates():
    """mapInArrow over (place, node, fp), sorted: pairs (u, v), u > v, to look at first."""

    def made(rows: np.ndarray, _: None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _bucket_pairs(rows[1], rows[2].view(np.uint64), np.cumsum(np.r_[True, rows[0, 1:] != rows[0, :-1]]))

    return _by_block(3, made, _LINK, 1 << 16)


def _open_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block between nodes of different roots that resemble each other: each pair is tried unless links join it already.

    side: rows of 1 meet those of 2, and rows of 0 meet all.
    """
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(kinds), bool)
    label, out = root.copy(), []
    for i in range(len(node) - 1):
        to = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if side[i]:
            to = to[side[to] != side[i]]
        to = to[np.minimum(size[to], size[i]) / np.maximum(size[to], size[i]) >= similarity]  # none resembles more than that
        if not len(to):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        marked[own] = True
        starts = np.cumsum(size[to]) - size[to]
        at = np.arange(int(size[to].sum())) + np.repeat(ends[to] - size[to] - starts, size[to])
        both = np.add.reduceat(marked[flat[at]], starts, dtype=np.int64)
        marked[own] = False
        alike = to[both / (size[i] + size[to] - both) >= similarity]
        out += [(int(node[i]), int(node[j])) for j in alike.tolist()]
        label[np.isin(label, label[alike])] = label[i]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _compared(similarity: float):
    """mapInArrow over (place, side, node, root, sketch), sorted by place: links (u, v), u > v, of texts alike."""

    def made(rows: np.ndarray, sketches: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1], True]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            order = a + np.lexsort((rows[2, a:b], rows[1, a:b]))
            yield _open_links(rows[2, order], rows[3, order], rows[1, order], [_unpacked(sketches[k].as_py()) for k in order.tolist()], similarity)

    return _by_block(4, made, _LINK, 1 << 10)


def _first_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are near, from the buckets with more than one; large buckets as blocks.

    Of a node's pairs those FIRST that most bands have are looked at. The blocks of a bucket don't meet here: each band deals nodes out in another way, so that blocks of one band are joined
    over those of the others. What isn't is left to _left.
    """
    block = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("rows") / ROWS))
    dealt = shared.select(F.when(F.col("rows") <= ROWS, F.col("bucket")).otherwise(F.xxhash64("bucket", block)).alias("place"), "node", "fp")
    found = dealt.repartition("place").sortWithinPartitions("place", "node").mapInArrow(_candidates(), "u long, v long").groupBy("u", "v").agg(F.count(F.lit(1)).alias("bands"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("bands"), "v"))).where(F.col("nth") <= FIRST).select("u", "v")


def _counted(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def _alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose sets resemble each other. A node's sketch is sent to several tasks where very many pairs have it."""
    n = pairs.count()
    sides, made = pairs, []
    for column, sketch in (("u", "a"), ("v", "b")):
        own = written(sketches.join(_counted(pairs, column).withColumnRenamed(column, "node"), "node").select(F.col("node").alias(column), F.col("sketch").alias(sketch), "rows"), "sketches")
        made.append(own)
        sides = spread_join(sides, own, [column], "rows", n, by="v" if column == "u" else "u").drop("rows")

    @F.arrow_udf("double")
    def resemblance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for k in range(len(a)):
            p, q = _unpacked(a[k].as_py()), _unpacked(b[k].as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both))
        return pa.array(out, pa.float64())

    found = written(sides.where(resemblance(F.col("a"), F.col("b")) >= similarity).select("u", "v"), "alike")
    dropped(*made)
    return found


def _left(shared: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u > v: links between texts alike that meet in a bucket and have different roots, whatever their fingerprints.

    A bucket's rows of its commonest root are one side, which needn't be compared with itself; the others are the other side.
    Both are dealt out in blocks: a block of the others meets each block of the commonest root and of the others. Of buckets
    with the same nodes (by number, sum and exclusive or of their hashes) one is looked at.
    """
    rooted = written(shared.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    by_root = rooted.groupBy("place", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(5))).alias("x"))
    several = by_root.groupBy("place").agg(F.sum("k").alias("rows"), F.sum("s").alias("shingles"), F.max(F.struct("k", "s", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("h").alias("h"), F.bit_xor("x").alias("x")).where("roots > 1").dropDuplicates(["rows", "h", "x"])
    blocks = lambda k, s: F.greatest(F.ceil(k / ROWS), F.ceil(s / SHINGLES), F.lit(1)).cast("int")
    sized = written(several.select("place", "rows", F.col("most.root").alias("main"), blocks(F.col("most.k"), F.col("most.s")).alias("mains"), blocks(F.col("rows") - F.col("most.k"), F.col("shingles") - F.col("most.s")).alias("others")), "several")
    total = sized.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    open_ = spread_join(rooted, sized, ["place"], "rows", total, by="node")
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    # blocks -1, -2, ... are of the commonest root, 0, 1, ... of the others; what meets is the pair of their numbers
    other = F.when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))
    small = (F.col("mains") == 1) & (F.col("others") == 1)
    met = open_.withColumn("own", F.when(is_main, -1 - own).otherwise(own)).withColumn("other", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(other)))
    side = F.when(small | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    place = F.when(small, F.col("place")).otherwise(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")))
    dealt = written(met.select(place.alias("place"), side.cast("long").alias("side"), "node", "root"), "open")
    counted = written(sketches.join(_counted(dealt, "node"), "node"), "sketches")
    full = spread_join(dealt, counted, ["node"], "rows", dealt.count(), by="place").select("place", "side", "node", "root", "sketch")
    found = written(full.repartition("place").sortWithinPartitions("place").mapInArrow(_compared(similarity), "u long, v long").distinct(), "left")
    dropped(rooted, sized, dealt, counted)
    return found


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits for an id and its text: equal rows have equal ones."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(text_col, id_col, F.lit(1)).alias("b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows (key, id, digest) and classes (digest, rows, least, first, root): texts of the same words, and their groups."""
    rows = written(docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), _described(words)(F.col(text_col)).alias("d")).select("key", "id", "d.*"), "described")
    grouped = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.min(F.struct("fp", "bands", "n")).alias("d"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "rows", "least", F.col("first.none").alias("none"), F.col("first.key").alias("first"), "d.*"), "classes")
    keyed = written(classes.select("node", "fp", "n", F.posexplode("bands").alias("band", "bucket")).withColumn("bucket", F.xxhash64("bucket", "band")), "bands")
    sized = _counted(keyed, "bucket").where("rows > 1")
    total = classes.count() * BANDS
    shared = written(spread_join(keyed, sized, ["bucket"], "rows", total, by="node"), "shared")
    pairs = written(_first_pairs(shared), "pairs")
    needed = written(classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("__first")), "needed")
    texts = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    own = texts.join(F.broadcast(needed) if needed.count() <= KEYS else needed, F.col("__key") == F.col("__first"))
    sketches = written(own.select("node", _sketch(words)(F.col("__text")).alias("sketch")).groupBy("node").agg(F.first("sketch").alias("sketch")), "sketch")
    alike = _alike(pairs, sketches, similarity)
    roots = components(alike)
    dropped(pairs)
    left = _left(shared.select(F.col("bucket").alias("place"), "node", "n"), roots, sketches, similarity)
    if not left.isEmpty():
        roots = components(roots.unionByName(left))
    out = written(classes.drop("fp", "bands", "n").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    dropped(keyed, shared, needed, sketches, classes, alike, left, roots)
    return rows, out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, id, group_id, keeps, times): a row for each row_key; group_id: the smallest id of its group; keeps: whether it is its
    group's one document; times: how many equal rows have the key.

    Documents of the same words are copies; of the others, those go together that share `similarity` of their shingles (as
    sets, A-Z in lower case), directly or over others. Texts without words (null, empty) are copies of each other. Texts meet
    in buckets of equal bands of least hashes. There FIRST pairs of each text that are near by fingerprint are looked at first, so
    that groups come together without all their pairs; then, whatever the fingerprints and however large the bucket, all pairs that
    aren't in one group by then. Null ids come last. Copies, groups and buckets of any size are dealt out over tasks.
    """
    rows, classes = _classes(docs, id_col, text_col, words, similarity)
    groups = written(classes.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("group_id"), F.min(F.struct("none", "least", "first")).alias("f")), "groups")
    placed = written(spread_join(classes.withColumnRenamed("rows", "copies"), groups, ["root"], "rows", classes.count(), by="node").select("digest", F.col("copies").alias("rows"), "group_id", F.col("f.first").alias("stays")), "placed")
    found = spread_join(rows.select("key", "id", "digest"), placed, ["digest"], "rows", rows.count(), by="key")
    return found.groupBy("key").agg(F.first("id").alias("id"), F.first("group_id").alias("group_id"), F.first(F.col("key") == F.col("stays")).alias("keeps"), F.count(F.lit(1)).alias("times"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that near_copies keeps: one of each group. Of equal rows one stays."""
    rows, classes = _classes(docs, id_col, text_col, words, similarity)
    kept = classes.groupBy("root").agg(F.min(F.struct("none", "least", "first")).alias("f")).select(F.col("f.first").alias("key"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    gone = written(times.join(kept, "key", "left_anti").select(F.col("key").alias("__gone")), "gone")
    n, repeated = gone.count(), not times.where("times > 1").isEmpty()
    dropped(rows, classes)
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    out = keyed.join(F.broadcast(gone) if n <= KEYS else gone, F.col("__key") == F.col("__gone"), "left_anti")
    return (out.dropDuplicates(["__key"]) if repeated else out).drop("__key")
