"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, low_enough, written

#: Rows of a block and queries that meet it in one task; pivots, and the rows that they are chosen from; candidates evaluated first.
ROWS, QUERIES, PIVOTS, SAMPLE, STEP = 8192, 2048, 24, 4096, 64
#: Up to so many blocks their distances to the pivots are sent to every task, to leave out blocks; beyond, queries meet all blocks.
BLOCKS = 20_000

#: Stands for scores below 64 bits.
LOWEST = -(1 << 63)

_FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "row long, query_id long, vec_id long, score long"


def pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each is the farthest from those before it, the first the farthest from the mean."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    far = ((x - x.mean(0)) ** 2).sum(1)
    out: list[int] = []
    near = np.full(len(x), np.inf)
    for _ in range(min(count, len(x))):
        k = int(far.argmax())
        out.append(k)
        near = np.minimum(near, ((x - x[k]) ** 2).sum(1))
        far = near
        if not near.max() > 0:
            break
    return x[out]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0))


def search(ids: np.ndarray, x: np.ndarray, table: np.ndarray, query_ids: np.ndarray, q: np.ndarray, to_query: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, ids, scores) of the k best of the rows for each query; ties go to the smaller id, rows of its own id are left out.

    table, to_query: distances to the pivots. |d(q, p) - d(x, p)| <= d(q, x) for each pivot p, so (|q|^2 + |x|^2 - the largest
    of these squared) / 2 is at least the inner product. Rows are evaluated from the highest bound on until the k-th score
    exceeds all bounds that are left. least: scores under which no row of a query is wanted.
    x and q: integers, whose products are exact in doubles up to 2^53; beyond that integers are used, and objects beyond 2^63.
    """
    width = max(x.shape[1], 1)
    top = max(_top(x), _top(q)) ** 2 * width
    exact = top < 2**52
    xf, qf = x.astype(float), q.astype(float)
    bounded = bool(np.isfinite(table).all() and np.isfinite(to_query).all())
    if not exact and top < 2**63:
        x, q = x.astype(np.int64), q.astype(np.int64)
    elif not exact:
        x, q = x.astype(object), q.astype(object)
    with np.errstate(over="ignore", invalid="ignore"):
        x2, q2 = (xf**2).sum(1), (qf**2).sum(1)
    slack = 1 + 1e-7 * (x2.max(initial=0) + q2.max(initial=0))
    for row, own in enumerate(query_ids.tolist()):
        if bounded:
            bound = (q2[row] + x2 - np.abs(table - to_query[row]).max(1) ** 2) / 2 + slack
        else:
            bound = np.full(len(x), np.inf)
        other = ids != own
        floor = -np.inf if least is None else float(least[row]) - 1
        left = np.flatnonzero(other & (bound >= floor))
        score, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(STEP, k)
        while len(left):
            if len(left) > step:  # the highest bounds; of the others, those that may still matter
                cut = np.argpartition(-bound[left], step)
                some, left = left[cut[:step]], left[cut[step:]]
            else:
                some, left = left, left[:0]
            if exact:
                new = np.rint(xf[some] @ qf[row]).astype(np.int64)
            else:
                new = x[some] @ q[row]
                if top >= 2**63:
                    if any(s >= 2**63 for s in new):
                        raise ValueError(f"a score of query {own} doesn't fit into 64 bits")
                    new = np.maximum(new, LOWEST).astype(np.int64)  # an error only if it stays among the best
            score, at = np.concatenate([score, new]), np.concatenate([at, some])
            best = np.lexsort((ids[at], ~score))[:k]
            score, at = score[best], at[best]
            if len(score) == k:
                left = left[bound[left] >= float(score[-1])]
            step *= 4
        yield row, ids[at], score


def _top(x: np.ndarray) -> int:
    return int(max((abs(v) for v in x.ravel().tolist()), default=0)) if x.dtype == object else int(np.abs(x).max(initial=0))


def _matrix(column: pa.Array | pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale x component) of the vectors, shorter ones filled with zeros: 64-bit integers, objects where those don't do."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_list(pa.float64()))
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), width))
    sizes = np.diff(starts)
    x[np.repeat(np.arange(len(column)), sizes), np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], sizes)] = flat[starts[0] : starts[-1]]
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    if not np.isfinite(x).all():
        raise ValueError("a component is too large to be scaled")
    if np.abs(x).max(initial=0) < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _placed(p: np.ndarray, scale: float, width: int):
    """mapInArrow over (row, id, query, v): with near, the number of the nearest pivot, d, the distances to all, and n2, the square of the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                x = _matrix(batch.column(3), scale, width).astype(float)
                d, n2 = distances(x, p), (x**2).sum(1)
            d = np.where(np.isfinite(d), d, np.inf)
            columns = [*batch.columns, pa.array(d.argmin(1) if len(d) else [], pa.int32()), pa.array(list(d), pa.list_(pa.float64())), pa.array(n2, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "query", "v", "near", "d", "n2"])

    return run


def _rows_of(t: pa.Table, scale: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.array(t["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1)
    return t["id"].to_numpy(), _matrix(t["v"], scale, width), table


def _answers(found: Iterator[tuple[int, np.ndarray, np.ndarray]], rows: np.ndarray, ids: np.ndarray) -> pa.Table:
    parts = [(np.full(len(i), rows[k]), np.full(len(i), ids[k]), i, s) for k, i, s in found]
    return pa.table([pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in range(4)], schema=_FOUND)


def _own_block(k: int, scale: float, width: int):
    def run(t: pa.Table) -> pa.Table:
        ids, x, table = _rows_of(t, scale, width)
        ask = np.flatnonzero(t["query"].to_numpy(zero_copy_only=False))
        return _answers(search(ids, x, table, ids[ask], x[ask], table[ask], k), t["row"].to_numpy()[ask], ids[ask])

    return run


def _other_block(k: int, scale: float, width: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:  # a chunk that got no rows or no queries
            return _FOUND.empty_table()
        ids, x, table = _rows_of(rows, scale, width)
        query_ids, q, to_query = _rows_of(asks, scale, width)
        least = asks["least"].to_numpy(zero_copy_only=False)
        return _answers(search(ids, x, table, query_ids, q, to_query, k, least), asks["row"].to_numpy(), query_ids)

    return run


def _wanted(block: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray):
    """Of each query: the blocks, but its own, whose highest possible score isn't under the query's least."""

    @F.arrow_udf("array<long>")
    def wanted(d: pa.Array, n2: pa.Array, least: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for k in range(len(d)):
            q, square, floor = np.array(d[k].as_py(), float), n2[k].as_py(), least[k].as_py()
            with np.errstate(invalid="ignore"):
                apart = np.nan_to_num(np.maximum(low - q, q - high), nan=0.0, posinf=0.0, neginf=0.0).max(1, initial=0.0)
            bound = (square + most - apart**2) / 2 + 1 + 1e-7 * (square + most)
            out.append(block[~(bound < floor) & (block != own[k].as_py())])
        return pa.array(out, pa.list_(pa.int64()))

    return wanted


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product of floor(scale x component), exact.

    queries: a condition on the rows that are queries; all rows but those of the query's own id are candidates, repeated ones
    each by itself. Vectors that are null or hold null or non-finite components, and null ids, take no part. Shorter vectors are
    filled with zeros. Ties go to the smaller id. Query rows that share an id are one query, with the best of their scores and
    rows. Scores that don't fit into 64 bits, where they would be among the best, end the query with an error.

    Rows go to blocks by their nearest pivot (of PIVOTS, from a sample of SAMPLE rows by the hash of their id). A query first
    meets its own block, whose k-th score is its least; then all blocks that their ranges of distances to the pivots don't rule
    out by it. What is collected is bounded: the sample, a count for each pivot, ranges of up to BLOCKS blocks.
    """
    spark = vectors.sparkSession
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.col(id_col).isNotNull()
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), vector.alias("v"))
    width, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1))).first()
    h = F.xxhash64("id", "v")
    sample = rows.where(low_enough(h, SAMPLE, n)).select("v", h.alias("h")).distinct().orderBy(F.shiftrightunsigned("h", 11), "v").limit(SAMPLE).select("v").toArrow()["v"]
    with np.errstate(over="ignore", invalid="ignore"):
        p = pivots(_matrix(sample, scale, width).astype(float), PIVOTS)
    shaped = rows.select(F.monotonically_increasing_id().alias("row"), "id", "query", "v")
    kinds = "row long, id long, query boolean, v array<double>, near int, d array<double>, n2 double"
    placed = written(shaped.mapInArrow(_placed(p, scale, width), kinds), "placed")
    parts = {r.near: -(-r["count"] // ROWS) for r in placed.groupBy("near").count().collect()}
    several = reduce(lambda c, n: c.when(F.col("near") == n, parts[n]), sorted(n for n in parts if parts[n] > 1), F.when(F.lit(False), 1)).otherwise(1)
    block = F.col("near").cast("long") * (1 << 40) + F.pmod(F.xxhash64("row"), several)
    blocks = placed.withColumn("block", block)
    first = written(blocks.groupBy("block").applyInArrow(_own_block(k, scale, width), _FOUND_SQL), "first")
    least = first.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    asks = blocks.where("query").join(least, "row", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
    count = sum(parts.values())
    if count <= BLOCKS:
        ranges = blocks.groupBy("block").agg(F.max("n2").alias("most"), F.array(*(F.min(F.get("d", F.lit(i))) for i in range(len(p)))).alias("low"), F.array(*(F.max(F.get("d", F.lit(i))) for i in range(len(p)))).alias("high")).collect()
        name, most = np.array([r.block for r in ranges], np.int64), np.array([r.most for r in ranges], float)
        low, high = (np.array([r[c] for r in ranges], float).reshape(len(ranges), len(p)) for c in ("low", "high"))
        wanted = _wanted(name, low, high, most)(F.col("d"), F.col("n2"), F.col("least"), F.col("block"))
    else:
        names = F.flatten(F.array(*(F.sequence(F.lit(n << 40).cast("long"), F.lit((n << 40) + m - 1).cast("long")) for n, m in sorted(parts.items()))))
        wanted = F.filter(names, lambda b: b != F.col("block"))
    asked = written(asks.select("row", "id", "v", "d", "least", F.explode(wanted).alias("block")), "asked")
    chunks = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    asking = asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
    meeting = blocks.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "row", "id", "v", "d")
    rest = meeting.groupBy("block", "chunk").cogroup(asking.groupBy("block", "chunk")).applyInArrow(_other_block(k, scale, width), _FOUND_SQL)
    found = written(first.unionByName(rest), "found")
    dropped(placed, first, asked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.when(F.col("score") == LOWEST, F.raise_error(F.lit("a score doesn't fit into 64 bits")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
