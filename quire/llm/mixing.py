"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHARES, WORD, written

#: Documents of a source that one flight takes, and flights whose rests the next one takes together.
FLIGHT, REST = 4096, 1000
#: Documents, of all sizes, that each flight leaves open: those of the last one go to the landing, where all their choices are weighed.
LANDING = 14


def targets(sizes: dict, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, total: float | None = None) -> dict:
    """Words that each source should give: by weight (the sources by code point, null last, weigh 1, 2, 3, 1, ...).

    None exceeds cap times the source's own size; what is over is reshared by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s] if isinstance(s, str) else s) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values()) if total is None else total), [*names], {}
    while open_:
        all_ = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / all_ > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / all_ for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Moves probabilities through the null space of the two totals (documents and words) until two at most are neither 0 nor 1.

    Three open documents at a time: (c - b, a - c, b - a) for sizes a, b, c changes neither total. Which way along it is
    drawn with the probabilities that keep each document's expectation, from coin (0 to 1, one for each document).
    """
    p = p.astype(float).tolist()
    s, coin = size.astype(float).tolist(), coin.tolist()
    open_: list[int] = []
    for k in range(len(p)):
        if not 1e-9 < p[k] < 1 - 1e-9:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = (s[i] for i in open_)
        u = (c - b, a - c, b - a) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(open_, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(open_, u, strict=True) if x)
        step = up if coin[k] * (up + down) < down else -down
        for i, x in zip(open_, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = float(round(p[i]))
        open_ = [i for i in open_ if 0 < p[i] < 1]
    return np.array(p, float)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few open documents of a source to 0 or 1: the choice whose words, then documents, come nearest to what is expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = np.abs(choices @ size[open_].astype(float) - p[open_] @ size[open_].astype(float))
        more = np.abs(choices.sum(1) - p[open_].sum())
        p[open_] = choices[np.lexsort((np.arange(len(choices)), np.round(more, 6), np.round(off, 6)))[0]]
    return p


def turn(p: np.ndarray, due: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
    """Turns settled documents over, in order and as long as they fit, to make up for what the landing is off.

    That is much only where one document outweighs all others of the landing.
    """
    off = float(p @ size - due @ size)
    for k in order.tolist():
        if abs(off) < 1:
            break
        if 0 < size[k] <= abs(off) and 0 < due[k] < 1 and p[k] == (off > 0):
            p[k] = 1 - p[k]
            off -= size[k] * (1 if off > 0 else -1)


def _flights(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        t = {c: rows[c].to_numpy(zero_copy_only=False) for c in ("__size", "__p", "__coin")}
        order = np.lexsort((t["__coin"], -t["__size"]))  # the smallest documents come last and stay open
        p = t["__p"].copy()
        left = np.unique(np.linspace(0, len(order) - 1, min(LANDING, len(order))).round().astype(int))
        flown = np.delete(order, left)
        p[flown] = flight(p[flown], t["__size"][flown], (t["__coin"][flown] >> 11) / float(1 << 53) + 0.5)
        if last:
            p[order] = landing(p[order], t["__size"][order])
            turn(p, t["__p"], t["__size"], order)
        return rows.set_column(rows.schema.get_field_index("__p"), "__p", pa.array(p))

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per row of docs: id, key, source, size (words), source_size, target, copies, taken (copies x size).

    A source's documents are each due target / source_size times: the whole part always, the rest as a probability, settled by
    flights over parts of the source with the documents that stay open (LANDING of all sizes and two to a part) going to the
    next flight, until a landing of a few documents is left for each source. A source's draw depends on its own documents and
    its target, not on how many flights other sources need. Drawn from key, a hash of id and text: reruns agree. Null texts have no words
    and a null source is a source. Sources without words have target 0 and nothing is taken. Of rows that repeat, each is a
    document; equal rows that are very many are dealt out over the flights by their place. What is collected is one row per
    source.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("key")), "sizes")
    spark = docs.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    goal = targets({r.source: r.source_size for r in stats}, weights, cap)
    due = {r.source: goal[r.source] / r.source_size if r.source_size else 0.0 for r in stats}
    parts = {r.source: -(-r.n // FLIGHT) for r in stats}
    kind = sized.schema["source"].dataType.simpleString()
    by_source = spark.createDataFrame([(r.source, r.source_size, float(goal[r.source]), min(due[r.source], cap), parts[r.source]) for r in stats], f"__source {kind}, source_size long, target double, __due double, __parts long")
    joined = sized.join(by_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    often = max(FLIGHT, sum(r.n for r in stats) // SHARES)  # so that there can't be more than SHARES such keys
    hot = F.broadcast(sized.groupBy(F.col("key").alias("__hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("__hot"))
    joined = joined.withColumn("__at", F.monotonically_increasing_id()).join(hot, F.col("key") == F.col("__hot"), "left")
    deal = F.when(F.col("__hot").isNull(), F.xxhash64("key", F.lit(5))).otherwise(F.xxhash64("key", "__at"))
    coin = F.xxhash64(F.col("key"), F.lit(97))
    units = joined.select("id", "key", "source", "source_size", "target", F.col("size").alias("__size"), F.floor("__due").alias("__whole"), (F.col("__due") - F.floor("__due")).alias("__p"), coin.alias("__coin"), F.pmod(deal, F.col("__parts")).alias("__part"))
    settled: list[DataFrame] = []
    most = max(parts.values(), default=1)
    while True:
        units = units.groupBy("source", "__part").applyInArrow(_flights(most <= 1), units.schema)
        if most <= 1:
            settled.append(units)
            break
        units = written(units, "flights")
        settled.append(units.where("__p <= 0 or __p >= 1"))
        units = units.where("__p > 0 and __p < 1").withColumn("__part", F.floor(F.col("__part") / REST))
        most = -(-most // REST)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("__whole") + F.round("__p")).cast("long")
    return out.select("id", "key", "source", F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of docs, all columns, with size, source_size, target, copies and taken; columns of those names are replaced.

    Rows find their draw by key; equal rows have equal copies in sum but may differ, and are numbered to be joined.
    """
    drop = [x for x in ("copies", "taken", "target", "size", "source_size") if x in docs.columns]
    plain = docs.drop(*drop)
    found = mix(plain, id_col, text_col, source_col, weights, cap)
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    key = F.xxhash64("__key", "__of", "__size").alias("__key")
    dealt = found.select(F.col("key").alias("__key"), F.col("source").alias("__of"), F.col("size").alias("__size"), "source_size", "target", "copies", "taken").select(key, "source_size", "target", "copies", "taken").withColumn("__nth", nth("__key"))
    own = plain.withColumn("size", word_count(F.col(text_col))).withColumn("__own_key", F.xxhash64(F.xxhash64(id_col, text_col), source_col, "size")).withColumn("__own", nth("__own_key"))
    return own.join(dealt, (F.col("__own_key") == F.col("__key")) & (F.col("__own") == F.col("__nth"))).drop("__key", "__nth", "__own_key", "__own")
