"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import utf8_arrays

#: Bytes whose shares are statistics: one row of the table for each.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|", b"#$%&*@^~<>{}[]\\/=+_", b"'\"()-", bytes(range(128, 256)))
_OF_BYTE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES, 1):
    _OF_BYTE[list(_bytes)] = _k
STATISTICS = len(_CLASSES) + 9
PIECE = 4 << 20


def _words(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    kinds = len(set(words))
    return (
        np.log1p(n),
        sum(map(len, words)) / n,
        max(map(len, words)),
        sum(map(eq, words, words[1:])) / n,
        kinds / n,
        kinds / n**0.7,
        1 - len(set(lines)) / len(lines),
    )


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each whole text: shares of kinds of bytes, lengths, and how much is repeated."""
    flat, starts = utf8_arrays(texts)
    lengths = np.diff(starts)
    shares = np.zeros((len(texts), len(_CLASSES) + 1))
    begin = 0
    while begin < len(texts):  # rows are taken together, a few MB of text at once
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + PIECE, "right")) - 1)
        kind = _OF_BYTE[flat[starts[begin] : starts[end]]]
        row = np.repeat(np.arange(end - begin, dtype=np.int32) * (len(_CLASSES) + 1), lengths[begin:end])
        row += kind
        shares[begin:end] = np.bincount(row, minlength=(end - begin) * (len(_CLASSES) + 1)).reshape(end - begin, -1)
        begin = end
    shares = shares[:, 1:] / np.maximum(lengths, 1)[:, None]
    words = np.array([_words(t or "") for t in texts.to_pylist()], np.float64).reshape(len(texts), 7)
    letters = shares[:, 0] + shares[:, 1] + shares[:, 10]
    more = np.stack([np.log1p(lengths), shares[:, 1] / np.maximum(letters, 1e-9)], 1)
    return np.concatenate([shares, words, more], 1)


def statistics_of(text: str) -> Column:
    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(list(statistics(texts)), pa.list_(pa.float64()))

    return made(text)


def train(labelled: DataFrame, text: str, label: str, order: Column, rows: int = 20_000) -> Trees:
    """Trees from labelled texts, at most `rows` of them: those that come first by order.

    Rows whose label is null teach nothing. Without rows, or with one label only, the trees score the prior (0.5 without rows).
    The statistics are computed on the executors; the driver gets `rows` short rows at most.
    """
    sample = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("double").alias("y"), order.alias("o"))
    found = sample.orderBy("o", "y", F.xxhash64("t")).limit(rows).select(statistics_of("t").alias("x"), "y").collect()
    x = np.array([r.x for r in found], np.float64).reshape(len(found), STATISTICS)
    return fit(x, np.array([r.y for r in found], np.float64))


def score(text: Column, trees: Trees) -> Column:
    """How likely a text is of label 1, from 0 to 1. Null and empty texts have a score like any other."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(trees.probability(statistics(texts)))

    return scored(text)


def labelled(docs: DataFrame, labels: DataFrame, wanted: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(text, label, hash of the id) of the labelled documents that `wanted` (over the id column) allows.

    Of the labels, the `rows` that come first by the hash of their id are taken before the texts are joined, so that what
    is broadcast has a size bound.
    """
    few = labels.where(wanted & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"), F.xxhash64(id_col).alias("order"))
    few = few.orderBy("order", "label_id", "label").limit(rows)
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("doc") == F.col("label_id")).select("text", "label", "order")
