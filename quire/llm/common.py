"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import tables
from quire.sources.tables import dropped  # noqa: F401

#: What counts as a word wherever words are separated by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker at once: of whole texts, Spark's own bounds take much of a small executor's memory.
BATCH, BATCH_BYTES = 2000, 8 << 20
#: A key with more than this part of all rows is dealt out over several tasks where rows are joined.
SHARES = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH and BATCH_BYTES where the session has Spark's own bounds."""
    for name, usual, wanted in (("maxRecordsPerBatch", ("10000",), BATCH), ("maxBytesPerBatch", ("64MB", "67108864", "67108864b", str((1 << 31) - 1)), BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", usual[0]) in usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(wanted))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder (see quire.sources.tables.written), computed in small batches."""
    small_batches(df.sparkSession)
    return tables.written(df, tag)


def spread_join(many: DataFrame, one: DataFrame, on: list[str], rows: str, total: int, how: str = "inner", by: str = "") -> DataFrame:
    """many joined to one, where one has a row for each key and, in the column `rows`, how many rows of many have that key.

    A key with over 1/SHARES of all rows (total) is dealt out over tasks: its row of one goes to each of them. There can't be
    more than SHARES such keys, so their list, which is broadcast, has a size bound. by: the column that deals rows out.
    """
    slice_ = max(1, -(-total // SHARES))
    parts = F.ceil(F.col(rows) / F.lit(slice_)).cast("int")
    hot = F.broadcast(one.where(F.col(rows) > slice_).select(*on, parts.alias("__parts")))
    left = many.join(hot, on, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"))).drop("__parts")
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > slice_, parts - 1).otherwise(0))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def low_enough(hash_: Column, count: int, total: int) -> Column:
    """Whether a row's hash is among the lowest of total rows, of which at least count are so, but for a chance of nearly nothing.

    Before a limit by that hash: no task then sends on more than its share of them.
    """
    return F.shiftrightunsigned(hash_, 11) / float(1 << 53) < F.lit((2 * count + 100) / max(total, 1))


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo of; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() alone would also fold other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def utf8_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and where each begins (one more entry than values). Null is empty."""
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    starts = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]
