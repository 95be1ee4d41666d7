"""Segmentation of a stream of whole documents.

Thresholds need all of a document's blocks, so the unit of a stream is a document, not a block: rows that hold whole texts or
files are segmented as they come, each micro-batch as a table, with the same code and the same results as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.segment import Plan, segment
from ..sources.tables import written


def stream_segments(stream: DataFrame, to_blocks: Callable[[DataFrame], DataFrame], sink: Callable[[Plan, int], None], **options: str) -> DataStreamWriter:
    """A writer that segments each micro-batch of documents and hands its plan and number to the sink.

    to_blocks makes blocks of a batch of rows (blocks_from_text, blocks_from_html). The sink should write under the batch's
    number, so that a batch that is run again replaces what it had written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(segment(written(to_blocks(rows), "stream"), **options), number)

    return stream.writeStream.foreachBatch(batch)
