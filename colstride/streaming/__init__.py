"""The row-wise operators over unbounded input.

Selections, element-wise calculation and whole-column sums need no state beyond an aggregate, so they run
on a streaming frame as they are; ``running_sum`` adds the sink side. Nothing here is a feature of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import agg_sum


def running_sum(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, value: str = "v") -> StreamingQuery:
    """Keep the sum of a stream of values up to date; ``sink`` gets (frame, batch number)."""
    return agg_sum(stream, value).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
