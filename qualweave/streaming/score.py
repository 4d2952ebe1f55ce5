"""Scoring a stream of whole reads.

Reads are independent, so a stream needs no state: each micro-batch of packed reads
is scored as a batch would be. packed reads come from plans/packing.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from qualweave.plans import infer, network


def score_stream(packed: DataFrame, config: network.Config, parameters: network.Parameters, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands the read totals of each micro-batch to sink(df, batch_id).

    checkpoint is a folder that the whole cluster shares; a restarted query resumes there.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        sink(infer.read_bits(infer.score(df, config, parameters)), batch_id)

    return packed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
