"""Scores as a stream: the batch aggregation over a streaming log, then projections only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators.scoring import summaries


def score_stream(answers: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each respondent whose answers changed goes to `write` with the new summary, at least once per change.

    There is no watermark: a respondent may come back at any time, so state is one row per respondent.
    """
    writer = summaries(answers).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
