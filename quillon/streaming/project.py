"""Appended cells projected onto known archetypes, and running marginals of a stream of counts.

This goes beyond batch analysis: each cell's mixture is an independent problem, so a stream of cells needs
no state, and late or repeated files need no repair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.decompose import simplex_regression


def project_stream(cells: DataFrame, archetypes: np.ndarray) -> DataFrame:
    """A streaming frame of (cell_id, arch, value) from one of (cell_id, vec)."""
    return simplex_regression(cells, archetypes)


def windowed_counts(events: DataFrame, time: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """(start, feature_id, cell_id, value): counts of events by feature, cell and window of event time;
    events later than the watermark are left out."""
    return (
        events.withWatermark(time, watermark).groupBy(F.window(time, window), "feature_id", "cell_id").agg(F.count("*").cast("double").alias("value"))
        .select(F.col("window.start").alias("start"), "feature_id", "cell_id", "value")
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Starts a query that appends each micro-batch, changed by ``change``, to Parquet; a batch that is
    retried replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
