"""Scoring a stream with a fitted preparation and model.

The fitted preparation is a stateless projection and Spark ML models
transform row by row, so a streaming DataFrame goes through the same code as
a batch one; only the sink differs.  No state store is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``model`` is a TrainResult or LoadedModel; returns keep + prediction columns."""
    scored = model.transform(stream, keep=keep)
    return scored.select(*keep, "prediction")


def to_table(scored: DataFrame, name: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Write scored rows to an in-memory table (tests) with a checkpoint in the shared folder."""
    w = scored.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()
