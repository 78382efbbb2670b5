"""Streams: submissions checked as they arrive, and scores watched for drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.engine import Checked, Engine


def check_stream(submissions: DataFrame, engine: Engine, sink: Callable[[Checked, int], None], checkpoint: str, ident: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Each micro-batch goes through the batch check; the sink gets the result and the batch's number, so it can write idempotently."""
    def one(batch: DataFrame, number: int) -> None:
        sink(engine.check(batch, ident, text), number)

    return submissions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_drift(scores: DataFrame, baseline: float, time: str = "scored_at", window: str = "1 day", late: str = "2 days", shift: float = 0.05) -> DataFrame:
    """(start, n, mean_score, drifted) of event-time windows of a stream or a table of scores; null scores do not count."""
    s = scores.where(F.col("score").isNotNull())
    s = s.withWatermark(time, late) if s.isStreaming else s
    g = s.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return g.select(F.col("window.start").alias("start"), "n", "mean_score", (F.abs(F.col("mean_score") - baseline) > shift).alias("drifted"))
