"""Page versions and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekit.operators import locale


def stream_pending(segments: DataFrame, lock: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], targets: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Compare each micro-batch of segments with the lock as it is then, and hand what has to be translated to a sink.

    A page's segments have to arrive in one batch. A batch that is repeated after a failure has the same id.
    """

    def step(batch: DataFrame, n: int) -> None:
        sink(locale.pending(batch, lock(), targets), n)

    return segments.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by, n, total) of tumbling windows; rows later than the watermark are dropped by a stream, never by a batch."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(by, start, end, n) of sessions that a gap separates."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
