"""Host deadlines by window and host as a stream (``keyed.host_cooldowns`` keeps one deadline a host over all windows).

Deferrals arrive as events (host, at, seconds); per window and host the later deadline is kept. State is one number each and
leaves after the watermark passed the deadline's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def host_deadlines(events: DataFrame, host: str = "host", at: str = "at", seconds: str = "seconds", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, host, retry_at) from a streaming or static frame of deferrals."""
    deadline = F.timestamp_seconds(F.unix_seconds(F.col(at)) + F.col(seconds))
    return events.withWatermark(at, late).groupBy(F.window(at, window), F.col(host)).agg(F.max(deadline).alias("retry_at"))


def append_done(stream: DataFrame, path: str, checkpoint: str):
    """Processes what is available and stops; the checkpoint makes a rerun resume where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
