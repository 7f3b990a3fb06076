"""Sessions of events: the streaming counterpart of active minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.registry import operator


@operator("G38", group="streaming")
def session_minutes(events: DataFrame, by: str, ts: str, gap_minutes: float, late: str = "1 day") -> DataFrame:
    """(by, start, minutes, events) of each session: events no further apart than the gap. Works on streams and tables; on a
    stream a session is final, and its state dropped, once the watermark has passed its end."""
    gap = f"{round(gap_minutes * 60_000_000)} microseconds"
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    out = timed.groupBy(F.session_window("__ts", gap).alias("__w"), by).agg(F.min("__ts").alias("start"), F.max("__ts").alias("__end"), F.count("*").alias("events"))
    return out.select(by, "start", ((F.unix_micros("__end") - F.unix_micros("start")) / 60e6).alias("minutes"), "events")
