"""Structured Streaming counterparts: tumbling counts, dynamic-gap sessions, idempotent upsert of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("event_type",), seconds: int = 300, late: str = "1 day") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped, as a day's slack does for files. ``ts`` has a time zone."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), *by, "n")


def stay_sessions(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("user_id",), late: str = "1 day") -> DataFrame:
    """Sessions whose gap is five minutes, or thirty at night."""
    gap = F.when((F.hour(ts) <= 5) | (F.hour(ts) == 23), "30 minutes").otherwise("5 minutes")
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), *by, "n")


def upsert_each_batch(merge: Callable[[DataFrame | None, DataFrame], DataFrame], read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merges each micro-batch into a table. With an idempotent ``merge``, a batch delivered again changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                write(merge(read(), batch))
        finally:
            batch.unpersist()

    return one
