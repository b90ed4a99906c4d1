"""Closed intervals: segmentation by value, clipping, coalescing, counters of overlaps, idempotent period upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_seconds(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def segment_by_value(df: DataFrame, key: Sequence[str], value: str, ts: str, order: Sequence[str] = (), start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Spans of each key over which the value stays the same, from first to last observation; null values are left out first."""
    known = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    w = Window.partitionBy(*key).orderBy(ts, value, *order)
    differs = lambda side: ~side(F.col(value)).over(w).eqNullSafe(F.col(value))
    # a run is read off its last row: no grouping follows the sort, so that a task holds its rows once
    marked = known.withColumn("__new", differs(F.lag)).withColumn("__ends", differs(F.lead))
    began = F.last(F.when(F.col("__new"), F.col(ts)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__began", began).where("__ends").select(*key, value, F.col("__began").alias(start), F.col(ts).alias(end))


def clip(df: DataFrame, low: Column, high: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals cut to [low, high]; those outside, and inverted ones, go."""
    return df.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high)).where(F.col(start) <= F.col(end))


def _reach(key: Sequence[str], start: str, end: str) -> Column:
    w = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(end).over(w)


def coalesce_intervals(df: DataFrame, key: Sequence[str], gap: float = 1.0, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals of a key that overlap, or follow within ``gap`` seconds of all before, become one. Null keys are keys."""
    w = Window.partitionBy(*key).orderBy(start, end)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(gap_seconds(_reach(key, start, end), F.col(start)) > gap, F.lit(True))
    # intervals without a begin come first and can only lead theirs; what has joined is read off the last row of a part, without a grouping after the sort
    first = F.when(F.col("__new") | F.lag(start).over(w).isNull(), F.col(start))
    marked = df.withColumn("__new", new).withColumn("__part", F.sum(F.col("__new").cast("int")).over(running)).withColumn("__first", first).withColumn("__ends", F.coalesce(F.lead("__new").over(w), F.lit(True)))
    joined = marked.withColumn("__from", F.last("__first", ignorenulls=True).over(running)).withColumn("__to", F.max(F.struct("__part", end)).over(running))
    return joined.where("__ends").select(*key, F.col("__from").alias(start), F.col(f"__to.{end}").alias(end))


def overlap_count(df: DataFrame, key: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Two for each interval that begins before all earlier ones of its key have ended. Rows with a null key don't count."""
    known = df.dropna(subset=[*key, start, end])
    hit = F.col(start) <= F.col("__reach")
    return known.withColumn("__reach", _reach(key, start, end)).agg(F.coalesce(F.sum(F.when(hit, 2).otherwise(0)), F.lit(0)).alias("overlaps"))


def mergeable_count(df: DataFrame, key: Sequence[str], gap: float = 1.0, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals that coalescing with ``gap`` would join to an earlier one."""
    known = df.dropna(subset=[*key, start, end])
    hit = gap_seconds(F.col("__reach"), F.col(start)) <= gap
    return known.withColumn("__reach", _reach(key, start, end)).agg(F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("mergeable"))


def overlapping(df: DataFrame, low: Column, high: Column, start: str, end: str) -> DataFrame:
    return df.where((F.col(start) <= high) & (F.col(end) >= low))


def upsert_period(existing: DataFrame, fresh: DataFrame, key: Sequence[str], low: Column, high: Column, gap: float = 1.0, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """What a period's table becomes when the rows of [low, high] are replaced by ``fresh``; doing it twice changes nothing."""
    kept = existing.where(~((F.col(start) <= high) & (F.col(end) >= low)))
    return coalesce_intervals(kept.unionByName(fresh.select(*kept.columns)), key, gap, start, end)


def merge_similar_neighbours(df: DataFrame, key: Sequence[str], same: Sequence[str], near: dict[str, float], start: str, end: str, day_gap: float = 300, night_gap: float = 1800, order: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """Neighbouring intervals of a key become one while ``same`` columns agree, ``near`` ones differ by less than given and
    the gap from the row before is short enough: longer at night (begin at 23 or before 6, UTC). The first row's other values stay.

    Rows with a null in the key are left out, as the grouping of the original rule does.
    """
    known = df.dropna(subset=list(key))
    w = Window.partitionBy(*key).orderBy(start, end, *order)
    hour = F.hour(F.col(start))
    allowed = F.when((hour <= 5) | (hour == 23), night_gap).otherwise(day_gap)
    stays = F.coalesce(gap_seconds(F.lag(end).over(w), F.col(start)) <= allowed, F.lit(False))
    for c in same:
        stays = stays & F.col(c).eqNullSafe(F.lag(c).over(w))
    for c, most in near.items():
        stays = stays & F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) <= most, F.lit(False))
    marked = known.withColumn("__new", (~stays).cast("int")).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = F.struct(start, end, *order)
    rest = [c for c in (*same, *near, *first)]
    return marked.groupBy(*key, "__part").agg(F.min(start).alias(start), F.max(end).alias(end), *[F.min_by(c, by).alias(c) for c in rest]).drop("__part")
