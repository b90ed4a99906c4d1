"""Run-length collapse: consecutive rows of one key and bucket become one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.scalar import bucket_no


def first_known(c: str, order: Column) -> Column:
    """First non-null value in order, as a grouped ``first`` gives it in data frames."""
    return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order))


def mark_islands(df: DataFrame, partition: Sequence[str], order: Sequence[str], change: Sequence[str | Column], null_breaks: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Adds the number of the run that a row belongs to within its partition.

    A run ends where one of ``change`` differs from the row before; null in one of ``null_breaks`` makes each row
    a run of its own. ``order`` has to be total for a result that doesn't depend on the partitioning.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    now = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(change)])
    new = ~F.lag(now).over(w).eqNullSafe(now)
    for c in null_breaks:
        new = new | F.col(c).isNull()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(running)).drop("__new")


def collapse_runs(df: DataFrame, partition: Sequence[str], ts: str, change: Sequence[str], order: Sequence[str] = (), seconds: int | None = 300, first: Sequence[str] = (), null_breaks: Sequence[str] = (), count: str = "event_count") -> DataFrame:
    """One row for each run: first and last time, first known value of ``first``, number of rows.

    An interleaved row of another key splits a run: this isn't the same as grouping by key and bucket.
    """
    changes: list[str | Column] = [*change]
    if seconds:
        changes.append(bucket_no(ts, seconds))
    marked = mark_islands(df, partition, [ts, *order], changes, null_breaks)
    by = F.struct(ts, *order)
    return (
        marked.groupBy(*partition, "island")
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            *[F.first(c).alias(c) for c in change if c not in partition],
            *[first_known(c, by).alias(c) for c in first],
            F.count("*").alias(count),
        )
        .drop("island")
    )
