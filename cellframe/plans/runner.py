"""Ordered steps with fail-fast and timing, and the frames that dashboards read from check and timing logs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.sources.files import append_jsonl, now_text

class Runner:
    """Runs named steps one after another; an exception stops the rest, a failed check doesn't. Timings are kept and may be appended to a file."""

    def __init__(self, spark: SparkSession, timing_path: str | None = None, run_id: str | None = None):
        self.spark, self.timing_path, self.run_id, self.timings = spark, timing_path, run_id or uuid.uuid4().hex[:12], []

    @contextmanager
    def measured(self, command: str):
        began, status = time.perf_counter(), "error"
        try:
            yield
            status = "ok"
        finally:
            self.timings.append({"ts_utc": now_text(), "command": command, "elapsed_total_sec": round(time.perf_counter() - began, 4), "status": status, "run_id": self.run_id})
            if self.timing_path:
                append_jsonl(self.spark, self.timings[-1:], self.timing_path)

    def run(self, steps: Iterable[tuple[str, Callable[[], object]]]) -> list[dict]:
        for name, step in steps:
            with self.measured(name):
                step()
        return self.timings


def days(first: date, last: date) -> list[date]:
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def months(first: date, last: date) -> list[date]:
    return sorted({d.replace(day=1) for d in days(first, last)})


def previous_month(day: date) -> date:
    return (day.replace(day=1) - timedelta(days=1)).replace(day=1)


def number_runs(log: DataFrame, boundaries: Sequence[str] = ("dataset_basic",), order: Sequence[str] = ("line",), partition: Sequence[str] = ("file",)) -> DataFrame:
    """Adds the number of the run that a check's line belongs to: a line of one of ``boundaries`` begins a run, in the order of the file. Lines before the first are run 0."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("run", F.sum(F.coalesce(F.col("check_name").isin(*boundaries), F.lit(False)).cast("int")).over(w))


def latest_run(log: DataFrame, boundaries: Sequence[str] = ("dataset_basic",), order: Sequence[str] = ("line",), partition: Sequence[str] = ("file",)) -> DataFrame:
    w = Window.partitionBy(*partition)
    return number_runs(log, boundaries, order, partition).withColumn("__last", F.max("run").over(w)).where("run = __last").drop("__last")


def wide_metrics(log: DataFrame, names: list[str]) -> DataFrame:
    """A row for each check, its metrics as columns."""
    return log.select("logger", "check_name", "status", *[F.col("metrics")[n].try_cast("double").alias(n) for n in names])


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("logger", "status").agg(F.count("*").alias("n"))


def failures(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin("failed", "warning"))


def null_ratios(log: DataFrame) -> DataFrame:
    return log.where(F.col("check_name").startswith("nulls.")).select("logger", F.expr("substring(check_name, 7)").alias("column_name"), F.col("metrics")["null_rate"].try_cast("double").alias("null_rate"))


def check_history(log: DataFrame) -> DataFrame:
    """``logger, check_name, run, status, was``: each check of each run and its status in the run before."""
    w = Window.partitionBy("logger", "check_name").orderBy("run")
    return log.select("logger", "check_name", "run", "status", F.lag("status").over(w).alias("was"))


def distribution(log: DataFrame, prefix: str, metric: str = "n") -> DataFrame:
    """``value, n, share`` of the checks whose names are ``prefix`` and a value: what a bar chart shows."""
    rows = log.where(F.col("check_name").startswith(prefix)).select("logger", F.substring("check_name", len(prefix) + 1, 1000).alias("value"), F.col("metrics")[metric].try_cast("double").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("logger")))


def rates(log: DataFrame) -> DataFrame:
    """``logger, check_name, status, rate``: the gates of a run, the lowest rate first."""
    return log.where(F.col("metrics")["rate"].isNotNull()).select("logger", "check_name", "status", F.col("metrics")["rate"].try_cast("double").alias("rate")).orderBy("rate", "check_name")


def time_share(timings: DataFrame) -> DataFrame:
    """``run_id, command, seconds, share`` of each command in its run."""
    t = timings.groupBy("run_id", "command").agg(F.sum("elapsed_total_sec").alias("seconds"))
    return t.withColumn("share", F.col("seconds") / F.nullif(F.sum("seconds").over(Window.partitionBy("run_id")), F.lit(0.0)))
