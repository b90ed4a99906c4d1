"""Data-quality checks as rows: name, status (ok, info, warning, failed) and metrics. A suite is one aggregate pass for each table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Gate:
    """Share of rows for which ``good`` holds; below ``failed`` it fails, below ``warn`` it warns. No rows: share 1. Null counts as bad."""

    name: str
    good: Column
    failed: float
    warn: float
    among: Column | None = None  # rows that count


@dataclass
class Limit:
    """Number of rows for which ``bad`` holds; more than ``most`` gives ``severity``."""

    name: str
    bad: Column
    severity: str = "warning"
    most: int = 0


def gate_status(rate: Column, failed: float, warn: float) -> Column:
    return F.when(rate < failed, "failed").when(rate < warn, "warning").otherwise("ok")


def rate_gates(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """``check_name, status, rate, bad``, one aggregate for all."""
    aggs = []
    for i, g in enumerate(gates):
        good = F.coalesce(g.good, F.lit(False)).cast("double")
        x = good if g.among is None else F.when(g.among, good)
        aggs += [F.coalesce(F.avg(x), F.lit(1.0)).alias(f"r{i}"), F.coalesce(F.sum(1 - x), F.lit(0.0)).cast("long").alias(f"b{i}")]
    rows = [F.struct(F.lit(g.name).alias("check_name"), gate_status(F.col(f"r{i}"), g.failed, g.warn).alias("status"), F.col(f"r{i}").alias("rate"), F.col(f"b{i}").alias("bad")) for i, g in enumerate(gates)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def count_gates(df: DataFrame, limits: Sequence[Limit]) -> DataFrame:
    """``check_name, status, bad``, one aggregate for all."""
    aggs = [F.coalesce(F.sum(F.coalesce(x.bad, F.lit(False)).cast("long")), F.lit(0)).alias(f"b{i}") for i, x in enumerate(limits)]
    rows = [F.struct(F.lit(x.name).alias("check_name"), F.when(F.col(f"b{i}") > x.most, x.severity).otherwise("ok").alias("status"), F.col(f"b{i}").alias("bad")) for i, x in enumerate(limits)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def as_results(df: DataFrame, *metrics: str) -> DataFrame:
    """``check_name, status, metrics`` with the metrics as a map of texts."""
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("string"))]
    return df.select("check_name", "status", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metrics"))


def summary(results: DataFrame) -> DataFrame:
    """Overall status: failed before warning before ok."""
    def n(status):
        return F.sum((F.col("status") == status).cast("int"))

    return results.agg(F.when(n("failed") > 0, "failed").when(n("warning") > 0, "warning").otherwise("ok").alias("status"), F.count("*").alias("checks"))
