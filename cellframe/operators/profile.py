"""Profiles: value counts, numeric summaries, null rates, duplicates, cross tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, c: str, top: int | None = None, keep_null: bool = True) -> DataFrame:
    """``value, n, pct`` by falling count, ties by value; null is ``<NA>`` or left out."""
    v = F.col(c).cast("string")
    base = df.select((F.coalesce(v, F.lit("<NA>")) if keep_null else v).alias("value")).where("value is not null")
    counted = base.groupBy("value").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    out = counted.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def numeric_profile(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """A row for each column: count, nulls, min, p50, p95, max, mean, std (0 for one value), in one pass.

    Percentiles are exact, which keeps every distinct value in one place; ``accuracy`` asks for approximate ones of bounded size instead.
    """
    quantile = (lambda x, q: F.percentile_approx(x, q, accuracy)) if accuracy else F.percentile
    aggs = []
    for c in columns:
        x = F.col(c).try_cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(x).alias("n"), F.sum(x.isNull().cast("long")).alias("nulls"), F.min(x).alias("min"), quantile(x, 0.5).alias("p50"), quantile(x, 0.95).alias("p95"),
                F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            ).alias(c)
        )
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def null_rates(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``column_name, null_rate`` of the expected columns in one pass; a column that isn't there has rate 1."""
    rates = [F.avg(F.col(c).isNull().cast("double")) if c in df.columns else F.lit(1.0) for c in expected]
    row = df.agg(F.count("*").alias("__n"), *[r.alias(f"r{i}") for i, r in enumerate(rates)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"r{i}"), F.lit(1.0)).alias("null_rate")) for i, c in enumerate(expected)])).alias("r")).select("r.*")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.countDistinct(c).alias(f"r{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("n_distinct")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``duplicate_rows, duplicate_keys``: rows in groups of two or more, nulls being equal."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_keys"))


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n, pct`` with nulls as values of their own."""
    counted = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("t")))).select(a, b, "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("pct"))


def adaptive_distribution(df: DataFrame, c: str, share: float = 0.85, top: int = 12) -> DataFrame:
    """``label, value``: summary of a column whose known values are numbers for the most part, else its most frequent values."""
    x = F.col(c).cast("string").try_cast("double")
    s = df.agg(F.count(c).alias("n"), F.count(x).alias("k"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95, 0.99)])).alias("p"))
    numeric = s.where(F.col("k") >= F.col("n") * share)
    named = [("min", F.col("min")), ("max", F.col("max")), ("mean", F.col("mean")), *[(f"p{q}", F.get("p", F.lit(i))) for i, q in enumerate((25, 50, 75, 95, 99))]]
    numbers = numeric.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in named])).alias("r")).select("r.*")
    words = s.where(F.col("k") < F.col("n") * share).select(F.lit(1).alias("one")).crossJoin(value_counts(df, c, top, keep_null=False)).select(F.col("value").alias("label"), F.col("n").cast("double").alias("value"))
    return numbers.where("value is not null").unionByName(words)


def hour_histogram(df: DataFrame, hour: Column) -> DataFrame:
    return df.groupBy(hour.alias("hour")).agg(F.count("*").alias("n")).where("hour is not null")


def nested_count_quantiles(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """p50, p95 and max of rows for each key."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("max"))


def missing_days(df: DataFrame, day: Column) -> DataFrame:
    """Days between the first and the last that no row has."""
    present = df.select(day.alias("day")).where("day is not null").distinct()
    span = present.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(present, "day", "left_anti")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
