"""Stay intervals: arbitration of indoor and outdoor cells, outliers by distance, weighted summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.scalar import floor_to, haversine
from cellframe.operators.intervals import merge_similar_neighbours


def indoor_first(df: DataFrame, bucket: Sequence[str], kind: str, outdoor: str = "o") -> DataFrame:
    """Outdoor rows of a bucket go if it has any row that isn't outdoor; null keys make buckets too."""
    some = F.max((F.col(kind) != outdoor).cast("int")).over(Window.partitionBy(*bucket))
    return df.withColumn("__in", some).where((F.coalesce("__in", F.lit(0)) == 0) | (F.col(kind) != outdoor)).drop("__in")


def distance_filter(df: DataFrame, bucket: Sequence[str], row: Sequence[str], lat: str, lon: str, alone_m: float = 40_000_000.0, most_m: float = 3_500.0, digits: int | None = None, among: Column | None = None) -> DataFrame:
    """Adds a row's mean distance to the others of its bucket and keeps those within the limit.

    Pairs count where both coordinates differ. The limit is ``alone_m`` where the bucket has one distinct mean, else ``most_m``. A bucket's
    places are gathered once and compared within the row, so nothing is joined with itself: a bucket is one subscriber's five minutes.
    Rows for which ``among`` doesn't hold stay, and no distance to them counts.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    w = Window.partitionBy(*bucket)
    places = F.collect_list(F.when(among, F.struct(F.col(lat).alias("a"), F.col(lon).alias("b")))).over(w)
    others = F.filter("__all", lambda p: (p["a"] != F.col(lat)) & (p["b"] != F.col(lon)))
    total = F.aggregate(others, F.lit(0.0), lambda s, p: s + haversine(F.col(lat), F.col(lon), p["a"], p["b"]))
    mean = F.when(among & (F.size(others) > 0), total / F.size(others))
    out = df.withColumn("__all", places).withColumn("mean_distance", mean).drop("__all")
    known = F.round("mean_distance", digits) if digits is not None else F.col("mean_distance")
    out = out.withColumn("distinct_means", F.size(F.collect_set(known).over(w)).cast("long"))
    return out.where(~among | (F.coalesce("mean_distance", F.lit(0.0)) < F.when(F.col("distinct_means") == 1, alone_m).otherwise(most_m)))


def weighted_summary(df: DataFrame, key: Sequence[str], weight: str, means: dict[str, str], mode: Sequence[str], items: str) -> DataFrame:
    """Weighted means, the tuple of ``mode`` columns of greatest total weight (ties: the greatest tuple) and the sorted distinct ``items``.

    Two levels of grouping on the same leading key. Where the weights sum to zero the mean is what IEEE division gives, in ANSI mode too: NaN, or infinite.
    """
    w = F.col(weight)

    def mean(n: str) -> Column:
        s, total = F.sum(f"__{n}").cast("double"), F.sum("__w").cast("double")
        by_zero = F.when(s == 0, float("nan")).otherwise(F.signum(s) * float("inf"))
        return F.when(total == 0, F.when(s.isNotNull(), by_zero)).otherwise(s / total)

    part = df.groupBy(*key, *mode).agg(F.sum(w).alias("__w"), *[F.sum(F.col(c) * w).alias(f"__{n}") for n, c in means.items()], F.collect_set(items).alias("__items"))
    tup = F.struct(*mode)
    out = part.groupBy(*key).agg(
        *[mean(n).alias(n) for n in means],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("cells"),
        F.max_by(tup, F.struct("__w", *mode)).alias("__mode"),
    )
    return out.select(*key, *means, "cells", *[F.col(f"__mode.{c}").alias(c) for c in mode])


def build_stays(events: DataFrame, centroids: DataFrame | None, report_date: Column, keep_unidentified: bool = False) -> DataFrame:
    """Stay intervals of a day's geo events (contract of the geo event table).

    Counts are summed by place and exact start; indoor wins a bucket; outdoor-only buckets are widened to five minutes; far outliers go;
    indoor cells are never outliers; equal observations of a cell count once; the weighted centre of a bucket's cells is the place; like neighbours merge.
    ``centroids``: ``cgi, lat, lon``, one row for each cell, used for outdoor cells. Rows of unidentified subscribers vanish when
    neighbours merge, as they do in the original; ``keep_unidentified`` keeps them out of the merging instead.
    """
    who = ["msisdn", "imsi", "imei"]
    e = events.withColumn("end_time_utc", F.coalesce("end_time_utc", "start_time_utc")).dropna(subset="msisdn cgi start_time_utc lat lon".split())
    e = e.withColumn("event_count", F.greatest(F.coalesce("event_count", F.lit(1)), F.lit(1))).withColumn("bs_type", F.substring(F.lower("bs_type"), 1, 1)).withColumn("bucket", floor_to("start_time_utc"))
    e = e.withColumns({c: F.coalesce(c, F.lit("")) for c in ("oktmo_code_1", "oktmo_code_2")})
    place = [*who, "bucket", "start_time_utc", "end_time_utc", "cgi", "lat", "lon", "bs_type"]
    top = F.max_by(F.struct("oktmo_code_1", "oktmo_code_2"), F.struct("event_count", "oktmo_code_1", "oktmo_code_2"))
    e = e.groupBy(*place).agg(F.sum("event_count").alias("n"), top.alias("t")).select(*place, "n", "t.oktmo_code_1", "t.oktmo_code_2")
    e = indoor_first(e, [*who, "bucket"], "bs_type")
    outdoor = F.col("bs_type") == "o"
    e = e.withColumn("start_time_utc", F.when(outdoor, F.col("bucket")).otherwise(F.col("start_time_utc"))).withColumn("end_time_utc", F.when(outdoor, F.col("bucket") + F.expr("interval 5 minutes")).otherwise(F.col("end_time_utc")))
    span = [*who, "start_time_utc", "end_time_utc", "bs_type"]
    e = distance_filter(e, span, ["cgi"], "lat", "lon", digits=6, among=outdoor).drop("mean_distance", "distinct_means")
    e = e.dropDuplicates([*span, "cgi", "lat", "lon", "n", "oktmo_code_1", "oktmo_code_2"])
    if centroids is not None:
        e = e.join(centroids.select("cgi", F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), "cgi", "left")
        e = e.withColumn("lat", F.when(outdoor, F.coalesce("__lat", "lat")).otherwise(F.col("lat"))).withColumn("lon", F.when(outdoor, F.coalesce("__lon", "lon")).otherwise(F.col("lon")))
    s = weighted_summary(e.withColumn("__cgi", F.col("cgi").cast("string")), span, "n", {"sub_lat": "lat", "sub_lon": "lon"}, ["oktmo_code_1", "oktmo_code_2"], "__cgi").withColumnRenamed("cells", "cgi_list")
    merged = merge_similar_neighbours(s, who, ["cgi_list", "bs_type"], {"sub_lat": 1e-6, "sub_lon": 1e-6}, "start_time_utc", "end_time_utc", first=["oktmo_code_1", "oktmo_code_2"])
    if keep_unidentified:
        merged = merged.unionByName(s.where("imsi is null or imei is null").select(*merged.columns))
    return merged.withColumn("time_key", report_date)
