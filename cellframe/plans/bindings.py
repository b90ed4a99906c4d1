"""Identifier bindings: day segments of (phone, device) and (phone, SIM), monthly upsert."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.functions import scalar as S
from cellframe.operators import intervals

KEYS = {"imei": ["msisdn", "imei"], "imsi": ["msisdn", "operator_id", "imsi"]}
_NORMAL = {"imei": S.imei, "imsi": S.imsi}


def day_bounds(day: date):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz"), F.lit(f"{day} 23:59:59.999999").cast("timestamp_ntz")


def pair_events(geo: DataFrame, kind: str) -> DataFrame:
    """Normalised (phone, value, time) of geo events that have all three."""
    return geo.select(S.msisdn(F.col("msisdn").cast("string")).alias("msisdn"), _NORMAL[kind](F.col(kind).cast("string")).alias(kind), F.col("start_time_utc").alias("ts")).dropna()


def day_segments(geo: DataFrame, kind: str, day: date) -> DataFrame:
    low, high = day_bounds(day)
    s = intervals.clip(intervals.segment_by_value(pair_events(geo, kind), ["msisdn"], kind, "ts"), low, high)
    return with_operator(s) if kind == "imsi" else s


def with_operator(df: DataFrame) -> DataFrame:
    """The home operator's code from the SIM; null for foreign ones, which stay."""
    return df.withColumn("operator_id", S.operator_of_imsi("imsi"))


def upsert_day(month: DataFrame | None, geo: DataFrame, kind: str, day: date) -> DataFrame:
    """The month's bindings after a day is built, or built again."""
    schema = schemas.MSISDN_IMEI if kind == "imei" else schemas.MSISDN_IMSI
    fresh = schemas.contract(day_segments(geo, kind, day), schema)
    low, high = day_bounds(day)
    if month is None:
        month = fresh.limit(0)
    return schemas.contract(intervals.upsert_period(schemas.contract(month, schema), fresh, KEYS[kind], low, high), schema)


def month_in_one_pass(geo: DataFrame, kind: str) -> DataFrame:
    """All days of a month at once: segments end with their day, so the day is part of the key."""
    e = pair_events(geo, kind).withColumn("day", F.to_date("ts"))
    s = intervals.segment_by_value(e, ["msisdn", "day"], kind, "ts").drop("day")
    s = with_operator(s) if kind == "imsi" else s
    return schemas.contract(intervals.coalesce_intervals(s, KEYS[kind]), schemas.MSISDN_IMEI if kind == "imei" else schemas.MSISDN_IMSI)


def operator_spans(person: DataFrame) -> DataFrame:
    """Span of each (phone, operator) in subscriptions."""
    return person.groupBy("msisdn", "operator_id").agg(F.min("actually_from").alias("valid_from"), F.max("actually_to").alias("valid_to"))


def read_normalised(b: DataFrame, kind: str, open_end: bool = False) -> DataFrame:
    """Stored bindings normalised again; incomplete rows go, but an open end may be filled."""
    end = F.coalesce("valid_to", F.lit(schemas.BINDING_OPEN_END).cast("timestamp_ntz")) if open_end else F.col("valid_to")
    extra = ["operator_id"] if kind == "imsi" and "operator_id" in b.columns else []
    return b.select(S.msisdn("msisdn").alias("msisdn"), _NORMAL[kind](kind).alias(kind), *extra, "valid_from", end.alias("valid_to")).dropna(subset=["msisdn", kind, "valid_from", "valid_to"])
