"""Dimensions from CSV: device types, countries, territories, time zones; exclusion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.functions import scalar as S


class DimensionError(ValueError):
    pass


def _demand(df: DataFrame, bad: dict[str, Column], unique: list[str]) -> None:
    """One aggregate that stops the build when a row breaks the contract or a key isn't unique."""
    aggs = [F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(True)).cast("long")).alias(f"b{i}") for i, c in enumerate(bad.values())], *[F.countDistinct(c).alias(f"u{i}") for i, c in enumerate(unique)]]
    r = df.agg(*aggs).first()
    if not r["n"]:
        raise DimensionError("no rows")
    found = [k for i, k in enumerate(bad) if r[f"b{i}"]] + [f"duplicate {c}" for i, c in enumerate(unique) if r[f"u{i}"] != r["n"]]
    if found:
        raise DimensionError(", ".join(found))


def build_tac(raw: DataFrame) -> DataFrame:
    """Device types: eight-digit codes, dates in one form, machine flag. Duplicate or malformed codes and dates are errors."""
    t = raw.withColumns({"tac": S.last_digits("tac", 8), "allocation_date": F.when(S.blank_to_null("allocation_date").isNotNull(), F.coalesce(S.flexible_date("allocation_date"), F.lit("?"))), "is_m2m": S.is_m2m("equipment_type")})
    _demand(t, {"malformed tac": ~F.coalesce(F.col("tac").rlike(r"^\d{8}$"), F.lit(False)), "unreadable allocation_date": F.coalesce(F.col("allocation_date") == "?", F.lit(False))}, ["tac"])
    return schemas.contract(t, schemas.DIM_TAC, fill_missing=True)


def build_oksm(raw: DataFrame) -> DataFrame:
    """Countries: three-digit codes, Latin ISO codes; ``NA`` is a country."""
    t = raw.withColumns({"numeric_code": S.last_digits("numeric_code", 3), "alpha2": S.latin_code("alpha2"), "alpha3": S.latin_code("alpha3")})
    bad = {"malformed numeric_code": ~F.coalesce(F.col("numeric_code").rlike(r"^\d{3}$"), F.lit(False)), "malformed alpha2": ~F.coalesce(F.col("alpha2").rlike("^[A-Z]{2}$"), F.lit(False)), "malformed alpha3": ~F.coalesce(F.col("alpha3").rlike("^[A-Z]{3}$"), F.lit(False)), "empty name_short": F.coalesce(F.trim("name_short"), F.lit("")) == ""}
    _demand(t, bad, ["numeric_code", "alpha2", "alpha3"])
    return schemas.contract(t, schemas.DIM_OKSM, fill_missing=True)


def country_lookup(oksm: DataFrame) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Codes by alpha-2, and country names of four letters or more: a dimension of a few hundred rows, read by the driver."""
    rows = oksm.select("numeric_code", "name_short", "name_full", "alpha2").collect()
    names = {str(n).strip().lower(): r["numeric_code"] for r in rows for n in (r["name_short"], r["name_full"]) if n and len(str(n).strip()) >= 4}
    return {r["alpha2"]: r["numeric_code"] for r in rows if r["alpha2"]}, sorted(names.items(), key=lambda x: -len(x[0]))


def build_oktmo(raw: DataFrame) -> DataFrame:
    return schemas.contract(raw.withColumn("level", F.col("level").try_cast("int")), schemas.DIM_OKTMO)


def build_time_zones(raw: DataFrame) -> DataFrame:
    return schemas.contract(raw.withColumns({"code": F.col("code").try_cast("int"), "timezone": F.col("timezone").try_cast("int")}), schemas.DIM_TIME_ZONES)


def exclusion(values: DataFrame | None, spark, normal) -> DataFrame:
    """Normalised values of a list; a list that isn't there is empty."""
    if values is None:
        return schemas.empty(spark, schemas.EXCLUSION)
    return values.select(normal("value").alias("value")).dropna().distinct()


def sample_exclusions(person: DataFrame, share: float = 0.007, seed: int = 0) -> DataFrame:
    """Identity triples of a share of rows, chosen by hash."""
    h = F.pmod(F.xxhash64("msisdn", "imsi", "imei", F.lit(seed)), F.lit(1_000_000))
    return person.where(h < int(share * 1_000_000)).select("msisdn", "imsi", "imei").distinct()
