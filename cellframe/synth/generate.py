"""Synthetic sources by seeded hashes: the same rows at every run and partitioning, dirty on purpose.

Distributions and contracts follow the sources that they stand for; exact sequences don't.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATORS = ("01", "02", "20", "99")


def unit(*parts) -> Column:
    """Uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def pick(u: Column, weighted: list[tuple[object, float]]) -> Column:
    total, at, out = sum(w for _, w in weighted), 0.0, None
    for v, w in weighted[:-1]:
        at += w / total
        out = F.when(u < at, F.lit(v)) if out is None else out.when(u < at, F.lit(v))
    return out.otherwise(F.lit(weighted[-1][0])) if out is not None else F.lit(weighted[0][0])


def cells(spark: SparkSession, n: int, seed: int = 1, noise: float = 0.077) -> DataFrame:
    """Raw cells, all text; ``noise`` of them with one bad field."""
    i = F.col("id")
    u = lambda k: unit(i, seed, k)
    bad, what = u("bad") < noise, u("what")
    df = spark.range(n)
    return df.select(
        F.lit("250").alias("mcc"), F.when(bad & (what < 0.1), "-1").otherwise(pick(u("op"), [(o, w) for o, w in zip(OPERATORS, (4, 3, 2, 1), strict=True)])).alias("mnc"), F.when(bad & what.between(0.1, 0.25), "ERR").otherwise((1000 + i % 97).cast("string")).alias("lac"), (10_000 + i).cast("string").alias("cell"),
        F.concat(F.lit("2024-"), F.lpad((1 + F.floor(u("m") * 12)).cast("string"), 2, "0"), F.lit("-01 00:00:00")).alias("date_on"), F.when(bad & what.between(0.25, 0.4), "2001-01-01 00:00:00").otherwise("2999-12-31 23:59:59").alias("date_off"),
        F.when(bad & what.between(0.4, 0.55), "190000").otherwise((37 + u("x") * 2).cast("string")).alias("coord_x"), F.when(bad & what.between(0.55, 0.7), "95").otherwise((55 + u("y") * 2).cast("string")).alias("coord_y"),
        pick(u("t"), [("outdoor", 70), ("indoor", 18), ("metro", 7), ("pico", 5)]).alias("bs_type"), pick(u("g"), [("4G", 55), ("3G", 25), ("2G", 15), ("LTE", 5)]).alias("generation"), F.when(bad & (what > 0.7), "-400").otherwise(F.floor(u("az") * 360).cast("string")).alias("azimuth"),
        pick(u("an"), [("120", 6), ("65", 3), ("360", 1)]).alias("sector_angle"), F.floor(u("p") * 60).cast("string").alias("power"), F.floor(5 + u("h") * 50).cast("string").alias("height"), F.floor(u("ti") * 12).cast("string").alias("tilt"), pick(u("f"), [("1800", 5), ("900", 3), ("2600", 2)]).alias("frequency"),
        pick(u("r"), [("a", 1), ("b", 2), ("c", 1)]).alias("rad_class"), F.lit("Region").alias("subject"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("street "), i.cast("string")).alias("address"),
    )


def subscribers(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Subscription intervals: identities, leaks, several SIMs of a person, number portability, corporate rows, foreigners."""
    i = F.col("id")
    u = lambda k: unit(i, seed, k)
    op = pick(u("op"), [(o, 1) for o in OPERATORS])
    foreign = u("foreign") < 0.10
    person = F.when((u("multi") < 0.015) & (i > 0), i - 1).otherwise(i)
    first = F.when(person % 2 == 0, pick(unit(person, "f"), [("Анна", 1), ("Мария", 1), ("Ольга", 1)])).otherwise(pick(unit(person, "f"), [("Олег", 1), ("Иван", 1), ("Пётр", 1)]))
    corporate = u("corp") < 0.08
    named = lambda c: F.when(~corporate, c)
    return spark.range(n).select(
        pick(u("type"), [(2, 74), (4, 12), (5, 6), (3, 5), (1, 3)]).alias("identity_type"), op.cast("bigint").alias("operator_Id"), F.concat(F.lit("79"), op, F.lpad(i.cast("string"), 7, "0")).alias("isdn"),
        F.when(u("noimsi") > 0.02, F.concat(F.when(foreign, F.lit("401")).otherwise("250"), op, F.lpad((i * 7919 + 17).cast("string"), 10, "0"))).alias("imsi"), F.when(u("noimei") > 0.02, F.concat(F.lpad((35_000_000 + i * 31 % 9973).cast("string"), 8, "0"), F.lpad(i.cast("string"), 7, "0"))).alias("imei"),
        F.concat(F.lit("8970"), op, F.lpad(i.cast("string"), 13, "0")).alias("iccid"), F.concat(F.lit("C"), i.cast("string")).alias("contract_number"), F.when(corporate, 1).otherwise(0).alias("client_type"), F.lit("2023-05-01 00:00:00").cast("timestamp_ntz").alias("actually_from"),
        F.when(u("closed") < 0.1, "2024-01-15 12:00:00").otherwise("2261-12-31 23:59:59").cast("timestamp_ntz").alias("actually_to"), F.date_add(F.lit("1950-01-01").cast("date"), F.floor(unit(person, "b") * 20000).cast("int")).alias("birth_day"),
        named(first).alias("first_name"), named(F.when(person % 2 == 0, "Ивановна").otherwise("Иванович")).alias("second_name"), named(F.concat(F.lit("Фамилия"), person.cast("string"))).alias("last_name"), F.when(foreign, "Uzbek office").otherwise("ОВД").alias("dul_department"),
        F.concat(F.lit("40"), F.lpad((person % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad(person.cast("string"), 6, "0")).alias("document"),
    )


_PRESENT = dict(cdr=0.72, gprs=0.78, sms=0.48, location=0.35)


def mart(spark: SparkSession, people: DataFrame, cell_table: DataFrame, kind: str, day: date, per_person: int = 4, seed: int = 1) -> DataFrame:
    """Records of one mart and day: a subscriber's events move among neighbouring cells; identities are sparse, some starts malformed."""
    n = cell_table.count()
    c = cell_table.select(*"mcc mnc lac cell".split(), F.col("cell").cast("bigint").alias("__c")).where("mnc >= 0 and lac <> 'ERR'")
    e = people.select("isdn", "imsi", "imei").where("isdn is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_person - 1))))
    u = lambda x: unit(F.col("isdn"), F.col("k"), kind, str(day), seed, x)
    e = e.withColumn("__c", F.lit(10_000) + F.pmod(F.floor(unit(F.col("isdn"), seed) * n) + F.floor(u("move") * 3).cast("bigint"), F.lit(n)).cast("bigint")).join(c, "__c")
    sec = F.floor(u("t") * 86400).cast("int")
    started = F.date_format(F.lit(f"{day} 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=sec), "yyyyMMddHHmmss")
    started = F.when(u("broken") < 0.002, F.substring(started, 1, 10)).otherwise(started)
    sim = F.when(u("imsi") < _PRESENT[kind], F.col("imsi"))
    common = [started.alias("Started"), sim.alias("IMSI"), F.when(u("imei") < 0.8, F.col("imei")).alias("IMEI"), F.when(u("owner") < 0.9, 1).otherwise(2).alias("Owner")]
    if kind in ("cdr", "gprs"):
        return e.select(*common, F.col("isdn").alias("CallingNumber"), F.concat_ws("-", "mcc", "mnc").alias("OwnerMCCMNC"), F.col("lac").try_cast("int").alias("BSStartLac"), F.col("cell").try_cast("bigint").alias("BSStartCell"))
    return e.select(*common, F.col("isdn").alias("Calling" if kind == "sms" else "Served"), F.col("mcc").alias("MCC"), F.col("mnc").alias("MNC"), F.col("lac").alias("Lac"), F.col("cell").alias("Cell"))


#: What is built in each kind of region: kinds of sites, generations, and watts of a site at most.
PROFILES = {
    "metropolis": {"bs_type": [("outdoor", 52), ("indoor", 27), ("metro", 14), ("pico", 7)], "generation": [("4G", 70), ("3G", 18), ("2G", 12)], "power": 40},
    "town": {"bs_type": [("outdoor", 80), ("indoor", 16), ("pico", 4)], "generation": [("4G", 55), ("3G", 25), ("2G", 20)], "power": 60},
    "wilds": {"bs_type": [("outdoor", 97), ("indoor", 3)], "generation": [("4G", 30), ("3G", 25), ("2G", 45)], "power": 120},
}


def region_cells(spark: SparkSession, regions: dict[str, tuple[int, str, float, float, float]], seed: int = 1, noise: float = 0.077) -> DataFrame:
    """Raw cells of several regions: name to number of cells, profile, longitude, latitude and width in degrees. Cell numbers are a region's own."""
    out = None
    for k, (name, (n, profile, lon, lat, width)) in enumerate(regions.items()):
        p, u = PROFILES[profile], lambda what, k=k: unit(F.col("cell"), seed, k, what)  # noqa: B023
        x, y = F.col("coord_x").cast("double"), F.col("coord_y").cast("double")
        one = cells(spark, n, seed * 1000 + k, noise)
        one = one.withColumns({
            "coord_x": F.when(x.between(37, 39), (lon + (x - 38) / 2 * width).cast("string")).otherwise(F.col("coord_x")), "coord_y": F.when(y.between(55, 57), (lat + (y - 56) / 2 * width).cast("string")).otherwise(F.col("coord_y")),
            "bs_type": pick(u("type"), p["bs_type"]), "generation": pick(u("generation"), p["generation"]), "power": F.floor(u("power") * p["power"]).cast("string"), "subject": F.lit(name), "cell": (F.col("cell").cast("bigint") + k * 100_000).cast("string"),
        })
        out = one if out is None else out.unionByName(one)
    return out


#: Fields that a source's rows have to have, and what a value has to look like if it isn't null; dirty rows are those that break it.
CONTRACTS = {
    "cells": {c: None for c in "mcc mnc lac cell date_on date_off coord_x coord_y bs_type generation azimuth sector_angle power height tilt frequency rad_class subject address".split()} | {"mcc": r"^\d{3}$", "cell": r"^\d+$", "date_on": r"^\d{4}-\d{2}-\d{2}"},
    "people": {c: None for c in "identity_type operator_Id client_type actually_from actually_to birth_day first_name second_name last_name dul_department contract_number".split()} | {"isdn": r"^79\d{9}$", "imsi": r"^\d{15}$", "imei": r"^\d{15}$", "iccid": r"^\d{19}$", "document": r"^\d{4} \d{6}$"},
}


def contract_report(df: DataFrame, source: str) -> DataFrame:
    """``field, filled, broken, ok``: of each field of a source's contract how many values there are and how many don't look like it. A column that isn't there isn't ok."""
    rows = []
    for field, pattern in CONTRACTS[source].items():
        c = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
        broken = F.sum((c.isNotNull() & ~c.rlike(pattern)).cast("long")) if pattern else F.lit(0).cast("long")
        rows.append(F.struct(F.lit(field).alias("field"), F.count(c).alias("filled"), F.coalesce(broken, F.lit(0)).alias("broken"), F.lit(field in df.columns).alias("there")).alias(field))
    return df.agg(*rows).select(F.explode(F.array(*[F.col(f) for f in CONTRACTS[source]])).alias("r")).select("r.field", "r.filled", "r.broken", (F.col("r.there") & (F.col("r.broken") == 0)).alias("ok"))


def person_versions(people: DataFrame, share: float = 0.04, seed: int = 1) -> DataFrame:
    """Subscriptions with versions: a share has an earlier version that ends days after the next begins, another was carried over from another operator."""
    u = lambda k: unit(F.col("iccid"), seed, k)
    early = people.where(u("overlap") < share).withColumn("actually_to", F.col("actually_from") + F.expr("interval 5 days")).withColumn("actually_from", F.col("actually_from") - F.expr("interval 200 days"))
    moved = people.where((u("overlap") >= share) & (u("moved") < 0.02)).withColumn("operator_Id", (F.col("operator_Id") + 1) % 100).withColumn("actually_to", F.col("actually_from") - F.expr("interval 1 second")).withColumn("actually_from", F.col("actually_from") - F.expr("interval 400 days"))
    return people.unionByName(early).unionByName(moved)


def states(people: DataFrame, n_cells: int, day: date, seed: int = 1) -> DataFrame:
    """A subscriber's day: profile (light, normal, heavy), how busy, how they move, home cell, when the day begins and how long it lasts."""
    u = lambda k: unit(F.col("isdn"), str(day), seed, k)
    level = pick(u("profile"), [("light", 28), ("normal", 54), ("heavy", 18)])
    moves = pick(u("mobility"), [("stays", 30), ("local", 45), ("far", 25)])
    base = F.when(level == "light", 3).when(level == "normal", 7).otherwise(14)
    busy = F.when(u("hyper") < 0.018, 6 + F.floor(u("times") * 9)).otherwise(1)
    return people.select(
        "isdn", "imsi", "imei", level.alias("level"), moves.alias("moves"), (base * busy + F.when(moves == "far", 3).when(moves == "local", 1).otherwise(0)).cast("int").alias("events"), F.floor(unit(F.col("isdn"), seed, "home") * n_cells).cast("bigint").alias("home"),
        pick(u("begin"), [(7, 4), (9, 6), (12, 5), (18, 4), (22, 1)]).alias("begins"), pick(u("long"), [(1, 3), (3, 4), (8, 2)]).alias("hours"),
    )


def journeys(people: DataFrame, cell_table: DataFrame, day: date, seed: int = 1) -> DataFrame:
    """``isdn, imsi, imei, k, at, cell, step``: a subscriber's k-th point of a day, in the middle of its part of the day's span give or take some percent, at a cell
    at most three steps from the one before along the line of cells.
    """
    n = cell_table.count()
    s = states(people, n, day, seed).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("events") - 1)))
    wide = F.when(F.col("moves") == "stays", 0).when(F.col("moves") == "local", 1).otherwise(3)
    jitter = (unit(F.col("isdn"), F.col("k"), str(day), seed, "at") - 0.5) * 0.07
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") + 0.5) / F.col("events") + jitter))
    at = F.lit(f"{day} 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("begins"), secs=F.round(part * F.col("hours") * 3600))
    step = F.when(F.col("k") == 0, 0).otherwise(F.floor(unit(F.col("isdn"), F.col("k"), str(day), seed, "step") * (2 * wide + 1)) - wide).cast("int")
    w = Window.partitionBy("isdn").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("isdn", "imsi", "imei", "k", at.alias("at"), "home", step.alias("step")).withColumn("cell", F.lit(10_000) + F.pmod(F.col("home") + F.sum("step").over(w), F.lit(n))).drop("home")


def handovers(points: DataFrame, camped_minutes: int = 60) -> DataFrame:
    """``isdn, at, cell, reason``: a location record where a subscriber's cell changes, and one every so often while it stays."""
    w = Window.partitionBy("isdn").orderBy("at", "k")
    seen = points.withColumn("was", F.lag("cell").over(w)).withColumn("next", F.coalesce(F.lead("at").over(w), F.col("at")))
    changed = seen.where("was is null or was <> cell").select("isdn", "at", "cell", F.lit("handover").alias("reason"))
    every = F.sequence(F.col("at") + F.make_dt_interval(mins=F.lit(camped_minutes)), F.col("next"), F.make_dt_interval(mins=F.lit(camped_minutes)))
    stays = seen.where(F.col("next") >= F.col("at") + F.make_dt_interval(mins=F.lit(camped_minutes))).select("isdn", F.explode(every).alias("at"), "cell", F.lit("periodic").alias("reason"))
    return changed.unionByName(stays)


def local_time(df: DataFrame, at: str, offset: str) -> DataFrame:
    """``Started``, the fourteen digits of a moment in UTC shifted by its cell's hours."""
    return df.withColumn("Started", F.date_format(F.col(at) + F.make_dt_interval(hours=F.coalesce(F.col(offset).cast("int"), F.lit(0))), "yyyyMMddHHmmss"))


def parties(df: DataFrame, seed: int = 1) -> DataFrame:
    """The other party of each record, and records that it owns: numbers change places and the owner's SIM is blank, as marts have them."""
    from cellframe.plans.events import swap_parties

    u = lambda k: unit(F.col("isdn"), F.col("k"), seed, k)
    peer = F.concat(F.lit("79"), F.lpad(F.floor(u("peer") * 1e9).cast("bigint").cast("string"), 9, "0"))
    with_peer = df.withColumn("peer", F.when(u("abroad") < 0.18, F.concat(F.lit("49"), F.substring(peer, 3, 9))).otherwise(peer)).withColumn("peer_imsi", F.lit(None).cast("string")).withColumn("Owner", F.when(u("owner") < 0.9, 1).otherwise(2))
    return swap_parties(with_peer, "Owner", ("isdn", "imsi"), ("peer", "peer_imsi"))


def cross_mart_noise(marts: dict[str, DataFrame], share: float = 0.025, seed: int = 1) -> dict[str, DataFrame]:
    """Each mart with a share of another's rows in its own columns, as misrouted records: those that it doesn't share are null."""
    names, out = list(marts), {}
    for i, name in enumerate(names):
        own, other = marts[name], marts[names[(i + 1) % len(names)]]
        stray = other.where(unit(*[F.col(c).cast("string") for c in other.columns], seed, "stray") < share)
        out[name] = own.unionByName(stray.select(*[(F.col(c) if c in other.columns else F.lit(None)).try_cast(own.schema[c].dataType).alias(c) for c in own.columns]))
    return out


def row_of_mart(points: DataFrame, kind: str, cells_by_number: DataFrame) -> DataFrame:
    """Points of journeys as typed rows of one mart. ``cells_by_number``: cell, mcc, mnc, lac, utc_offset."""
    from cellframe.plans.events import CELL, PARTY

    e = local_time(points.join(cells_by_number, "cell"), "at", "utc_offset")
    u = lambda k: unit(F.col("isdn"), F.col("k"), kind, k)
    lac, cell = CELL[kind]
    common = [F.when(u("broken") < 0.002, F.substring("Started", 1, 10)).otherwise(F.col("Started")).alias("Started"), F.when(u("imsi") < _PRESENT[kind], F.col("imsi")).alias("IMSI"), F.when(u("imei") < 0.8, F.col("imei")).alias("IMEI"), F.col("isdn").alias(PARTY[kind]), (F.col("Owner") if "Owner" in points.columns else F.lit(1)).alias("Owner")]
    place = [F.col("lac").cast("string").try_cast("int").alias(lac), F.col("cell").cast("bigint").alias(cell)] if kind in ("cdr", "gprs") else [F.col("lac").cast("string").alias(lac), F.col("cell").cast("string").alias(cell)]
    code = [F.concat_ws("-", "mcc", "mnc").alias("OwnerMCCMNC")] if kind in ("cdr", "gprs") else [F.col("mcc").cast("string").alias("MCC"), F.col("mnc").cast("string").alias("MNC")]
    return e.select(*common, *code, *place)
