"""Cell dimension: raw cells normalised with an error table, enriched, merged into versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.functions import scalar as S
from cellframe.operators import geo, scd
from cellframe.session import checkpointed

NUMERIC = tuple("mcc mnc lac cell coord_x coord_y azimuth sector_angle frequency power height amplification tilt el_tilt mech_tilt".split())
TEXT = ("bs_type", "generation", "address", "subject", "location", "description", "rad_class")
TIMES = ("date_on", "date_off")
#: Accepted range of radio fields; values outside are moved to the border.
RANGES = dict(power=(0.0, 150.0), height=(-50.0, 240.0), amplification=(-25.0, 80.0)) | dict.fromkeys("tilt el_tilt mech_tilt".split(), (-120.0, 120.0))


def row_key() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(F.lit("cgi="), F.concat_ws("_", *[part(c) for c in NUMERIC[:4]]), F.lit(" date_on="), part("date_on"), F.lit(" date_off="), part("date_off"))


def processable() -> Column:
    """Whether all four parts of a prepared cell's key are numbers."""
    out = F.lit(True)
    for c in NUMERIC[:4]:
        out = out & F.col(c).isNotNull()
    return out


def prepare(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised cells, and ``row_key, field, value, reason`` of everything that was wrong. Nothing fails; what can't be read is null."""
    for c in (*NUMERIC, *TEXT, *TIMES):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    number = {c: F.col(c).cast("string").try_cast("double") for c in NUMERIC}
    time = {c: F.col(c).cast("string").try_cast("timestamp_ntz") for c in TIMES}

    def issue(cond: Column, field: str, reason: str) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), F.lit(reason).alias("reason")))

    x, y = S.wrap_longitude(number["coord_x"]), number["coord_y"]
    issues = [issue(filled(c) & number[c].isNull(), c, "non_numeric") for c in NUMERIC] + [issue(filled(c) & time[c].isNull(), c, "non_timestamp") for c in TIMES]
    issues += [issue(~x.between(-180, 180), "coord_x", "invalid_lon"), issue(~y.between(-90, 90), "coord_y", "invalid_lat"), issue(number["mnc"] < 0, "mnc", "negative_mnc"), issue(time["date_off"] < time["date_on"], "date_off", "date_off_before_date_on")]
    errors = raw.select(row_key().alias("row_key"), F.explode(F.filter(F.array(*issues), lambda e: e.isNotNull())).alias("e")).select("row_key", "e.*")
    clean = {c: number[c] for c in NUMERIC} | {c: time[c] for c in TIMES} | {c: S.blank_to_null(F.col(c).cast("string")) for c in TEXT}
    clean |= {"coord_x": F.when(x.between(-180, 180), x), "coord_y": F.when(y.between(-90, 90), y), "mnc": F.when(number["mnc"] >= 0, number["mnc"])}
    clean |= {c: S.clamp(number[c], low, high) for c, (low, high) in RANGES.items()}
    rest = [c for c in raw.columns if c not in clean]
    return raw.select(*rest, *[v.alias(c) for c, v in clean.items()]), errors


def build_snapshot(prepared: DataFrame, zones: DataFrame | None = None, territories: DataFrame | None = None) -> DataFrame:
    """One row for each cell with its time zone, territory, sector, reach and best-server area."""
    w = prepared.where(processable())
    w = w.withColumns({"mcc": F.col("mcc").cast("smallint"), "mnc": F.col("mnc").cast("smallint"), "lac": F.col("lac").cast("int"), "cell_id": F.col("cell").cast("bigint"), "lon": F.bround("coord_x", 5), "lat": F.bround("coord_y", 5)})
    w = w.withColumns({"telecomstandard": S.generation("generation"), "bs_type": S.site_type("bs_type", "location", "description"), "azimuth": S.azimuth("azimuth"), "sector_angle": S.sector_angle("sector_angle"), "frequency": F.col("frequency").cast("int")})
    w = scd.latest(w, list(schemas.BS_KEYS), ["date_on", "date_off", "lat", "lon"])
    w = w.withColumn("sector_radius", S.sector_radius_km("bs_type")).withColumn("geohash", S.geohash("lat", "lon")).withColumn("__id", S.cgi(*schemas.BS_KEYS))
    if zones is not None:
        w = geo.first_covering(w, zones.select("code", "timezone", "geometry"), "__id", "lon", "lat", "code", "geometry").drop("code")
    else:
        w = w.withColumn("timezone", F.lit(None).cast("int"))
    if territories is not None:
        w = geo.territory(w, territories, "__id", "lon", "lat", "subject")
    else:
        w = w.withColumn("oktmo_code_1", F.lit(None).cast("string")).withColumn("oktmo_code_2", F.lit(None).cast("string"))
    # geometry refers to these columns many times over, and the mosaic reads them again: computed once, written once
    w = checkpointed(w)
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    rings = F.when(placed, geo.sector_rings(F.col("lon"), F.col("lat"), F.col("sector_radius"), F.col("azimuth"), F.col("sector_angle"), F.col("bs_type")))
    w = w.withColumn("__rings", rings).withColumn("sector_wkt", geo.rings_wkt(F.col("__rings"))).withColumn("__m", geo.rings_metrics(F.col("__rings")))
    w = w.withColumns({"sector_wkt_area": F.col("__m.area_km2"), "sector_wkt_centroid_lon": F.col("__m.lon"), "sector_wkt_centroid_lat": F.col("__m.lat")}).drop("__rings", "__m")
    w = w.withColumn("reach_m", S.reach_m("sector_radius", S.valid_power("power", "bs_type"), S.valid_height("height", "bs_type"), S.median_tilt("tilt", "el_tilt", "mech_tilt"), "bs_type", S.radiation_factor("rad_class")))
    w = checkpointed(w)
    mosaic = geo.best_server_mosaic(w, ["telecomstandard", "frequency"], "__id")
    return checkpointed(schemas.contract(w.join(mosaic, "__id", "left"), schemas.BS, fill_missing=True))


def merge_snapshot(history: DataFrame, snapshot: DataFrame, effective: Column) -> DataFrame:
    """Versions after a snapshot; the time that it takes effect is the caller's, so a repeated run changes nothing."""
    compare = [c for c in schemas.BS.fieldNames() if c not in (*schemas.BS_KEYS, "date_on", "date_off")]
    return schemas.contract(scd.merge(history, snapshot, list(schemas.BS_KEYS), compare, effective, F.lit(schemas.BS_OPEN_END).cast("timestamp_ntz")), schemas.BS)
