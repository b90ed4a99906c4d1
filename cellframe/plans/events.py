"""Event marts: union of call, message, session and location records; daily geo events; stay intervals."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe import schemas
from cellframe.functions import scalar as S
from cellframe.operators import impute, joins, stay
from cellframe.operators.geo import first_covering
from cellframe.operators.islands import collapse_runs, first_known, mark_islands
from cellframe.session import checkpointed

CODES = dict(cdr=10001, sms=10002, gprs=10003, location=10004)
PARTY = dict(cdr="CallingNumber", sms="Calling", gprs="CallingNumber", location="Served")
#: Columns of lac and cell in each mart.
CELL = {"cdr": ("BSStartLac", "BSStartCell"), "gprs": ("BSStartLac", "BSStartCell"), "sms": ("Lac", "Cell"), "location": ("Lac", "Cell")}


def location(mcc: Column, mnc: Column, lac: Column, cell: Column) -> Column:
    return F.struct(mcc.alias("mcc"), mnc.alias("mnc"), lac.try_cast("bigint").alias("lac"), cell.try_cast("bigint").alias("cell"))


def location_known(c: str = "location") -> Column:
    loc = F.col(c)
    text = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    return F.coalesce(loc.isNotNull() & text(loc["mcc"]) & text(loc["mnc"]) & loc["lac"].isNotNull() & loc["cell"].isNotNull(), F.lit(False))


def normalise_mart(df: DataFrame, mart: str, day: date | None = None) -> DataFrame:
    """A mart's rows in the event contract; rows without a fourteen-digit start go, and those of another local day."""
    lac, cell = (F.col(c).cast("string") for c in CELL[mart])
    if mart in ("cdr", "gprs"):
        code = S.digits("OwnerMCCMNC")
        loc = location(F.when(code != "", F.substring(code, 1, 3)), F.when(F.length(code) > 3, F.substring(code, 4, 10)), lac, cell)
    else:
        loc = location(S.blank_to_null(F.col("MCC").cast("string")), S.blank_to_null(F.col("MNC").cast("string")), lac, cell)
    text = lambda c: F.trim(F.col(c).cast("string"))
    rows = df.where(S.fourteen_digits("Started"))
    if day:
        rows = rows.where(F.substring(text("Started"), 1, 8) == day.strftime("%Y%m%d"))
    return rows.select(text("Started").alias("event_timestamp"), text("IMSI").alias("imsi"), text("IMEI").alias("imei"), text(PARTY[mart]).alias("msisdn"), loc.alias("location"), F.lit(CODES[mart]).cast("bigint").alias("event"), F.lit(mart).alias("event_name"))


def swap_parties(df: DataFrame, owner: str, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """Numbers and devices of both parties swapped where the second owns the record; an owner's devices blank where nobody is said to."""
    o = F.col(owner)
    out = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        out[x] = F.when(o == 2, F.col(y)).otherwise(F.col(x))
        out[y] = F.when(o == 2, F.col(x)).otherwise(F.col(y))
        if k:
            out[x] = F.when(o == 1, F.col(x))
    return df.withColumns(out)


def build_events(marts: dict[str, DataFrame], day: date | None = None) -> DataFrame:
    """Union of the marts, runs of one subscriber, type and cell within five minutes collapsed.

    Rows without a usable location pass by with count 1; a null subscriber never collapses.
    """
    rows = None
    for mart, df in marts.items():
        one = normalise_mart(df, mart, day)
        rows = one if rows is None else rows.unionByName(one)
    return collapse_events(rows)


def collapse_events(rows: DataFrame) -> DataFrame:
    passing = rows.where(~location_known()).withColumn("event_count", F.lit(1).cast("bigint"))
    work = rows.where(location_known()).withColumn("__ts", S.event_time("event_timestamp")).withColumn("__cgi", S.cgi("location.mcc", "location.mnc", "location.lac", "location.cell"))
    order = ["__ts", "event_name", "__cgi", "msisdn", "imei"]
    marked = mark_islands(work, ["imsi"], order, ["event_name", "__cgi", S.bucket_no("__ts")], ["imsi"])
    by = F.struct(*order)
    kept = "event_timestamp event event_name location msisdn imei".split()
    runs = marked.groupBy("imsi", "island").agg(*[first_known(c, by).alias(c) for c in kept], F.count("*").alias("event_count"))
    return schemas.contract(runs.select(*schemas.EVENT.fieldNames()).unionByName(passing.select(*schemas.EVENT.fieldNames())), schemas.EVENT)


def cell_lookup(bs: DataFrame) -> DataFrame:
    """Versions of cells by key: place, kind, territory, hours from UTC. Versions without begin or place go."""
    n = lambda c: F.col(c).try_cast("double")
    return bs.select(
        S.cgi(*schemas.BS_KEYS).alias("cgi"), n("lat").alias("lat"), n("lon").alias("lon"), F.coalesce(F.col("bs_type").cast("string"), F.lit("o")).alias("bs_type"), "oktmo_code_1", "oktmo_code_2",
        F.col("date_on").try_cast("timestamp_ntz").alias("date_on"), F.col("date_off").try_cast("timestamp_ntz").alias("date_off"), F.coalesce(F.col("timezone").try_cast("int"), F.lit(0)).alias("utc_offset"),
    ).dropna(subset=["date_on", "lat", "lon"])


def location_parts(events: DataFrame, c: str = "location") -> tuple[Column, Column, Column, Column]:
    """mcc, mnc, lac and cell as numbers, of a location that is a struct, an array of the four, or a text ``mccmnc|lac|cell``; all null without the column."""
    if c not in events.columns:
        return (F.lit(None).cast("bigint"),) * 4
    loc, kind = F.col(c), events.schema[c].dataType
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        parts = [loc[n].cast("string") if n in names else F.lit(None).cast("string") for n in ("mcc", "mnc", "lac", "cell")] if "mcc" in names else [loc[n].cast("string") for n in names[:4]]
    elif isinstance(kind, T.ArrayType):
        parts = [F.get(loc, F.lit(k)).cast("string") for k in range(4)]
    else:
        cut = F.split(loc.cast("string"), r"\|")
        code = F.when(F.size(cut) >= 3, S.digits(F.get(cut, F.lit(0))))
        parts = [F.substring(code, 1, 3), F.substring(code, 4, 20), F.when(F.size(cut) >= 3, F.get(cut, F.lit(1))), F.when(F.size(cut) >= 3, F.get(cut, F.lit(2)))]
    return tuple(S.digits(p).try_cast("bigint") for p in parts[:2]) + tuple(F.trim(p).try_cast("bigint") for p in parts[2:])


def normalise_events(events: DataFrame) -> DataFrame:
    """Events with numeric identifiers, cell key, known type and local time.

    The type is the name; the code only where no row of the table has a name.
    """
    mcc, mnc, lac, cell = location_parts(events)
    named = F.max(F.col("event_name").isNotNull().cast("int"))
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)]), F.col("event").cast("int"))
    rows = events.crossJoin(F.broadcast(events.agg(named.alias("__named"))))
    kind = F.when(F.col("__named") == 1, F.lower(F.trim("event_name"))).otherwise(code)
    return rows.select(
        S.msisdn("msisdn").try_cast("bigint").alias("msisdn"), S.digits_to_long("imsi", 10).alias("imsi"), S.digits_to_long("imei", 8).alias("imei"),
        F.when(mcc.isNotNull() & mnc.isNotNull() & lac.isNotNull() & cell.isNotNull(), S.cgi(mcc, mnc, lac, cell)).alias("cgi"), kind.alias("source_event_type"),
        F.coalesce(F.col("event_count").try_cast("int"), F.lit(1)).alias("event_count"), S.event_time("event_timestamp").alias("start_time_local"),
    ).where(F.col("source_event_type").isin(*CODES))


def transform_metrics(events: DataFrame) -> DataFrame:
    """Counters of what normalisation would lose, one row."""
    loc = F.col("location")

    def n(cond):
        return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))

    kind = F.lower(F.trim("event_name"))
    return events.agg(
        F.count("*").alias("rows"), n(S.msisdn("msisdn").isNull()).alias("bad_msisdn"), n(S.digits_to_long("imsi", 10).isNull()).alias("bad_imsi"), n(S.digits_to_long("imei", 8).isNull()).alias("bad_imei"),
        n(S.event_time("event_timestamp").isNull()).alias("bad_timestamp"), n(kind.isNull() | ~kind.isin(*CODES)).alias("unknown_type"), n(loc.isNull() | loc["mcc"].isNull()).alias("no_mcc"), n(loc.isNull() | loc["mnc"].isNull()).alias("no_mnc"),
        n(loc.isNull() | loc["lac"].isNull()).alias("no_lac"), n(loc.isNull() | loc["cell"].isNull()).alias("no_cell"),
    )


def build_geo_all(events: DataFrame, bs: DataFrame, day: date) -> DataFrame:
    """Geo events of a UTC day: missing cells imputed, each event with the version of its cell, valid rows only, runs collapsed.

    The count of a run is its number of rows, and the end stays null, as in the original.
    """
    versions = cell_lookup(bs)
    rows = normalise_events(events).where(F.col("start_time_local").isNotNull())
    rows = impute.impute_between(rows, impute.cell_points(versions), "msisdn", ["start_time_local", "source_event_type", "imsi", "imei"])
    got = joins.version_join(rows.where(F.col("cgi").isNotNull()), versions, ["cgi"], "start_time_local", "date_on", "date_off", tie=["lat", "lon"])
    got = got.withColumn("oktmo_code_1", F.coalesce("oktmo_code_1", F.lit("unknown"))).withColumn("start_time_utc", S.local_to_utc("start_time_local", "utc_offset"))
    low, high = F.lit(str(day)).cast("timestamp_ntz"), F.lit(str(day + timedelta(days=1))).cast("timestamp_ntz")
    valid = got.where((F.col("start_time_utc") >= low) & (F.col("start_time_utc") < high)).dropna(subset=["msisdn", "cgi"]).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    valid = valid.withColumn("lat", F.bround("lat", 5)).withColumn("lon", F.bround("lon", 5))
    runs = collapse_runs(valid, ["msisdn"], "start_time_utc", ["source_event_type", "cgi"], ["source_event_type", "cgi", "imsi", "imei"], first="imsi imei utc_offset lat lon bs_type oktmo_code_1 oktmo_code_2".split())
    return schemas.contract(runs.withColumn("start_time_utc", F.col("first_ts")).withColumn("end_time_utc", F.lit(None)), schemas.GEO_EVENT)


def build_geo_intervals(geo: DataFrame, imsi_bindings: DataFrame, imei_bindings: DataFrame, bs: DataFrame | None, zones: DataFrame | None, day: date, fan_out: bool = False) -> DataFrame:
    """Stay intervals of a day: identifiers filled from bindings, stays built, time zone of each place by polygon, else of its first cell.

    ``fan_out`` gives an outdoor event each version of its cell, as the original's join does; the default is one point for each cell.
    """
    rows = geo
    for b, c in ((imsi_bindings, "imsi"), (imei_bindings, "imei")):
        held = b.select(F.col("msisdn").try_cast("bigint").alias("msisdn"), F.col(c).try_cast("bigint").alias(c), "valid_from", "valid_to")
        rows = joins.fill_from_intervals(rows, held, "msisdn", c, "start_time_utc")
    points = zone_of_cell = None
    if bs is not None:
        c = bs.withColumn("cgi", S.cgi(*schemas.BS_KEYS))
        has = lambda x: x if x in bs.columns else "lat" if x.endswith("lat") else "lon"
        place = c.select("cgi", "date_on", F.col("timezone").cast("int").alias("timezone"), F.coalesce(has("mapinfo_wkt_centroid_lat"), has("sector_wkt_centroid_lat"), "lat").alias("lat"), F.coalesce(has("mapinfo_wkt_centroid_lon"), has("sector_wkt_centroid_lon"), "lon").alias("lon"))
        one = place.groupBy("cgi").agg(F.max_by(F.struct("lat", "lon", "timezone"), F.struct("date_on", "lat", "lon")).alias("r")).select("cgi", "r.*")
        points = (place if fan_out else one).select("cgi", "lat", "lon")
        zone_of_cell = one.select(F.col("cgi").cast("string").alias("__cgi"), F.col("timezone").alias("__tz"))
    # written before it is joined with what is computed from it: row numbers, and sums of doubles, may differ at another evaluation
    out = checkpointed(stay.build_stays(rows, points, F.lit(day)).withColumn("__row", F.monotonically_increasing_id()))
    if zones is not None:
        out = first_covering(out, zones.select("code", "timezone", "geometry"), "__row", "sub_lon", "sub_lat", "code", "geometry").drop("code")
    else:
        out = out.withColumn("timezone", F.lit(None).cast("int"))
    if zone_of_cell is not None:
        out = out.join(zone_of_cell, F.get("cgi_list", F.lit(0)) == F.col("__cgi"), "left").withColumn("timezone", F.coalesce("timezone", "__tz"))
    return schemas.contract(out, schemas.STAY)
