"""Table contracts and sentinels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BS_OPEN_END = "2262-04-11 00:00:00"
BINDING_OPEN_END = "2999-12-31 23:59:59"
GENERATED_PERSON_OPEN_END = "2261-12-31 23:59:59"


_SIMPLE = {"string": T.StringType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(":") for f in text[7:-1].split(","))])
    return _SIMPLE[text]


def _schema(text: str) -> T.StructType:
    """A schema from ``name type, name type``; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(*(n, _type(t))) for n, t in (f.split(" ") for f in text.split(", "))])


EVENT = _schema("event_timestamp string, imsi string, imei string, msisdn string, location struct<mcc:string,mnc:string,lac:bigint,cell:bigint>, event bigint, event_name string, event_count bigint")
GEO_EVENT = _schema("msisdn bigint, imsi bigint, imei bigint, start_time_utc timestamp_ntz, end_time_utc timestamp_ntz, utc_offset int, lat double, lon double, bs_type string, cgi bigint, event_count int, source_event_type string, oktmo_code_1 string, oktmo_code_2 string")
BS = _schema(
    "mcc smallint, mnc smallint, lac int, cell_id bigint, telecomstandard string, frequency int, bs_type string, lat double, lon double, geohash string, azimuth double, sector_angle double, sector_radius double, "
    "sector_wkt string, sector_wkt_area double, sector_wkt_centroid_lon double, sector_wkt_centroid_lat double, mapinfo_wkt string, mapinfo_wkt_area double, mapinfo_wkt_centroid_lon double, mapinfo_wkt_centroid_lat double, "
    "timezone smallint, oktmo_code_1 string, oktmo_code_2 string, address string, location string, description string, date_on timestamp_ntz, date_off timestamp_ntz"
)
BS_KEYS = tuple("mcc mnc lac cell_id".split())
MSISDN_IMEI = _schema("msisdn string, imei string, valid_from timestamp_ntz, valid_to timestamp_ntz")
MSISDN_IMSI = _schema("msisdn string, imsi string, operator_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz")
STAY = _schema("msisdn bigint, imsi bigint, imei bigint, start_time_utc timestamp_ntz, end_time_utc timestamp_ntz, cgi_list array<string>, sub_lat double, sub_lon double, bs_type string, timezone int, oktmo_code_1 string, oktmo_code_2 string, time_key date")
PERSON = _schema(
    "report_date date, person_id string, person_cluster_key string, person_confidence string, sim_count bigint, msisdn string, imsi string, imei string, gender string, age string, citizenship string, operator_id bigint, actually_from timestamp_ntz, actually_to timestamp_ntz"
)
DIM_TAC = _schema("tac string, manufacturer string, model_name string, marketing_name string, equipment_type string, radio_technology string, sim_form_factor string, allocation_date string, reporting_body string, chipset string, comment string, is_m2m boolean")
DIM_OKSM = _schema("numeric_code string, name_short string, name_full string, alpha2 string, alpha3 string, autokey string")
DIM_OKTMO = _schema("WKT string, level int, parent_code string, code string, name string")
DIM_TIME_ZONES = _schema("code int, name string, timezone int, geometry string")
EXCLUSION = _schema("value string")


def contract(df: DataFrame, schema: T.StructType, fill_missing: bool = False) -> DataFrame:
    """The contract's columns, in its order and types; a missing column is an error, or null."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing and not fill_missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.lit(None) if f.name in missing else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema])


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
