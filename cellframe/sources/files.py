"""Reading and writing: dated layouts, tolerant projected reads, dimension CSVs, JSON lines, log files, idempotent period writes."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY_IN_PATH = (r"(\d\d\d\d)/(\d\d)/(\d\d)(?:/|$)", r"(\d\d\d\d)-(\d\d)-(\d\d)", r"load_year=(\d{4})/load_month=(\d{1,2})/load_day=(\d{1,2})")


def day_of_path(path: Column) -> Column:
    """The date that a path names in any of the three layouts; null if none."""
    found = []
    for pattern in _DAY_IN_PATH:
        y, m, d = (F.regexp_extract(path, pattern, k).try_cast("int") for k in (1, 2, 3))
        found.append(F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")).cast("date")))
    return F.coalesce(*found)


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """All files below a folder of any file system, sorted; none if it isn't there. Names only: an index of files, not their rows."""
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return []
    if fs.getFileStatus(path).isFile():
        return [root]
    out, it = [], fs.listFiles(path, True)
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.endswith(suffix):
            out.append(p)
    return sorted(out)


def near_day(spark: SparkSession, paths: Sequence[str], day: date, slack: int = 1) -> list[str]:
    """Paths of a day and ``slack`` days around it; paths without a date are always kept."""
    out = []
    for p in paths:
        hit = next((m for m in (re.search(x, p) for x in _DAY_IN_PATH) if m), None)
        if hit is None or abs((date(*map(int, hit.groups())) - day).days) <= slack:
            out.append(p)
    return out


def read_columns(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """The schema's columns of many files, missing ones null, unreadable files skipped; an empty table for no files."""
    if not paths:
        return spark.createDataFrame([], schema)
    df = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*paths)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, (T.StructType, T.ArrayType)) else (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_day(spark: SparkSession, root: str, day: date, schema: T.StructType, slack: int = 1) -> DataFrame:
    """Files of a mart near a day, whatever their layout."""
    return read_columns(spark, near_day(spark, list_files(spark, root), day, slack), schema)


def read_partitions(spark: SparkSession, root: str, day: date, slack: int = 1, column: str = "report_date") -> DataFrame:
    """The same for a table partitioned by date: the filter prunes partitions before any file is opened."""
    low, high = day - timedelta(days=slack), day + timedelta(days=slack)
    return spark.read.parquet(root).where(F.col(column).between(F.lit(low), F.lit(high)))


def latest_complete_snapshot(spark: SparkSession, root: str, year: int, month: int) -> str:
    """The newest ``load_day`` folder of a month that has a ``_SUCCESS`` marker; an error if there is none."""
    best = None
    for p in list_files(spark, root, "_SUCCESS"):
        m = re.search(r"load_year=(\d+)/load_month=(\d+)/load_day=(\d+)/_SUCCESS$", p)
        if m and (int(m[1]), int(m[2])) == (year, month) and (best is None or int(m[3]) > best[0]):
            best = (int(m[3]), p.rsplit("/", 1)[0])
    if best is None:
        raise FileNotFoundError(f"no complete snapshot for {year}-{month:02d} in {root}")
    return best[1]


def read_geo_all_day(spark: SparkSession, path: str) -> DataFrame:
    """The four columns that bindings need of a day's geo events; an empty table if the file isn't there or can't be read."""
    from cellframe import schemas

    kept = T.StructType([schemas.GEO_EVENT[c] for c in ("msisdn", "imsi", "imei", "start_time_utc")])
    return read_columns(spark, list_files(spark, path), kept)


def source_of_path(path: Column, root: str = "") -> Column:
    """The path segment that names a file's source, behind its day; ``_unknown`` if there is none."""
    inside = F.regexp_replace(path, "^" + re.escape(root), "") if root else path
    found = F.regexp_extract(inside, r"(?:\d{4}/\d{2}/\d{2}|\d{4}-\d{2}-\d{2}|load_day=\d{1,2})/([^/]+?)(?:\.parquet)?(?:/|$)", 1)
    return F.when(found != "", found).otherwise("_unknown")


#: Where each table lies below the root: daily ones by day, monthly ones by the first of the month.
LAYOUTS = {
    "dds/event": "dds/event/{day:%Y/%m/%d}/{source}/events.parquet", "dds/event_dds": "dds/event_dds/{day:%Y-%m-%d}/{source}.parquet", "stg/geo_all": "stg/geo_all/{day:%Y-%m-%d}.parquet",
    "fct/msisdn_imei": "fct/msisdn_imei/{month:%Y-%m-%d}.parquet", "fct/msisdn_imsi": "fct/msisdn_imsi/{month:%Y-%m-%d}.parquet", "fct/geo_intervals": "fct/geo_intervals/{day:%Y-%m-%d}.parquet", "fct/person": "fct/person/{month:%Y-%m-%d}.parquet", "fct/bs": "fct/bs.parquet",
}


def layout_path(root: str, table: str, day: date | None = None, source: str = "") -> str:
    return f"{root.rstrip('/')}/" + LAYOUTS[table].format(day=day or date.min, month=(day or date.min).replace(day=1), source=source)


def daily_path(base: str, day: date) -> str:
    """A day's file in a folder, or ``base`` itself where it names a file."""
    return base if base.lower().endswith(".parquet") else f"{base.rstrip('/')}/{day.isoformat()}.parquet"


def monthly_path(base: str, day: date) -> str:
    return daily_path(base, day.replace(day=1))


def read_dimension_csv(spark: SparkSession, path: str, mapping: dict[str, tuple[str, str]], sep: str = ";") -> DataFrame:
    """``mapping``: target column to (source column, type). All is read as text, so that codes keep leading zeros and ``NA`` stays a code;
    a byte-order mark before the first header is dropped; a missing source column is an error.
    """
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [s for s, _ in mapping.values() if s not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[cast_logical(F.col(f"`{s}`"), t).alias(n) for n, (s, t) in mapping.items()])


def cast_logical(c: Column, kind: str) -> Column:
    """A text in one of the contract's logical types; what doesn't fit is null, an unknown type an error."""
    t = F.trim(c)
    t = F.when(t != "", t)
    simple = {"string": "string", "smallint": "smallint", "int": "int", "int32": "int", "long": "bigint", "int64": "bigint", "float": "double", "float64": "double", "double": "double", "timestamp": "timestamp_ntz", "date": "date"}
    if kind in ("bool", "boolean"):
        return F.lower(t).isin(*"1 t true y yes".split())
    if kind not in simple:
        raise ValueError(f"unsupported logical type {kind}")
    return t.try_cast(simple[kind])


def write_period(df: DataFrame, root: str, by: Sequence[str]) -> None:
    """Replaces just the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def swap_write(spark: SparkSession, df: DataFrame, root: str) -> None:
    """Overwrites a table that ``df`` itself may read: written beside it, the old one renamed aside, the new one into its place.

    Nothing is deleted before the new table is in place; where a rename fails, the old one is put back and an error raised. A crash between both
    renames leaves the old table beside as ``.__old``, which the next call puts back before it begins.
    """
    root = root.rstrip("/")
    (old, fs), (aside, _), (new, _) = (_fs(spark, f"{root}{x}") for x in ("", ".__old", ".__new"))
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        elif not fs.rename(aside, old):
            raise OSError(f"{root}: its last state can't be put back")
    df.write.mode("overwrite").parquet(f"{root}.__new")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{root} can't be renamed")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{root}.__new can't be renamed")
    if had:
        fs.delete(aside, True)


def count_rows(spark: SparkSession, path: str) -> int:
    """From file footers alone: no column is read."""
    return spark.read.parquet(path).count()


def has_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def route_by_region(df: DataFrame, region: str, centres: dict[str, Sequence[str]], default: str) -> DataFrame:
    """Adds ``source_id``, the data centre that a row's region belongs to."""
    out = F.lit(default)
    for centre, regions in centres.items():
        out = F.when(F.col(region).isin(*regions), centre).otherwise(out)
    return df.withColumn("source_id", out)


def write_routed(df: DataFrame, root: str, report_date: date, region: str, centres: dict[str, Sequence[str]], default: str) -> None:
    """A day's rows by data centre; each centre has a folder, a centre without rows an empty one, and a day written again replaces itself alone."""
    routed = route_by_region(df, region, centres, default)
    for centre in dict.fromkeys([default, *centres]):
        routed.where(F.col("source_id") == centre).drop("source_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/report_date={report_date.isoformat()}/source_id={centre}")


def move_event(spark: SparkSession, source: str, target: str, source_id: str, report_date: date) -> dict[str, str]:
    """One centre's day of events into the common layout; a missing source isn't an error."""
    if not list_files(spark, source):
        return {"source_id": source_id, "status": "missing_source"}
    write_period(spark.read.parquet(source).withColumn("report_date", F.lit(report_date)).withColumn("source_id", F.lit(source_id)), target, ["report_date", "source_id"])
    return {"source_id": source_id, "status": "ok"}


def append_jsonl(spark: SparkSession, records: Sequence[dict], path: str) -> None:
    rows = [(json.dumps(r, ensure_ascii=False, default=str),) for r in records]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


TIMING = "ts_utc string, command string, elapsed_total_sec double, status string, run_id string"


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing records; broken lines are left out, a missing run id is null."""
    r = F.from_json("value", TIMING)
    return spark.read.text(path).select(r.alias("r")).select("r.*").where("command is not null")


def latest_timings(df: DataFrame) -> DataFrame:
    return df.groupBy("command").agg(F.max_by(F.struct("elapsed_total_sec", "status", "run_id", "ts_utc"), "ts_utc").alias("r")).select("command", "r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line`` of text files; the number of a line tells its place in its file, also where a file is read in parts."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    return lines.select("value", "file", F.row_number().over(Window.partitionBy("file").orderBy("place")).alias("line"))


def parse_log(lines: DataFrame, tag: str) -> DataFrame:
    """``ts, level, logger, check_name, status, metrics`` of log lines ``ts | level | logger | {json}`` with a tag; other lines go. Further columns stay."""
    more = [c for c in lines.columns if c != "value"]
    parts = F.split("value", r"\s*\|\s*", 4)
    rows = lines.select(*more, F.get(parts, F.lit(0)).alias("ts"), F.get(parts, F.lit(1)).alias("level"), F.get(parts, F.lit(2)).alias("logger"), F.from_json(F.get(parts, F.lit(3)), "tag string, check string, status string, metrics map<string,string>").alias("p"))
    return rows.where(F.col("p.tag") == tag).select(*more, "ts", "level", "logger", F.col("p.check").alias("check_name"), F.col("p.status").alias("status"), F.col("p.metrics").alias("metrics"))


def now_text() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
