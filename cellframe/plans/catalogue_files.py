"""Queries over readers, writers, logs, steps and generators. What they write goes to a folder of their own below the session's shared one."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe import schemas
from cellframe.plans import runner
from cellframe.plans.catalogue import query, table
from cellframe.session import shared_folder
from cellframe.sources import files
from cellframe.synth import generate

DAY = date(2024, 1, 10)


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


@query("""select event_id, case when event_id % 4 = 0 then null else value end as value, cast(null as varchar) absent, strftime(ts, '%Y-%m-%d') as day from events where cast(ts as date) between date '2024-01-09' and date '2024-01-11' or cast(ts as date) = date '2024-01-20'""")
def dated_files(spark, d):
    """Files of several layouts near a day: others aren't opened, an undated one always is, a column that isn't there is null."""
    root, e = scratch(spark), table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), "ts")
    layouts = {"2024-01-07": "m/2024/01/07", "2024-01-09": "m/2024/01/09", "2024-01-10": "m/2024-01-10", "2024-01-11": "m/load_year=2024/load_month=1/load_day=11", "2024-01-12": "m/2024/01/12", "2024-01-20": "m/undated"}
    for day, folder in layouts.items():
        e.where(F.date_format("ts", "yyyy-MM-dd") == day).write.parquet(f"{root}/{folder}")
    out = files.read_day(spark, f"{root}/m", DAY, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("absent", T.StringType()), T.StructField("ts", T.TimestampNTZType())]))
    return out.select("event_id", "value", "absent", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""with p(p, source, "day") as (values ('r/m/2024/01/09/central/e.parquet', 'central', '2024-01-09'), ('r/m/2024-01-10/far-east.parquet', 'far-east', '2024-01-10'), ('r/m/load_year=2024/load_month=1/load_day=5/north/p', 'north', '2024-01-05'), ('r/m/none.parquet', '_unknown', null)) select p, source, cast("day" as varchar) as day from p
union all select 'layout', 'x/dds/event/2024/01/10/central/events.parquet', 'x/fct/person/2024-01-01.parquet' union all select 'layout', 'a/2024-01-10.parquet', 'a/2024-01-01.parquet' union all select 'layout', 'b.parquet', 'b.parquet'""")
def paths_and_layouts(spark, d):
    """Day and source that a path names; where a table's day or month lies."""
    paths = ["r/m/2024/01/09/central/e.parquet", "r/m/2024-01-10/far-east.parquet", "r/m/load_year=2024/load_month=1/load_day=5/north/p", "r/m/none.parquet"]
    named = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.source_of_path(F.col("p"), "r/m").alias("source"), files.day_of_path(F.col("p")).cast("string").alias("day"))
    laid = [("layout", files.layout_path("x", "dds/event", DAY, "central"), files.layout_path("x", "fct/person", DAY)), ("layout", files.daily_path("a", DAY), files.monthly_path("a", DAY)), ("layout", files.daily_path("b.parquet", DAY), files.monthly_path("b.parquet", DAY))]
    return named.unionByName(spark.createDataFrame(laid, named.schema))


@query("""select 'snapshot' what, count(*) n, cast(max(event_id) as bigint) most from events where day(ts) = 9
union all select 'period', count(*), max(case when event_type = 'click' then event_id + 1000000 else event_id end) from events
union all select 'swapped', count(*), max(event_id) * 2 from events union all select 'swapped again', count(*), max(event_id) * 4 from events
union all select 'routed ' || centre, count(*) filter (where c = centre), max(case when c = centre then event_id end) from (select case when event_type in ('view', 'error') then 'far-east' else 'central' end c, event_id from events), (values ('central'), ('far-east')) v(centre) group by centre
union all select 'empty centre', 0, null union all select 'moved', count(*), max(event_id) from events union all select 'not moved', 0, null
union all select 'footers', count(*), null from events union all select 'columns', 2, 1 union all select 'four columns', count(*), max(event_id) from events union all select 'no file', 0, null""")
def write_patterns(spark, d):
    """Latest complete snapshot, period overwrite, swap, routing, moving, counting: what is there afterwards."""
    root, e = scratch(spark), table(spark, d, "events")
    out = []

    def add(what: str, df: DataFrame, most: str = "event_id") -> None:
        out.append(df.agg(F.count("*").alias("n"), F.max(F.col(most).cast("long")).alias("most")).select(F.lit(what).alias("what"), "n", "most"))

    for day in (5, 9, 12):
        folder = f"{root}/s/load_year=2024/load_month=01/load_day={day:02d}"
        e.where(F.dayofmonth("ts") == day).write.parquet(folder)
    path, fs = files._fs(spark, f"{root}/s/load_year=2024/load_month=01/load_day=12/_SUCCESS")
    fs.delete(path, False)
    add("snapshot", spark.read.parquet(files.latest_complete_snapshot(spark, f"{root}/s", 2024, 1)))
    files.write_period(e.select("event_id", "event_type"), f"{root}/p", ["event_type"])
    files.write_period(e.where("event_type = 'click'").select((F.col("event_id") + 1000000).alias("event_id"), "event_type"), f"{root}/p", ["event_type"])
    add("period", spark.read.parquet(f"{root}/p"))
    e.select("event_id").write.parquet(f"{root}/w")
    for name in ("swapped", "swapped again"):
        files.swap_write(spark, spark.read.parquet(f"{root}/w").withColumn("event_id", F.col("event_id") * 2), f"{root}/w")
        # the table is read when the result is; what it is now has to be kept apart
        spark.read.parquet(f"{root}/w").write.parquet(f"{root}/w-{name}".replace(" ", "-"))
        add(name, spark.read.parquet(f"{root}/w-{name}".replace(" ", "-")))
    files.write_routed(e.select("event_id", "event_type"), f"{root}/r", DAY, "event_type", {"far-east": ["view", "error"], "north": ["none"]}, "central")
    routed = spark.read.parquet(f"{root}/r")
    for centre in ("central", "far-east"):
        add(f"routed {centre}", routed.where(F.col("source_id") == centre))
    add("empty centre", spark.read.parquet(f"{root}/r/report_date=2024-01-10/source_id=north"))
    states = files.move_event(spark, f"{root}/w-swapped", f"{root}/m", "central", DAY)["status"], files.move_event(spark, f"{root}/gone", f"{root}/m", "north", DAY)["status"]
    moved = files.read_partitions(spark, f"{root}/m", DAY).where(F.lit(states == ("ok", "missing_source")))
    add("moved", moved.withColumn("event_id", F.col("event_id") / 2))
    add("not moved", moved.where("source_id = 'north'"))
    out.append(spark.createDataFrame([("footers", files.count_rows(spark, f"{root}/w"), None), ("columns", *map(len, files.has_columns(e, ["ts", "value", "nowhere"])))], "what string, n bigint, most bigint"))
    e.select(F.col("event_id").alias("msisdn"), F.lit(1).cast("bigint").alias("imsi"), F.lit("x").alias("more"), F.col("ts").alias("start_time_utc")).write.parquet(f"{root}/g")
    four, none = files.read_geo_all_day(spark, f"{root}/g"), files.read_geo_all_day(spark, f"{root}/nothing")
    add("four columns", four.where(F.lit(four.columns == ["msisdn", "imsi", "imei", "start_time_utc"])).withColumnRenamed("msisdn", "event_id"))
    add("no file", none.withColumnRenamed("msisdn", "event_id"))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


@query("""select lpad(cast(n_nationkey as varchar), 3, '0') code, case when n_nationkey = 3 then 'NA' else n_name end as name, case when n_nationkey % 4 = 0 then null else n_nationkey * 1.5 end size, n_nationkey % 2 = 0 even, case when n_nationkey % 3 = 0 then null else n_nationkey end::int as whole, case when n_nationkey % 5 = 0 then null else date '2024-01-01' + cast(n_nationkey as integer) end as "since" from nation""")
def dimension_from_csv(spark, d):
    """A dimension out of a CSV with a byte-order mark: leading zeros and ``NA`` stay, logical types are cast, what doesn't fit is null."""
    root, k = scratch(spark), F.col("n_nationkey")
    s = lambda c: c.cast("string")
    rows = table(spark, d, "nation").select(F.concat_ws(";", F.lpad(s(k), 3, "0"), F.when(k == 3, "NA").otherwise(F.col("n_name")), F.when(k % 4 == 0, "").otherwise(s(k * 1.5)), F.when(k % 2 == 0, "Yes").otherwise("no"), F.when(k % 3 == 0, "x").otherwise(s(k)), F.when(k % 5 == 0, " ").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd"))).alias("value"), k)
    head = spark.createDataFrame([("﻿c;n;s;e;w;d", -1)], "value string, n_nationkey int")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(root)
    return files.read_dimension_csv(spark, root, {"code": ("c", "string"), "name": ("n", "string"), "size": ("s", "float64"), "even": ("e", "bool"), "whole": ("w", "int32"), "since": ("d", "date")})


@query("""select * from (values ('one', 'ok', true), ('two', 'error', true)) t(command, status, timed)""")
def steps_and_timings(spark, d):
    """Steps run in order until one fails; their timings written as JSON lines, a broken line beside them, and read again."""
    root = scratch(spark)
    r = runner.Runner(spark, root, "r1")

    def fail():
        raise RuntimeError("stop")

    try:
        r.run([("one", lambda: None), ("two", fail), ("three", lambda: None)])
    except RuntimeError:
        pass
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(root)
    t = files.latest_timings(files.read_timings(spark, root))
    share = runner.time_share(files.read_timings(spark, root)).groupBy("run_id").agg(F.sum("share").alias("s"))
    return t.join(share, "run_id").select("command", "status", (F.col("elapsed_total_sec") >= 0).alias("timed"))


@query("""with l as (select n_nationkey k, n_regionkey g, n_nationkey // 5 run from nation)
select 'status' frame, g::varchar a, case when k % 4 = 0 then 'failed' else 'ok' end b, count(*)::double v from l where run = 4 group by 2, 3
union all select 'failure', g::varchar, 'nulls.c' || k, null from l where run = 4 and k % 4 = 0 union all select 'nulls', g::varchar, 'c' || k, k / 100.0 from l where run = 4
union all select 'wide', g::varchar, 'nulls.c' || k, k / 100.0 from l where run = 4 union all select 'share', g::varchar, 'c' || k, round((k / 100.0) / sum(k / 100.0) over (partition by g), 6) from l where run = 4
union all select 'was', g::varchar, 'nulls.c' || k, null from l where run = 4 union all select 'rate', g::varchar, 'nulls.c' || k, k / 100.0 from l where run = 4""")
def dashboard_frames(spark, d):
    """Frames that dashboards show, of the latest run of each log."""
    n = table(spark, d, "nation")
    line = lambda more: F.concat(F.lit("2024 | INFO | "), F.col("n_regionkey").cast("string"), F.lit(' | {"tag":"DQ",'), more, F.lit("}"))
    k = F.col("n_nationkey")
    value = F.format_string("%.2f", k / 100.0)
    check = line(F.concat(F.lit('"check":"nulls.c'), k.cast("string"), F.lit('","status":"'), F.when(k % 4 == 0, "failed").otherwise("ok"), F.lit('","metrics":{"null_rate":"'), value, F.lit('","rate":"'), value, F.lit('"}')))
    starts = line(F.lit('"check":"dataset_basic","status":"ok","metrics":{}'))
    both = n.select(F.floor(k / 5).alias("run"), F.lit(1).alias("o"), k, check.alias("value")).unionByName(n.where("n_nationkey % 5 = 0").select(F.floor(k / 5).alias("run"), F.lit(0).alias("o"), k, starts.alias("value")))
    root = scratch(spark)
    both.coalesce(1).sortWithinPartitions("run", "o", "n_nationkey").select("value").write.text(root)
    log = files.parse_log(files.read_log(spark, root), "DQ")
    last = runner.latest_run(log).where("check_name <> 'dataset_basic'")
    frames = {
        "status": runner.status_counts(last).select(F.col("logger").alias("a"), F.col("status").alias("b"), F.col("n").cast("double").alias("v")), "failure": runner.failures(last).select(F.col("logger").alias("a"), F.col("check_name").alias("b"), F.lit(None).cast("double").alias("v")), "nulls": runner.null_ratios(last).select(F.col("logger").alias("a"), F.col("column_name").alias("b"), F.col("null_rate").alias("v")),
        "wide": runner.wide_metrics(last, ["null_rate"]).select(F.col("logger").alias("a"), F.col("check_name").alias("b"), F.col("null_rate").alias("v")), "share": runner.distribution(last, "nulls.", "null_rate").select(F.col("logger").alias("a"), F.col("value").alias("b"), F.round("share", 6).alias("v")),
        "was": runner.check_history(last).where("was is null").select(F.col("logger").alias("a"), F.col("check_name").alias("b"), F.lit(None).cast("double").alias("v")), "rate": runner.rates(last).select(F.col("logger").alias("a"), F.col("check_name").alias("b"), F.col("rate").alias("v")),
    }
    out = None
    for name, f in frames.items():
        one = f.select(F.lit(name).alias("frame"), "a", "b", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query("select 'month' what, '2024-02-01' a, '2024-02-29' b, 43::bigint n union all select 'previous', '2023-12-01', '2024-12-01', 3")
def days_and_months(spark, d):
    """Bounds of a month, days and months of a window, the month before."""
    from cellframe.plans import persons

    low, high = date(2024, 12, 25), date(2025, 2, 5)
    rows = [("month", *map(str, persons.month_bounds(date(2024, 2, 1))), len(runner.days(low, high))), ("previous", str(runner.previous_month(date(2024, 1, 5))), str(runner.months(low, high)[0]), len(runner.months(low, high)))]
    return spark.createDataFrame(rows, "what string, a string, b string, n bigint")


@query("""select source, check_name, true holds from (values ('cells', 'rows'), ('cells', 'noise'), ('cells', 'contract'), ('people', 'rows'), ('people', 'types'), ('people', 'corporate'), ('people', 'foreign'), ('people', 'versions'), ('people', 'contract'), ('cdr', 'imsi'), ('gprs', 'imsi'), ('sms', 'imsi'), ('location', 'imsi'), ('cdr', 'times'), ('cdr', 'neighbours'), ('location', 'handover'), ('cdr', 'repeatable'), ('regions', 'cells'), ('regions', 'profiles'), ('regions', 'places')) t(source, check_name)""")
def generated_sources(spark, d):
    """What synthetic sources promise: sizes, shares of what is dirty, contracts, movement among neighbouring cells, the same rows at every run."""
    raw, people = generate.cells(spark, 2000, noise=0.2), generate.subscribers(spark, 3000)
    rows = []

    def holds(source: str, name: str, df: DataFrame, condition) -> None:
        rows.append(df.agg(condition.alias("holds")).select(F.lit(source).alias("source"), F.lit(name).alias("check_name"), "holds"))

    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    holds("cells", "rows", raw, F.count("*") == 2000)
    bad = (F.col("mnc") == "-1") | (F.col("lac") == "ERR") | (F.col("coord_x") == "190000") | (F.col("coord_y") == "95") | (F.col("date_off") < F.col("date_on")) | (F.col("azimuth") == "-400")
    holds("cells", "noise", raw, share(bad).between(0.14, 0.26))
    holds("cells", "contract", generate.contract_report(raw, "cells"), F.min("ok"))
    holds("people", "rows", people, F.countDistinct("isdn") >= 2900)
    holds("people", "types", people, share(F.col("identity_type") == 2).between(0.68, 0.80))
    holds("people", "corporate", people, share(F.col("client_type") == 1).between(0.05, 0.11))
    holds("people", "foreign", people, share(F.col("dul_department") == "Uzbek office").between(0.06, 0.14))
    versions = generate.person_versions(people).groupBy("isdn").agg(F.count("*").alias("n"))
    holds("people", "versions", versions, share(F.col("n") > 1).between(0.02, 0.10))
    holds("people", "contract", generate.contract_report(people, "people"), F.min("ok"))
    few = people.where("isdn < '79010001500'")
    for kind, present in generate._PRESENT.items():
        m = generate.mart(spark, few, raw, kind, DAY)
        holds(kind, "imsi", m, share(F.col("IMSI").isNotNull()).between(present - 0.1, present + 0.1))
        if kind == "cdr":
            holds("cdr", "times", m, share(F.col("Started").rlike("^20240110[0-9]{6}$")) > 0.97)
    j = generate.journeys(few, raw, DAY)
    holds("cdr", "neighbours", j, F.max(F.abs(F.col("step"))) <= 3)
    hand = generate.handovers(j)
    holds("location", "handover", hand, (F.count("*") > 0) & F.min(F.col("reason").isin("handover", "periodic")))
    one, two = (generate.mart(spark, few.repartition(n), raw, "cdr", DAY) for n in (2, 5))
    holds("cdr", "repeatable", one.exceptAll(two), F.count("*") == 0)
    wide = generate.region_cells(spark, {"City": (600, "metropolis", 65.0, 57.0, 1.0), "Far": (400, "wilds", 129.0, 62.0, 8.0)}, noise=0.0)
    holds("regions", "cells", wide, (F.countDistinct("cell") == 1000) & (F.count("*") == 1000))
    per = wide.groupBy("subject").agg(share(F.col("bs_type") == "outdoor").alias("o"), share(F.col("generation") == "2G").alias("g"))
    holds("regions", "profiles", per, F.min(F.when(F.col("subject") == "City", F.col("o").between(0.42, 0.62) & F.col("g").between(0.06, 0.20)).otherwise((F.col("o") > 0.9) & F.col("g").between(0.35, 0.55))))
    place = F.when(F.col("subject") == "City", F.abs(F.col("coord_x").cast("double") - 65) <= 0.5).otherwise(F.abs(F.col("coord_x").cast("double") - 129) <= 4)
    holds("regions", "places", wide, F.min(place))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("select column_name, cast(kind as varchar) kind, nulls from (values ('x', 'bigint', true), ('location', 'struct<mcc:string,mnc:string,lac:bigint,cell:bigint>', true)) t(column_name, kind, nulls) union all select 'rows', '0', true")
def contracts(spark, d):
    """Contract columns in their order and types, missing ones null where that is asked for; an empty table of a contract."""
    s = T.StructType([T.StructField("x", T.LongType()), schemas.EVENT["location"]])
    df = schemas.contract(table(spark, d, "nation").select(F.lit("7").alias("x"), "n_name"), s, fill_missing=True)
    rows = [(f.name, f.dataType.simpleString(), f.nullable or f.name == "x") for f in df.schema] + [("rows", str(schemas.empty(spark, s).count()), True)]
    return spark.createDataFrame(rows, "column_name string, kind string, nulls boolean")
