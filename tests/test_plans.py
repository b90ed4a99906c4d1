from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.dq import core, suites
from cellframe.plans import bindings, cells, dims, events, persons, runner
from cellframe.sources import files
from cellframe.streaming import streams
from cellframe.synth import generate

DAY = date(2024, 1, 10)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Each table is written and read again before the next is built from it, as the plans are run."""
    root = tmp_path_factory.mktemp("world")

    def stored(df, name):
        df.coalesce(2).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    raw, people = stored(generate.cells(spark, 300, noise=0.2), "raw"), stored(generate.subscribers(spark, 200), "people")
    marts = {k: stored(generate.mart(spark, people, raw, k, DAY), k) for k in events.CODES}
    clean, errors = cells.prepare(raw)
    zones = spark.createDataFrame([(1, "z", 3, "POLYGON((30 50,45 50,45 60,30 60,30 50))")], "code int, name string, timezone int, geometry string")
    bs = stored(cells.merge_snapshot(schemas.empty(spark, schemas.BS), cells.build_snapshot(clean, zones), F.lit("2024-01-01").cast("timestamp_ntz")), "bs")
    ev = stored(events.build_events(marts, DAY), "events")
    geo = stored(events.build_geo_all(ev, bs, DAY), "geo")
    imei, imsi = (stored(bindings.upsert_day(None, geo, k, DAY), f"b_{k}") for k in ("imei", "imsi"))
    return {"raw": raw, "people": people, "marts": marts, "errors": errors, "zones": zones, "bs": bs, "events": ev, "geo": geo, "imei": imei, "imsi": imsi, "stored": stored}


def statuses(df):
    return {r.check_name: r.status for r in df.collect()}


def test_events(world):
    ev = world["events"]
    assert ev.schema == schemas.EVENT or [f.name for f in ev.schema] == schemas.EVENT.fieldNames()
    rows = sum(events.normalise_mart(m, k, DAY).count() for k, m in world["marts"].items())
    assert ev.agg(F.sum("event_count")).first()[0] == rows
    assert ev.where("imsi is null and event_count > 1").count() == 0
    s = statuses(suites.dds_event(ev))
    assert s["event_count_positive"] == "ok" and s["stg_contract.alignment"] == "ok" and s["timestamp_parseable"] == "ok"


def test_location_rules(spark):
    row = ("20240110000100", " 250011234567890", None, "79990000000", "250-01", 7, 8)
    df = spark.createDataFrame([row, (*row[:4], " ", 7, 8), ("bad", *row[1:]), ("20240111000100", *row[1:])], "Started string, IMSI string, IMEI string, CallingNumber string, OwnerMCCMNC string, BSStartLac int, BSStartCell bigint")
    got = events.build_events({"cdr": df}, DAY).orderBy(F.col("location.mcc").asc_nulls_first()).collect()
    assert [(r.location.mcc, r.location.mnc, r.event_count) for r in got] == [(None, None, 1), ("250", "01", 1)]
    m = events.transform_metrics(events.build_events({"cdr": df}, DAY)).first()
    assert (m.rows, m.no_mcc, m.bad_imei) == (2, 1, 2)


def test_geo_all(world):
    geo = world["geo"]
    assert geo.count() > 500 and geo.where("end_time_utc is not null").count() == 0
    s = statuses(suites.stg_geo_all(geo))
    assert "failed" not in s.values()
    # local midnight of the zone three hours ahead belongs to the day before in UTC
    assert geo.where(F.to_date("start_time_utc") != F.lit(DAY)).count() == 0 and geo.select("utc_offset").distinct().count() == 1


def test_cells(world):
    assert {r.reason for r in world["errors"].select("reason").distinct().collect()} >= {"non_numeric", "invalid_lon", "invalid_lat", "negative_mnc", "date_off_before_date_on"}
    s = statuses(suites.fct_bs(world["bs"]))
    assert all(v != "failed" for v in s.values()) and s["sector_wkt"] == "ok" and s["mapinfo_wkt"] == "ok"
    assert world["bs"].where("lat is not null and lon is not null and (mapinfo_wkt is null or sector_wkt is null)").count() == 0
    assert statuses(suites.src_bs(world["raw"]))["contract.date_off_present"] == "ok"


def test_bindings(world):
    for k, suite in (("imei", suites.fct_msisdn_imei), ("imsi", suites.fct_msisdn_imsi)):
        s = statuses(suite(world[k]))
        assert "failed" not in s.values(), s
        again = bindings.upsert_day(world[k], world["geo"], k, DAY)
        assert sorted(map(str, again.collect())) == sorted(map(str, world[k].collect()))
        assert sorted(map(str, bindings.month_in_one_pass(world["geo"], k).collect())) == sorted(map(str, world[k].collect()))
    assert world["imsi"].where("operator_id is null").count() > 0


def test_stays(world, spark):
    out = events.build_geo_intervals(world["geo"], world["imsi"], world["imei"], world["bs"], world["zones"], DAY)
    out = world["stored"](out, "stays")
    assert out.count() > 0 and out.where("imsi is null or imei is null").count() == 0
    s = statuses(suites.fct_geo_intervals(out))
    assert "failed" not in s.values() and s["timezone"] == "ok"
    plain = events.build_geo_intervals(world["geo"], world["imsi"], world["imei"], None, None, DAY)
    assert plain.count() > 0 and plain.where("timezone is not null").count() == 0


def test_stay_of_one_bucket(spark):
    t = lambda m: datetime(2024, 1, 10, 12, m)
    base = (79990000000, 250010000000001, 350000000000001)
    rows = [(*base, t(1), None, 3, 55.0, 37.0, "o", 1, 2, "cdr", "01", None), (*base, t(2), None, 3, 55.001, 37.002, "o", 2, 1, "sms", "02", None), (*base, t(2), None, 3, 55.001, 37.002, "o", 2, 1, "cdr", "02", None), (*base, t(7), None, 3, 55.0, 37.0, "i", 3, 5, "cdr", "03", "x"), (*base, t(8), None, 3, 55.5, 37.5, "o", 4, 5, "cdr", "04", None)]
    out = events.build_geo_intervals(spark.createDataFrame(rows, schemas.GEO_EVENT), *(schemas.empty(spark, x) for x in (schemas.MSISDN_IMSI, schemas.MSISDN_IMEI)), None, None, DAY).orderBy("start_time_utc").collect()
    assert [(r.start_time_utc, r.end_time_utc, r.cgi_list, r.bs_type) for r in out] == [(t(0), t(5), ["1", "2"], "o"), (t(7), t(7), ["3"], "i")]
    assert out[0].sub_lat == pytest.approx((55.0 * 2 + 55.001 * 2) / 4) and out[0].oktmo_code_1 == "02"


def test_persons(world, spark):
    month = date(2024, 1, 1)
    out = persons.build_persons(world["people"], month, world["imsi"], world["imei"], codes={"RU": "643", "UZ": "860"})
    out = world["stored"](out, "persons")
    s = statuses(suites.fct_person(out, spark.createDataFrame([("643",), ("860",)], "numeric_code string")))
    assert "failed" not in s.values(), s
    again = persons.build_persons(world["people"], month, world["imsi"], world["imei"], previous=out.withColumn("person_id", F.concat(F.lit("prs_"), F.substring(F.sha2("person_id", 256), 1, 24))))
    kept = out.select("person_cluster_key", F.col("person_id").alias("a")).join(again.select("person_cluster_key", F.col("person_id").alias("b")), "person_cluster_key")
    assert kept.where("a = b").count() == 0 and kept.count() == out.count()
    drop = out.limit(5).select(F.col("msisdn").alias("value"))
    fewer = persons.build_persons(world["people"], month, world["imsi"], world["imei"], exclusions={"msisdn": drop})
    assert fewer.join(drop, fewer.msisdn == drop.value).count() == 0 and fewer.count() < out.count()
    with pytest.raises(ValueError):
        persons.month_bounds(date(2024, 1, 2))
    assert persons.month_bounds(date(2024, 12, 1))[1] == date(2024, 12, 31)


def test_shared_device_joins_people(spark):
    row = lambda isdn, imsi, imei, last: (0, 1, isdn, imsi, imei, None, datetime(2023, 1, 1), None, date(1990, 1, 1), last, "Иван", None, None, None)
    schema = "client_type int, operator_Id bigint, isdn string, imsi string, imei string, iccid string, actually_from timestamp_ntz, actually_to timestamp_ntz, birth_day date, last_name string, first_name string, second_name string, dul_department string, document string"
    raw = spark.createDataFrame([row("79990000001", "250010000000001", "35000000000001", "а"), row("79990000002", "250010000000002", "35000000000001", "б"), row("79990000003", "250010000000003", "35000000000003", "в"), row("79990000004", "250010000000004", "35000000000004", "в")], schema)
    none = [schemas.empty(spark, x) for x in (schemas.MSISDN_IMSI, schemas.MSISDN_IMEI)]
    out = persons.build_persons(raw, date(2024, 1, 1), *none).collect()
    assert sorted((r.person_confidence, r.sim_count) for r in out) == [("high", 2), ("high", 2)]


def test_person_of_many_subscriptions_is_grouped_in_parts(spark):
    i = F.col("id").cast("string")
    many = spark.range(4000).select(
        F.lit(0).alias("client_type"), F.lit(1).alias("operator_Id"), F.concat(F.lit("7999"), F.lpad(i, 7, "0")).alias("isdn"), F.concat(F.lit("25001"), F.lpad((F.col("id") % 3999).cast("string"), 10, "0")).alias("imsi"), F.lit("35000000000001").alias("imei"), F.lit(None).cast("string").alias("iccid"),
        (F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % 10).cast("int"))).alias("actually_from"), F.lit(None).cast("timestamp_ntz").alias("actually_to"), F.lit(None).cast("date").alias("birth_day"), *[F.lit(None).cast("string").alias(c) for c in "last_name first_name second_name dul_department document".split()],
    )
    out = persons.build_persons(many, date(2024, 1, 1), *[schemas.empty(spark, x) for x in (schemas.MSISDN_IMSI, schemas.MSISDN_IMEI)])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.sim_count, r.msisdn, r.actually_from) for r in out.collect()] == [(3999, "79990000009", datetime(2023, 1, 10))]


def test_dimensions(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("﻿code;a2;a3;short;full;key\n4;AF;AFG;Афганистан;Исламский;1\n516;NA;NAM;Намибия;Республика;2\n643;RU;RUS;Россия;РФ;3\n", encoding="utf-8")
    raw = files.read_dimension_csv(spark, str(p), {"numeric_code": ("code", "string"), "alpha2": ("a2", "string"), "alpha3": ("a3", "string"), "name_short": ("short", "string"), "name_full": ("full", "string"), "autokey": ("key", "string")})
    oksm = dims.build_oksm(raw)
    assert {r.alpha2 for r in oksm.collect()} == {"AF", "NA", "RU"} and oksm.where("numeric_code = '004'").count() == 1
    assert set(statuses(suites.dim_oksm(oksm)).values()) <= {"ok", "info"}
    codes, names = dims.country_lookup(oksm)
    assert codes["NA"] == "516" and ("намибия", "516") in names
    with pytest.raises(ValueError):
        files.read_dimension_csv(spark, str(p), {"x": ("nope", "string")})
    tac = spark.createDataFrame([("1234567", "Acme", "Modem", "05.03.2021"), ("00000008", "", "Phone", None)], "tac string, manufacturer string, equipment_type string, allocation_date string")
    t = dims.build_tac(tac)
    assert {(r.tac, r.is_m2m, r.allocation_date) for r in t.collect()} == {("01234567", True, "2021-03-05"), ("00000008", False, None)}
    assert statuses(suites.dim_tac(t))["manufacturer_empty"] == "warning"
    with pytest.raises(dims.DimensionError):
        dims.build_tac(tac.union(tac))
    o = spark.createDataFrame([("POLYGON((0 0,1 0,1 1,0 0))", 1, None, "01", "A"), ("POLYGON((0 0,1 0,1 1,0 0))", 2, "09", "0101", "-")], schemas.DIM_OKTMO)
    s = statuses(suites.dim_oktmo(o))
    assert s["hierarchy.orphans"] == s["hierarchy.childless"] == s["name_empty"] == "warning" and s["geometry"] == "ok"
    assert statuses(suites.dim_time_zones(spark.createDataFrame([(1, "a", 20, None)], schemas.DIM_TIME_ZONES)))["timezone_range"] == "warning"


def test_source_suites(world, spark):
    s = statuses(suites.src_marts(world["marts"]))
    assert s["cdr.stg_contract.msisdn"] == "ok" and "mix" in s
    assert statuses(suites.src_person(world["people"], F.lit(date(2024, 1, 1))))["isdn_format"] == "ok"
    e = statuses(suites.src_exclusions({"imsi": spark.createDataFrame([("1",)], "value string"), "imei": None}, spark))
    assert e["imei.presence"] == "failed" and e["imsi.totals"] == "info"
    assert statuses(suites.absent(spark)) == {"presence": "failed"}
    assert suites.overall(suites.absent(spark)).first().status == "failed" and suites.overall(suites.absent(spark), always_ok=True).first().status == "ok"
    g = core.rate_gates(spark.createDataFrame([], "x int"), [core.Gate("a", F.col("x") > 0, 0.9, 0.99)]).first()
    assert (g.status, g.rate) == ("ok", 1.0)


def test_layouts_and_snapshots(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a")], "x int, s string")
    for sub in ("m/2024/01/09", "m/2024/01/13", "m/other", "m/load_year=2024/load_month=01/load_day=10"):
        one.write.parquet(f"{root}/{sub}")
    (tmp_path / "m" / "2024" / "01" / "09" / "broken.parquet").write_bytes(b"not parquet")
    got = files.read_day(spark, f"{root}/m", DAY, spark.createDataFrame([], "x bigint, gone string").schema)
    assert got.count() == 3 and got.columns == ["x", "gone"] and got.where("gone is not null").count() == 0
    assert files.read_day(spark, f"{root}/nowhere", DAY, one.schema).count() == 0
    assert files.latest_complete_snapshot(spark, f"{root}/m", 2024, 1).endswith("load_day=10")
    with pytest.raises(FileNotFoundError):
        files.latest_complete_snapshot(spark, f"{root}/m", 2024, 2)
    days = spark.createDataFrame([("a/2024/01/09/x",), ("b-2024-01-10.parquet",), ("c/load_year=2024/load_month=1/load_day=5/p",), ("none",)], "p string").select(files.day_of_path(F.col("p")).cast("string").alias("d"))
    assert [r.d for r in days.collect()] == ["2024-01-09", "2024-01-10", "2024-01-05", None]
    t = f"{root}/t"
    files.write_period(one.withColumn("d", F.lit("a")), t, ["d"])
    files.write_period(one.withColumn("d", F.lit("b")), t, ["d"])
    files.write_period(one.withColumn("x", F.lit(7)).withColumn("d", F.lit("b")), t, ["d"])
    assert sorted((r.d, r.x) for r in spark.read.parquet(t).collect()) == [("a", 1), ("b", 7)]
    files.swap_write(spark, spark.read.parquet(t).withColumn("x", F.col("x") + 1), t)
    assert sorted(r.x for r in spark.read.parquet(t).collect()) == [2, 8] and files.count_rows(spark, t) == 2
    assert files.move_event(spark, f"{root}/absent", t, "central", DAY)["status"] == "missing_source"
    assert files.move_event(spark, f"{root}/m/other", f"{root}/dds", "central", DAY)["status"] == "ok"
    assert files.read_partitions(spark, f"{root}/dds", DAY).count() == 1
    routed = files.route_by_region(spark.createDataFrame([("k",), ("x",)], "r string"), "r", {"far-east": ["k"]}, "central")
    assert [r.source_id for r in routed.collect()] == ["far-east", "central"]


def test_runner_and_logs(spark, tmp_path):
    path = str(tmp_path / "timing")
    r = runner.Runner(spark, path, "r1")
    with pytest.raises(RuntimeError):
        r.run([("one", lambda: None), ("two", lambda: (_ for _ in ()).throw(RuntimeError("x"))), ("three", lambda: None)])
    (tmp_path / "timing" / "zz.txt").write_text("{broken\n")
    t = files.read_timings(spark, path)
    assert sorted((x.command, x.status) for x in t.collect()) == [("one", "ok"), ("two", "error")] and files.latest_timings(t).count() == 2
    j = lambda check, more="": f'2024 | INFO | dq | {{"tag":"DQ","check":"{check}","status":"ok"{more}}}'
    lines = [j("early"), j("dataset_basic"), j("a", ',"metrics":{"n":"1"}'), '2024 | INFO | dq | {"tag":"OTHER","check":"dataset_basic"}', j("summary"), j("dataset_basic"), j("time_order"), '2024 | INFO | dq | {"tag":"DQ","check":"nulls.x","status":"warning","metrics":{"null_rate":"0.5"}}', "free text", j("summary")]
    (tmp_path / "dq.log").write_text("\n".join(lines) + "\n")
    log = files.parse_log(files.read_log(spark, str(tmp_path / "dq.log")), "DQ")
    # all lines have one time: their order is that of the file, and a boundary begins its run
    assert {(x.line, x.run) for x in runner.number_runs(log).collect()} == {(1, 0), (2, 1), (3, 1), (5, 1), (6, 2), (7, 2), (8, 2), (10, 2)}
    assert {x.run for x in runner.number_runs(log, ("dataset_basic", "summary")).where("line = 10").collect()} == {4}
    last = runner.latest_run(log)
    assert {x.check_name for x in last.collect()} == {"dataset_basic", "time_order", "nulls.x", "summary"} and runner.failures(last).count() == 1 and runner.null_ratios(last).first().null_rate == 0.5
    assert {(x.check_name, x.run): x.was for x in runner.check_history(runner.number_runs(log)).collect()}["dataset_basic", 2] == "ok"
    assert {x.check_name: x.n for x in runner.wide_metrics(log, ["n"]).collect()}["a"] == 1.0 and runner.status_counts(log).count() == 2
    assert len(runner.days(date(2024, 12, 25), date(2025, 2, 5))) == 43 and runner.months(date(2024, 12, 25), date(2025, 2, 5))[0] == date(2024, 12, 1) and runner.previous_month(date(2024, 1, 5)) == date(2023, 12, 1)


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 12, 0, 10), "a", 1), (datetime(2024, 1, 1, 12, 4), "a", 1), (datetime(2024, 1, 1, 12, 6), "b", 2), (datetime(2024, 1, 1, 23, 0), "a", 1), (datetime(2024, 1, 1, 23, 20), "a", 1), (datetime(2024, 1, 9), "z", 9)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id int")
    df.write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def finished(out, name):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    counts = {(r.event_type, r.n) for r in finished(streams.tumbling_counts(stream()), "tumbling")}
    assert {("a", 2), ("b", 1)} <= counts
    sessions = sorted((r.user_id, r.n) for r in finished(streams.stay_sessions(stream()), "sessions"))
    assert sessions == [(1, 2), (1, 2), (2, 1)]
    table, seen = str(tmp_path / "t"), []

    def merge(old, new):
        return new.select("user_id").distinct() if old is None else old.union(new.select("user_id")).distinct()

    def read():
        return spark.read.parquet(table) if seen else None

    def write(d):
        files.swap_write(spark, d, table)
        seen.append(1)

    f = streams.upsert_each_batch(merge, read, write)
    for _ in range(2):
        q = stream().writeStream.foreachBatch(f).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert sorted(r.user_id for r in spark.read.parquet(table).collect()) == [1, 2, 9]


def test_commands_of_a_day_and_a_month(spark, tmp_path):
    """All commands in order over generated sources, twice: a repeated day changes nothing."""
    from cellframe.plans.jobs import Jobs

    root = str(tmp_path)
    (tmp_path / "src" / "dim").mkdir(parents=True)
    write = lambda name, text: (tmp_path / "src" / "dim" / f"{name}.csv").write_text(text, encoding="utf-8")
    write("oktmo", 'WKT;level;parent_code;code;name\n"POLYGON((30 50,45 50,45 60,30 60,30 50))";2;01;0101;Town\n"POLYGON((30 50,45 50,45 60,30 60,30 50))";1;;01;Region\n')
    write("time-zones", 'code;name;timezone;geometry\n1;Region;3;"POLYGON((30 50,45 50,45 60,30 60,30 50))"\n')
    write("tac", ";".join(f for f in schemas.DIM_TAC.fieldNames() if f != "is_m2m") + "\n35000001;Acme;M;M;Modem;LTE;x;05.03.2021;b;c;d\n")
    write("oksm", "numeric_code;name_short;name_full;alpha2;alpha3;autokey\n643;Russia;Russian Federation;RU;RUS;1\n860;Uzbekistan;Republic;UZ;UZB;2\n")
    jobs = Jobs(spark, root)
    timings = jobs.run([*jobs.src(DAY, people=60, n_cells=40), *jobs.stage_1(DAY), *jobs.stage_2(DAY), *jobs.person(DAY.replace(day=1))])
    assert len(timings) == 4 + 3 + 16 + 8 and {t["status"] for t in timings} == {"ok"} and set(jobs.commands(DAY)) == {t["command"] for t in timings}
    tables = [jobs.path("fct/bs"), jobs.path("stg/geo_all", DAY), jobs.path("fct/msisdn_imsi", DAY), jobs.path("fct/geo_intervals", DAY), jobs.path("fct/person", DAY)]
    before = [sorted(map(str, spark.read.parquet(t).collect())) for t in tables]
    assert all(before)
    checks = spark.read.parquet(f"{root}/qa/checks")
    assert {r.suite.split(".")[0] for r in checks.select("suite").distinct().collect()} == {t["command"] for t in timings if t["command"].startswith("dq-")}
    shown = jobs.dashboard("dq-stg-geo-all")
    assert shown["failures"].where("status = 'failed'").count() == 0 and shown["status"].count() > 0 and shown["rates"].count() == 0 and jobs.dashboard("dq-fct-person")["rates"].count() > 0
    seen = jobs.table_profile(tables[1], ["lat", "lon"], ["source_event_type"])
    assert seen["numbers"].count() == 2 and seen["source_event_type"].count() > 1
    steps = dict(jobs.stage_2(DAY))
    for name in ("build-stg-geo-all", "build-fct-msisdn-imsi-operator", "build-fct-geo-intervals"):
        steps[name]()
    assert [sorted(map(str, spark.read.parquet(t).collect())) for t in tables] == before
    with pytest.raises(Exception, match="src/marts|no complete snapshot|PATH_NOT_FOUND|doesn't|not"):
        jobs.run(jobs.person(date(2023, 1, 1)))


def test_generated_rows_of_marts(spark):
    people, raw = generate.subscribers(spark, 80), generate.cells(spark, 50)
    points = generate.parties(generate.journeys(people, raw, DAY))
    assert points.where("Owner = 2").count() > 0 and points.where("Owner = 2 and imsi is not null").count() == 0
    at = raw.where("mnc >= 0 and lac <> 'ERR'").select(F.col("cell").cast("bigint").alias("cell"), "mcc", "mnc", "lac", F.lit(3).alias("utc_offset"))
    marts = {k: generate.row_of_mart(points, k, at) for k in events.CODES}
    ev = events.build_events(marts, DAY)
    assert ev.count() > 0 and {r.event_name for r in ev.select("event_name").distinct().collect()} == set(events.CODES)
    noisy = generate.cross_mart_noise(marts, share=0.2)
    assert all(noisy[k].columns == marts[k].columns and noisy[k].count() > marts[k].count() for k in marts)
    assert generate.local_time(spark.createDataFrame([(datetime(2024, 1, 9, 23, 0), 2)], "t timestamp_ntz, o int"), "t", "o").first().Started == "20240110010000"
    s = {r.level for r in generate.states(people, 50, DAY).select("level").distinct().collect()}
    assert s == {"light", "normal", "heavy"}
    v = generate.person_versions(people, share=0.5)
    assert v.count() > people.count() and v.where("actually_to < actually_from").count() == 0
