"""Queries over the table builders themselves, each from derived input to its whole output, against SQL that builds the same table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cellframe.functions import scalar as S
from cellframe.operators import geo, joins, profile
from cellframe.plans import bindings, cells, dims, events, persons
from cellframe.plans.catalogue import query, table
from cellframe.plans.catalogue_checks import derived, plain

DAY = date(2024, 1, 10)

# geo events of a day

_CELLS = """select cast(250 as smallint) as mcc, cast(1 as smallint) as mnc, 1 as lac, cast(n_nationkey % 20 as bigint) as cell_id, cast(55 + (n_nationkey * 7 % 13) / 10.0 as double) as lat, cast(37 + (n_nationkey * 5 % 11) / 10.0 as double) as lon, case when n_nationkey % 3 = 0 then 'i' when n_nationkey % 3 = 1 then 'o' end as bs_type,
 case when n_nationkey % 4 = 0 then null else cast(n_nationkey as string) end as oktmo_code_1, cast(n_nationkey * 2 as string) as oktmo_code_2, n_nationkey % 3 as timezone, case when n_nationkey < 20 then <a> else <b> end as date_on, case when n_nationkey < 5 then <b> when n_nationkey = 7 then <a> when n_nationkey = 9 then null else <z> end as date_off from {nation}"""


def _times(sql: str, kind: str) -> str:
    for mark, text in (("<a>", "2024-01-05 00:00:00"), ("<b>", "2024-01-10 12:00:00"), ("<z>", "2100-01-01 00:00:00")):
        sql = sql.replace(mark, f"cast('{text}' as {kind})")
    return sql


_NAMES = "case event_type when 'click' then ' CDR' when 'view' then 'gprs' when 'purchase' then 'sms' when 'error' then 'fax' else 'location' end"


@query(f"""with bs as ({plain(_times(_CELLS, "timestamp"))}), v as (select 2500100001000000 + cell_id cgi, lat, lon, coalesce(bs_type, 'o') bs_type, oktmo_code_1, oktmo_code_2, timezone utc_offset, date_on, date_off from bs),
pt as (select cgi cell, median(lat) lat, median(lon) lon from v group by 1),
e as (select 79160000000 + user_id msisdn, 250010000000000 + user_id imsi, 300000000000000 + event_id imei, lower(trim({_NAMES})) kind, date_trunc('second', ts) t, case when event_id % 6 = 0 then null else 2500100001000000 + event_id % 23 end cgi from events where event_type <> 'error'),
k as (select *, cgi in (select cell from pt) and cgi is not null known, row_number() over (partition by msisdn order by t, kind, imsi, imei) pos from e),
a as (select *, last_value(case when known then pos end ignore nulls) over (partition by msisdn order by pos rows between unbounded preceding and 1 preceding) bp, last_value(case when known then cgi end ignore nulls) over (partition by msisdn order by pos rows between unbounded preceding and 1 preceding) bc,
 first_value(case when known then pos end ignore nulls) over (partition by msisdn order by pos rows between 1 following and unbounded following) ap, first_value(case when known then cgi end ignore nulls) over (partition by msisdn order by pos rows between 1 following and unbounded following) ac from k),
q as (select distinct bc, ac, (pos - bp)::double / (ap - bp) f from a where not known and bp is not null and ap is not null and bc <> ac),
s as (select q.*, p.cell, x.lat lat0, x.lon lon0, y.lat - x.lat dlat, y.lon - x.lon dlon, p.lat, p.lon from q join pt x on x.cell = bc join pt y on y.cell = ac cross join pt p),
r as (select *, case when dlat * dlat + dlon * dlon > 0 then ((lat - lat0) * dlat + (lon - lon0) * dlon) / (dlat * dlat + dlon * dlon) else 0.5 end pr from s),
c as (select bc, ac, f, arg_min(cell, row(case when pr between -0.2 and 1.2 then 0 else 1 end, (lat - (lat0 + dlat * f)) * (lat - (lat0 + dlat * f)) + (lon - (lon0 + dlon * f)) * (lon - (lon0 + dlon * f)) + abs(pr - f) * 0.01, cell)) chosen from r group by all),
i as (select a.* exclude (cgi), case when known or bp is null or ap is null then cgi when a.bc = a.ac then a.bc else chosen end cgi from a left join c on a.bc = c.bc and a.ac = c.ac and (pos - bp)::double / (ap - bp) = c.f and not known),
j as (select i.msisdn, i.imsi, i.imei, i.kind, i.t, v.*, row_number() over (partition by i.imei order by case when date_on <= t and (date_off is null or t <= date_off) then 0 else 1 end, case when date_on <= t and (date_off is null or t <= date_off) then 0 else abs(epoch_us(t) - epoch_us(date_on)) end, date_on desc, lat, lon) n from i join v using (cgi)),
u as (select *, t - to_hours(cast(utc_offset as integer)) utc from j where n = 1), d as (select *, time_bucket(interval '5 minutes', utc) b from u where utc >= timestamp '2024-01-10' and utc < timestamp '2024-01-11'),
m as (select *, case when lag(kind) over w is not distinct from kind and lag(cgi) over w is not distinct from cgi and lag(b) over w is not distinct from b and lag(imei) over w is not null then 0 else 1 end new from d window w as (partition by msisdn order by utc, kind, cgi, imsi, imei)), g as (select *, sum(new) over (partition by msisdn order by utc, kind, cgi, imsi, imei rows unbounded preceding) island from m)
select msisdn, min(utc) start_time_utc, kind source_event_type, cgi, count(*) event_count, arg_min(imei, row(utc, kind, cgi, imsi, imei)) imei, any_value(utc_offset) utc_offset, round(any_value(lat), 5) lat, round(any_value(lon), 5) lon, any_value(bs_type) bs_type, coalesce(any_value(oktmo_code_1), 'unknown') oktmo_code_1, any_value(oktmo_code_2) oktmo_code_2 from g group by msisdn, island, kind, cgi""")
def geo_events_of_a_day(spark, d):
    """Events of three local days to geo events of one UTC day: cells imputed, versions joined, places validated, runs collapsed."""
    raw = derived(spark, d, f"""select date_format(ts, 'yyyyMMddHHmmss') as event_timestamp, concat('25001', lpad(cast(user_id as string), 10, '0')) as imsi, concat('3', lpad(cast(event_id as string), 14, '0')) as imei, concat('7916', lpad(cast(user_id as string), 7, '0')) as msisdn,
     if(event_id % 6 = 0, null, named_struct('mcc', '250', 'mnc', '01', 'lac', 1L, 'cell', event_id % 23)) as location, cast(null as bigint) as event, {_NAMES} as event_name, 3L as event_count from {{events}}""")
    out = events.build_geo_all(raw, derived(spark, d, _times(_CELLS, "timestamp_ntz")), DAY)
    return out.select("msisdn", "start_time_utc", "source_event_type", "cgi", F.col("event_count").cast("long").alias("event_count"), "imei", "utc_offset", "lat", "lon", "bs_type", "oktmo_code_1", "oktmo_code_2")


_HAVERSINE = "2 * 6371000.0 * asin(least(1, sqrt(greatest(0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))))"
_WHO = "msisdn, imsi, imei"


@query(f"""with e as (select 79160000000 + user_id % 12 msisdn, 1 + user_id % 12 imsi, case when user_id % 12 = 5 then null else 7 end imei, timestamp '2024-01-10 21:30:00' + to_seconds(cast(event_id * 13 % 14400 as integer)) t, case when event_id % 9 = 0 then timestamp '2024-01-10 21:30:00' + to_seconds(cast(event_id * 13 % 14400 + 30 as integer)) end te, event_id % 14 cgi,
 55 + (event_id % 14 * 7 % 5) / 100.0 + case when event_id % 14 = 13 then 0.2 else 0 end lat, 37 + (event_id % 14 * 3 % 7) / 100.0 lon, case when event_id % 14 = 4 then 'Indoor' when event_id % 14 = 9 then 'm' else 'O' end bs, event_id % 3 n, case when event_id % 5 = 0 then null else cast(event_id % 4 as varchar) end c1, cast(event_id % 2 as varchar) c2 from events where event_id % 21 <> 0),
b as (select {_WHO}, time_bucket(interval '5 minutes', t) b, t, coalesce(te, t) te, cgi, lat::double lat, lon::double lon, substr(lower(bs), 1, 1) bs, greatest(n, 1) n, coalesce(c1, '') c1, c2 from e),
p as (select {_WHO}, b, t, te, cgi, lat, lon, bs, sum(n) n, arg_max(row(c1, c2), row(n, c1, c2)) c from b group by {_WHO}, b, t, te, cgi, lat, lon, bs),
a as (select *, max(case when bs <> 'o' then 1 else 0 end) over (partition by {_WHO}, b) inside from p), w as (select {_WHO}, case when bs = 'o' then b else t end s, case when bs = 'o' then b + interval '5 minutes' else te end f, cgi, lat, lon, bs, n, c[1] c1, c[2] c2, row_number() over () id from a where inside = 0 or bs <> 'o'),
o as (select x.id, any_value(x.imsi) imsi, any_value(x.imei) imei, any_value(x.msisdn) msisdn, any_value(x.s) s, any_value(x.f) f, round(avg(case when x.lat <> y.lat and x.lon <> y.lon then {_HAVERSINE} end), 6) m from w x join w y on x.msisdn = y.msisdn and x.imsi = y.imsi and x.imei is not distinct from y.imei and x.s = y.s and x.f = y.f and x.bs = 'o' and y.bs = 'o' group by x.id),
k as (select *, (select count(distinct m) from o z where z.msisdn = o.msisdn and z.imsi = o.imsi and z.imei is not distinct from o.imei and z.s = o.s and z.f = o.f) kinds from o), z as (select distinct w.* exclude (id) from w left join k using (id) where w.bs <> 'o' or coalesce(k.m, 0) < case when k.kinds = 1 then 40000000 else 3500 end),
h as (select {_WHO}, s, f, bs, c1, c2, sum(n) n from z group by all), mode as (select {_WHO}, s, f, bs, arg_max(row(c1, c2), row(n, c1, c2)) c from h group by {_WHO}, s, f, bs), g as (select {_WHO}, s, f, bs, sum(lat * n) / sum(n) lat, sum(lon * n) / sum(n) lon, list_sort(list(distinct cast(cgi as varchar))) cells from z group by {_WHO}, s, f, bs),
r as (select g.*, mode.c from g join mode on g.msisdn = mode.msisdn and g.imsi = mode.imsi and g.imei = mode.imei and g.s = mode.s and g.f = mode.f and g.bs = mode.bs),
l as (select *, case when lag(cells) over q is not distinct from cells and lag(bs) over q is not distinct from bs and abs(lat - lag(lat) over q) <= 1e-6 and abs(lon - lag(lon) over q) <= 1e-6 and epoch_us(s) - epoch_us(lag(f) over q) <= 1000000::bigint * case when hour(s) <= 5 or hour(s) = 23 then 1800 else 300 end then 0 else 1 end new from r window q as (partition by {_WHO} order by s, f)),
i as (select *, sum(new) over (partition by {_WHO} order by s, f rows unbounded preceding) part from l)
select msisdn, imsi, imei, min(s) start_time_utc, max(f) end_time_utc, array_to_string(arg_min(cells, row(s, f)), ',') cells, round(arg_min(lat, row(s, f)), 6) sub_lat, round(arg_min(lon, row(s, f)), 6) sub_lon, arg_min(bs, row(s, f)) bs_type, arg_min(c[1], row(s, f)) oktmo_code_1, arg_min(c[2], row(s, f)) oktmo_code_2 from i group by {_WHO}, part""")
def stays_of_a_day(spark, d):
    """Geo events to stay intervals: counts summed, indoor cells win, outdoor outliers go, weighted centres, like neighbours merged."""
    from cellframe.operators import stay

    k, u = F.col("event_id"), F.col("user_id") % 12
    start = F.lit("2024-01-10 21:30:00").cast("timestamp_ntz")
    cell = k % 14
    e = table(spark, d, "events").where("event_id % 21 <> 0").select(
        (F.lit(79160000000) + u).alias("msisdn"), (1 + u).alias("imsi"), F.when(u != 5, F.lit(7).cast("bigint")).alias("imei"), (start + F.make_dt_interval(secs=k * 13 % 14400)).alias("start_time_utc"), F.when(k % 9 == 0, start + F.make_dt_interval(secs=k * 13 % 14400 + 30)).alias("end_time_utc"), cell.alias("cgi"),
        (55 + (cell * 7 % 5) / 100.0 + F.when(cell == 13, 0.2).otherwise(0.0)).alias("lat"), (37 + (cell * 3 % 7) / 100.0).alias("lon"), F.when(cell == 4, "Indoor").when(cell == 9, "m").otherwise("O").alias("bs_type"), (k % 3).alias("event_count"), F.when(k % 5 != 0, (k % 4).cast("string")).alias("oktmo_code_1"), (k % 2).cast("string").alias("oktmo_code_2"),
    )
    s = stay.build_stays(e, None, F.lit(DAY))
    return s.select("msisdn", "imsi", "imei", "start_time_utc", "end_time_utc", F.array_join("cgi_list", ",").alias("cells"), F.round("sub_lat", 6).alias("sub_lat"), F.round("sub_lon", 6).alias("sub_lon"), "bs_type", "oktmo_code_1", "oktmo_code_2")


@query("""with c as (select c_custkey k, 79160000000 + c_custkey msisdn, timestamp '2024-01-10 10:00:00' + to_seconds(cast(c_custkey % 3000 as integer)) t, c_custkey % 5 cell from customer), f as (select *, case when k % 3 = 0 then case when k % 6 = 0 then 250010000000000 + k * 2 end else 250010000000000 + k end imsi, case when k % 5 = 0 then null else 350000000000000 + k end imei from c)
select msisdn, imsi, imei, t start_time_utc, t end_time_utc, cast(2500100001000000 + cell as varchar) cell, case when k % 2 = 0 then 5 when cell = 4 then null else cell % 3 end timezone, 'i' bs_type, date '2024-01-10' time_key from f where imsi is not null and imei is not null""")
def zones_of_stays(spark, d):
    """Identifiers filled from bindings, time zone of each stay by polygon, else of its cell."""
    k = F.col("c_custkey")
    c, day = table(spark, d, "customer"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    cgi = F.lit(2500100001000000) + k % 5
    g = c.select((F.lit(79160000000) + k).alias("msisdn"), F.when(k % 3 != 0, F.lit(250010000000000) + k).alias("imsi"), F.when(k % 5 != 0, F.lit(350000000000000) + k).alias("imei"), (day + F.make_dt_interval(hours=F.lit(10), secs=k % 3000)).alias("start_time_utc"), F.lit(None).cast("timestamp_ntz").alias("end_time_utc"), F.lit(0).alias("utc_offset"), F.when(k % 2 == 0, 55.5).otherwise(65.5).alias("lat"), F.lit(37.5).alias("lon"), F.lit("i").alias("bs_type"), cgi.alias("cgi"), F.lit(1).alias("event_count"), F.lit("cdr").alias("source_event_type"), F.lit("1").alias("oktmo_code_1"), F.lit("2").alias("oktmo_code_2"))
    sims = c.where("c_custkey % 6 = 0").select((F.lit(79160000000) + k).cast("string").alias("msisdn"), (F.lit(250010000000000) + k * 2).cast("string").alias("imsi"), day.alias("valid_from"), (day + F.expr("interval 1 day")).alias("valid_to"))
    devices = sims.where("false").withColumnRenamed("imsi", "imei")
    bs = spark.range(4).select(F.lit(250).alias("mcc"), F.lit(1).alias("mnc"), F.lit(1).alias("lac"), F.col("id").alias("cell_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("id") % 3).alias("timezone"), day.alias("date_on"))
    zones = spark.createDataFrame([(2, 9, "POLYGON((30 50,40 50,40 60,30 60,30 50))"), (1, 5, "POLYGON((37 55,38 55,38 56,37 56,37 55))")], "code int, timezone int, geometry string")
    out = events.build_geo_intervals(g, sims, devices, bs, zones, DAY)
    return out.select("msisdn", "imsi", "imei", "start_time_utc", "end_time_utc", F.get("cgi_list", F.lit(0)).alias("cell"), F.col("timezone").cast("long").alias("timezone"), "bs_type", "time_key")


_SUBSCRIPTIONS = """select case when c_custkey % 9 = 0 then 1 else 0 end as client_type, c_custkey % 4 as operator_Id, case when c_custkey % 8 = 0 then concat('8916', lpad(cast(c_custkey as string), 7, '0')) else concat('7916', lpad(cast(c_custkey as string), 7, '0')) end as isdn, case when c_custkey % 10 = 0 then null else concat('25001', lpad(cast(c_custkey as string), 10, '0')) end as imsi, lpad(cast(case when c_custkey % 5 = 0 then c_custkey - c_custkey % 20 else c_custkey end as string), 15, '3') as imei,
 case when c_custkey % 11 = 0 then null else concat('8970', lpad(cast(c_custkey as string), 15, '0')) end as iccid, cast('2023-01-01 00:00:00' as <ts>) + interval '1' day * cast(c_custkey % 300 as int) as actually_from, case when c_custkey % 7 = 0 then cast('2023-12-30 00:00:00' as <ts>) when c_custkey % 7 = 1 then null else cast('2024-01-20 00:00:00' as <ts>) end as actually_to, case when c_custkey % 6 = 0 then cast(null as date) else cast('1980-06-01' as date) end as birth_day,
 case when c_custkey % 3 = 0 then 'Anna' else 'Olga' end as first_name, 'Петровна' as second_name, concat('Last', cast(c_custkey % 40 as string)) as last_name, '' as dul_department, '4010 000001' as document from {customer}"""


@query(f"""with recursive raw as ({plain(_SUBSCRIPTIONS.replace("<ts>", "timestamp").replace("interval '1' day * cast(c_custkey % 300 as int)", "to_days(cast(c_custkey % 300 as integer))"))}),
p as (select '7' || substr(isdn, 2) msisdn, coalesce(imsi, '2500299' || substr(isdn, 4)) imsi, imei, iccid, operator_Id operator_id, actually_from, coalesce(actually_to, timestamp '2999-12-31 23:59:59') actually_to, birth_day, first_name, last_name from raw where client_type = 0 and actually_from <= timestamp '2024-01-31' and coalesce(actually_to, timestamp '2999-12-31 23:59:59') >= timestamp '2024-01-01'),
x as (select *, case when birth_day is not null then 'bio:' || lower(last_name) || '|' || lower(first_name) || '|петровна|1980-06-01|4010000001' end bio from p where msisdn not in (select '7916' || lpad(cast(s_suppkey as varchar), 7, '0') from supplier) and imsi is not null),
e as (select distinct 'msisdn:' || msisdn a, unnest(['imsi:' || imsi, 'imei:' || imei, 'iccid:' || iccid, bio]) b from x union select 'msisdn:7' || substr(isdn, 2), 'imsi:2500299' || substr(isdn, 4) from raw where imsi is null and '7' || substr(isdn, 2) not in (select '7916' || lpad(cast(s_suppkey as varchar), 7, '0') from supplier)), g as (select a, b from e where b is not null union select b, a from e where b is not null),
reach as (select a node, a as to_ from (select distinct a from g) union select reach.node, g.b from reach join g on g.a = reach.to_), comp as (select node, min(to_) root from reach group by node), keys as (select root, coalesce(min(node) filter (where node like 'bio:%'), min(node) filter (where node like 'iccid:%'), min(node)) ck, case when count(*) filter (where node like 'bio:%') > 0 then 'high' when count(*) filter (where node like 'iccid:%') > 0 then 'medium' else 'low' end conf from comp group by root),
j as (select x.*, ck, conf, 'prs_' || substr(sha256(ck), 1, 24) pid from x join comp on comp.node = 'msisdn:' || x.msisdn join keys using (root)), n as (select pid, count(distinct imsi || '|' || coalesce(iccid, '')) sims from j group by pid), f as (select *, row_number() over (partition by pid order by actually_from desc, msisdn, imsi, imei, iccid) r from j)
select pid person_id, ck person_cluster_key, conf person_confidence, sims sim_count, msisdn, imsi, imei, 'F' gender, case when birth_day is null then 'U' else '43' end age, 'U' citizenship, operator_id, actually_from from f join n using (pid) where r = 1""")
def person_profiles(spark, d):
    """Subscriptions of a month to persons: bindings fill, exclusions go, components of identifiers, the latest subscription stands for each."""
    raw = derived(spark, d, _SUBSCRIPTIONS.replace("<ts>", "timestamp_ntz"))
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-02-10 00:00:00"))
    number = F.concat(F.lit("7"), F.substring("isdn", 2, 10))
    sims = raw.where("imsi is null").select(number.alias("msisdn"), F.concat(F.lit("2500299"), F.substring("isdn", 4, 8)).alias("imsi"), low.alias("valid_from"), high.alias("valid_to"))
    out = table(spark, d, "supplier").select(F.concat(F.lit("8 916 "), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("value"))
    p = persons.build_persons(raw, date(2024, 1, 1), sims, sims.where("false").withColumnRenamed("imsi", "imei"), exclusions={"msisdn": out})
    return p.select("person_id", "person_cluster_key", "person_confidence", "sim_count", "msisdn", "imsi", "imei", "gender", "age", "citizenship", "operator_id", "actually_from")


@query("""with r as (select o_orderkey k, o_custkey from orders where o_orderkey % 10 = 0)
select k, case when k % 7 = 0 then null else 250.0 end mcc, case when k % 11 = 0 then null else 1.0 end mnc, cast(k as double) cell, case when k % 13 = 0 then null when k % 13 = 1 then null when k % 13 = 2 then -160.0 else 37.5 end coord_x, case when k % 17 = 0 then null else 55.0 end coord_y, least(150.0, cast(k % 300 as double)) power, greatest(-50.0, least(240.0, k % 400 - 100.0)) height, case when k % 3 = 0 then null else 'street' end address, k % 7 <> 0 and k % 11 <> 0 processable from r""")
def cells_prepared(spark, d):
    """Raw cells normalised: numbers, wrapped longitudes, clamped radio fields; which of them can be processed."""
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(
        k.alias("k"), F.when(k % 7 == 0, "ERR").otherwise(" 250 ").alias("mcc"), F.when(k % 11 == 0, "-1").otherwise("1").alias("mnc"), F.lit("5").alias("lac"), k.cast("string").alias("cell"), F.when(k % 13 == 0, "").when(k % 13 == 1, "700").when(k % 13 == 2, "200").otherwise("37.5").alias("coord_x"), F.when(k % 17 == 0, "95").otherwise("55").alias("coord_y"),
        (k % 300).cast("string").alias("power"), (k % 400 - 100).cast("string").alias("height"), F.when(k % 3 == 0, "  ").otherwise(" street").alias("address"), F.lit("2024-01-10").alias("date_on"),
    )
    clean = cells.prepare(raw)[0]
    return clean.select("k", "mcc", "mnc", "cell", "coord_x", "coord_y", "power", "height", "address", cells.processable().alias("processable"))


@query("""with s as (select s_suppkey k, s_suppkey % 5 kind from supplier where s_suppkey <= 40)
select k cell_id, case kind when 0 then 'm' when 1 then 'i' when 2 then 'f' else 'o' end bs_type, case when k % 2 = 0 then '3G' else '4G' end telecomstandard, case when k % 3 = 0 then 5 when k % 3 = 1 then 3 end timezone, case when k % 3 = 0 then '01' when k % 3 = 1 then '02' end oktmo_code_1, case when k % 3 = 0 then '0101' end oktmo_code_2, case kind when 0 then 0.2 when 1 then 0.1 when 2 then 0.05 else 5.0 end::double sector_radius, true sector_fits, true mosaic_fits from s""")
def cell_snapshot(spark, d):
    """Cells with zone, territory, sector and best-server area; areas are held against those of the regular polygons that they are."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 5
    # sites stand degrees apart, so that none cuts another's circle
    raw = table(spark, d, "supplier").where("s_suppkey <= 40").select(
        F.lit("250").alias("mcc"), F.lit("1").alias("mnc"), F.lit("5").alias("lac"), k.cast("string").alias("cell"), F.lit("2024-01-10").alias("date_on"), F.lit("2999-01-01").alias("date_off"), (k % 3 * 20 + 10 + k * 0.25).cast("string").alias("coord_x"), (10 + k * 1.5).cast("string").alias("coord_y"),
        F.when(kind == 0, "metro").when(kind == 1, "indoor").when(kind == 2, "femto").otherwise("tower").alias("bs_type"), F.when(k % 2 == 0, "3g").otherwise("LTE").alias("generation"), (k * 30).cast("string").alias("azimuth"), (60 + k * 5).cast("string").alias("sector_angle"), F.lit("1800").alias("frequency"), F.lit("20").alias("power"), F.lit("30").alias("height"), F.lit("4").alias("tilt"), F.lit("b").alias("rad_class"), F.lit("East").alias("subject"),
    )
    box = lambda x: f"POLYGON(({x} 0,{x + 15} 0,{x + 15} 80,{x} 80,{x} 0))"
    zones = spark.createDataFrame([(1, 5, box(8)), (2, 3, box(28))], "code int, timezone int, geometry string")
    lands = spark.createDataFrame([(box(8), 2, "01", "0101", "town"), (box(28), 1, None, "02", "West")], "WKT string, level int, parent_code string, code string, name string")
    w = cells.build_snapshot(cells.prepare(raw)[0], zones, lands)
    r, angle = F.col("sector_radius"), F.radians("sector_angle")
    fan = lambda r, a, n: n * 0.5 * r * r * F.sin(a / n)
    rear = F.radians(F.least(F.lit(100.0), F.greatest(F.lit(40.0), F.col("sector_angle") * 0.65), 360 - F.col("sector_angle")))
    sector = F.when(F.col("bs_type") == "o", fan(r, angle, 18) + fan(r * 0.35, rear, 18)).otherwise(48 * 0.5 * r * r * F.sin(F.lit(2 * 3.141592653589793 / 48)))
    reach = S.reach_m("sector_radius", F.lit(20.0), F.lit(30.0), F.lit(4.0), "bs_type", F.lit(1.0)) / 1000
    # the local plane keeps one scale for its group; area is counted with the scale of the cell's own latitude
    mosaic = F.col("mapinfo_wkt_area") > 0
    near = F.abs(F.col("sector_wkt_area") - sector) < 0.004 * sector + 0.0005
    return w.select("cell_id", "bs_type", "telecomstandard", "timezone", "oktmo_code_1", "oktmo_code_2", "sector_radius", near.alias("sector_fits"), (mosaic & (reach > 0)).alias("mosaic_fits"))


@query("""with p as (select s_suppkey k, s_suppkey % 7 * 300.0 x, s_suppkey // 7 * 300.0 y from supplier where s_suppkey < 49)
select k, case when x between 300 and 1500 and y between 300 and 1500 and exists (select 1 from p q where q.x = p.x + 300 and q.y = p.y) and exists (select 1 from p q where q.y = p.y + 300 and q.x = p.x) and exists (select 1 from p q where q.x = p.x - 300 and q.y = p.y) and exists (select 1 from p q where q.y = p.y - 300 and q.x = p.x) then 0.09 end area from p""")
def best_server_squares(spark, d):
    """Sites on a square grid, cut into many tiles: each inner one serves its square, whatever tile its neighbours are in."""
    k = F.col("s_suppkey")
    x, y = (k % 7) * 300.0, F.floor(k / 7) * 300.0
    c = table(spark, d, "supplier").where("s_suppkey < 49").select(k.alias("k"), F.lit("4G").alias("standard"), (x / 111_320.0).alias("lon"), (y / 111_320.0).alias("lat"), F.lit(250.0).alias("reach_m"), x.alias("x"), y.alias("y"))
    m = geo.best_server_mosaic(c, ["standard"], "k")
    around = c.select("x", "y")
    inner = F.col("x").between(300, 1500) & F.col("y").between(300, 1500)
    for n, (dx, dy) in enumerate(((300, 0), (-300, 0), (0, 300), (0, -300))):
        c = c.join(around.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(True).alias(f"n{n}")), ["x", "y"], "left")
        inner = inner & F.coalesce(f"n{n}", F.lit(False))
    return c.join(m, "k").select("k", F.when(inner, F.round("mapinfo_wkt_area", 2)).alias("area"))


@query("with z as (select 1 code, 'a' z union all select 2, 'b') select code, 200::bigint n, 200::bigint kinds, true covered from z")
def points_in_zones(spark, d):
    """Points drawn inside polygons, a hole among them: as many as asked for, all covered, none twice."""
    zones = spark.createDataFrame([(1, "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1))"), (2, "POLYGON((10 0,14 0,12 5,10 0))")], "code int, wkt string")
    p = geo.sample_in_zones(zones, "code", "wkt", 200)
    e = zones.select("code", geo.edges("wkt").alias("e"))
    inside = p.join(e, "code").withColumn("ok", geo.covers(F.col("e"), F.col("lon"), F.col("lat")) & (geo.border_distance(F.col("e"), F.col("lon"), F.col("lat")) >= 0))
    return inside.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("lon", "lat").alias("kinds"), F.min("ok").alias("covered"))


@query("with p as (select c_custkey k, c_custkey % 10 + 0.5 x, case when c_custkey % 4 = 0 then ' east ' when c_custkey % 4 = 1 then 'WEST' when c_custkey % 4 = 2 then 'nowhere' end s from customer) select k, case when s = ' east ' then case when x between 0 and 5 then 7 when x between 4 and 8 then 9 else 7 end when s = 'WEST' then 2 else 3 end utc_offset from p")
def offset_by_subject(spark, d):
    """Hours from UTC by the subject's name, by polygon where it has several zones."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), (k % 10 + 0.5).cast("double").alias("x"), F.lit(1.0).alias("y"), F.when(k % 4 == 0, " east ").when(k % 4 == 1, "WEST").when(k % 4 == 2, "nowhere").alias("s"))
    zones = spark.createDataFrame([(2, "East", 9, "POLYGON((4 0,8 0,8 2,4 2,4 0))"), (1, "East", 7, "POLYGON((0 0,5 0,5 2,0 2,0 0))"), (3, "west", 2, None)], "code int, name string, timezone int, geometry string")
    return geo.offset_of_subject(p, zones, "k", "x", "y", "s").select("k", "utc_offset")


@query("select event_id, case when event_id % 5 = 0 then 'South' when event_id % 20 < 10 then 'North ' || event_id % 20 end subject from events")
def subject_of_cell(spark, d):
    """Region of a row, its own or its cell's."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (k % 20).cast("string").alias("lac"), F.lit(" 7").alias("cell"), F.when(k % 5 == 0, " South ").otherwise("").alias("region"))
    known = spark.range(10).select(F.col("id").alias("lac"), F.lit(7).alias("cell"), F.concat(F.lit("North "), F.col("id").cast("string")).alias("subject"))
    return joins.subject_of_cell(e, known, region="region").select("event_id", "subject")


@query("with f(form) as (values ('struct'), ('array'), ('text')) select form, event_id, case when event_id % 4 = 0 then null else 250 end::bigint mcc, case when event_id % 4 = 0 or event_id % 9 = 0 then null else 1 end::bigint mnc, case when event_id % 4 = 0 then null else user_id end lac, case when event_id % 4 = 0 then null else event_id end cell from f, events")
def location_forms(spark, d):
    """The parts of a location that is a struct, an array or an old text."""
    e = table(spark, d, "events")
    k, mnc = F.col("event_id"), F.when(F.col("event_id") % 9 == 0, "").otherwise("01")
    text = lambda c: F.col(c).cast("string")
    forms = {"struct": F.struct(F.lit("250").alias("mcc"), mnc.alias("mnc"), F.col("user_id").alias("lac"), k.alias("cell")), "array": F.array(F.lit("250"), mnc, text("user_id"), text("event_id")), "text": F.concat_ws("|", F.concat(F.lit("250-"), mnc), text("user_id"), text("event_id"))}
    out = None
    for name, form in forms.items():
        one = e.select(F.lit(name).alias("form"), "event_id", F.when(k % 4 != 0, form).alias("location"))
        one = one.select("form", "event_id", *[c.alias(n) for c, n in zip(events.location_parts(one), ("mcc", "mnc", "lac", "cell"), strict=True)])
        out = one if out is None else out.unionByName(one)
    return out


# bindings, subscriptions, dimensions


@query("""with g as (select '7916' || lpad(cast(user_id as varchar), 7, '0') msisdn, lpad(cast(user_id % 3 + event_id % 2 as varchar), 15, '3') imei, ts from events where event_id % 7 <> 0 and cast(ts as date) = date '2024-01-10'),
m as (select *, case when lag(imei) over w is not distinct from imei and lag(ts) over w is not null then 0 else 1 end n from g window w as (partition by msisdn order by ts, imei)), i as (select *, sum(n) over (partition by msisdn order by ts, imei rows unbounded preceding) k from m) select msisdn, imei, min(ts) valid_from, max(ts) valid_to from i group by msisdn, imei, k""")
def device_segments_of_a_day(spark, d):
    """Phone and device segments of one day."""
    k, u = F.col("event_id"), F.col("user_id")
    g = table(spark, d, "events").where(F.to_date("ts") == F.lit(DAY)).select(F.concat(F.lit("8 916 "), F.lpad(u.cast("string"), 7, "0")).alias("msisdn"), F.when(k % 7 != 0, F.lpad((u % 3 + k % 2).cast("string"), 15, "3")).alias("imei"), F.col("ts").alias("start_time_utc"))
    return bindings.day_segments(g, "imei", DAY)


@query("select '7916' || lpad(cast(o_custkey as varchar), 7, '0') msisdn, o_orderkey % 3 operator_id, min(o_orderdate) valid_from, max(o_orderdate + to_days(9)) valid_to from orders group by 1, 2")
def operator_spans(spark, d):
    """First and last time of each phone with each operator."""
    o = table(spark, d, "orders").select(F.concat(F.lit("7916"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("msisdn"), (F.col("o_orderkey") % 3).alias("operator_id"), F.col("o_orderdate").alias("actually_from"), (F.col("o_orderdate") + F.expr("interval 9 days")).alias("actually_to"))
    return bindings.operator_spans(o)


@query("select '7916' || lpad(cast(o_custkey as varchar), 7, '0') msisdn, lpad(cast(o_orderkey as varchar), 15, '2') imsi, o_orderkey % 4 operator_id, o_orderdate valid_from, case when o_orderkey % 6 = 0 then timestamp '2100-01-01' else o_orderdate end valid_to from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0")
def bindings_read(spark, d):
    """Stored bindings normalised again, incomplete ones gone, an open end filled."""
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").select(F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("+7 916 "), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))).alias("msisdn"), F.when(k % 7 == 0, "12").otherwise(F.lpad(k.cast("string"), 15, "2")).alias("imsi"), (k % 4).alias("operator_id"), F.col("o_orderdate").alias("valid_from"), F.when(k % 6 != 0, F.col("o_orderdate")).alias("valid_to"))
    out = bindings.read_normalised(b, "imsi", open_end=True)
    # what is read into pandas can't hold the year 2999
    return out.withColumn("valid_to", F.when(F.col("valid_to") > F.lit("2900-01-01").cast("timestamp_ntz"), F.lit("2100-01-01").cast("timestamp_ntz")).otherwise(F.col("valid_to")))


@query(f"""with raw as ({plain(_SUBSCRIPTIONS.replace("<ts>", "timestamp").replace("interval '1' day * cast(c_custkey % 300 as int)", "to_days(cast(c_custkey % 300 as integer))"))}), b as (select '7' || substr(isdn, 2) msisdn, '2500299' || substr(isdn, 4) imsi from raw where imsi is null and client_type = 0)
select '7' || substr(isdn, 2) msisdn, coalesce(imsi, '2500299' || substr(isdn, 4)) imsi, imei, operator_Id operator_id, actually_from from raw where client_type = 0 and coalesce(actually_to, timestamp '2100-01-01') >= timestamp '2024-01-01'""")
def subscriptions_of_a_month(spark, d):
    """Natural persons' subscriptions that overlap a month, identifiers filled from bindings."""
    raw = derived(spark, d, _SUBSCRIPTIONS.replace("<ts>", "timestamp_ntz"))
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-02-10 00:00:00"))
    sims = raw.where("imsi is null").select(F.concat(F.lit("7"), F.substring("isdn", 2, 10)).alias("msisdn"), F.concat(F.lit("2500299"), F.substring("isdn", 4, 8)).alias("imsi"), low.alias("valid_from"), high.alias("valid_to"))
    return persons.prepare_subscriptions(raw, date(2024, 1, 1), sims, sims.where("false").withColumnRenamed("imsi", "imei")).select("msisdn", "imsi", "imei", "operator_id", "actually_from")


@query("""with b as (select o_custkey m, o_orderkey % 500 i, o_orderdate a, case when o_orderkey % 9 = 0 then null else o_orderdate + to_days(20) end e from orders where o_orderdate < timestamp '1996-04-01'), h as (select * from b where a <= timestamp '1996-03-31 23:59:59' and (e is null or e >= timestamp '1996-03-01')), r as (select c_custkey m, c_nationkey n, c_custkey k from customer where c_custkey % 5 = 0)
select distinct 'msisdn:' || m u, 'imsi:' || i v from h union select 'msisdn:' || m, 'imei:' || n from r union select 'msisdn:' || m, 'bio:' || k from r union select 'msisdn:' || m, 'imsi:' || k from r""")
def month_edges(spark, d):
    """Edges of subscriptions, and of the bindings that overlap a month."""
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1996-04-01'").select(F.col("o_custkey").alias("msisdn"), (k % 500).alias("imsi"), F.col("o_orderdate").alias("valid_from"), F.when(k % 9 != 0, F.col("o_orderdate") + F.expr("interval 20 days")).alias("valid_to"))
    r = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("msisdn"), F.col("c_custkey").alias("imsi"), F.col("c_nationkey").alias("imei"), F.lit(None).cast("string").alias("iccid"), F.concat(F.lit("bio:"), F.col("c_custkey").cast("string")).alias("bio_key"))
    return persons.identifier_edges(r, b, b.where("false").withColumnRenamed("imsi", "imei"), date(1996, 3, 1))


@query("select lpad(cast(p_partkey as varchar), 8, '0') tac, p_partkey % 4 = 0 is_m2m, case when p_partkey % 3 = 0 then '2021-03-05' end allocation_date, p_brand manufacturer from part")
def device_types(spark, d):
    """Device types built from raw rows: codes padded, dates in one form, machines marked."""
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(k.cast("string").alias("tac"), F.when(k % 4 == 0, "Modem").when(k % 4 == 1, "Phone").alias("equipment_type"), F.when(k % 3 == 0, "05.03.2021").otherwise(" ").alias("allocation_date"), F.col("p_brand").alias("manufacturer"))
    return dims.build_tac(raw).select("tac", "is_m2m", "allocation_date", "manufacturer")


@query("""with n as (select n_nationkey k, upper(substr(n_name, 1, 2)) a2, lower(n_name) nm from nation) select lpad(cast(k * 3 as varchar), 3, '0') numeric_code, chr(65 + cast(k as integer)) || 'Z' alpha2, 'Q' || chr(65 + cast(k as integer)) || 'Z' alpha3, nm || ' land' name_short, false excluded from n where k % 2 = 1
union all select lpad(cast(k * 3 as varchar), 3, '0'), chr(65 + cast(k as integer)) || 'Z', 'Q' || chr(65 + cast(k as integer)) || 'Z', nm || ' land', true from n where k % 2 = 0""")
def countries_and_exclusions(spark, d):
    """Countries built from raw rows, looked up by code, and a normalised exclusion list beside one that isn't there."""
    k = F.col("n_nationkey")
    letter = F.chr(65 + k)
    raw = table(spark, d, "nation").select((k * 3).cast("string").alias("numeric_code"), F.concat(F.lit(" "), F.lower(letter), F.lit("z")).alias("alpha2"), F.concat(F.lit("q"), letter, F.lit("Z")).alias("alpha3"), F.concat(F.lower("n_name"), F.lit(" land")).alias("name_short"), F.col("n_name").alias("name_full"))
    built = dims.build_oksm(raw)
    codes, names = dims.country_lookup(built)
    found = built.where(F.col("alpha2").isin(*codes) & F.lower("name_short").isin(*[n for n, _ in names]))
    listed = dims.exclusion(found.where("numeric_code % 2 = 0").select(F.concat(F.lit("No."), "numeric_code").alias("value")), spark, lambda c: S.last_digits(c, 3))
    none = dims.exclusion(None, spark, S.imsi)
    left = joins.exclude(found, {"numeric_code": listed, "alpha2": none}).select("numeric_code", F.lit(True).alias("__left"))
    return found.join(left, "numeric_code", "left").select("numeric_code", "alpha2", "alpha3", "name_short", F.col("__left").isNull().alias("excluded"))


@query("select 100::bigint n, 100::bigint kinds, true known, true share_fits from (select 1)")
def samples_by_hash(spark, d):
    """A sample without replacement, and a share of identities chosen by hash, the same at every run."""
    e = table(spark, d, "events")
    one, two = (profile.sample_by_hash(e.repartition(n), "event_id", 100, seed=7) for n in (2, 5))
    both = one.select("event_id").join(two.select("event_id"), "event_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("kinds"))
    p = e.select(F.col("event_id").alias("msisdn"), F.col("user_id").alias("imsi"), F.col("user_id").alias("imei"))
    some = dims.sample_exclusions(p, 0.3).agg(F.count("*").alias("s")).crossJoin(p.agg(F.count("*").alias("t")))
    return both.crossJoin(some).select("n", "kinds", (F.col("kinds") == F.col("n")).alias("known"), (F.col("s") / F.col("t")).between(0.2, 0.4).alias("share_fits"))


_GEOHASH = " || ".join("substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + " + " + ".join(f"(({'x' if (k * 5 + b) % 2 == 0 else 'y'} >> {(22 if (k * 5 + b) % 2 == 0 else 21) - (k * 5 + b) // 2}) & 1) * {1 << (4 - b)}" for b in range(5)) + ", 1)" for k in range(9))


@query(f"""with t as (select c_custkey k, case c_custkey % 4 when 0 then ' 3g' when 1 then '4G ' when 2 then '5G' end g, case c_custkey % 5 when 0 then ' <NA>' when 1 then 'none' when 2 then '  ' when 3 then ' a b ' end s, lpad(cast(c_custkey as varchar), case when c_custkey % 3 = 0 then 13 else 15 end, '4') im, case c_custkey % 4 when 0 then '2024-01-01T00:00:00+03:30' when 1 then '2024-01-01T00:00:00-0500' when 2 then '2024-01-01T00:00:00Z' end iso, floor((37.0 + c_custkey % 90 + 180) / 360 * 8388608)::bigint x, floor((c_custkey % 80 + 0.25 + 90) / 180 * 4194304)::bigint y from customer)
select k, case when upper(trim(g)) in ('2G', '3G', '4G') then upper(trim(g)) else '4G' end generation, nullif(trim(s), '') filled, case when s is null or lower(trim(s)) in ('<na>', 'none') then '' else trim(s) end plain_text, case when length(im) >= 14 then im end imei, cast(k * 1000003 as varchar) digits, case when k % 4 = 0 then 210 when k % 4 = 1 then -300 when k % 4 = 2 then 0 end::bigint offset_min, ('0x' || substr(sha256('k' || k), 1, 8))::bigint seed, k % 3 = 0 machine, {_GEOHASH} geohash, round(date_diff('day', date '1980-02-03', date '2024-01-01') / 365.25, 6) dq_age from t""")
def more_scalars(spark, d):
    """Generation, texts and numbers filled or not, device numbers, offsets of times, seeds, machines, geohashes, ages of the checks."""
    from cellframe.dq.suites import age_in_years

    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % n + 1).cast("int"))
    im = F.when(k % 3 == 0, F.lpad(k.cast("string"), 13, "4")).otherwise(F.lpad(k.cast("string"), 15, "4"))
    c = table(spark, d, "customer").select(k.alias("k"), pick(4, " 3g", "4G ", "5G", None).alias("g"), pick(5, " <NA>", "none", "  ", " a b ", None).alias("s"), im.alias("im"), pick(4, "2024-01-01T00:00:00+03:30", "2024-01-01T00:00:00-0500", "2024-01-01T00:00:00Z", None).alias("iso"), F.when(k % 3 == 0, "Modem").otherwise("Phone").alias("e"), (37.0 + k % 90).alias("lon"), (k % 80 + 0.25).alias("lat"), F.lit("1980-02-03").alias("b"))
    return c.select(
        "k", S.generation("g").alias("generation"), S.blank_to_null("s").alias("filled"), S.text_or_empty("s").alias("plain_text"), S.imei("im").alias("imei"), S.number_to_digits((F.col("k") * 1000003).cast("double")).alias("digits"), S.iso_offset_minutes("iso").cast("long").alias("offset_min"), S.stable_seed(F.concat(F.lit("k"), F.col("k").cast("string"))).alias("seed"), S.is_m2m("e").alias("machine"), S.geohash("lat", "lon").alias("geohash"),
        F.round(age_in_years("b", F.lit("2024-01-01").cast("date")), 6).alias("dq_age"),
    )
