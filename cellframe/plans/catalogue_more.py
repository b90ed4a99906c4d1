"""More queries of the catalogue: table plans on derived marts, filters, graph keys, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.dq import suites
from cellframe.functions import scalar as S
from cellframe.operators import entity, geo, intervals, scd, stay
from cellframe.plans import bindings, cells, events
from cellframe.plans.catalogue import query, table, ts
from cellframe.sources import files
from cellframe.streaming import streams

# a record of each kind for every event of a type, dirty in places
_MARTS = """a as (select event_id, user_id, event_type, case when event_id % 97 = 0 then 'bad' else ' ' || strftime(ts, '%Y%m%d%H%M%S') end started, case when event_id % 6 = 0 then null else '25001' || lpad(cast(user_id as varchar), 10, '0') end imsi,
 '7916' || lpad(cast(user_id as varchar), 7, '0') phone, case when event_id % 5 = 0 then null else user_id % 7 end lac, user_id % 3 cell, case when event_id % 31 = 0 then '' else '250-0' || (user_id % 2) end code from events),
m as (select event_id, trim(started) t, imsi, phone, code, lac, cell, case event_type when 'click' then 'cdr' when 'view' then 'gprs' when 'purchase' then 'sms' else 'location' end mart from a),
n as (select event_id, t, imsi, phone, mart, case when mart in ('cdr', 'gprs') then case when code = '' then null else '250' end else '250' end mcc, case when mart in ('cdr', 'gprs') then case when code = '' then null else substr(code, 5) end else '01' end mnc, lac, cell from m where regexp_full_match(t, '\\d{14}'))"""


def _marts(spark, d) -> dict[str, DataFrame]:
    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    base = e.select(
        "event_id", "event_type", F.when(k % 97 == 0, "bad").otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyyMMddHHmmss"))).alias("Started"), F.when(k % 6 != 0, F.concat(F.lit("25001"), F.lpad(u.cast("string"), 10, "0"))).alias("IMSI"),
        F.lit(None).cast("string").alias("IMEI"), F.concat(F.lit("7916"), F.lpad(u.cast("string"), 7, "0")).alias("phone"), F.when(k % 5 != 0, u % 7).alias("lac"), (u % 3).alias("cell"), F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("250-0"), (u % 2).cast("string"))).alias("code"),
    )
    kind = F.when(F.col("event_type") == "click", "cdr").when(F.col("event_type") == "view", "gprs").when(F.col("event_type") == "purchase", "sms").otherwise("location")
    base = base.withColumn("mart", kind)
    out = {}
    for m in events.CODES:
        lac, cell = events.CELL[m]
        rows = base.where(F.col("mart") == m).withColumnRenamed("phone", events.PARTY[m]).withColumnRenamed("lac", lac).withColumnRenamed("cell", cell)
        out[m] = rows.withColumnRenamed("code", "OwnerMCCMNC") if m in ("cdr", "gprs") else rows.withColumn("MCC", F.lit("250")).withColumn("MNC", F.lit("01"))
    return out


@query(f"""with {_MARTS},
w as (select *, 2500000000000000 + mnc::bigint * 100000000000 + lac * 1000000 + cell cgi, time_bucket(interval '5 minutes', strptime(t, '%Y%m%d%H%M%S')) b from n where mcc is not null and lac is not null),
f as (select *, case when imsi is not null and lag(mart) over x is not distinct from mart and lag(cgi) over x is not distinct from cgi and lag(b) over x is not distinct from b and lag(event_id) over x is not null then 0 else 1 end new from w window x as (partition by imsi order by t, mart, cgi, phone, event_id)),
i as (select *, sum(new) over (partition by imsi order by t, mart, cgi, phone, event_id rows unbounded preceding) island from f)
select imsi, min(t) event_timestamp, mart event_name, any_value(lac) lac, any_value(cell) cell, count(*) event_count from i group by imsi, island, mart union all select imsi, t, mart, lac, cell, 1 from n where mcc is null or lac is null""")
def build_events(spark, d):
    """Four marts in one event model, runs collapsed, rows without a location passing by."""
    out = events.build_events(_marts(spark, d))
    return out.select("imsi", "event_timestamp", "event_name", F.col("location.lac").alias("lac"), F.col("location.cell").alias("cell"), "event_count")


@query(f"""with {_MARTS} select count(*) as rows, count(*) filter (where imsi is null) bad_imsi, count(*) filter (where mcc is null) no_mcc, count(*) filter (where lac is null) no_lac from n""")
def transform_counters(spark, d):
    """What normalisation would lose, counted in one pass over the marts."""
    rows = None
    for m, df in _marts(spark, d).items():
        one = events.normalise_mart(df, m)
        rows = one if rows is None else rows.unionByName(one)
    return events.transform_metrics(rows).select("rows", "bad_imsi", "no_mcc", "no_lac")


@query("""
with r as (select o_orderkey, case when o_orderkey % 7 = 0 then 'ERR' else '250' end mcc, case when o_orderkey % 11 = 0 then '-1' else '1' end mnc, case when o_orderkey % 13 = 0 then '200' when o_orderkey % 13 = 1 then '700' else '37.5' end x, case when o_orderkey % 17 = 0 then '95' else '55' end y, '2024-01-10' a, case when o_orderkey % 19 = 0 then '2023-01-01' when o_orderkey % 19 = 1 then 'never' else '2999-12-31' end b from orders)
select field, reason, count(*) n from (select 'mcc' field, 'non_numeric' reason from r where mcc = 'ERR' union all select 'mnc', 'negative_mnc' from r where mnc = '-1' union all select 'coord_x', 'invalid_lon' from r where x = '700' union all select 'coord_y', 'invalid_lat' from r where y = '95' union all select 'date_off', 'date_off_before_date_on' from r where b = '2023-01-01' union all select 'date_off', 'non_timestamp' from r where b = 'never') group by all""")
def cell_error_log(spark, d):
    """Errors of raw cells by field and reason; nothing stops for them."""
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(
        F.when(k % 7 == 0, "ERR").otherwise("250").alias("mcc"), F.when(k % 11 == 0, "-1").otherwise("1").alias("mnc"), F.lit("5").alias("lac"), k.cast("string").alias("cell"), F.when(k % 13 == 0, "200").when(k % 13 == 1, "700").otherwise("37.5").alias("coord_x"), F.when(k % 17 == 0, "95").otherwise("55").alias("coord_y"),
        F.lit("2024-01-10").alias("date_on"), F.when(k % 19 == 0, "2023-01-01").when(k % 19 == 1, "never").otherwise("2999-12-31").alias("date_off"),
    )
    return cells.prepare(raw)[1].groupBy("field", "reason").agg(F.count("*").alias("n"))


@query("select o_orderkey, case when o_orderkey % 3 = 2 then 'b' || o_custkey else 'a' || o_orderkey end a_number, case when o_orderkey % 3 = 2 then 'a' || o_orderkey else 'b' || o_custkey end b_number, case when o_orderkey % 3 = 1 then 'i' || o_orderkey end a_imsi from orders")
def party_swap(spark, d):
    """Parties change places where the second owns the record."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("owner"), s("a", "o_orderkey").alias("a_number"), s("b", "o_custkey").alias("b_number"), s("i", "o_orderkey").alias("a_imsi"), F.lit("x").alias("b_imsi"))
    return events.swap_parties(o, "owner", ("a_number", "a_imsi"), ("b_number", "b_imsi")).select("o_orderkey", "a_number", "b_number", "a_imsi")


@query("""with v as (select o_orderkey, o_orderdate a, coalesce(case when o_orderkey % 4 = 0 then null else o_orderdate + to_days(45) end, timestamp '2100-01-01') b from orders)
select o_orderkey, a, b from v where a <= timestamp '1996-03-31 23:59:59' and b >= timestamp '1996-03-01'""")
def period_overlap(spark, d):
    """Versions active in a period; an open end is the end of time."""
    v = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"), F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate") + F.expr("interval 45 days")), ts("2100-01-01")).alias("b"))
    return intervals.overlapping(v, ts("1996-03-01"), ts("1996-03-31 23:59:59"), "a", "b")


@query("with w as (select s_suppkey k, case s_suppkey % 6 when 0 then 'POLYGON((0 0,1 0,1 1,0 0))' when 1 then 'POLYGON EMPTY' when 2 then 'POINT(1 2)' when 3 then 'garbage' when 4 then 'POLYGON((0 0,1 0,1 1))' else null end g from supplier) select count(*) filter (where g is not null) present, count(*) filter (where g = 'garbage') parse_errors, count(*) filter (where g like 'POINT%') wrong_type, count(*) filter (where g like '%EMPTY') as empty, count(*) filter (where g = 'POLYGON((0 0,1 0,1 1))') invalid from w")
def wkt_quality(spark, d):
    """Unreadable, mistyped, empty and broken geometry texts, counted."""
    k = F.col("s_suppkey") % 6
    g = F.when(k == 0, "POLYGON((0 0,1 0,1 1,0 0))").when(k == 1, "POLYGON EMPTY").when(k == 2, "POINT(1 2)").when(k == 3, "garbage").when(k == 4, "POLYGON((0 0,1 0,1 1))")
    return geo.wkt_metrics(table(spark, d, "supplier").select(g.alias("g")), "g")


@query("select event_type command, arg_max(value, row(ts, event_id)) elapsed_total_sec, max(ts) ts_utc from events group by 1")
def latest_per_command(spark, d):
    """The latest timing of each command."""
    e = table(spark, d, "events").select(F.col("event_type").alias("command"), F.col("value").alias("elapsed_total_sec"), F.lit("ok").alias("status"), F.col("event_id").alias("run_id"), F.col("ts").alias("ts_utc"))
    return files.latest_timings(e).select("command", "elapsed_total_sec", "ts_utc")


@query("""with b as (select c_custkey m, case when c_custkey % 3 = 0 then null else c_custkey % 50 end i, c_nationkey j from customer) select distinct 'msisdn:' || m u, 'imsi:' || i v from b where i is not null union select distinct 'msisdn:' || m, 'imei:' || j from b""")
def identifier_edges(spark, d):
    """Distinct edges from phone numbers to other identifiers; null ones make none."""
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("m"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 50).alias("i"), F.col("c_nationkey").alias("j"))
    return entity.edges_of(b, ("msisdn", "m"), [("imsi", "i"), ("imei", "j")])


@query("""with c as (select 'g' || (s_suppkey % 20) root, case when s_suppkey % 4 = 0 then 'bio:' when s_suppkey % 4 = 1 then 'iccid:' else 'msisdn:' end || s_suppkey node from supplier)
select root, coalesce(min(node) filter (where node like 'bio:%'), min(node) filter (where node like 'iccid:%'), min(node)) cluster_key, case when count(*) filter (where node like 'bio:%') > 0 then 'high' when count(*) filter (where node like 'iccid:%') > 0 then 'medium' else 'low' end confidence from c group by root""")
def cluster_keys(spark, d):
    """Canonical key and confidence of each component."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "bio:").when(k % 4 == 1, "iccid:").otherwise("msisdn:")
    return entity.clusters(table(spark, d, "supplier").select(F.concat(F.lit("g"), (k % 20).cast("string")).alias("root"), F.concat(kind, k.cast("string")).alias("node")))


@query("""with e as (select *, ts + to_seconds(case when hour(ts) <= 5 or hour(ts) = 23 then 1800 else 300 end) as until from events), m as (select *, case when ts < max(until) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end n from e), s as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) g from m)
select user_id, min(ts) start_time, max(until) end_time, count(*) n from s group by user_id, g""")
def dynamic_gap_sessions(spark, d):
    """Sessions with a longer gap at night, by the function that also runs on streams."""
    out = streams.stay_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"), "n")


@query("select source_id, count(*) n from (select case when r_name in ('ASIA', 'MIDDLE EAST') then 'far-east' else 'central' end source_id from nation join region on n_regionkey = r_regionkey) group by 1")
def region_routing(spark, d):
    """Rows by data centre."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return files.route_by_region(n, "r_name", {"far-east": ["ASIA", "MIDDLE EAST"]}, "central").groupBy("source_id").agg(F.count("*").alias("n"))


_GEO = "g as (select '7916' || lpad(cast(user_id as varchar), 7, '0') msisdn, case when event_id % 9 = 0 then null else '25001' || lpad(cast(user_id % 5 + event_id % 2 as varchar), 10, '0') end imsi, ts, cast(ts as date) as dd from events)"


def _geo(spark, d):
    u, k = F.col("user_id"), F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("7916"), F.lpad(u.cast("string"), 7, "0")).alias("msisdn"), F.when(k % 9 != 0, F.concat(F.lit("25001"), F.lpad((u % 5 + k % 2).cast("string"), 10, "0"))).alias("imsi"), F.col("ts").alias("start_time_utc"))


@query(f"""with {_GEO}, m as (select *, case when lag(imsi) over w is not distinct from imsi and lag(ts) over w is not null then 0 else 1 end n from g where imsi is not null window w as (partition by msisdn, dd order by ts, imsi)), i as (select *, sum(n) over (partition by msisdn, dd order by ts, imsi rows unbounded preceding) k from m),
s as (select msisdn, imsi, min(ts) a, max(ts) b from i group by msisdn, dd, imsi, k), r as (select *, max(b) over (partition by msisdn, imsi order by a, b rows between unbounded preceding and 1 preceding) reach from s), p as (select *, sum(case when reach is null or epoch_us(a) - epoch_us(reach) > 1000000 then 1 else 0 end) over (partition by msisdn, imsi order by a, b rows unbounded preceding) part from r)
select msisdn, imsi, cast(1 as bigint) operator_id, min(a) valid_from, max(b) valid_to from p group by msisdn, imsi, part""")
def month_bindings(spark, d):
    """Phone and SIM bindings of a month, all days in one pass."""
    return bindings.month_in_one_pass(_geo(spark, d), "imsi")


@query(f"""with {_GEO}, e as (select *, row_number() over (partition by msisdn, imsi order by ts) n from g where imsi is not null)
select 'order' check_name, 'ok' status from (select 1) union all select 'null.imsi', case when count(*) filter (where imsi is null) > 0 then 'failed' else 'ok' end from g union all select 'msisdn_format', 'ok' from (select 1) union all select 'foreign_share', 'ok' from (select 1)""")
def dq_binding_suite(spark, d):
    """Four of the checks of the binding suite over raw pairs, some of which lack a SIM."""
    rows = _geo(spark, d).select("msisdn", "imsi", S.operator_of_imsi("imsi").alias("operator_id"), F.col("start_time_utc").alias("valid_from"), F.col("start_time_utc").alias("valid_to"))
    return suites.fct_msisdn_imsi(rows).where(F.col("check_name").isin("order", "null.imsi", "msisdn_format", "foreign_share")).select("check_name", "status")


@query("with p as (select s_suppkey id, s_suppkey % 10 + 0.5 x, s_suppkey * 7 % 10 + 0.5 y, case when s_suppkey % 3 = 0 then 'East' else 'none' end subject from supplier) select id, case when x <= 4 and y <= 4 then '01' when subject = 'East' then '02' when x <= 6 then '01' end oktmo_code_1, case when x <= 4 and y <= 4 then '0101' end oktmo_code_2 from p")
def territory_codes(spark, d):
    """Municipality and region of points, with the fallbacks by name and by region polygon."""
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), (k % 10 + 0.5).cast("double").alias("x"), (k * 7 % 10 + 0.5).cast("double").alias("y"), F.when(k % 3 == 0, "East").otherwise("none").alias("subject"))
    z = spark.createDataFrame([("POLYGON((0 0,4 0,4 4,0 4,0 0))", 2, "01", "0101", "town"), ("POLYGON((0 0,6 0,6 10,0 10,0 0))", 1, None, "01", "West"), ("POLYGON((50 50,51 50,51 51,50 50))", 1, None, "02", "east")], "WKT string, level int, parent_code string, code string, name string")
    return geo.territory(p, z, "id", "x", "y", "subject").select("id", "oktmo_code_1", "oktmo_code_2")


@query("select s_suppkey id, floor((s_suppkey * 91 % 1000) / 100.0 / 0.5)::bigint || ':' || floor((s_suppkey * 37 % 1000) / 100.0 / 0.5)::bigint grid from supplier")
def grid_keys(spark, d):
    """Grid cell of each point."""
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), (k * 91 % 1000 / 100.0).cast("double").alias("lat"), (k * 37 % 1000 / 100.0).cast("double").alias("lon"))
    return p.select("id", S.grid_key("lat", "lon", 0.5).alias("grid"))


@query("""with e as (select user_id, event_id, ts, event_type, value from events where event_id % 4 <> 0), s as (select user_id, time_bucket(interval '6 hours', ts) b, event_type kind, sum(value) w, sum(value * event_id) x from e group by all), r as (select user_id, b, round(sum(x) / sum(w), 4) cx, arg_max(kind, row(w, kind)) kind from s group by 1, 2),
m as (select *, case when kind is not distinct from lag(kind) over q and epoch_us(b) - epoch_us(lag(b) over q) <= 6 * 3600 * 1000000::bigint then 0 else 1 end n from r window q as (partition by user_id order by b)), i as (select *, sum(n) over (partition by user_id order by b rows unbounded preceding) k from m)
select user_id, min(b) start_time, max(b) end_time, arg_min(kind, b) kind, arg_min(cx, b) centre from i group by user_id, k""")
def stay_intervals(spark, d):
    """Weighted centre and mode of each bucket, like neighbours merged: the core of stay building."""
    e = table(spark, d, "events").where("event_id % 4 <> 0").withColumn("b", S.floor_to("ts", 21600)).withColumn("c", F.col("event_id").cast("string"))
    s = stay.weighted_summary(e, ["user_id", "b"], "value", {"centre": "event_id"}, ["event_type"], "c").withColumn("centre", F.round("centre", 4)).withColumn("e", F.col("b")).withColumn("kind", F.col("event_type"))
    out = intervals.merge_similar_neighbours(s, ["user_id"], ["kind"], {}, "b", "e", 21600, 21600, first=["centre"])
    return out.select("user_id", F.col("b").alias("start_time"), F.col("e").alias("end_time"), "kind", "centre")


@query("select l_orderkey, l_linenumber, case when l_quantity < 10 then 10.0 when l_quantity > 40 then 40.0 else l_quantity end clamped, case when abs(l_discount - 0.05) < 1e-9 then 'true' when l_discount > 0.05 then 'false' else '<other>' end flag, case when l_quantity = floor(l_quantity) then cast(cast(l_quantity as bigint) as varchar) end label from lineitem")
def value_normalisers(spark, d):
    """Clamped numbers, truth values as text, labels of numbers."""
    x = F.col("l_discount")
    raw = F.when(F.abs(x - 0.05) < 1e-9, "Yes").when(x > 0.05, "0").otherwise("perhaps")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp("l_quantity", 10.0, 40.0).alias("clamped"), S.boolean_text(raw).alias("flag"), S.number_label("l_quantity").alias("label"))


@query("select event_type, user_id, min(event_id) event_id from events group by 1, 2")
def dedupe_first(spark, d):
    """First row of each key kept."""
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", (-F.col("event_id")).alias("back"))
    return scd.latest(e, ["event_type", "user_id"], ["back"]).drop("back")
