"""Queries over the driver's tables, each with the SQL that gives the same rows.

The telemetry marts aren't among these tables, so every operator is applied to columns that have the needed shape: events
as observations, orders as intervals, part prices as versions, keys rendered as dirty identifiers.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.dq import core as dq
from cellframe.dq import suites
from cellframe.functions import scalar as S
from cellframe.operators import entity, impute, intervals, islands, joins, profile, scd
from cellframe.operators import geo as G
from cellframe.operators import stay as ST
from cellframe.plans import events, runner
from cellframe.session import checkpointed
from cellframe.sources import files
from cellframe.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# runs and intervals


@query("""
with a as (select *, time_bucket(interval '5 minutes', ts) b from events),
m as (select *, case when lag(event_type) over w is not distinct from event_type and lag(b) over w is not distinct from b and lag(event_id) over w is not null then 0 else 1 end n from a window w as (partition by user_id order by ts, event_type, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_type, event_id rows unbounded preceding) island from m)
select user_id, event_type, min(ts) first_ts, max(ts) last_ts, count(*) event_count from i group by user_id, event_type, island""")
def event_islands_5m(spark, d):
    """Five-minute run-length collapse of each user's events by type."""
    return islands.collapse_runs(table(spark, d, "events"), ["user_id"], "ts", ["event_type"], ["event_type", "event_id"]).select("user_id", "event_type", "first_ts", "last_ts", "event_count")


@query("""
with a as (select *, case when event_id % 3 = 0 then null else value end v, case when event_id % 11 = 0 then null else user_id % 20 end u, time_bucket(interval '1 day', ts) b from events),
m as (select *, case when u is not null and lag(b) over w is not distinct from b and lag(event_id) over w is not null then 0 else 1 end n from a window w as (partition by u order by ts, event_id)),
i as (select *, sum(n) over (partition by u order by ts, event_id rows unbounded preceding) island from m)
select u as user_group, min(ts) first_ts, max(ts) last_ts, arg_min(v, row(ts, event_id)) filter (where v is not null) v, count(*) event_count from i group by u, island""")
def event_islands_day_first_known(spark, d):
    """Coarser buckets, a null key that never collapses, first known value of each run."""
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("user_group", F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 20))
    return islands.collapse_runs(e, ["user_group"], "ts", [], ["event_id"], seconds=86400, first=["v"], null_breaks=["user_group"]).select("user_group", "first_ts", "last_ts", "v", "event_count")


_SEGMENTS = """
with m as (select user_id, event_type, ts, event_id, case when lag(event_type) over w is not distinct from event_type and lag(event_id) over w is not null then 0 else 1 end n from events window w as (partition by user_id order by ts, event_type, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_type, event_id rows unbounded preceding) island from m),
s as (select user_id, event_type, min(ts) valid_from, max(ts) valid_to from i group by user_id, event_type, island)"""


def _segments(spark, d):
    return intervals.segment_by_value(table(spark, d, "events"), ["user_id"], "event_type", "ts", ["event_id"])


@query(_SEGMENTS + """ select user_id, event_type, greatest(valid_from, timestamp '2024-01-05') valid_from, least(valid_to, timestamp '2024-01-20 23:59:59.999999') valid_to from s where valid_to >= timestamp '2024-01-05' and valid_from <= timestamp '2024-01-20 23:59:59.999999'""")
def binding_segments(spark, d):
    """Value-change segments of each user, clipped to a period."""
    return intervals.clip(_segments(spark, d), ts("2024-01-05"), ts("2024-01-20 23:59:59.999999")).select("user_id", "event_type", "valid_from", "valid_to")


_COALESCE = """, r as (select *, max(valid_to) over (partition by user_id, event_type order by valid_from, valid_to rows between unbounded preceding and 1 preceding) reach from s),
p as (select *, sum(case when reach is null or epoch_us(valid_from) - epoch_us(reach) > 43200000000 then 1 else 0 end) over (partition by user_id, event_type order by valid_from, valid_to rows unbounded preceding) part from r)"""


@query(_SEGMENTS + _COALESCE + " select user_id, event_type, min(valid_from) valid_from, max(valid_to) valid_to from p group by user_id, event_type, part")
def binding_coalesce(spark, d):
    """Segments of one binding within twelve hours of each other become one."""
    return intervals.coalesce_intervals(_segments(spark, d), ["user_id", "event_type"], gap=43200)


@query("""
with o as (select o_custkey, o_orderdate valid_from, o_orderdate + to_days(cast(20 + o_orderkey % 60 as integer)) valid_to from orders),
r as (select *, max(valid_to) over (partition by o_custkey order by valid_from, valid_to rows between unbounded preceding and 1 preceding) reach from o)
select cast(sum(case when valid_from <= reach then 2 else 0 end) as bigint) as overlaps, cast(sum(case when epoch_us(valid_from) - epoch_us(reach) <= 86400000000 * 5 then 1 else 0 end) as bigint) as mergeable from r""")
def interval_invariants(spark, d):
    """Overlap and mergeable-gap counters over orders as intervals."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.make_dt_interval(days=(20 + F.col("o_orderkey") % 60).cast("int"))).alias("valid_to"))
    return intervals.overlap_count(o, ["o_custkey"]).crossJoin(intervals.mergeable_count(o, ["o_custkey"], 5 * 86400))


@query(_SEGMENTS + """, kept as (select * from s where not (valid_from <= timestamp '2024-01-15 23:59:59.999999' and valid_to >= timestamp '2024-01-15')),
fresh as (select user_id, event_type, greatest(valid_from, timestamp '2024-01-15') valid_from, least(valid_to, timestamp '2024-01-15 23:59:59.999999') valid_to from s where valid_to >= timestamp '2024-01-15' and valid_from <= timestamp '2024-01-15 23:59:59.999999'),
u as (select * from kept union all select * from fresh),
r as (select *, max(valid_to) over (partition by user_id, event_type order by valid_from, valid_to rows between unbounded preceding and 1 preceding) reach from u),
p as (select *, sum(case when reach is null or epoch_us(valid_from) - epoch_us(reach) > 1000000 then 1 else 0 end) over (partition by user_id, event_type order by valid_from, valid_to rows unbounded preceding) part from r)
select user_id, event_type, min(valid_from) valid_from, max(valid_to) valid_to from p group by user_id, event_type, part""")
def binding_upsert(spark, d):
    """A day's rows replace what overlaps that day; applied twice, as a delivered-again day would be."""
    # read for the period's rows and for the rest, of both deliveries
    s = checkpointed(_segments(spark, d))
    low, high = ts("2024-01-15"), ts("2024-01-15 23:59:59.999999")
    fresh = intervals.clip(s, low, high)
    once = intervals.upsert_period(s, fresh, ["user_id", "event_type"], low, high)
    return intervals.upsert_period(once, fresh, ["user_id", "event_type"], low, high)


@query("""
with e as (select user_id, event_type, ts, event_id, floor(value) / 100.0 place from events where event_id % 13 <> 0),
m as (select *, case when event_type is not distinct from lag(event_type) over w and abs(place - lag(place) over w) <= 0.5
  and epoch_us(ts) - epoch_us(lag(ts) over w) <= 1000000::bigint * (case when hour(ts) <= 5 or hour(ts) = 23 then 36000 else 7200 end) then 0 else 1 end n from e window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) part from m)
select user_id, min(ts) start_ts, max(ts) end_ts, arg_min(event_type, row(ts, event_id)) event_type, arg_min(place, row(ts, event_id)) place from i group by user_id, part""")
def session_gap_day_night(spark, d):
    """Neighbours of like place and type become one stay, with a longer gap allowed at night."""
    e = table(spark, d, "events").where("event_id % 13 <> 0").select("user_id", "event_type", "event_id", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), (F.floor("value") / 100.0).cast("double").alias("place"))
    return intervals.merge_similar_neighbours(e, ["user_id"], ["event_type"], {"place": 0.5}, "start_ts", "end_ts", 7200, 36000, ["event_id"])


# joins

_VERSIONS = "v as (select l_partkey, l_shipdate date_on, case when l_orderkey % 5 = 0 then null else l_shipdate + to_days(cast(90 + l_orderkey % 200 as integer)) end date_off, l_suppkey, l_orderkey, l_linenumber from lineitem)"
_ORDERS = "o as (select o_orderkey, o_orderkey % 2000 + 1 as l_partkey, o_orderdate from orders)"


def _versions(spark, d):
    li = table(spark, d, "lineitem")
    end = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_shipdate") + F.make_dt_interval(days=(90 + F.col("l_orderkey") % 200).cast("int")))
    v = li.select("l_partkey", F.col("l_shipdate").alias("date_on"), end.alias("date_off"), "l_suppkey", "l_orderkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 + 1).alias("l_partkey"), "o_orderdate")
    return o, v


@query(f"""with {_VERSIONS}, {_ORDERS}, j as (select o_orderkey, o_orderdate, v.*, row_number() over (partition by o_orderkey order by date_on desc, l_orderkey, l_linenumber) n from o join v using (l_partkey) where date_on <= o_orderdate and (date_off is null or o_orderdate <= date_off))
select o_orderkey, l_partkey, o_orderdate, date_on, l_orderkey, l_suppkey from j where n = 1""")
def asof_latest_version(spark, d):
    """Interval join to versions, the latest active one wins."""
    o, v = _versions(spark, d)
    return joins.version_join(o, v, ["l_partkey"], "o_orderdate", "date_on", "date_off", nearest=False, tie=["l_orderkey", "l_linenumber"], prune=True).select("o_orderkey", "l_partkey", "o_orderdate", "date_on", "l_orderkey", "l_suppkey")


@query(f"""with {_VERSIONS}, {_ORDERS}, j as (select o_orderkey, o_orderdate, v.*, date_on <= o_orderdate and (date_off is null or o_orderdate <= date_off) act from o join v using (l_partkey)),
k as (select *, row_number() over (partition by o_orderkey order by act desc, case when act then 0 else abs(epoch_us(o_orderdate) - epoch_us(date_on)) end, date_on desc, l_orderkey, l_linenumber) n from j)
select o_orderkey, l_partkey, o_orderdate, date_on, l_orderkey, l_suppkey from k where n = 1""")
def asof_nearest_fallback(spark, d):
    """The same, falling back to the nearest version where none is active."""
    o, v = _versions(spark, d)
    return joins.version_join(o, v, ["l_partkey"], "o_orderdate", "date_on", "date_off", tie=["l_orderkey", "l_linenumber"], prune=True).select("o_orderkey", "l_partkey", "o_orderdate", "date_on", "l_orderkey", "l_suppkey")


@query("""
with b as (select o_custkey k, o_orderstatus v, o_orderdate s, o_orderdate + to_days(400) t from orders),
e as (select o_orderkey, o_custkey k, o_orderdate + to_days(100) as "at", case when o_orderkey % 3 = 0 then o_orderstatus end v from orders),
f as (select e.o_orderkey, arg_max(b.v, row(b.s, b.v)) fill from e join b on e.k = b.k and b.s <= e."at" and e."at" <= b.t where e.v is null group by 1)
select e.o_orderkey, coalesce(e.v, f.fill) v from e left join f using (o_orderkey)""")
def interval_fill(spark, d):
    """Missing values filled from the binding that holds at each row's time."""
    o = table(spark, d, "orders")
    b = o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 400 days")).alias("valid_to"))
    e = o.select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("interval 100 days")).alias("at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("v"))
    return joins.fill_from_intervals(e, b, "k", "v", "at").select("o_orderkey", "v")


@query("""
with b as (select o_custkey k, o_orderpriority v, o_orderdate s, o_orderdate + to_days(300) t from orders),
f as (select k, arg_max(v, row(s, v)) fill from b where s <= timestamp '1996-06-30 23:59:59' and t >= timestamp '1996-06-30 23:59:59' group by k)
select c_custkey, coalesce(case when c_custkey % 4 = 0 then 'own' end, fill) v from customer left join f on c_custkey = k""")
def point_in_time_fill(spark, d):
    """Missing values filled from the binding that holds at one instant."""
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("v"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 300 days")).alias("valid_to"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("own")).alias("v"))
    return joins.fill_at_instant(c, b, "c_custkey", "v", ts("1996-06-30 23:59:59"))


@query("""
select c_custkey, c_mktsegment from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_totalprice > 450000)
and not exists (select 1 from nation n where n.n_nationkey = c.c_nationkey and n_regionkey = 2) and not exists (select 1 from supplier s where s.s_suppkey = c.c_custkey and s_acctbal < 0)""")
def exclusion_lists(spark, d):
    """Rows in none of three exclusion lists."""
    lists = {
        "c_custkey": table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("value")),
        "c_nationkey": table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("value")),
        "__supp": table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("value")),
    }
    return joins.exclude(table(spark, d, "customer").withColumn("__supp", F.col("c_custkey")), lists).select("c_custkey", "c_mktsegment")


@query("""
with i as (select o_orderkey, lpad(cast(o_orderkey * 7919 % 99999999 as varchar), 8, '0') || lpad(cast(o_custkey as varchar), 7, '0') imei from orders),
m as (select distinct lpad(cast(o_orderkey * 7919 % 99999999 as varchar), 8, '0') tac from orders where o_orderstatus = 'F')
select o_orderkey, imei from i where substr(imei, 1, 8) not in (select tac from m)""")
def machine_device_exclusion(spark, d):
    """Rows whose device type, the first eight digits, isn't that of a machine."""
    o = table(spark, d, "orders")
    tac = F.lpad((F.col("o_orderkey") * 7919 % 99999999).cast("string"), 8, "0")
    rows = o.select("o_orderkey", F.concat(tac, F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("imei"))
    return joins.exclude_by(rows, S.tac_of_imei("imei"), o.where("o_orderstatus = 'F'").select(tac.alias("tac")), "tac")


@query("""
with a as (select s_suppkey, case when s_suppkey % 10 = 0 then null else s_nationkey end k from supplier), b as (select case when n_nationkey % 6 = 0 then null else n_nationkey end k, n_name from nation)
select s_suppkey, a.k nation, n_name from a join b on a.k is not distinct from b.k""")
def null_safe_merge(spark, d):
    """Equi-join in which null keys meet."""
    a = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("nation"))
    b = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey")).alias("nation"), "n_name")
    return joins.null_safe_join(a, b, ["nation"])


_CHANGED = "b as (select c_custkey, case when c_custkey % 7 = 0 then 'MOVED' else c_mktsegment end seg, c_nationkey nat from customer where c_custkey % 11 <> 0 union all select c_custkey + 1000000, c_mktsegment, c_nationkey from customer where c_custkey % 50 = 0), a as (select c_custkey, c_mktsegment seg, c_nationkey nat from customer)"


def _changed(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    b = a.where("c_custkey % 11 <> 0").withColumn("seg", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("seg"))).unionByName(a.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return a, b


@query(f"with {_CHANGED} select coalesce(a.c_custkey, b.c_custkey) c_custkey, case when a.c_custkey is null then 'added' when b.c_custkey is null then 'removed' when a.seg <> b.seg or a.nat <> b.nat then 'changed' else 'same' end change from a full join b on a.c_custkey = b.c_custkey")
def key_diff(spark, d):
    """What became of each key between two states."""
    return joins.key_diff(*_changed(spark, d), ["c_custkey"], ["seg", "nat"])


@query(f"""with {_CHANGED}, j as (select a.c_custkey ak, b.c_custkey bk, a.seg aseg, b.seg bseg, a.nat anat, b.nat bnat from a full join b on a.c_custkey = b.c_custkey)
select ak c_custkey, aseg seg, anat nat, timestamp '2024-01-01' date_on, case when bk is not null and aseg = bseg and anat = bnat then timestamp '2262-04-11' else timestamp '2024-02-29 23:59:59.999999' end date_off from j where ak is not null
union all select bk, bseg, bnat, timestamp '2024-03-01', timestamp '2262-04-11' from j where bk is not null and (ak is null or aseg <> bseg or anat <> bnat)""")
def scd2_merge(spark, d):
    """A snapshot merged into open versions of the second kind."""
    a, b = _changed(spark, d)
    history = a.withColumn("date_on", ts("2024-01-01")).withColumn("date_off", ts("2262-04-11"))
    return scd.merge(history, b, ["c_custkey"], ["seg", "nat"], ts("2024-03-01"), ts("2262-04-11"))


@query("select 'nation without region' kind, cast(n_regionkey as bigint) value from (select distinct n_regionkey from nation) where n_regionkey not in (select r_regionkey from region where r_regionkey % 3 <> 0) union all select 'region without nation', r_regionkey from region where r_regionkey not in (select n_regionkey from nation where n_nationkey > 12)")
def hierarchy_integrity(spark, d):
    """Orphan children and childless parents."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    a = joins.missing_references(n, "n_regionkey", r.where("r_regionkey % 3 <> 0"), "r_regionkey").select(F.lit("nation without region").alias("kind"), F.col("value").cast("long").alias("value"))
    b = joins.missing_references(r, "r_regionkey", n.where("n_nationkey > 12"), "n_regionkey").select(F.lit("region without nation").alias("kind"), F.col("value").cast("long").alias("value"))
    return a.unionByName(b)


@query("""
with t(token, result, priority) as (values ('purchase', 'P', 1), ('clic', 'C', 2), ('i', 'I', 3), ('r', 'R', 4)),
j as (select event_id, result, row_number() over (partition by event_id order by priority) n from events join t on contains(lower(event_type), token))
select e.event_id, j.result from events e left join j on e.event_id = j.event_id and n = 1""")
def token_containment(spark, d):
    """The first token that a text contains decides."""
    t = spark.createDataFrame([("purchase", "P", 1), ("clic", "C", 2), ("i", "I", 3), ("r", "R", 4)], "token string, result string, priority int")
    return joins.first_contained(table(spark, d, "events"), "event_type", t).select("event_id", "result")


_PLACES = "p as (select s_suppkey id, (s_suppkey * 37 % 1000) / 100.0 lon, (s_suppkey * 91 % 1000) / 100.0 lat from supplier)"


def _places(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 1000 / 100.0).cast("double").alias("lon"), (F.col("s_suppkey") * 91 % 1000 / 100.0).cast("double").alias("lat"))


@query(f"""with {_PLACES}, g as (select id, lon::double lon, lat::double lat from p), j as (select a.id, b.id other, pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2) d from g a join g b on a.id <> b.id and abs(floor(a.lon / 2.0) - floor(b.lon / 2.0)) <= 1 and abs(floor(a.lat / 2.0) - floor(b.lat / 2.0)) <= 1),
r as (select *, row_number() over (partition by id order by round(d, 9), other) n from j) select id, other, round(d, 6) dist2, cast(n as integer) as rank from r where n <= 3""")
def nearest_neighbours(spark, d):
    """Three nearest neighbours by way of grid cells."""
    p = _places(spark, d)
    return joins.nearest_k(p, p, 3, 2.0, digits=9).select("id", "other", F.round("dist2", 6).alias("dist2"), "rank")


@query("""
with i as (select o_custkey, o_orderdate s, o_orderdate + to_days(30) t, o_orderkey k from orders)
select o.o_orderkey, i.k as holder from orders o join i on o.o_custkey = i.o_custkey and i.s <= o.o_orderdate and o.o_orderdate <= i.t""")
def range_join_days(spark, d):
    """All intervals of up to thirty days that hold at each row's time, joined by bucket of time."""
    o = table(spark, d, "orders")
    i = o.select("o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("t"), F.col("o_orderkey").alias("holder"))
    return joins.range_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), i, ["o_custkey"], "o_orderdate", "s", "t").select("o_orderkey", "holder")


# scalars


@query("""
with t as (select c_custkey, case c_custkey % 6 when 0 then '8(9' || lpad(cast(c_custkey as varchar), 2, '0') || ') ' || lpad(cast(c_custkey * 7919 % 10000000 as varchar), 7, '0') when 1 then '+7 9' || lpad(cast(c_custkey * 104729 % 1000000000 as varchar), 9, '0') when 2 then '9' || lpad(cast(c_custkey * 104729 % 1000000000 as varchar), 9, '0') when 3 then cast(c_custkey as varchar) when 4 then ' ' else '4420' || lpad(cast(c_custkey as varchar), 8, '0') || 'x' end raw from customer),
d as (select *, regexp_replace(raw, '\\D', '', 'g') g from t), e as (select *, case when length(g) = 10 then '7' || g else g end h from d), f as (select *, case when length(h) = 11 and h like '8%' then '7' || substr(h, 2) else h end k from e)
select c_custkey, case when length(k) between 7 and 15 then k end msisdn from f""")
def msisdn_normalise(spark, d):
    """Dirty phone numbers in canonical form."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    m = k % 6
    raw = (
        F.when(m == 0, F.concat(F.lit("8(9"), F.when(F.length(s(k)) > 2, F.substring(s(k), 1, 2)).otherwise(F.lpad(s(k), 2, "0")), F.lit(") "), F.lpad(s(k * 7919 % 10000000), 7, "0")))
        .when(m == 1, F.concat(F.lit("+7 9"), F.lpad(s(k * 104729 % 1000000000), 9, "0")))
        .when(m == 2, F.concat(F.lit("9"), F.lpad(s(k * 104729 % 1000000000), 9, "0")))
        .when(m == 3, s(k)).when(m == 4, " ").otherwise(F.concat(F.lit("4420"), F.lpad(s(k), 8, "0"), F.lit("x")))
    )
    return table(spark, d, "customer").select("c_custkey", S.msisdn(raw).alias("msisdn"))


@query("""
with t as (select c_custkey, case when c_custkey % 5 = 0 then '208' else '250' end || '-' || lpad(cast(c_custkey % 100 as varchar), 2, '0') || lpad(cast(c_custkey * 7919 % 10000000000 as varchar), case when c_custkey % 3 = 0 then 5 else 10 end, '0') raw from customer), g as (select c_custkey, regexp_replace(raw, '\\D', '', 'g') g from t)
select c_custkey, case when length(g) between 14 and 15 then g end imsi, case when length(g) >= 10 then cast(g as bigint) end imsi_long, case when substr(g, 1, 3) = '250' then cast(substr(g, 4, 2) as bigint) end operator_id, case when length(g) >= 8 then substr(g, 1, 8) end tac from g""")
def subscriber_identifiers(spark, d):
    """IMSI in both lengths, operator and TAC."""
    k = F.col("c_custkey")
    n = (k * 7919 % 10000000000).cast("string")
    raw = F.concat(F.when(k % 5 == 0, "208").otherwise("250"), F.lit("-"), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 3 == 0, F.lpad(n, 5, "0")).otherwise(F.lpad(n, 10, "0")))
    return table(spark, d, "customer").select("c_custkey", S.imsi(raw).alias("imsi"), S.digits_to_long(raw, 10).alias("imsi_long"), S.operator_of_imsi(raw).alias("operator_id"), S.tac_of_imei(raw).alias("tac"))


@query("""
with t as (select l_orderkey, l_linenumber, '250' mcc, cast(l_partkey % 100 as varchar) mnc, case when l_orderkey % 9 = 0 then 'ERR' else cast(l_suppkey as varchar) end lac, case when l_orderkey % 8 = 0 then null else l_partkey end cell from lineitem)
select l_orderkey, l_linenumber, coalesce(try_cast(mcc as bigint), 0) * 10000000000000 + coalesce(try_cast(mnc as bigint), 0) * 100000000000 + coalesce(try_cast(lac as bigint), 0) * 1000000 + coalesce(cell, 0) as cgi from t""")
def cell_keys(spark, d):
    """One number of a cell's four parts."""
    li = table(spark, d, "lineitem")
    lac = F.when(F.col("l_orderkey") % 9 == 0, "ERR").otherwise(F.col("l_suppkey").cast("string"))
    cell = F.when(F.col("l_orderkey") % 8 != 0, F.col("l_partkey"))
    return li.select("l_orderkey", "l_linenumber", S.cgi(F.lit("250"), (F.col("l_partkey") % 100).cast("string"), lac, cell).alias("cgi"))


@query("""
with t as (select n_nationkey, case when n_nationkey % 3 = 0 then translate(upper(substr(n_name, 1, 2)), 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ') else ' ' || lower(substr(n_name, 1, 2)) end code, cast(n_nationkey * 13 as varchar) num, case n_nationkey % 4 when 0 then lpad(cast(n_nationkey % 28 + 1 as varchar), 2, '0') || '.03.2021' when 1 then cast(n_nationkey % 28 + 1 as varchar) || '/7/2020' when 2 then 'soon' else '2019-01-' || lpad(cast(n_nationkey % 28 + 1 as varchar), 2, '0') end as "day" from nation)
select n_nationkey, translate(upper(trim(code)), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX') alpha2, right('000' || num, 3) numeric_code, right('00000000' || num, 8) tac,
case n_nationkey % 4 when 0 then '2021-03-' || substr("day", 1, 2) when 1 then '2020-07-' || lpad(split_part("day", '/', 1), 2, '0') when 3 then "day" end allocation_date from t""")
def dimension_codes(spark, d):
    """Country codes with look-alike letters, padded numbers, dates in several forms."""
    n = F.col("n_nationkey")
    two = F.substring("n_name", 1, 2)
    code = F.when(n % 3 == 0, F.translate(F.upper(two), "ABEKMHOPCTYX", "АВЕКМНОРСТУХ")).otherwise(F.concat(F.lit(" "), F.lower(two)))
    num, dd = (n * 13).cast("string"), (n % 28 + 1).cast("string")
    day = F.when(n % 4 == 0, F.concat(F.lpad(dd, 2, "0"), F.lit(".03.2021"))).when(n % 4 == 1, F.concat(dd, F.lit("/7/2020"))).when(n % 4 == 2, "soon").otherwise(F.concat(F.lit("2019-01-"), F.lpad(dd, 2, "0")))
    return table(spark, d, "nation").select("n_nationkey", S.latin_code(code).alias("alpha2"), S.last_digits(num, 3).alias("numeric_code"), S.last_digits(num, 8).alias("tac"), S.flexible_date(day).alias("allocation_date"))


@query("""
select event_id, strftime(ts, '%Y%m%d%H%M%S') started, time_bucket(interval '5 minutes', ts) bucket_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' bucket_end, ts - to_hours(cast(event_id % 13 as integer)) utc, date_trunc('second', ts) parsed, strftime(ts, '%Y-%m') as month, cast(hour(ts) as integer) as hour from events""")
def time_functions(spark, d):
    """Buckets, local time to UTC, fourteen-digit times."""
    started = F.date_format("ts", "yyyyMMddHHmmss")
    return table(spark, d, "events").select("event_id", started.alias("started"), S.floor_to("ts").alias("bucket_start"), S.bucket_end("ts").alias("bucket_end"), S.local_to_utc("ts", F.col("event_id") % 13).alias("utc"), S.event_time(started).alias("parsed"), F.date_format("ts", "yyyy-MM").alias("month"), F.hour("ts").alias("hour"))


@query("""select event_id, strftime(ts, '%Y%m%d%H%M%S') started from events where event_id % 17 <> 0 and strftime(ts, '%Y%m%d') = '20240110' and event_type = 'click'""")
def report_day_slack(spark, d):
    """A mart's rows of one report day with well-formed times."""
    s = F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.date_format("ts", " yyyyMMddHHmmss"))
    k = F.col("event_id")
    mart = table(spark, d, "events").where("event_type = 'click'").select(s.alias("Started"), k.alias("IMSI"), k.alias("IMEI"), k.alias("CallingNumber"), F.lit("25001").alias("OwnerMCCMNC"), F.lit(1).alias("BSStartLac"), F.lit(1).alias("BSStartCell"))
    return events.normalise_mart(mart, "cdr", date(2024, 1, 10)).select(F.col("imsi").cast("long").alias("event_id"), F.col("event_timestamp").alias("started"))


@query("""
with t as (select c_custkey, date '1900-01-01' + cast(c_custkey * 37 % 50000 as integer) b from customer), y as (select *, floor(date_diff('day', b, date '2024-05-01') / 365.2425) a from t)
select c_custkey, case when a between 0 and 120 then cast(cast(a as integer) as varchar) else 'U' end age from y""")
def age_at_month_start(spark, d):
    birth = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("c_custkey") * 37 % 50000).cast("int"))
    return table(spark, d, "customer").select("c_custkey", S.age_at(birth, F.lit("2024-05-01").cast("date")).alias("age"))


_PEOPLE = """t as (select c_custkey, case c_custkey % 5 when 0 then 'Иванова' when 1 then 'Petrov' when 2 then 'nan' when 3 then 'Алиев' else 'Smith' end as "last", case c_custkey % 7 when 0 then 'Анна' when 1 then 'Олег' when 2 then '' when 3 then 'Мария' else 'John' end as "first",
case c_custkey % 6 when 0 then 'Ивановна' when 1 then 'Петрович' when 2 then 'Кызы' when 3 then 'Оглы' else null end as "second", case c_custkey % 8 when 0 then 'ОВД района' when 1 then 'Kazakhstan office' when 2 then 'embassy of china' else '' end dept, case c_custkey % 9 when 0 then 'паспорт РФ 4010' when 1 then 'German passport' when 2 then 'КНР' else '' end doc from customer)"""


def _people(spark, d):
    k = F.col("c_custkey")

    def pick(n, *values):
        out = F.when(k % n == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:-1], 1):
            out = out.when(k % n == i, F.lit(v))
        return out.otherwise(F.lit(values[-1]))

    return table(spark, d, "customer").select(
        "c_custkey", pick(5, "Иванова", "Petrov", "nan", "Алиев", "Smith").alias("last"), pick(7, "Анна", "Олег", "", "Мария", "John").alias("first"), pick(6, "Ивановна", "Петрович", "Кызы", "Оглы", None).cast("string").alias("second"),
        pick(8, "ОВД района", "Kazakhstan office", "embassy of china", "").alias("dept"), pick(9, "паспорт РФ 4010", "German passport", "КНР", "").alias("doc"),
    )


@query(f"""with {_PEOPLE}, n as (select c_custkey, lower(case when "last" = 'nan' then '' else "last" end) l, lower("first") f, lower(coalesce("second", '')) s, lower(dept) o, lower(doc) p from t),
m as (select *, trim(l || ' ' || f || ' ' || s) names from n)
select c_custkey, case when s like '%вна' or s like '%ична' or s like '%кызы' then 'F' when s like '%вич' or s like '%оглы' then 'M' when f like '%а' or f like '%я' then 'F' when f <> '' then 'M' else 'U' end gender,
coalesce(case when o like '%овд%' then '643' when o like '%kaz%' then '398' when o like '%china%' then '156' end, case when p like '%паспорт рф%' then '643' when p like '%кнр%' then '156' when p like '%german passport%' then '276' end,
case when names like '%smith%' and false then '0' end, case when (names like '%вич%' or names like '%вна%' or names like '%оглы%' or names like '%кызы%') and o = '' and p = '' then '643' end, 'U') citizenship from m""")
def gender_citizenship(spark, d):
    """Demographic classifiers by cascades of tokens."""
    codes = {"RU": "643", "KZ": "398", "CN": "156", "DE": "276"}
    return _people(spark, d).select("c_custkey", S.gender("first", "second").alias("gender"), S.citizenship("dept", "doc", "first", "second", "last", codes).alias("citizenship"))


@query(f"""with {_PEOPLE} select c_custkey, case when "last" <> 'nan' and "first" <> '' then 'bio:' || lower("last") || '|' || lower("first") || '|' || lower(coalesce("second", '')) || '|1990-01-01|' || regexp_replace(doc, '\\D', '', 'g') end bio,
'prs_' || substr(sha256(case when "last" <> 'nan' and "first" <> '' then 'bio:' || lower("last") || '|' || lower("first") || '|' || lower(coalesce("second", '')) || '|1990-01-01|' || regexp_replace(doc, '\\D', '', 'g') else 'x' end), 1, 24) person_id from t""")
def biographic_keys(spark, d):
    bio = S.bio_key("last", "first", "second", F.lit("1990-01-01").cast("date"), "doc")
    return _people(spark, d).select("c_custkey", bio.alias("bio"), S.person_id(F.coalesce(bio, F.lit("x"))).alias("person_id"))


@query("""
with t as (select p_partkey k, p_size::double s, substr(p_brand, -1) b from part), u as (select k, s, case when k % 4 = 0 then 'metro hall' when k % 4 = 1 then 'Indoor unit' when k % 4 = 2 then 'pico' else null end kind, case when k % 5 = 0 then null else s * 3 end power, case when k % 6 = 0 then 500.0 else s end height, s * 20 az, s - 3 ang from t),
v as (select *, case when lower(kind) like '%metro%' then 'm' when lower(kind) like '%indoor%' then 'i' when lower(kind) like '%pico%' then 'f' else 'o' end bs from u),
w as (select *, least(coalesce(power, case bs when 'm' then 22.0 when 'i' then 6.0 when 'f' then 1.5 else 42.0 end), 150.0) pv, greatest(-50.0, least(240.0, height)) hv, case bs when 'm' then 0.2 when 'i' then 0.1 when 'f' then 0.05 else 5.0 end::double r, (case when abs(ang) < 1 then 120.0 else least(abs(ang), 359.0) end) a from v),
x as (select *, greatest(120.0, r * 850) * least(1.48, greatest(0.72, 1 + 0.18 * ln(1 + pv / 15))) * (1 + least(0.32, greatest(0, hv) / 120) * 0.11) * greatest(0.68, 1 - least(0.22, least(35.0, s) / 28 * 0.16)) * (case k % 3 when 0 then 1.08 else 1.0 end) reach from w)
select k p_partkey, bs bs_type, pv power_v, hv height_v, r radius_km, a sector_angle, round(az - 360 * floor(az / 360), 5) azimuth, round(case when bs in ('m', 'i', 'f') then greatest(80.0, least(reach, 900.0)) else greatest(120.0, least(reach, 42000.0)) end, 4) reach_m from x""")
def radio_reach(spark, d):
    """Kind of site, validated radio fields and reach of a cell."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 4 == 0, "metro hall").when(k % 4 == 1, "Indoor unit").when(k % 4 == 2, "pico").alias("kind"), F.when(k % 5 != 0, s * 3).alias("power"), F.when(k % 6 == 0, 500.0).otherwise(s).alias("height"), s.alias("tilt"), (s * 20).alias("az"), (s - 3).alias("ang"), F.when(k % 3 == 0, "A").otherwise("q").alias("rad"))
    p = p.withColumn("bs_type", S.site_type("kind", F.lit(None), F.lit(None))).withColumn("power_v", S.valid_power("power", "bs_type")).withColumn("height_v", S.valid_height("height", "bs_type")).withColumn("radius_km", S.sector_radius_km("bs_type"))
    reach = S.reach_m("radius_km", "power_v", "height_v", S.median_tilt("tilt"), "bs_type", S.radiation_factor("rad"))
    return p.select("p_partkey", "bs_type", "power_v", "height_v", "radius_km", S.sector_angle("ang").alias("sector_angle"), S.azimuth("az").alias("azimuth"), F.round(reach, 4).alias("reach_m"))


# aggregates and windows


@query("""
with t as (select user_id, time_bucket(interval '1 day', ts) b, event_type, event_id, case when event_id % 4 = 0 then 'i' else 'o' end kind from events), m as (select *, max(case when kind <> 'o' then 1 else 0 end) over (partition by user_id, b) any_in from t)
select user_id, b as bucket, event_id, kind from m where not (any_in = 1 and kind = 'o')""")
def indoor_arbitration(spark, d):
    """Outdoor rows go from buckets that have an indoor one."""
    e = table(spark, d, "events").select("user_id", S.floor_to("ts", 86400).alias("bucket"), "event_id", F.when(F.col("event_id") % 4 == 0, "i").otherwise("o").alias("kind"))
    return ST.indoor_first(e, ["user_id", "bucket"], "kind")


@query("""
with e as (select event_id, user_id, time_bucket(interval '1 day', ts) b, (event_id * 7 % 50) / 1000.0::double + 55 lat, (event_id * 11 % 70) / 1000.0::double + 37 lon from events),
j as (select x.event_id, x.user_id, x.b, avg(case when x.lat <> y.lat and x.lon <> y.lon then 2 * 6371000.0 * asin(least(1, sqrt(greatest(0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))) end) m from e x join e y on x.user_id = y.user_id and x.b = y.b group by all),
c as (select *, (select count(distinct round(k.m, 3)) from j k where k.user_id = j.user_id and k.b = j.b) n from j)
select event_id, round(m, 2) mean_distance, n as distinct_means from c where coalesce(m, 0) < case when n = 1 then 40000000 else 3500 end""")
def outlier_distance_filter(spark, d):
    """Places far from the others of their bucket go."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", S.floor_to("ts", 86400).alias("b"), (k * 7 % 50 / 1000.0 + 55).alias("lat"), (k * 11 % 70 / 1000.0 + 37).alias("lon"))
    return ST.distance_filter(e, ["user_id", "b"], ["event_id"], "lat", "lon", digits=3).select("event_id", F.round("mean_distance", 2).alias("mean_distance"), F.col("distinct_means"))


@query("""
with w as (select l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) w from lineitem group by all), best as (select l_orderkey, arg_max(row(l_returnflag, l_linestatus), row(w, l_returnflag, l_linestatus)) m from w group by 1),
c as (select l_orderkey, round(sum(l_partkey * l_quantity) / sum(l_quantity), 6) x, round(sum(l_suppkey * l_quantity) / sum(l_quantity), 6) y, list_sort(list(distinct cast(l_suppkey as varchar))) cells from lineitem group by 1)
select l_orderkey, x, y, array_to_string(cells, ',') cells, m[1] code_1, m[2] code_2 from c join best using (l_orderkey)""")
def weighted_centroid_mode(spark, d):
    """Weighted centre, weighted mode of a pair, sorted distinct list."""
    out = ST.weighted_summary(table(spark, d, "lineitem").withColumn("cell", F.col("l_suppkey").cast("string")), ["l_orderkey"], "l_quantity", {"x": "l_partkey", "y": "l_suppkey"}, ["l_returnflag", "l_linestatus"], "cell")
    return out.select("l_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.array_join("cells", ",").alias("cells"), F.col("l_returnflag").alias("code_1"), F.col("l_linestatus").alias("code_2"))


_CELLS = "pt as (select c cell, (c * 7 % 13)::double lat, (c * 5 % 11)::double lon from range(0, 40) t(c))"


@query(f"""
with {_CELLS}, e as (select event_id, user_id, ts, case when event_id % 3 = 0 then null when event_id % 10 = 1 then 1000 + event_id % 5 else event_id * 17 % 40 end cgi from events),
k as (select *, cgi is not null and cgi < 40 known, row_number() over (partition by user_id order by ts, event_id) pos from e),
a as (select *, last_value(case when known then pos end ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding) bp, last_value(case when known then cgi end ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding) bc,
 first_value(case when known then pos end ignore nulls) over (partition by user_id order by pos rows between 1 following and unbounded following) ap, first_value(case when known then cgi end ignore nulls) over (partition by user_id order by pos rows between 1 following and unbounded following) ac from k),
q as (select distinct bc, ac, (pos - bp)::double / (ap - bp) f from a where not known and bp is not null and ap is not null and bc <> ac),
s as (select q.*, p.cell, x.lat lat0, x.lon lon0, y.lat - x.lat dlat, y.lon - x.lon dlon, p.lat, p.lon from q join pt x on x.cell = bc join pt y on y.cell = ac cross join pt p),
r as (select *, case when dlat * dlat + dlon * dlon > 0 then ((lat - lat0) * dlat + (lon - lon0) * dlon) / (dlat * dlat + dlon * dlon) else 0.5 end pr from s),
c as (select bc, ac, f, arg_min(cell, row(case when pr between -0.2 and 1.2 then 0 else 1 end, (lat - (lat0 + dlat * f)) * (lat - (lat0 + dlat * f)) + (lon - (lon0 + dlon * f)) * (lon - (lon0 + dlon * f)) + abs(pr - f) * 0.01, cell)) chosen from r group by all)
select event_id, case when known or bp is null or ap is null then cgi when a.bc = a.ac then a.bc else chosen end cgi from a left join c on a.bc = c.bc and a.ac = c.ac and (pos - bp)::double / (ap - bp) = c.f and not known""")
def impute_between_anchors(spark, d):
    """Missing and unknown cells between two known ones."""
    points = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") * 7 % 13).cast("double").alias("lat"), (F.col("id") * 5 % 11).cast("double").alias("lon"))
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(k % 3 == 0, None).when(k % 10 == 1, 1000 + k % 5).otherwise(k * 17 % 40).alias("cgi"))
    return impute.impute_between(e, points, "user_id", ["ts", "event_id"]).select("event_id", "cgi")


@query("with p as (select l_suppkey cell, median(l_quantity) lat, median(l_discount) lon from lineitem group by 1) select cell, round(lat, 6) lat, round(lon, 6) lon from p")
def median_points(spark, d):
    """Median place of each cell."""
    p = impute.cell_points(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_discount")
    return p.select("cell", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("select o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) top_order, max(o_totalprice) top_price, any_value(n) sim_count from orders join (select o_custkey, count(distinct o_orderstatus || '|' || o_orderpriority) n from orders group by 1) using (o_custkey) group by 1")
def arg_max_and_composite_distinct(spark, d):
    """The row of the greatest value, and a count of distinct pairs."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("top_order"), F.col("o_totalprice").alias("top_price"))
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("sim_count"))
    return scd.latest(o, ["o_custkey"], ["top_price", "top_order"]).join(n, "o_custkey")


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1")
def first_row_per_group(spark, d):
    """The latest row of each key."""
    return scd.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""with c as (select cast(ts as date) as day, count(*) filter (where event_type = 'click') cdr, count(*) filter (where event_type = 'purchase') sms, count(*) filter (where event_type = 'view') gprs, count(*) filter (where event_type = 'signup') as location from events where event_type <> 'error' group by 1)
select *, cdr + sms + gprs + location total, round(gprs / nullif(cdr + sms + gprs + location, 0), 6) gprs_share, round(location / greatest(gprs, 1), 6) location_to_gprs from c""")
def daily_traffic_mix(spark, d):
    """Rows of each mart by day, the share of data sessions and location rows for each of them."""
    kind = F.when(F.col("event_type") == "click", "cdr").when(F.col("event_type") == "view", "gprs").when(F.col("event_type") == "purchase", "sms").otherwise("location")
    counts = table(spark, d, "events").where("event_type <> 'error'").groupBy(F.to_date("ts").alias("day"), kind.alias("mart")).agg(F.count("*").alias("n"))
    return suites.traffic_mix(counts)


@query("""select 'l_quantity' column_name, count(l_quantity) n, count(*) - count(l_quantity) nulls, min(l_quantity) as min, quantile_cont(l_quantity, 0.5) p50, quantile_cont(l_quantity, 0.95) p95, max(l_quantity) as max, round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) std from lineitem
union all select 'l_discount', count(l_discount), 0, min(l_discount), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.95), max(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) from lineitem""")
def profile_numeric(spark, d):
    p = profile.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return p.select("column_name", "n", "nulls", "min", "p50", "p95", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("with t as (select case when event_id % 9 = 0 then '<NA>' else event_type end v from events) select v as value, count(*) n, round(count(*) * 100.0 / (select count(*) from events), 4) pct from t group by v order by n desc, v limit 4")
def profile_categorical(spark, d):
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))
    return profile.value_counts(e, "event_type", 4)


@query("""select label, round(v, 6) as value from (select unnest([row('min', min(value)), row('max', max(value)), row('mean', avg(value)), row('p25', quantile_cont(value, 0.25)), row('p50', quantile_cont(value, 0.5)), row('p75', quantile_cont(value, 0.75)), row('p95', quantile_cont(value, 0.95)), row('p99', quantile_cont(value, 0.99))]) r from events) t(r), lateral (select r[1] as label, r[2] as v) union all select * from (select event_type, count(*)::double from events group by 1 order by 2 desc, 1 limit 3)""")
def adaptive_distribution(spark, d):
    """Summary of a numeric column, top values of another."""
    e = table(spark, d, "events")
    return profile.adaptive_distribution(e, "value").unionByName(profile.adaptive_distribution(e, "event_type", top=3)).select("label", F.round("value", 6).alias("value"))


@query("select * from (select 'ts' column_name, avg(case when ts is null then 1.0 else 0 end) null_rate from events union all select 'value', round(avg(case when event_id % 7 = 0 then 1.0 else 0 end), 9) from events union all select 'absent', 1.0)")
def null_rates(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return profile.null_rates(e, ["ts", "value", "absent"]).select("column_name", F.round("null_rate", 9).alias("null_rate"))


@query("select 'user_id' column_name, count(distinct user_id) n_distinct from events union all select 'event_type', count(distinct event_type) from events union all select 'props', count(distinct props) from events")
def cardinality(spark, d):
    return profile.cardinality(table(spark, d, "events"), ["user_id", "event_type", "props"])


@query("with g as (select count(*) n from (select case when user_id % 5 = 0 then null else user_id end u, event_type, cast(ts as date) from events) group by all) select cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) duplicate_rows, count(*) filter (where n > 1) duplicate_keys from (select count(*) n from (select case when user_id % 5 = 0 then null else user_id end u, event_type t, cast(ts as date) d from events) group by u, t, d)")
def duplicate_rows(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("u"), "event_type", F.to_date("ts").alias("day"))
    return profile.duplicate_rows(e, ["u", "event_type", "day"])


@query("select a, o_orderpriority b, count(*) n, round(count(*) * 100.0 / (select count(*) from orders), 4) pct from (select case when o_orderkey % 6 = 0 then null else o_orderstatus end a, o_orderpriority from orders) group by all")
def cross_table(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b"))
    return profile.cross_tab(o, "a", "b")


@query("select case when n <= 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' else '>20' end as bucket, count(*) n_groups from (select count(*) n from lineitem group by l_orderkey) group by 1")
def event_count_buckets(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return c.groupBy(S.count_bucket("n").alias("bucket")).agg(F.count("*").alias("n_groups"))


@query("select quantile_cont(n, 0.5) p50, quantile_cont(n, 0.95) p95, max(n) as max from (select count(*) n from orders group by o_custkey)")
def rows_per_site_quantiles(spark, d):
    return profile.nested_count_quantiles(table(spark, d, "orders"), ["o_custkey"])


@query("select cast(hour(ts) as integer) as hour, count(*) n from events group by 1")
def hour_histogram(spark, d):
    return profile.hour_histogram(table(spark, d, "events"), F.hour("ts"))


@query("with p as (select distinct cast(ts as date) as day from events where day(ts) % 4 <> 0) select cast(g as date) as day from (select unnest(generate_series((select min(day) from p)::timestamp, (select max(day) from p)::timestamp, interval 1 day)) g) where cast(g as date) not in (select day from p)")
def calendar_coverage(spark, d):
    """Days between the first and last that have no row."""
    return profile.missing_days(table(spark, d, "events").where(F.dayofmonth("ts") % 4 != 0), F.to_date("ts"))


@query("""select event_id as line, 'c' || event_id % 7 check_name, case when event_id % 3 = 0 then 'failed' else 'ok' end status, cast(json_extract_string(props, '$.k') as double) k from events where event_id % 5 <> 0""")
def log_json_parse(spark, d):
    """Checks and their figures out of log lines; lines of another tag, and broken ones, go."""
    k = F.col("event_id")
    payload = F.concat(F.lit('{"tag":"'), F.when(k % 5 == 0, "OTHER").otherwise("DQ"), F.lit('","check":"c'), (k % 7).cast("string"), F.lit('","status":"'), F.when(k % 3 == 0, "failed").otherwise("ok"), F.lit('","metrics":'), F.col("props"), F.lit("}"))
    lines = table(spark, d, "events").select(F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), F.lit("dq"), payload).alias("value"), k.alias("line"))
    lines = lines.unionByName(spark.createDataFrame([("free text", -1), ("a | b | c | {broken", -2)], "value string, line bigint"))
    return files.parse_log(lines, "DQ").select("line", "check_name", "status", F.col("metrics")["k"].cast("double").alias("k"))


@query("select event_id, sum(case when event_type in ('signup', 'error') then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding)::bigint run from events")
def log_run_ids(spark, d):
    """Runs of several logs, each begun by a line of one of two boundaries, in the order of lines."""
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.col("event_type").alias("check_name"))
    return runner.number_runs(log, ("signup", "error")).select("event_id", F.col("run").cast("long").alias("run"))


@query("select doc_id, len(list_filter(string_split(replace(text, ' ', chr(17)), chr(17)), lambda x: trim(x, ' ') <> '')) n_entries from documents")
def service_list_counts(spark, d):
    """Entries of lists joined by U+0011, blank ones left out."""
    return table(spark, d, "documents").select("doc_id", F.size(S.service_entries(F.translate("text", " ", "\x11"))).cast("long").alias("n_entries"))


@query("select 'union' op, count(*) n from (select o_custkey from orders union all select c_custkey from customer) union all select 'intersect', count(*) from (select o_custkey from orders intersect select c_custkey from customer where c_acctbal > 0) union all select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'distinct', count(*) from (select distinct o_custkey, o_orderstatus from orders)")
def set_operations(spark, d):
    """Union of all, intersection, difference, distinct pairs."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    ok, ck = o.select("o_custkey"), c.select("c_custkey")
    parts = {"union": ok.union(ck), "intersect": ok.intersect(c.where("c_acctbal > 0").select("c_custkey")), "except": ck.subtract(ok), "distinct": o.select("o_custkey", "o_orderstatus").distinct()}
    out = None
    for k, v in parts.items():
        one = v.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select event_id, n from (select event_id, row_number() over (order by ts, event_type, event_id) n from events) where n <= 100")
def stable_order_top(spark, d):
    """Total order by several keys, and its head."""
    top = table(spark, d, "events").orderBy("ts", "event_type", "event_id").limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy("ts", "event_type", "event_id")).cast("long").alias("n"))


@query("select time_bucket(interval '5 minutes', ts) bucket_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' bucket_end, event_type, count(*) n from events group by all")
def tumbling_counts(spark, d):
    """Tumbling five-minute counts, by the function that also runs on streams."""
    out = streams.tumbling_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), F.col("bucket_end").cast("timestamp_ntz").alias("bucket_end"), "event_type", "n")


# graph


_GRAPH = "e as (select 'c:' || o_custkey a, 'o:' || o_orderkey b from orders where o_custkey % 3 = 0 union all select 'o:' || o_orderkey, 'p:' || o_orderkey % 4001 from orders where o_orderkey % 5 = 0)"


@query(f"""with recursive {_GRAPH}, u as (select a, b from e union select b, a from e), c as (select a node, a as root from (select distinct a from u) union select u.b, c.root from c join u on c.node = u.a)
select node, min(root) root from c group by node""")
def connected_components(spark, d):
    """Components of an identifier graph, named after their least node."""
    return entity.connected_components(_graph(spark, d))


def _graph(spark, d):
    o = table(spark, d, "orders")
    order = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    a = o.where("o_custkey % 3 = 0").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("u"), order.alias("v"))
    return a.unionByName(o.where("o_orderkey % 5 = 0").select(order.alias("u"), F.concat(F.lit("p:"), (F.col("o_orderkey") % 4001).cast("string")).alias("v")))


@query("""
with k as (select c_custkey, 'bio:' || lower(c_name) cluster_key from customer), prev as (select 'bio:' || lower(c_name) cluster_key, 'prs_old' || c_custkey person_id from customer where c_custkey % 4 = 0)
select c_custkey, coalesce(p.person_id, 'prs_' || substr(sha256(k.cluster_key), 1, 24)) person_id from k left join prev p using (cluster_key)""")
def stable_person_id(spark, d):
    """Last period's id where the key was known, else a hash."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("bio:"), F.lower("c_name")).alias("cluster_key"))
    prev = c.where("c_custkey % 4 = 0").select("cluster_key", F.concat(F.lit("prs_old"), F.col("c_custkey").cast("string")).alias("person_id"))
    return entity.stable_ids(c, prev).select("c_custkey", "person_id")


# geography


@query(f"with {_PLACES} select a.id, b.id other, round(2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 2) meters from p a join p b on b.id = a.id % 17 + 1")
def haversine_pairs(spark, d):
    p = _places(spark, d)
    q = p.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, F.col("other") == F.col("id") % 17 + 1).select("id", "other", F.round(S.haversine("lat", "lon", "lat2", "lon2"), 2).alias("meters"))


_ZONES = [(2, "POLYGON((0 0,4.005 0,4.005 4.005,0 4.005,0 0),(1.005 1.005,2.005 1.005,2.005 2.005,1.005 2.005,1.005 1.005))"), (1, "MULTIPOLYGON(((3.005 3.005,8.005 3.005,8.005 7.005,3.005 7.005,3.005 3.005)),((9.005 9.005,10 9.005,10 10,9.005 9.005)))"), (3, "POLYGON((0 0,20 0,20 2.505,0 2.505,0 0))")]


@query(f"""with {_PLACES}, z as (select id, case when lon between 3.005 and 8.005 and lat between 3.005 and 7.005 or (lon >= 9.005 and lat >= 9.005 and lat <= lon and lon <= 10) then 1
 when lon <= 4.005 and lat <= 4.005 and not (lon > 1.005 and lon < 2.005 and lat > 1.005 and lat < 2.005) then 2 when lat <= 2.505 then 3 end as zone from p) select id, cast(zone as integer) as zone from z""")
def point_in_polygon(spark, d):
    """The first polygon, by code, that covers each point; holes, several parts and borders count."""
    zones = spark.createDataFrame(_ZONES, "code int, wkt string")
    return G.first_covering(_places(spark, d), zones, "id", "lon", "lat", "code", "wkt").select("id", F.col("code").alias("zone"))


@query(f"""with {_PLACES}, s as (select id, lon, lat, id % 360 az, 40 + id % 80 an from p), b as (select id, lon, lat, k, radians(az - an / 2.0 + k * (an / 18.0)) br from s, range(0, 19) t(k)),
r as (select id, 0 as i, round(lon, 6) x, round(lat, 6) y from s union all select id, k + 1, round(lon + 5.0 / (111.32 * greatest(0.01, cos(radians(lat)))) * sin(br), 6), round(lat + 5.0 / 111.32 * cos(br), 6) from b union all select id, 20, round(lon, 6), round(lat, 6) from s),
q as (select id, i, x, y, lead(x) over w x2, lead(y) over w y2, first_value(x) over w x0, first_value(y) over w y0 from r window w as (partition by id order by i)),
c as (select id, any_value(x0) x0, any_value(y0) y0, sum((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) / 2 a, sum(((x - x0) + (x2 - x0)) * ((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0))) sx, sum(((y - y0) + (y2 - y0)) * ((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0))) sy from q where x2 is not null group by id)
select id, round(abs(a) * 111.32 * 111.32 * greatest(0.01, cos(radians(y0 + sy / (6 * a)))), 3) area_km2, round(x0 + sx / (6 * a), 4) lon_c, round(y0 + sy / (6 * a), 4) lat_c from c""")
def sector_area_centroid(spark, d):
    """Wedge of a cell's sector, its area and centre."""
    p = _places(spark, d)
    ring = G.wedge(F.col("lon"), F.col("lat"), F.lit(5.0), (F.col("id") % 360).cast("double"), (40 + F.col("id") % 80).cast("double"))
    m = p.select("id", G.ring_metrics(ring).alias("m"))
    return m.select("id", F.round("m.area_km2", 3).alias("area_km2"), F.round("m.lon", 4).alias("lon_c"), F.round("m.lat", 4).alias("lat_c"))


# quality gates


@query("""with r as (select avg(case when value >= 5 then 1.0 else 0 end) a, avg(case when event_type in ('click', 'view', 'purchase', 'signup') then 1.0 else 0 end) b, avg(case when user_id is not null then 1.0 else 0 end) c, count(*) n from events)
select 'value_range' as check_name, case when a < .9 then 'failed' when a < .99 then 'warning' else 'ok' end status, round(a, 6) rate from r union all select 'known_type', case when b < .5 then 'failed' when b < .95 then 'warning' else 'ok' end, round(b, 6) from r union all select 'user_present', case when c < .99 then 'failed' when c < .995 then 'warning' else 'ok' end, round(c, 6) from r""")
def dq_rate_gates(spark, d):
    """Share of good rows against two limits, all checks in one pass."""
    checks = [dq.Gate("value_range", F.col("value") >= 5, 0.9, 0.99), dq.Gate("known_type", F.col("event_type").isin("click", "view", "purchase", "signup"), 0.5, 0.95), dq.Gate("user_present", F.col("user_id").isNotNull(), 0.99, 0.995)]
    return dq.rate_gates(table(spark, d, "events"), checks).select("check_name", "status", F.round("rate", 6).alias("rate"))


@query("""select case when sum(case when status = 'failed' then 1 else 0 end) > 0 then 'failed' when sum(case when status = 'warning' then 1 else 0 end) > 0 then 'warning' else 'ok' end status, count(*) checks from (select case when avg(case when l_discount <= 0.08 then 1.0 else 0 end) < .99 then 'warning' else 'ok' end status from lineitem union all select case when count(*) filter (where l_quantity < 1) > 0 then 'failed' else 'ok' end from lineitem union all select 'info')""")
def dq_overall_status(spark, d):
    """Worst of a suite's checks."""
    li = table(spark, d, "lineitem")
    rows = dq.rate_gates(li, [dq.Gate("discount", F.col("l_discount") <= 0.08, 0.0, 0.99)]).select("check_name", "status").unionByName(dq.count_gates(li, [dq.Limit("quantity", F.col("l_quantity") < 1, "failed")]).select("check_name", "status")).unionByName(spark.createDataFrame([("basic", "info")], "check_name string, status string"))
    return dq.summary(rows)
