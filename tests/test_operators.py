import random
import time
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from cellframe.operators import entity, geo, impute, intervals, islands, joins, profile, scd, stay

T0 = datetime(2024, 1, 1)
IV = "k string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def at(s):
    return T0 + timedelta(seconds=s)


def test_interleaved_rows_split_a_run(spark):
    rows = [("a", at(0), "x", 1, None), ("a", at(60), "y", 2, "q"), ("a", at(90), "x", 3, "r"), ("a", at(120), "x", 4, "s"), ("a", at(301), "x", 5, None), (None, at(0), "x", 6, None), (None, at(1), "x", 7, None)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz, kind string, id int, v string")
    got = islands.collapse_runs(df, ["u"], "ts", ["kind"], ["id"], first=["v"], null_breaks=["u"]).collect()
    assert sorted((r.u or "", r.kind, r.event_count, r.v or "") for r in got) == [("", "x", 1, ""), ("", "x", 1, ""), ("a", "x", 1, ""), ("a", "x", 1, ""), ("a", "x", 2, "r"), ("a", "y", 1, "q")]


def random_intervals(spark, seed, n=300):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), at(s := r.randrange(5000)), at(s + r.randrange(40))) for _ in range(n)]
    return spark.createDataFrame(rows, IV)


def test_coalesced_intervals_neither_overlap_nor_merge(spark):
    for seed in (1, 2):
        df = random_intervals(spark, seed)
        out = intervals.coalesce_intervals(df, ["k"], 1.0)
        assert intervals.overlap_count(out, ["k"]).first()[0] == 0 and intervals.mergeable_count(out, ["k"]).first()[0] == 0
        cover = lambda d: {(r.k, s) for r in d.collect() for s in range(int((r.valid_from - T0).total_seconds()), int((r.valid_to - T0).total_seconds()) + 1)}
        assert cover(df) <= cover(out)
    assert intervals.overlap_count(df, ["k"]).first()[0] > 0


def test_gap_of_one_and_two_seconds(spark):
    df = spark.createDataFrame([("a", at(0), at(10)), ("a", at(11), at(20)), ("a", at(22), at(30)), ("a", at(2), at(3))], IV)
    assert sorted((r.valid_from, r.valid_to) for r in intervals.coalesce_intervals(df, ["k"]).collect()) == [(at(0), at(20)), (at(22), at(30))]


def test_upsert_is_idempotent(spark):
    old, new = random_intervals(spark, 3), random_intervals(spark, 4, 40).where("valid_from between timestamp_ntz'2024-01-01 00:10:00' and timestamp_ntz'2024-01-01 00:20:00'")
    low, high = F.lit(at(600)).cast("timestamp_ntz"), F.lit(at(1240)).cast("timestamp_ntz")
    once = intervals.upsert_period(old, new, ["k"], low, high)
    twice = intervals.upsert_period(once, new, ["k"], low, high)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_value_flips_make_three_segments(spark):
    df = spark.createDataFrame([("a", at(0), "x"), ("a", at(5), "x"), ("a", at(9), "y"), ("a", at(12), "x"), ("a", at(14), None)], "k string, ts timestamp_ntz, v string")
    assert sorted((r.valid_from, r.valid_to, r.v) for r in intervals.segment_by_value(df, ["k"], "v", "ts").collect()) == [(at(0), at(5), "x"), (at(9), at(9), "y"), (at(12), at(12), "x")]


def test_night_gap(spark):
    day, night = 12 * 3600, 23 * 3600
    rows = [("a", at(day), at(day)), ("a", at(day + 360), at(day + 360)), ("a", at(night), at(night)), ("a", at(night + 1800), at(night + 1800)), (None, at(0), at(0))]
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz").withColumn("x", F.lit(1.0))
    assert sorted((r.s, r.e) for r in intervals.merge_similar_neighbours(df, ["k"], [], {"x": 1e-6}, "s", "e").collect()) == [(at(day), at(day)), (at(day + 360), at(day + 360)), (at(night), at(night + 1800))]


def test_version_join(spark):
    v = spark.createDataFrame([("c", at(100), at(200), 1), ("c", at(150), None, 2), ("c", at(90), at(95), 3), ("d", at(0), at(1), 4)], "c string, on timestamp_ntz, off timestamp_ntz, ver int")
    e = spark.createDataFrame([(1, "c", at(120)), (2, "c", at(180)), (3, "c", at(10)), (4, "d", at(50)), (5, "z", at(0)), (6, "c", at(97))], "id int, c string, t timestamp_ntz")
    got = {r.id: r.ver for r in joins.version_join(e, v, ["c"], "t", "on", "off").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 6: 1}
    assert {r.id: r.ver for r in joins.version_join(e, v, ["c"], "t", "on", "off", nearest=False).collect()} == {1: 1, 2: 2}


def test_version_join_against_loops(spark):
    """Overlapping, nested, equal, open, inverted and touching versions, events at and between all their ends."""
    r = random.Random(12)
    versions = [(r.choice("ab"), at(s := r.randrange(60)), r.choice([None, at(s), at(s + r.randrange(-3, 25)), at(s + r.randrange(60))]), n) for n in range(60)]
    events = [(n, r.choice("abz"), at(r.randrange(-10, 90) + r.choice([0, 0.5]))) for n in range(400)] + [(1000, None, at(3)), (1001, "a", None)]
    v, e = spark.createDataFrame(versions, "c string, on timestamp_ntz, off timestamp_ntz, ver int"), spark.createDataFrame(events, "id int, c string, t timestamp_ntz")
    want = {}
    for nearest in (True, False):
        for i, c, t in events:
            own = [x for x in versions if x[0] == c and t is not None]
            live = [x for x in own if x[1] <= t and (x[2] is None or t <= x[2])]
            best = min(live, key=lambda x: (-(x[1] - T0).total_seconds(), x[3]), default=None)
            if not best and nearest:
                best = min(own, key=lambda x: (abs((x[1] - t).total_seconds()), -(x[1] - T0).total_seconds(), x[3]), default=None)
            want[nearest, i] = best and best[3]
        got = {x.id: x.ver for x in joins.version_join(e, v, ["c"], "t", "on", "off", nearest=nearest, tie=["ver"]).collect()}
        assert got == {i: ver for (k, i), ver in want.items() if k == nearest and ver is not None}
    twice = joins.version_join(e.union(e), v, ["c"], "t", "on", "off", tie=["ver"])
    assert twice.count() == 2 * sum(ver is not None for (k, _), ver in want.items() if k)


def test_version_join_of_one_hot_key(spark):
    began = time.time()
    v = spark.range(10_000).select(F.lit("k").alias("c"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 10)).alias("on"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 10 + F.col("id") % 97)).alias("off"), F.col("id").alias("ver"))
    e = spark.range(100_000).select(F.col("id"), F.lit("k").alias("c"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("t"))
    out = joins.version_join(e, v, ["c"], "t", "on", "off", tie=["ver"])
    assert out.agg(F.count("*"), F.max(F.abs(F.col("ver") * 10 - F.col("id")))).first()[0] == 100_000 and time.time() - began < 60


def test_fills(spark):
    b = spark.createDataFrame([("m", "i1", at(0), at(10)), ("m", "i2", at(5), at(20)), ("n", None, at(0), at(9))], "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    e = spark.createDataFrame([(1, "m", None, at(3)), (2, "m", None, at(7)), (3, "m", "own", at(7)), (4, "m", None, at(50)), (5, None, None, at(3)), (6, "n", None, at(3))], "id int, k string, v string, t timestamp_ntz")
    want = {1: "i1", 2: "i2", 3: "own", 4: None, 5: None, 6: None}
    assert {r.id: r.v for r in joins.fill_from_intervals(e, b, "k", "v", "t").collect()} == want
    assert {r.id: r.v for r in joins.fill_at_instant(e, b, "k", "v", F.lit(at(7)).cast("timestamp_ntz")).collect()} == {1: "i2", 2: "i2", 3: "own", 4: "i2", 5: None, 6: None}


def test_fills_of_any_overlap_and_steps_only_where_needed(spark, monkeypatch):
    r = random.Random(9)
    held = [(r.choice("ab"), r.choice(["x", "y", "z", None]), s := at(r.randrange(400)), s + timedelta(seconds=r.choice([-5, 0, 3, 40, 300])) if r.random() < 0.95 else None) for _ in range(120)]
    asked = [(i, r.choice(["a", "b", "c", None]), "own" if i % 9 == 0 else None, None if i % 50 == 7 else at(r.randrange(-20, 800))) for i in range(400)]
    e, schema = spark.createDataFrame(asked, "id int, k string, v string, t timestamp_ntz"), "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    best = lambda k, t: max(((s, v) for c, v, s, u in held if c == k and t is not None and v is not None and u is not None and s <= t <= u), default=(None, None))[1]
    assert {x.id: x.v for x in joins.fill_from_intervals(e, spark.createDataFrame(held, schema), "k", "v", "t").collect()} == {i: v or best(k, t) for i, k, v, t in asked}
    # of intervals of one length none ends within an earlier one: one pass settles all
    monkeypatch.setattr(joins, "version_steps", None)
    held = [(k, v, s, s + timedelta(seconds=60)) for k, v, s, _ in held]
    assert {x.id: x.v for x in joins.fill_from_intervals(e, spark.createDataFrame(held, schema), "k", "v", "t").collect()} == {i: v or best(k, t) for i, k, v, t in asked}


def test_impute_against_loops(spark):
    r = random.Random(4)
    points = {c: (r.randrange(100) / 10, r.randrange(100) / 10) for c in range(15)}
    rows = [(u, k, r.choice([None, 99, *range(15)])) for u in ("a", "b") for k in range(40)] + [(None, 0, None)]
    want = {}
    for u in ("a", "b"):
        seq = [c for x, _, c in rows if x == u]
        for pos, c in enumerate(seq):
            before = [p for p in range(pos) if seq[p] in points]
            after = [p for p in range(pos + 1, len(seq)) if seq[p] in points]
            if c in points or not before or not after:
                want[u, pos] = c
                continue
            i, j = before[-1], after[0]
            f = (pos - i) / (j - i)
            (y0, x0), (y1, x1) = points[seq[i]], points[seq[j]]
            n = (y1 - y0) ** 2 + (x1 - x0) ** 2
            along = {q: ((y - y0) * (y1 - y0) + (x - x0) * (x1 - x0)) / n if n else 0.5 for q, (y, x) in points.items()}
            some = [q for q in points if -0.2 <= along[q] <= 1.2] or list(points)
            want[u, pos] = seq[i] if seq[i] == seq[j] else min(some, key=lambda q: ((points[q][0] - y0 - (y1 - y0) * f) ** 2 + (points[q][1] - x0 - (x1 - x0) * f) ** 2 + abs(along[q] - f) * 0.01, q))
    df = spark.createDataFrame(rows, "u string, k int, cgi bigint")
    pts = spark.createDataFrame([(c, *p) for c, p in points.items()], "cell bigint, lat double, lon double")
    got = {(x.u, x.k): x.cgi for x in impute.impute_between(df, pts, "u", ["k"]).collect() if x.u}
    assert got == want


def test_scd_has_one_open_version_for_each_live_key(spark):
    end, later = F.lit("2262-04-11").cast("timestamp_ntz"), F.lit("2024-03-01").cast("timestamp_ntz")
    one = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    two = spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "k int, v string")
    h0 = one.limit(0).withColumn("date_on", later).withColumn("date_off", end)
    h1 = scd.merge(h0, one, ["k"], ["v"], F.lit("2024-01-01").cast("timestamp_ntz"), end)
    h2 = scd.merge(h1, two, ["k"], ["v"], later, end)
    open_ = h2.where(F.col("date_off") == end)
    assert sorted((r.k, r.v or "") for r in open_.collect()) == [(1, "a"), (2, "x"), (4, "")]
    assert sorted(map(str, scd.merge(h2, two, ["k"], ["v"], later, end).collect())) == sorted(map(str, h2.collect()))
    assert h2.where("date_off < date_on").count() == 0 and h2.count() == 5


def test_components_and_clusters(spark):
    e = spark.createDataFrame([("msisdn:1", "imsi:1"), ("msisdn:1", "bio:z"), ("msisdn:2", "imsi:1"), ("msisdn:3", "iccid:9"), ("msisdn:4", "msisdn:4")], "u string, v string")
    c = entity.connected_components(e)
    roots = {r.node: r.root for r in c.collect()}
    assert roots["msisdn:2"] == roots["bio:z"] == "bio:z" and roots["msisdn:4"] == "msisdn:4" and roots["msisdn:3"] == "iccid:9"
    keyed = {r.root: (r.cluster_key, r.confidence) for r in entity.clusters(c).collect()}
    assert keyed == {"bio:z": ("bio:z", "high"), "iccid:9": ("iccid:9", "medium"), "msisdn:4": ("msisdn:4", "low")}


def test_polygons(spark):
    hole = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 5.0, 5.0), (5, 1.0, 1.5), (6, None, 1.0)], "id int, x double, y double")
    zones = spark.createDataFrame([(2, hole), (1, "MULTIPOLYGON(((3 3,6 3,6 6,3 6,3 3)),((10 10,11 10,11 11,10 10)))"), (3, "nonsense"), (4, None)], "code int, wkt string")
    assert {r.id: r.code for r in geo.first_covering(pts, zones, "id", "x", "y", "code", "wkt").collect()} == {1: 2, 2: None, 3: 2, 4: 1, 5: 2, 6: None}
    m = geo.wkt_metrics(zones.unionByName(spark.createDataFrame([(5, "POLYGON EMPTY"), (6, "POLYGON((0 0,1 0,1 1))"), (7, "POINT(1 1)")], "code int, wkt string")), "wkt").first()
    assert (m.present, m.parse_errors, m.wrong_type, m.empty, m.invalid) == (6, 1, 1, 1, 1)
    t = geo.territory(pts.withColumn("subject", F.lit(" East ")), spark.createDataFrame([(hole, 2, "01", "0101", "town"), ("POLYGON((0 0,9 0,9 9,0 9,0 0))", 1, None, "01", "West"), ("POLYGON((50 50,51 50,51 51,50 50))", 1, None, "02", "east")], "WKT string, level int, parent_code string, code string, name string"), "id", "x", "y", "subject")
    assert {r.id: (r.oktmo_code_1, r.oktmo_code_2) for r in t.collect()} == {1: ("01", "0101"), 2: ("02", None), 3: ("01", "0101"), 4: ("02", None), 5: ("01", "0101"), 6: ("02", None)}


def test_sector_and_circle(spark):
    lon, lat = F.lit(0.0), F.lit(0.0)
    r = spark.range(1).select(
        geo.rings_metrics(geo.sector_rings(lon, lat, F.lit(5.0), F.lit(90.0), F.lit(120.0), F.lit("x"))).alias("w"), geo.rings_metrics(geo.sector_rings(lon, lat, F.lit(0.1), F.lit(0.0), F.lit(120.0), F.lit("i"))).alias("c"),
        geo.rings_wkt(geo.sector_rings(lon, lat, F.lit(5.0), F.lit(0.0), F.lit(120.0), F.lit("o"))).alias("o"),
    ).first()
    assert abs(r.w.area_km2 - np.pi * 25 / 3) < 0.2 and r.w.lon > 0 and abs(r.w.lat) < 1e-4
    assert abs(r.c.area_km2 - np.pi * 0.01) < 0.001 and r.o.startswith("MULTIPOLYGON(((0.0 0.0,")


def test_voronoi_cells_part_the_plane():
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 5000, 60), r.uniform(0, 5000, 60)
    cells = geo.voronoi_cells(x, y, np.full(60, 900.0))
    inside = lambda p, u, v: all((b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0]) >= -1e-6 for a, b in zip(p, np.roll(p, -1, axis=0), strict=True))
    for u, v in r.uniform(0, 5000, (200, 2)):
        d = np.hypot(x - u, y - v)
        owners = [i for i in range(60) if len(cells[i]) and inside(cells[i], u, v)]
        assert owners in ([], [int(d.argmin())]) and (owners or d.min() > 880)
    a, b = geo.spread_duplicates(np.zeros(3), np.zeros(3), ["c", "a", "b"])
    assert len({*zip(a, b, strict=True)}) == 3


def test_distance_filter_and_indoor(spark):
    rows = [("b", 1, 55.0, 37.0, "o"), ("b", 2, 55.001, 37.001, "o"), ("b", 3, 55.002, 37.003, "o"), ("b", 4, 56.0, 38.0, "o"), ("c", 5, 55.0, 37.0, "o"), ("c", 6, 58.0, 39.0, "o"), ("d", 7, 1.0, 1.0, "i"), ("d", 8, 1.0, 2.0, "o")]
    df = spark.createDataFrame(rows, "k string, id int, lat double, lon double, t string")
    far = {r.id: r.mean_distance for r in stay.distance_filter(df, ["k"], ["id"], "lat", "lon").collect()}
    assert {5, 6, 7, 8} <= set(far) and 4 not in far
    assert {r.id for r in stay.indoor_first(df, ["k"], "t").collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_profiles(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0), (None, None)], "a string, b double")
    p = profile.numeric_profile(df, ["b"]).first()
    assert (p.n, p.nulls, p.p50, round(p.p95, 6), p.std) == (3, 1, 2.0, 2.9, 1.0)
    assert {r.label for r in profile.adaptive_distribution(df, "a").collect()} >= {"min", "p99"}
    assert {r.column_name: r.null_rate for r in profile.null_rates(df, ["a", "zz"]).collect()} == {"a": 0.25, "zz": 1.0}
    assert profile.duplicate_rows(df.union(df), ["a"]).first() == (8, 4)
    assert profile.sample_by_hash(df, "a", 2).count() == 2
    assert profile.null_rates(df.limit(0), ["a"]).first().null_rate == 1.0


def test_weighted_summary_of_zero_weight(spark):
    rows = [(1, 0.0, 4.0, "a", "x"), (2, 0.0, 4.0, "a", "x"), (2, 2.0, 6.0, "b", "y"), (3, 1.0, 5.0, "a", "x"), (3, -1.0, 3.0, "a", "x"), (4, None, 5.0, "a", "x")]
    df = spark.createDataFrame(rows, "k int, w double, v double, kind string, c string")
    got = {r.k: (r.m, r.kind) for r in stay.weighted_summary(df, ["k"], "w", {"m": "v"}, ["kind"], "c").collect()}
    assert np.isnan(got[1][0]) and got[1][1] == "a" and got[2] == (6.0, "b") and got[3][0] == float("inf") and got[4][0] is None


def test_segments_and_parts_are_read_off_one_sort(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([at(r.randrange(3000)), None]) if r.random() < 0.1 else at(r.randrange(3000)), r.choice([at(r.randrange(3000)), None]) if r.random() < 0.1 else at(r.randrange(3000))) for _ in range(250)]
    rows = [(k, s, t if s is None or t is None or r.random() < 0.1 else s + (t - T0) / 60) for k, s, t in rows]
    parts = {}
    for k, s, t in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or T0, x[2] is not None, x[2] or T0)):
        mine = parts.setdefault(k, [])
        reach = max((e for p in mine for _, e in p if e is not None), default=None)
        mine[-1].append((s, t)) if mine and reach is not None and s is not None and (s - reach).total_seconds() <= 2 else mine.append([(s, t)])
    some = lambda f, x: f((v for v in x if v is not None), default=None)
    want = sorted(((k, some(min, [s for s, _ in p]), some(max, [t for _, t in p])) for k, mine in parts.items() for p in mine), key=repr)
    got = intervals.coalesce_intervals(spark.createDataFrame(rows, IV), ["k"], 2)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    seen = spark.createDataFrame([(x[0], x[1], r.choice(["x", "y", None])) for x in rows], "k string, ts timestamp_ntz, v string")
    for out in (got, intervals.segment_by_value(seen, ["k"], "v", "ts")):
        assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_with_hubs(spark):
    r = random.Random(7)
    edges = [(f"n{r.randrange(400)}", f"n{r.randrange(400)}") for _ in range(260)] + [("a", f"n{i}") for i in range(0, 400, 40)] + [("z", f"q{i}") for i in range(60)] + [("q7", "z"), ("l", "l")]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for hub in (0, 5, 100_000):
        assert {x.node: x.root for x in entity.connected_components(spark.createDataFrame(edges, "u string, v string"), hub=hub).collect()} == root
    # a hub's edges meet its least node where they are
    star = spark.createDataFrame([("a", f"b{i}") for i in range(3000)], "u string, v string")
    met = entity._with_least(star, "u", star.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n")), 1000)
    assert met.count() == 3000 and "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
    assert entity.connected_components(star, hub=1000).where("root = 'a'").count() == 3001


def test_range_join_takes_intervals_of_any_length(spark):
    r = random.Random(8)
    ends = [(s, s + timedelta(microseconds=r.choice([0, 1, 999, 10**6, 86_400 * 10**6 * 30, 86_400 * 10**6 * 365 * 900]))) for s in (at(r.randrange(86400 * 60)) for _ in range(400))]
    iv = [(r.choice("abc"), s, t, i) for i, (s, t) in enumerate(ends)] + [("a", at(9), at(8), 900), (None, at(0), at(10**8), 901), ("a", at(0), None, 902), ("a", datetime(1, 1, 1), datetime(9999, 12, 31), 903)]
    ev = [(r.choice("abc"), r.choice([*ends[i], at(r.randrange(86400 * 90))]), i) for i in range(300)] + [("a", None, 900), (None, at(5), 901)]
    v = spark.createDataFrame(iv, "k string, s timestamp_ntz, t timestamp_ntz, holder int")
    e = spark.createDataFrame(ev, "k string, at timestamp_ntz, id int")
    began = time.time()
    got = sorted((x.id, x.holder) for x in joins.range_join(e, v, ["k"], "at", "s", "t").collect())
    assert time.time() - began < 60
    assert got == sorted((i, h) for k, a, i in ev for c, s, t, h in iv if k is not None and k == c and a is not None and t is not None and s <= a <= t)


def test_nearest_of_dense_cells_and_crowded_places(spark):
    r = random.Random(5)
    spots = [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(150)] + [(0.3 + r.gauss(0, 1e-3), 0.3 + r.gauss(0, 1e-3)) for _ in range(250)] + [(1.0, 1.0)] * 40 + [(0.25 * (i % 9), -0.25 * (i // 9)) for i in range(60)] + [(99.0, 99.0), (-50.0, 4.0), (-50.5, 4.0)]
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)] + [(9000, None, 1.0), (None, 1.0, 1.0)], "id int, lon double, lat double")
    for digits in (None, 9, 2):
        want = {}
        for i, (a, b) in enumerate(spots):
            far = [((a - c) ** 2 + (b - e) ** 2, j) for j, (c, e) in enumerate(spots) if i != j and abs(c // 2.0 - a // 2.0) <= 1 and abs(e // 2.0 - b // 2.0) <= 1]
            near = far if digits is None else [(Decimal(repr(d)).quantize(Decimal(10) ** -digits, ROUND_HALF_UP), j) for d, j in far]
            want |= {(i, n): j for n, (_, j) in enumerate(sorted(near)[:3], 1)}
        assert {(x.id, x.rank): x.other for x in joins.nearest_k(p, p, 3, 2.0, digits=digits).collect()} == want
    # 200 000 at one place: pairs would be 4 x 10^10
    crowd = spark.range(200_000).select("id", F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"))
    began = time.time()
    assert joins.nearest_k(crowd, crowd, 2, 2.0).agg(F.count("*"), F.max("other")).first() == (400_000, 2) and time.time() - began < 60


def test_nearest_and_tokens(spark):
    p = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id int, lon double, lat double")
    got = {(r.id, r.other) for r in joins.nearest_k(p, p, 2, 1.5).collect()}
    assert (0, 1) in got and (0, 5) in got and len([g for g in got if g[0] == 12]) == 2
    t = spark.createDataFrame([("bc", "second", 2), ("ab", "first", 1)], "token string, result string, priority int")
    df = spark.createDataFrame([(1, "xABC"), (2, "bcd"), (3, None), (4, "q")], "id int, s string")
    assert {r.id: r.result for r in joins.first_contained(df, "s", t).collect()} == {1: "first", 2: "second", 3: None, 4: None}
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert [(r.k, r.a, r.b) for r in joins.null_safe_join(a, b, ["k"]).collect()] == [(None, 1, 3)]
