"""Geometry with native expressions: WKT to rings, point in polygon, sectors, areas, centres; Voronoi cells by clipping.

A polygon in memory is ``array<struct<part:int, x:double, y:double, x2:double, y2:double>>``: the edges of all its rings. A point is
inside if a ray to the right crosses an odd number of edges (holes and several parts work by themselves); on an edge counts as inside.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.scalar import KM_PER_DEGREE, col

_POINT = r"(-?[\d.]+(?:[eE][+\-]?\d+)?)\s+(-?[\d.]+(?:[eE][+\-]?\d+)?)"


def edges(wkt) -> Column:
    """Edges of a POLYGON or MULTIPOLYGON text; null for what isn't one."""
    c = col(wkt)
    rings = F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring_edges(r: Column) -> Column:
        pts = F.transform(F.split(r, ","), lambda p: F.struct(F.regexp_extract(p, _POINT, 1).try_cast("double").alias("x"), F.regexp_extract(p, _POINT, 2).try_cast("double").alias("y")))
        return F.zip_with(F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts) - 1), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("x2"), b["y"].alias("y2")))

    ok = F.upper(F.trim(c)).rlike(r"^(MULTI)?POLYGON\s*\(") & (F.size(rings) > 0)
    return F.when(ok, F.flatten(F.transform(rings, ring_edges)))


def bounds(e: Column) -> Column:
    xs, ys = F.transform(e, lambda s: s["x"]), F.transform(e, lambda s: s["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def covers(e: Column, x: Column, y: Column) -> Column:
    """Whether the polygon of these edges holds the point, its border included."""
    def crosses(s):
        return ((s["y"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x"]) * (y - s["y"]) / (s["y2"] - s["y"]) + s["x"])

    def on(s):
        cross = (x - s["x"]) * (s["y2"] - s["y"]) - (y - s["y"]) * (s["x2"] - s["x"])
        return (F.abs(cross) < 1e-12) & x.between(F.least(s["x"], s["x2"]), F.greatest(s["x"], s["x2"])) & y.between(F.least(s["y"], s["y2"]), F.greatest(s["y"], s["y2"]))

    # edges level with the point can't cross: the division is never reached for them
    crossing = F.filter(e, lambda s: F.when((s["y"] > y) != (s["y2"] > y), crosses(s)).otherwise(F.lit(False)))
    return F.exists(e, on) | (F.size(crossing) % 2 == 1)


def prepare_zones(zones: DataFrame, order: str, wkt: str) -> DataFrame:
    """Zones with edges and bounding boxes, parsed once."""
    e = zones.withColumn("__e", edges(wkt)).where("__e is not null").withColumn("__b", bounds(F.col("__e")))
    return e.select(F.col(order).alias("__order"), *[c for c in zones.columns if c != wkt], "__e", "__b")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def first_covering(points: DataFrame, zones: DataFrame, id_col: str, x: str, y: str, order: str, wkt: str, size: float = 1.0) -> DataFrame:
    """Each point with the columns of the least zone by ``order`` that covers it, null if none does. ``order`` is a zone's key.

    Zones are laid on a grid of ``size`` degrees by their bounding boxes and meet points by grid cell; boxes part what remains, and only then
    the edges are fetched, by the zone's key, and walked.
    """
    z = prepare_zones(zones, order, wkt)
    kept = [c for c in z.columns if not c.startswith("__")]
    box = F.col("__b")
    span = lambda lo, hi: F.sequence(_cell(box[lo], size), _cell(box[hi], size))
    laid = z.select("__order", "__b", F.explode(span("x0", "x1")).alias("__gx")).withColumn("__gy", F.explode(span("y0", "y1")))
    px, py = F.col(x), F.col(y)
    p = points.select(id_col, px, py, _cell(px, size).alias("__gx"), _cell(py, size).alias("__gy")).where("__gx is not null and __gy is not null")
    near = p.join(laid, ["__gx", "__gy"]).where(px.between(box["x0"], box["x1"]) & py.between(box["y0"], box["y1"])).select(id_col, px, py, "__order")
    hit = near.join(z.drop("__b"), "__order").where(covers(F.col("__e"), px, py))
    best = hit.groupBy(id_col).agg(F.min_by(F.struct(*kept), "__order").alias("__z")).select(id_col, *[F.col(f"__z.{c}").alias(c) for c in kept])
    return points.join(best, id_col, "left")


def offset_of_subject(points: DataFrame, zones: DataFrame, id_col: str, x: str, y: str, subject: str, default: int = 3) -> DataFrame:
    """Adds ``utc_offset``: of the time zones named like the point's subject the first by ``code`` that covers it, else the first of them, else ``default``.

    ``zones``: code, name, timezone, geometry.
    """
    named = zones.select(F.lower(F.trim("name")).alias("__name"), "code", "timezone", "geometry").where("timezone is not null")
    first = named.groupBy("__name").agg(F.min_by("timezone", "code").alias("__first"))
    p = points.select(id_col, x, y, F.lower(F.trim(F.col(subject).cast("string"))).alias("__name")).where("__name is not null")
    shaped = named.withColumn("__e", edges("geometry")).where("__e is not null").drop("geometry")
    hit = p.join(shaped, "__name").where(covers(F.col("__e"), F.col(x), F.col(y))).groupBy(id_col).agg(F.min_by("timezone", "code").alias("__hit"))
    best = p.join(first, "__name").join(hit, id_col, "left").select(id_col, F.coalesce("__hit", "__first").cast("int").alias("__offset"))
    return points.join(best, id_col, "left").withColumn("utc_offset", F.coalesce("__offset", F.lit(default))).drop("__offset")


def sample_in_zones(zones: DataFrame, key: str, wkt: str, n: int, seed: int = 0, tries: int = 64) -> DataFrame:
    """``key, k, lon, lat``: up to n points inside each zone, drawn from its bounding box by hash, the same at every run.

    A point is the first of ``tries`` draws that the zone covers; where none is, the zone is too thin a part of its box and the point is left out.
    """
    z = prepare_zones(zones.select(key, wkt), key, wkt)

    def unit(k: Column, t: Column, axis: str) -> Column:
        return F.pmod(F.xxhash64(F.col("__order"), k, t, F.lit(axis), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    b = F.col("__b")

    def draw(k: Column, t: Column) -> Column:
        return F.struct((b["x0"] + (b["x1"] - b["x0"]) * unit(k, t, "x")).alias("lon"), (b["y0"] + (b["y1"] - b["y0"]) * unit(k, t, "y")).alias("lat"))

    drawn = z.select("__order", "__e", "__b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: draw(F.col("k"), t))
    first = F.get(F.filter(draws, lambda q: covers(F.col("__e"), q["lon"], q["lat"])), F.lit(0))
    return drawn.select(F.col("__order").alias(key), "k", first.alias("p")).where("p is not null").select(key, "k", "p.lon", "p.lat")


def border_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest edge, in the units of the coordinates."""

    def to_edge(s: Column) -> Column:
        dx, dy = s["x2"] - s["x"], s["y2"] - s["y"]
        norm = dx * dx + dy * dy
        t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x"]) * dx + (y - s["y"]) * dy) / norm))).otherwise(0.0)
        return F.sqrt(F.pow(x - s["x"] - t * dx, 2) + F.pow(y - s["y"] - t * dy, 2))

    return F.array_min(F.transform(e, to_edge))


def territory(points: DataFrame, zones: DataFrame, id_col: str, x: str, y: str, subject: str) -> DataFrame:
    """Region and municipality of each point: the second-level zone and its parent, else a region of the subject's name, else the first-level zone.

    ``zones``: WKT, level, parent_code, code, name.
    """
    two = first_covering(points, zones.where("level = 2").select("code", "parent_code", "WKT"), id_col, x, y, "code", "WKT").withColumnRenamed("code", "__c2").withColumnRenamed("parent_code", "__p2")
    names = zones.where("level = 1").groupBy(F.lower(F.trim("name")).alias("__name")).agg(F.min("code").alias("__cn"))
    named = two.join(names, F.lower(F.trim(F.col(subject))) == F.col("__name"), "left").drop("__name")
    one = first_covering(named, zones.where("level = 1").select("code", "WKT"), id_col, x, y, "code", "WKT").withColumnRenamed("code", "__c1")
    return one.withColumn("oktmo_code_1", F.coalesce("__p2", "__cn", "__c1")).withColumn("oktmo_code_2", F.col("__c2")).drop("__c1", "__c2", "__p2", "__cn")


def destination(lon: Column, lat: Column, bearing_deg: Column, km: Column) -> Column:
    """Point at a distance and bearing on a flat earth, six places."""
    b = F.radians(bearing_deg)
    dlat = km / KM_PER_DEGREE * F.cos(b)
    dlon = km / (KM_PER_DEGREE * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))) * F.sin(b)
    return F.struct(F.round(lon + dlon, 6).alias("x"), F.round(lat + dlat, 6).alias("y"))


def wedge(lon: Column, lat: Column, km: Column, azimuth: Column, angle: Column) -> Column:
    """Closed ring of a sector: its apex and nineteen points of its arc."""
    half = F.greatest(F.lit(1.0), F.least(F.lit(179.0), angle / 2))
    apex = F.struct(F.round(lon, 6).alias("x"), F.round(lat, 6).alias("y"))
    arc = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: destination(lon, lat, azimuth - half + i * (2 * half / 18.0), km))
    return F.concat(F.array(apex), arc, F.array(apex))


def circle(lon: Column, lat: Column, km: Column, steps: int = 48) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: destination(lon, lat, (i % steps) * (360.0 / steps), km))


def sector_rings(lon: Column, lat: Column, km: Column, azimuth: Column, angle: Column, bs_type: Column) -> Column:
    """Rings of a cell's coverage: a circle for small sites and full angles, else a wedge, with a rear lobe for outdoor sites.

    The lobe is shorter than the wedge, so what the wedge doesn't cover of it is its part outside the wedge's angle: that much of it is a second ring of
    a MULTIPOLYGON, which meets the first only at the apex. No area counts twice.
    """
    round_ = bs_type.isin("m", "i", "f") | (angle >= 360)
    front = wedge(lon, lat, km, azimuth, angle)
    rear = wedge(lon, lat, F.greatest(F.lit(0.05), km * 0.35), F.pmod(azimuth + 180.0, F.lit(360.0)), F.least(F.lit(100.0), F.greatest(F.lit(40.0), angle * 0.65), 360 - angle))
    return F.when(round_, F.array(circle(lon, lat, km))).when((bs_type == "o") & (angle <= 358), F.array(front, rear)).otherwise(F.array(front))


def rings_wkt(rings: Column) -> Column:
    def one(r):
        return F.concat(F.lit("(("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit("))"))

    return F.when(F.size(rings) == 1, F.concat(F.lit("POLYGON"), one(F.get(rings, F.lit(0))))).otherwise(F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(rings, one), ","), F.lit(")")))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once for the row, however often ``f`` refers to it: as a lambda's variable, not as text pasted in."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ring_metrics(ring: Column) -> Column:
    """``area_km2, lon, lat`` of a closed ring: shoelace sums about its first point."""
    return bound(ring, lambda r: bound(F.get(r, F.lit(0)), lambda o: _metrics(r, o)))


def _metrics(ring: Column, o: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n = F.size(ring)

    def pair(a: Column, b: Column) -> Column:
        x, y, u, v = a["x"] - o["x"], a["y"] - o["y"], b["x"] - o["x"], b["y"] - o["y"]
        return F.struct((x * v - u * y).alias("c"), (x + u).alias("x"), (y + v).alias("y"))

    def add(s: Column, p: Column) -> Column:
        return F.struct((s["a"] + p["c"]).alias("a"), (s["x"] + p["x"] * p["c"]).alias("x"), (s["y"] + p["y"] * p["c"]).alias("y"))

    def done(s: Column) -> Column:
        lat = o["y"] + F.when(s["a"] != 0, s["y"] / (3 * s["a"])).otherwise(0.0)
        lon = o["x"] + F.when(s["a"] != 0, s["x"] / (3 * s["a"])).otherwise(0.0)
        scale = KM_PER_DEGREE * KM_PER_DEGREE * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
        return F.struct((F.abs(s["a"]) / 2 * scale).alias("area_km2"), lon.alias("lon"), lat.alias("lat"))

    return F.aggregate(F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), pair), zero, add, done)


def rings_metrics(rings: Column) -> Column:
    """Area of all rings together and their common centre, weighted by area, five places."""
    def joined(m: Column) -> Column:
        total = F.aggregate(m, F.lit(0.0), lambda s, r: s + r["area_km2"])
        lon = F.aggregate(m, F.lit(0.0), lambda s, r: s + r["lon"] * r["area_km2"]) / total
        lat = F.aggregate(m, F.lit(0.0), lambda s, r: s + r["lat"] * r["area_km2"]) / total
        return F.struct(F.bround(total, 5).alias("area_km2"), F.bround(lon, 5).alias("lon"), F.bround(lat, 5).alias("lat"))

    return bound(F.transform(rings, ring_metrics), joined)


def wkt_metrics(df: DataFrame, c: str) -> DataFrame:
    """Counts of what is wrong with WKT texts: unreadable, empty, no polygon, open or too short rings."""
    t = F.trim(F.col(c))
    rings = F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), F.lit(1))
    kind = F.regexp_extract(F.upper(t), r"^([A-Z]+)", 1)
    ends = F.transform(rings, lambda r: F.transform(F.split(r, ","), lambda p: F.trim(p)))
    bad_ring = F.exists(ends, lambda p: (F.size(p) < 4) | (F.get(p, F.lit(0)) != F.element_at(p, -1)) | F.exists(p, lambda q: ~q.rlike(f"^{_POINT}$")))
    present = t.isNotNull() & (t != "")
    known = kind.isin("POLYGON", "MULTIPOLYGON", "POINT", "LINESTRING", "MULTIPOINT", "MULTILINESTRING", "GEOMETRYCOLLECTION")
    poly = kind.isin("POLYGON", "MULTIPOLYGON")
    is_empty = F.upper(t).rlike(r"\bEMPTY$")

    def n(cond):
        return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))

    return df.agg(n(present).alias("present"), n(present & ~known).alias("parse_errors"), n(present & known & ~poly).alias("wrong_type"), n(present & poly & is_empty).alias("empty"), n(present & poly & ~is_empty & (bad_ring | (F.size(rings) == 0))).alias("invalid"))


def _clip(poly: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """Part of a convex polygon where a x + b y <= c."""
    if not len(poly):
        return poly
    d = poly[:, 0] * a + poly[:, 1] * b - c
    out = []
    for i in range(len(poly)):
        j = (i + 1) % len(poly)
        if d[i] <= 0:
            out.append(poly[i])
        if (d[i] < 0 < d[j]) or (d[j] < 0 < d[i]):
            t = d[i] / (d[i] - d[j])
            out.append(poly[i] + t * (poly[j] - poly[i]))
    return np.array(out)


def voronoi_cells(x: np.ndarray, y: np.ndarray, reach: np.ndarray, steps: int = 64, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """Each site's reach circle cut by the bisectors towards the sites near enough to matter: a site farther than twice the reach can't cut it.

    Sites are looked up by grid of the largest reach, so cost follows neighbours, not all pairs. Sites that aren't ``wanted`` get no cell of their own.
    """
    reach = np.maximum(120.0, reach)
    size = 2 * float(reach.max()) if len(reach) else 1.0
    gx, gy = np.floor(x / size).astype(int), np.floor(y / size).astype(int)
    grid: dict = {}
    for i, k in enumerate(zip(gx.tolist(), gy.tolist(), strict=True)):
        grid.setdefault(k, []).append(i)
    turn = 2 * math.pi * np.arange(steps) / steps
    out = []
    for i in range(len(x)) if wanted is None else np.flatnonzero(wanted).tolist():
        poly = np.stack([x[i] + reach[i] * np.cos(turn), y[i] + reach[i] * np.sin(turn)], axis=1)
        near = np.array([j for p in (-1, 0, 1) for q in (-1, 0, 1) for j in grid.get((gx[i] + p, gy[i] + q), ()) if j != i], int)
        d2 = (x[near] - x[i]) ** 2 + (y[near] - y[i]) ** 2
        for j in near[np.argsort(d2, kind="stable")]:
            a, b = x[j] - x[i], y[j] - y[i]
            if a * a + b * b > 4 * reach[i] ** 2:
                break
            poly = _clip(poly, a, b, (x[j] ** 2 + y[j] ** 2 - x[i] ** 2 - y[i] ** 2) / 2)
        out.append(poly)
    return out


def spread_duplicates(x: np.ndarray, y: np.ndarray, keys: list[str], step: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Sites at one place moved apart by a step each, in the order of their keys: the same at every run."""
    x, y = x.astype(float).copy(), y.astype(float).copy()
    at: dict = {}
    for i in range(len(x)):
        at.setdefault((round(x[i] * 1e6), round(y[i] * 1e6)), []).append(i)
    for same in at.values():
        if len(same) > 1:
            for k, i in enumerate(sorted(same, key=lambda i: keys[i])):
                h = int(pd.util.hash_array(np.array([keys[i]], object))[0] % 1000) / 1e6
                x[i] += (k - len(same) // 2) * step + h
                y[i] -= h * step * 0.7
    return x, y


def best_server_mosaic(cells: DataFrame, group: list[str], key: str, lon: str = "lon", lat: str = "lat", reach: str = "reach_m") -> DataFrame:
    """``key, mapinfo_wkt, area, centroid`` of each cell's best-server area among those of its group, in a local plane about the group's middle.

    A group is cut into square tiles of twice its largest reach at least; each tile is a task that also gets the sites of the eight around it, which are all
    that can cut its own. So no task holds a group whole.
    """
    placed = cells.select(*group, F.col(key).alias("__key"), F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat"), F.greatest(F.lit(120.0), F.coalesce(F.col(reach).cast("double"), F.lit(120.0))).alias("__reach"))
    placed = placed.where(F.col("__lon").between(-180, 180) & F.col("__lat").between(-90, 90))
    # rounded, so that the order of a sum doesn't move the plane
    planes = placed.groupBy(*group).agg(F.round(F.avg("__lon"), 2).alias("__lon0"), F.round(F.avg("__lat"), 2).alias("__lat0"), F.max("__reach").alias("__most"))
    same = None
    for c in group:
        e = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = e if same is None else same & e
    w = placed.join(planes.select(*[F.col(c).alias(f"__{c}") for c in group], "__lon0", "__lat0", "__most"), same).drop(*[f"__{c}" for c in group])
    scale = 111_320.0 * F.greatest(F.lit(0.2), F.cos(F.radians("__lat0")))
    w = w.withColumns({"__x": (F.col("__lon") - F.col("__lon0")) * scale, "__y": (F.col("__lat") - F.col("__lat0")) * 111_320.0})
    # sites at one place are moved apart by some metres, which the margin covers
    side = 2 * F.col("__most") + 1000
    w = w.withColumns({"__gx": F.floor(F.col("__x") / side), "__gy": F.floor(F.col("__y") / side)})
    around = F.expr("flatten(transform(array(-1L, 0L, 1L), i -> transform(array(-1L, 0L, 1L), j -> struct(i as i, j as j))))")
    w = w.withColumn("__n", F.explode(around)).withColumns({"__tx": F.col("__gx") + F.col("__n.i"), "__ty": F.col("__gy") + F.col("__n.j"), "__own": (F.col("__n.i") == 0) & (F.col("__n.j") == 0)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if pdf["__own"].any():
            pdf = pdf.sort_values("__key", kind="stable", ignore_index=True)
            lon0, lat0 = float(pdf["__lon0"][0]), float(pdf["__lat0"][0])
            sx, sy = 111_320.0 * max(0.2, math.cos(math.radians(lat0))), 111_320.0
            x, y = spread_duplicates(pdf["__x"].to_numpy(), pdf["__y"].to_numpy(), pdf["__key"].astype(str).tolist())
            own = pdf["__own"].to_numpy(bool)
            for k, poly in zip(pdf["__key"][own], voronoi_cells(x, y, pdf["__reach"].to_numpy(float), wanted=own), strict=True):
                if len(poly) < 3:
                    continue
                p = np.stack([lon0 + poly[:, 0] / sx, lat0 + poly[:, 1] / sy], axis=1)
                q = np.roll(p, -1, axis=0)
                o = p[0]
                cross = (p[:, 0] - o[0]) * (q[:, 1] - o[1]) - (q[:, 0] - o[0]) * (p[:, 1] - o[1])
                a = cross.sum()
                cx = o[0] + ((p[:, 0] + q[:, 0] - 2 * o[0]) * cross).sum() / (3 * a) if a else o[0]
                cy = o[1] + ((p[:, 1] + q[:, 1] - 2 * o[1]) * cross).sum() / (3 * a) if a else o[1]
                wkt = "POLYGON((" + ",".join(f"{u:.7f} {v:.7f}" for u, v in [*p, p[0]]) + "))"
                rows.append((k, wkt, round(abs(a) / 2 * KM_PER_DEGREE**2 * max(0.01, math.cos(math.radians(cy))), 5), round(cx, 5), round(cy, 5)))
        return pd.DataFrame(rows, columns=[key, "mapinfo_wkt", "mapinfo_wkt_area", "mapinfo_wkt_centroid_lon", "mapinfo_wkt_centroid_lat"])

    kind = cells.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, mapinfo_wkt string, mapinfo_wkt_area double, mapinfo_wkt_centroid_lon double, mapinfo_wkt_centroid_lat double"
    return w.groupBy(*group, "__tx", "__ty").applyInPandas(run, schema)
