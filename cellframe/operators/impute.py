"""Cells for events that lack one, between the known cells before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_points(versions: DataFrame, cell: str = "cgi", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Median place of each cell over its versions."""
    return versions.where(F.col(cell).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(cell).alias("cell")).agg(F.median(lat).alias("lat"), F.median(lon).alias("lon"))


def with_anchors(df: DataFrame, points: DataFrame, key: str, order: list[str], cell: str = "cgi") -> DataFrame:
    """Adds ``known``, the nearest known cells before and after in the key's sequence, and how far between them by position a row is."""
    w = Window.partitionBy(key).orderBy(*order)
    # both look back, the second in falling order of position: a frame that reaches ahead is computed anew for every row
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key).orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.join(points.select(F.col("cell").alias(cell), F.lit(True).alias("known")), cell, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    at = F.when(F.col("known"), F.struct(F.col("__pos").alias("pos"), F.col(cell).alias("cell")))
    placed = marked.withColumn("__pos", F.row_number().over(w)).withColumn("__at", at)
    placed = placed.withColumn("__before", F.last("__at", ignorenulls=True).over(earlier)).withColumn("__after", F.last("__at", ignorenulls=True).over(later))
    open_ = ~F.col("known") & F.col(key).isNotNull() & F.col("__before").isNotNull() & F.col("__after").isNotNull()
    fraction = (F.col("__pos") - F.col("__before.pos")) / (F.col("__after.pos") - F.col("__before.pos"))
    return placed.select(*df.columns, "known", F.when(open_, F.col("__before.cell")).alias("before"), F.when(open_, F.col("__after.cell")).alias("after"), F.when(open_, fraction).alias("fraction"))


def impute_between(df: DataFrame, points: DataFrame, key: str, order: list[str], cell: str = "cgi") -> DataFrame:
    """``df`` with cells for rows between two known ones: the same cell if both are equal, else the cell closest to the place
    interpolated between them, of those in the corridor (projection -0.2 to 1.2; all if it is empty); ties go to the least cell.

    Distinct (before, after, fraction) are scored once, and only against cells near enough to win: see ``choose``.
    """
    rows = with_anchors(df, points, key, order, cell)
    asks = rows.where("fraction is not null and before <> after").select("before", "after", "fraction").distinct()
    chosen = choose(asks, points)
    out = rows.join(chosen, ["before", "after", "fraction"], "left")
    value = F.when(F.col("fraction").isNull(), F.col(cell)).when(F.col("before") == F.col("after"), F.col("before")).otherwise(F.coalesce("chosen", F.col(cell)))
    return out.withColumn(cell, value).select(*df.columns)


#: Sides of grid cells in degrees are 2 ** level.
LEVELS = range(-6, 10)


def choose(asks: DataFrame, points: DataFrame) -> DataFrame:
    """``before, after, fraction, chosen``.

    Both anchors are cells in the corridor themselves, and a score is at least the squared distance; so the winner lies within the root of the better
    anchor's score of the target, and the corridor is never empty. Asks and cells meet by grid cells of that size, nine of them.
    """
    a = asks.join(points.select(F.col("cell").alias("before"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "before")
    a = a.join(points.select(F.col("cell").alias("after"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "after")
    dlat, dlon, f = F.col("lat1") - F.col("lat0"), F.col("lon1") - F.col("lon0"), F.col("fraction")
    norm = dlat * dlat + dlon * dlon
    tlat, tlon = F.col("lat0") + dlat * f, F.col("lon0") + dlon * f

    def along(lat: Column, lon: Column) -> Column:
        return F.when(norm > 0, ((lat - F.col("lat0")) * dlat + (lon - F.col("lon0")) * dlon) / norm).otherwise(0.5)

    def score(lat: Column, lon: Column) -> Column:
        return (lat - tlat) * (lat - tlat) + (lon - tlon) * (lon - tlon) + F.abs(along(lat, lon) - f) * 0.01

    worst = F.least(score(F.col("lat0"), F.col("lon0")), score(F.col("lat1"), F.col("lon1")))
    level = F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(F.sqrt(worst) * (1 + 1e-9) + 1e-12)).cast("int"))
    a = a.withColumn("level", F.least(level, F.lit(LEVELS[-1])))

    def grid(c: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), F.col("level"))).cast("long")

    around = F.expr("flatten(transform(array(-1L, 0L, 1L), i -> transform(array(-1L, 0L, 1L), j -> struct(i as i, j as j))))")
    a = a.withColumns({"gy": grid(tlat), "gx": grid(tlon)}).withColumn("n", F.explode(around)).withColumns({"gy": F.col("gy") + F.col("n.i"), "gx": F.col("gx") + F.col("n.j")})
    p = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in LEVELS]))).withColumns({"gy": grid(F.col("lat")), "gx": grid(F.col("lon"))})
    inside = along(F.col("lat"), F.col("lon")).between(-0.2, 1.2)
    scored = a.join(p, ["level", "gy", "gx"]).where(inside).withColumn("__s", score(F.col("lat"), F.col("lon")))
    return scored.groupBy("before", "after", "fraction").agg(F.min_by("cell", F.struct("__s", "cell")).alias("chosen"))
