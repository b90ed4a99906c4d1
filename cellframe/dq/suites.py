"""Data-quality suites, one for each table. Each gives ``check_name, status, metrics`` rows.

A suite takes one aggregate pass for its rates, counts and nulls, and one grouped pass for each key or interval invariant. Schema and
presence are decided on the driver from the table's columns; nothing else is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.dq.core import Gate, Limit, as_results, count_gates, gate_status, rate_gates, summary
from cellframe.functions import scalar as S
from cellframe.operators import geo, intervals, joins, profile

RESULT = "check_name string, status string, metrics map<string,string>"
GEO_TYPES = tuple("cdr sms gprs location".split())


class Suite:
    """Collects checks on one table and runs them as few passes."""

    def __init__(self, df: DataFrame, expected: Sequence[str] = (), prefix: str = ""):
        self.df, self.prefix, self.gates, self.limits, self.more = df, prefix, [], [], []
        present, missing = joins_columns(df, expected)
        self.fixed = [("presence", "ok", {}), ("schema", "failed" if missing else "ok", {"missing": ",".join(missing), "extra": ",".join(c for c in df.columns if expected and c not in expected)})]
        self.columns = present

    def has(self, *columns: str) -> bool:
        return all(c in self.df.columns for c in columns)

    def rate(self, name: str, good: Column, failed: float, warn: float, among: Column | None = None, needs: Sequence[str] = ()) -> Suite:
        if self.has(*needs):
            self.gates.append(Gate(name, good, failed, warn, among))
        return self

    def none(self, name: str, bad: Column, severity: str = "warning", needs: Sequence[str] = ()) -> Suite:
        if self.has(*needs):
            self.limits.append(Limit(name, bad, severity))
        return self

    def add(self, results: DataFrame) -> Suite:
        self.more.append(results)
        return self

    def nulls(self, severity: str = "info", columns: Sequence[str] | None = None) -> Suite:
        """Null rate of each column; any null has ``severity``."""
        cols = [c for c in (columns or self.columns or self.df.columns) if c in self.df.columns]
        r = profile.null_rates(self.df, cols)
        self.more.append(r.select(F.concat(F.lit("nulls."), "column_name").alias("check_name"), F.when(F.col("null_rate") > 0, severity).otherwise("ok").alias("status"), F.create_map(F.lit("null_rate"), F.col("null_rate").cast("string")).alias("metrics")))
        return self

    def distinct(self, columns: Sequence[str]) -> Suite:
        r = profile.cardinality(self.df, [c for c in columns if self.has(c)])
        self.more.append(r.select(F.concat(F.lit("cardinality."), "column_name").alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n_distinct"), F.col("n_distinct").cast("string")).alias("metrics")))
        return self

    def unique(self, name: str, key: Sequence[str], severity: str) -> Suite:
        if self.has(*key):
            d = profile.duplicate_rows(self.df, key)
            self.more.append(d.select(F.lit(name).alias("check_name"), F.when(F.col("duplicate_rows") > 0, severity).otherwise("ok").alias("status"), F.create_map(F.lit("rows"), F.col("duplicate_rows").cast("string"), F.lit("keys"), F.coalesce("duplicate_keys", F.lit(0)).cast("string")).alias("metrics")))
        return self

    def values(self, name: str, c: str, top: int = 20) -> Suite:
        if self.has(c):
            v = profile.value_counts(self.df, c, top)
            self.more.append(v.select(F.concat(F.lit(f"{name}."), "value").alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("pct"), F.col("pct").cast("string")).alias("metrics")))
        return self

    def profile(self, name: str, columns: Sequence[str]) -> Suite:
        """Numeric summary of each column that is there."""
        cols = [c for c in columns if self.has(c)]
        if cols:
            p = profile.numeric_profile(self.df, cols)
            metrics = ("n", "nulls", "min", "p50", "p95", "max", "mean", "std")
            self.more.append(as_results(p.select(F.concat(F.lit(f"{name}."), "column_name").alias("check_name"), F.lit("info").alias("status"), *metrics), *metrics))
        return self

    def presence(self, name: str, columns: Sequence[str]) -> Suite:
        """Empty, filled and distinct values of each column that is there, as texts."""
        for c in (c for c in columns if self.has(c)):
            one = self.df.agg(F.coalesce(F.sum(_empty(c).cast("long")), F.lit(0)).alias("empty"), F.coalesce(F.sum((~_empty(c)).cast("long")), F.lit(0)).alias("filled"), F.countDistinct(F.when(~_empty(c), F.trim(F.col(c).cast("string")))).alias("n_distinct"))
            self.more.append(as_results(one.select(F.lit(f"{name}.{c}").alias("check_name"), F.lit("info").alias("status"), "*"), "empty", "filled", "n_distinct"))
        return self

    def few_values(self, name: str, columns: Sequence[str], most: int = 20) -> Suite:
        """All values, with counts and shares, of each column that has at most ``most`` of them."""
        for c in (c for c in columns if self.has(c)):
            v = profile.value_counts(self.df, c, most + 1, keep_null=False)
            few = v.agg(F.count("*").alias("__k")).where(f"__k <= {most}")
            self.more.append(v.crossJoin(few).select(F.concat(F.lit(f"{name}.{c}."), "value").alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("pct"), F.col("pct").cast("string")).alias("metrics")))
        return self

    def results(self) -> DataFrame:
        spark = self.df.sparkSession
        out = spark.createDataFrame(self.fixed, RESULT)
        out = out.unionByName(as_results(self.df.agg(F.count("*").alias("rows")).select(F.lit("basic").alias("check_name"), F.when(F.col("rows") > 0, "ok").otherwise("warning").alias("status"), "rows"), "rows"))
        if self.gates:
            out = out.unionByName(as_results(rate_gates(self.df, self.gates), "rate", "bad"))
        if self.limits:
            out = out.unionByName(as_results(count_gates(self.df, self.limits), "bad"))
        for m in self.more:
            out = out.unionByName(m)
        return out.withColumn("check_name", F.concat(F.lit(self.prefix), "check_name")) if self.prefix else out


def joins_columns(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    return [c for c in expected if c in df.columns], [c for c in expected if c not in df.columns]


def absent(spark: SparkSession) -> DataFrame:
    """What a suite says of a table that isn't there."""
    return spark.createDataFrame([("presence", "failed", {})], RESULT)


def overall(results: DataFrame, always_ok: bool = False) -> DataFrame:
    s = summary(results)
    return s.withColumn("status", F.lit("ok")) if always_ok else s


def _like(c: str, pattern: str) -> Column:
    return F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def _wkt(df: DataFrame, c: str, name: str) -> DataFrame:
    m = geo.wkt_metrics(df, c)
    bad = F.col("parse_errors") + F.col("wrong_type") + F.col("empty") + F.col("invalid")
    return as_results(m.select(F.lit(name).alias("check_name"), F.when(bad > 0, "warning").otherwise("ok").alias("status"), "*"), "present", "parse_errors", "wrong_type", "empty", "invalid")


def _missing(name: str, child: DataFrame, c: str, parent: DataFrame, p: str, severity: str) -> DataFrame:
    n = joins.missing_references(child, c, parent, p).agg(F.count("*").alias("missing"))
    return as_results(n.select(F.lit(name).alias("check_name"), F.when(F.col("missing") > 0, severity).otherwise("ok").alias("status"), "missing"), "missing")


# dimensions; their overall status is always ok, with counts


def dim_oktmo(df: DataFrame) -> DataFrame:
    s = Suite(df, schemas.DIM_OKTMO.fieldNames()).nulls().distinct(["code", "parent_code", "level"])
    s.none("level_domain", ~F.coalesce(F.col("level").isin(1, 2), F.lit(False))).none("code_numeric", ~_like("code", r"^\d+$")).none("parent_numeric", F.col("parent_code").isNotNull() & ~_like("parent_code", r"^\d+$"))
    s.none("hierarchy.level1_with_parent", (F.col("level") == 1) & ~_empty("parent_code")).none("hierarchy.level2_without_parent", (F.col("level") == 2) & _empty("parent_code")).none("name_empty", _empty("name") | F.trim("name").isin("-"))
    one, two = df.where("level = 1"), df.where("level = 2")
    return s.unique("code_unique", ["code"], "warning").add(_missing("hierarchy.orphans", two, "parent_code", one, "code", "warning")).add(_missing("hierarchy.childless", one, "code", two, "parent_code", "warning")).add(_wkt(df, "WKT", "geometry")).results()


def dim_time_zones(df: DataFrame) -> DataFrame:
    s = Suite(df, schemas.DIM_TIME_ZONES.fieldNames()).nulls().distinct(["code", "timezone"]).none("code_numeric", _number("code").isNull()).none("timezone_range", ~F.coalesce(_number("timezone").between(-12, 14), F.lit(False)))
    return s.values("timezone", "timezone").add(_wkt(df, "geometry", "geometry")).results()


def dim_tac(df: DataFrame, least_m2m: float = 0.001) -> DataFrame:
    s = Suite(df, schemas.DIM_TAC.fieldNames()).nulls().none("tac_format", ~_like("tac", r"^\d{8}$"), "failed").unique("tac_unique", ["tac"], "failed")
    s.none("m2m_matches_equipment", F.col("is_m2m") != S.is_m2m("equipment_type"), "failed").none("allocation_date_format", ~_empty("allocation_date") & ~_like("allocation_date", r"^\d{4}-\d{2}-\d{2}$")).none("manufacturer_empty", _empty("manufacturer"))
    return s.rate("m2m_share", F.col("is_m2m"), 0.0, least_m2m).results()


def dim_oksm(df: DataFrame) -> DataFrame:
    s = Suite(df, schemas.DIM_OKSM.fieldNames()).nulls().none("numeric_format", ~_like("numeric_code", r"^\d{3}$"), "failed").none("alpha2_format", ~_like("alpha2", "^[A-Z]{2}$"), "failed").none("alpha3_format", ~_like("alpha3", "^[A-Z]{3}$"), "failed")
    for c in ("numeric_code", "alpha2", "alpha3", "autokey"):
        s.unique(f"{c}_unique", [c], "failed")
    for a, b in (("numeric_code", "alpha2"), ("numeric_code", "alpha3"), ("alpha2", "alpha3")):
        n = df.agg(F.countDistinct(a, b).alias("pairs"), F.countDistinct(a).alias("first"), F.countDistinct(b).alias("second"))
        s.add(as_results(n.select(F.lit(f"pairs.{a}.{b}").alias("check_name"), F.when((F.col("pairs") == F.col("first")) & (F.col("pairs") == F.col("second")), "ok").otherwise("warning").alias("status"), "*"), "pairs", "first", "second"))
    s.none("names", _empty("name_short") | _empty("name_full"), "failed").none("autokey_empty", _empty("autokey"), "failed").distinct(["numeric_code", "alpha2"])
    home = df.agg(F.coalesce(F.max((F.col("numeric_code") == "643").cast("int")), F.lit(0)).alias("found"))
    return s.add(as_results(home.select(F.lit("home_present").alias("check_name"), F.when(F.col("found") == 1, "ok").otherwise("warning").alias("status"), "found"), "found")).results()


# sources


def src_bs(df: DataFrame) -> DataFrame:
    x, y, lac, cell = _number("coord_x"), _number("coord_y"), _number("lac"), _number("cell")
    on, off = (F.col(c).cast("string").try_cast("timestamp_ntz") for c in ("date_on", "date_off"))
    coords = x.between(-180, 180) & y.between(-90, 90)
    codes = lac.isNotNull() & cell.isNotNull() & (lac >= 0) & (lac < 1e5) & (cell >= 0) & (cell < 1e6)
    ordered = off.isNull() | (off >= on)
    s = Suite(df, "mcc mnc lac cell date_on date_off coord_x coord_y bs_type generation".split()).nulls().distinct(["mcc", "mnc", "bs_type", "generation"])
    s.rate("stg_contract.lac_cell", codes, 0.995, 0.999).rate("stg_contract.coords", coords, 0.995, 0.999).rate("stg_contract.temporal_order", ordered, 0.99, 0.995).rate("stg_contract.generation_present", ~_empty("generation"), 0.99, 0.995)
    s.rate("contract.mcc_rf", _number("mcc") == 250, 0.99, 0.999).rate("contract.mnc_valid", _number("mnc").between(0, 99), 0.99, 0.999).rate("contract.lac_cell_non_negative", (lac >= 0) & (cell >= 0), 0.995, 0.999).none("contract.date_off_present", off.isNull(), "failed")
    s.rate("contract.coords_present", x.isNotNull() & y.isNotNull(), 0.995, 0.999).rate("contract.generation_vocab", F.upper(F.trim("generation")).isin("2G", "3G", "4G"), 0.95, 0.99)
    if s.has("azimuth"):
        s.rate("contract.azimuth_semantics", _number("azimuth").between(0, 360), 0.98, 0.995, ~_empty("azimuth"))
    from cellframe.plans.cells import RANGES

    for c, (low, high) in RANGES.items():
        s.rate(f"contract.range.{c}", _number(c).between(low, high), 0.98, 0.995, ~_empty(c) if s.has(c) else None, needs=[c])
    for c in ("frequency_in", "frequency_out"):
        if s.has(c):
            s.rate(f"contract.frequency_list.{c}", S.number_list(c), 0.98, 0.995, ~_empty(c))
    if s.has("border"):
        s.none("contract.border_boolean", S.boolean_text("border") == "<other>")
    s.unique("key_integrity", "mcc mnc lac cell date_on".split(), "warning").values("bs_type", "bs_type").values("generation", "generation")
    sites = profile.nested_count_quantiles(df.where(coords), ["coord_x", "coord_y"])
    s.add(as_results(sites.select(F.lit("contract.cells_per_coordinate").alias("check_name"), F.lit("info").alias("status"), "*"), "p50", "p95", "max"))
    spatial = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in (("bad_lon", ~x.between(-180, 180)), ("bad_lat", ~y.between(-90, 90)), ("no_lon", x.isNull()), ("no_lat", y.isNull()))])
    s.add(as_results(spatial.select(F.lit("spatial.ranges").alias("check_name"), F.lit("info").alias("status"), "*"), "bad_lon", "bad_lat", "no_lon", "no_lat"))
    s.profile("numeric", RADIO).presence("radio.presence", (*RADIO, "rad_class")).few_values("unique_values", ("mcc", "mnc", "bs_type", "generation", "frequency", "rad_class"))
    s.none("radio.power_without_height", _number("power").isNotNull() & _number("height").isNull(), "info", needs=["power", "height"])
    kinds = profile.cross_tab(df, "generation", "bs_type")
    s.add(kinds.select(F.concat_ws(".", F.lit("radio.generation_bs_type"), F.coalesce("generation", F.lit("<NA>")), F.coalesce("bs_type", F.lit("<NA>"))).alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("pct"), F.col("pct").cast("string")).alias("metrics")))
    active = active_days(df, on, off).agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("max"), F.count("*").alias("days"))
    s.add(as_results(active.select(F.lit("temporal.active_cells_a_day").alias("check_name"), F.lit("info").alias("status"), "*"), "p50", "p95", "max", "days"))
    scope = df.agg(F.count("*").alias("rows"), F.countDistinct("mcc", "mnc").alias("operators"), F.countDistinct("mcc", "mnc", "lac", "cell").alias("cells"))
    s.add(as_results(scope.select(F.lit("scope").alias("check_name"), F.lit("info").alias("status"), "*"), "rows", "operators", "cells"))
    for name, t in (("month", on), ("month_off", off)):
        months = profile.value_counts(df.select(F.date_format(t, "yyyy-MM").alias("m")), "m")
        s.add(months.select(F.concat(F.lit(f"temporal.{name}."), "value").alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("metrics")))
    return s.results()


RADIO = ("power", "height", "amplification", "tilt", "el_tilt", "mech_tilt", "azimuth", "sector_angle", "frequency")


def active_days(df: DataFrame, on: Column, off: Column, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """``day, n``: intervals that hold on each day from the first begin to the last (or from ``low`` to ``high``), by sums of begins and ends.

    An interval costs two rows, however long it holds.
    """
    spans = df.select(F.to_date(on).alias("a"), F.to_date(off).alias("b")).where("a is not null and (b is null or b >= a)")
    changes = spans.select(F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("c")), F.when(F.col("b").isNotNull(), F.struct(F.date_add("b", 1).alias("day"), F.lit(-1).alias("c"))))).alias("x")).select("x.*").where("day is not null").groupBy("day").agg(F.sum("c").alias("c"))
    ends = spans.agg(F.coalesce(low, F.min("a")) if low is not None else F.min("a"), F.max("a")).toDF("a", "b").where("a is not null")
    if high is not None:
        ends = ends.withColumn("b", high)
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"), F.lit(0).alias("c"))
    # days are few: one ordered pass over them
    both = changes.unionByName(days.select("day", F.col("c").cast("long").alias("c"))).groupBy("day").agg(F.sum("c").alias("c"), F.max(F.lit(0)).alias("z"))
    running = both.withColumn("n", F.sum("c").over(Window.partitionBy("z").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(days.select("day"), "day", "left_semi").select("day", "n")


def age_in_years(birth: str, as_of: Column) -> Column:
    """Years with fractions, as the checks count them."""
    return F.datediff(as_of, F.col(birth).try_cast("date")) / 365.25


def src_person(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    as_of = as_of if as_of is not None else F.current_date()
    gsm = F.col("identity_type").try_cast("int").isin(2, 4, 5)
    physical = F.col("client_type").try_cast("int") == 0
    a, b = (F.col(c).try_cast("timestamp_ntz") for c in ("actually_from", "actually_to"))
    age = age_in_years("birth_day", as_of)
    name = ~_empty("last_name") & ~_empty("first_name")
    s = Suite(df, "identity_type operator_Id isdn imsi imei iccid client_type actually_from actually_to birth_day first_name second_name last_name document".split()).nulls().distinct(["operator_Id", "isdn", "imsi"])
    for c in ("isdn", "imsi", "imei"):
        s.rate(f"identity.{c}_filled", ~_empty(c), 0.90, 0.98, gsm)
    s.rate("non_gsm_isdn_leak", _empty("isdn"), 0.0, 0.99, ~gsm).rate("isdn_format", _like("isdn", r"^7\d{10}$"), 0.95, 0.99, ~_empty("isdn")).rate("imsi_length", _like("imsi", r"^\d{15}$"), 0.95, 0.99, ~_empty("imsi")).rate("imei_length", _like("imei", r"^\d{15}$"), 0.95, 0.99, ~_empty("imei"))
    s.rate("iccid_length", _like("iccid", r"^\d{18,20}$"), 0.90, 0.98, ~_empty("iccid")).rate("passport", _like("document", r"^\d\d\d\d \d{6}$"), 0.90, 0.98, physical & ~_empty("document")).rate("age_range", age.between(14, 110), 0.90, 0.98, physical & F.col("birth_day").isNotNull())
    s.rate("fio_physical", name, 0.95, 0.98, physical).rate("fio_corporate_absent", ~name, 0.0, 0.95, ~physical).rate("stg_contract.interval_order", b.isNull() | (b >= a), 0.995, 0.999).rate("stg_contract.fio_present", name, 0.95, 0.98, physical)
    for c in ("isdn", "imsi", "imei"):
        s.rate(f"stg_contract.{c}_present", ~_empty(c), 0.99, 0.995, physical)
    if s.has("service_list"):
        s.rate("service_list", F.forall(S.service_entries("service_list"), lambda x: x.rlike(r"^[^;]+;")), 0.90, 0.98, ~_empty("service_list"))
    s.unique("operator_isdn_key", ["operator_Id", "isdn", "actually_from"], "warning").unique("four_key", "operator_Id isdn imsi actually_from".split(), "warning").values("operator", "operator_Id")
    cross = profile.cross_tab(df, "identity_type", "client_type")
    return s.add(cross.select(F.concat_ws(".", F.lit("cross"), F.coalesce(F.col("identity_type").cast("string"), F.lit("<NA>")), F.coalesce(F.col("client_type").cast("string"), F.lit("<NA>"))).alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("pct"), F.col("pct").cast("string")).alias("metrics"))).results()


def snapshot_inventory(inventory: DataFrame, low: Column, high: Column) -> DataFrame:
    """What a month's or a period's daily snapshots amount to. ``inventory``: day, rows, success."""
    inside = inventory.where(F.col("day").between(low, high))
    span = inside.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).withColumn("status", F.when(F.col("days") > 0, "ok").otherwise("warning"))
    out = span.select(F.lit("date_range").alias("check_name"), "status", F.create_map(F.lit("days"), F.col("days").cast("string"), F.lit("span"), (F.datediff("last", "first") + 1).cast("string")).alias("metrics"))
    calendar = inside.sparkSession.range(1).select(F.explode(F.sequence(low.cast("date"), high.cast("date"))).alias("day"))
    missing = calendar.join(inside.select("day").distinct(), "day", "left_anti").agg(F.count("*").alias("missing"))
    out = out.unionByName(as_results(missing.select(F.lit("calendar_coverage").alias("check_name"), F.when(F.col("missing") > 0, "warning").otherwise("ok").alias("status"), "missing"), "missing"))
    for kind, rows in (("success", inside.where("success")), ("partial", inside.where("not success"))):
        v = rows.agg(F.count("*").alias("days"), F.min("rows").alias("min"), F.percentile("rows", 0.5).alias("p50"), F.percentile("rows", 0.95).alias("p95"), F.max("rows").alias("max"), F.avg("rows").alias("mean"))
        out = out.unionByName(as_results(v.select(F.lit(f"period_volume.{kind}").alias("check_name"), F.lit("info").alias("status"), "*"), "days", "min", "p50", "p95", "max", "mean"))
    done = inside.agg(F.count("*").alias("days"), F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("success_days"), F.max(F.when(F.col("success"), F.dayofmonth("day"))).alias("latest_day"))
    done = done.withColumn("share", F.col("success_days") / F.nullif("days", F.lit(0)))
    return out.unionByName(as_results(done.select(F.lit("success_days").alias("check_name"), F.when(F.col("success_days") > 0, "ok").otherwise("warning").alias("status"), "*"), "days", "success_days", "share", "latest_day"))


def src_exclusions(lists: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    out = None
    for name, df in lists.items():
        if df is None:
            one = spark.createDataFrame([(f"{name}.presence", "failed", {})], RESULT)
        else:
            t = df.agg(F.count("*").alias("rows"), F.countDistinct("value").alias("n_unique"), F.coalesce(F.sum(F.col("value").isNull().cast("long")), F.lit(0)).alias("nulls")) if "value" in df.columns else None
            one = Suite(df, ["value"], prefix=f"{name}.").results()
            if t is not None:
                one = one.unionByName(as_results(t.select(F.lit(f"{name}.totals").alias("check_name"), F.lit("info").alias("status"), "*"), "rows", "n_unique", "nulls"))
        out = one if out is None else out.unionByName(one)
    return out


_IMSI_LIMITS = {"cdr": (0.35, 0.45), "gprs": (0.40, 0.50), "sms": (0.20, 0.30), "location": (0.15, 0.22)}


def src_mart(df: DataFrame, mart: str) -> DataFrame:
    from cellframe.plans.events import CELL, PARTY

    lac, cell = (_number(c) for c in CELL[mart])
    s = Suite(df, ["Started", "IMSI", "IMEI", PARTY[mart], *CELL[mart]], prefix=f"{mart}.").nulls()
    s.rate("stg_contract.started", S.fourteen_digits("Started"), 0.99, 0.995).rate("stg_contract.owner", _number("Owner").isin(1, 2) if s.has("Owner") else F.lit(True), 0.99, 0.995, needs=["Owner"]).rate("stg_contract.lac_cell", (lac >= 0) & (lac < 1e5) & (cell >= 0) & (cell < 1e6), 0.99, 0.995)
    s.rate("stg_contract.imsi", F.length(S.digits("IMSI")) >= 10, *_IMSI_LIMITS[mart]).rate("stg_contract.msisdn", F.length(S.digits(PARTY[mart])).between(10, 15), 0.98, 0.99)
    if s.has("Latitude", "Longitude"):
        s.rate("stg_contract.coords", _number("Latitude").between(-90, 90) & _number("Longitude").between(-180, 180), 0.99, 0.995)
    if mart in ("cdr", "gprs"):
        s.unique("imsi_started_duplicates", ["IMSI", "Started"], "warning")
    good = S.fourteen_digits("Started")
    cover = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("well_timed"), F.countDistinct(F.when(good, F.substring(F.trim("Started"), 1, 8))).alias("days"))
    s.add(as_results(cover.select(F.lit("coverage").alias("check_name"), F.when(F.col("days") > 0, "ok").otherwise("warning").alias("status"), "*"), "rows", "well_timed", "days"))
    located = F.coalesce((lac >= 0) & (cell >= 0), F.lit(False))
    kept = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in (("untimed", ~F.coalesce(good, F.lit(False))), ("timed_unlocated", good & ~located), ("timed_located", good & located))])
    s.add(as_results(kept.select(F.lit("filters").alias("check_name"), F.lit("info").alias("status"), "*"), "untimed", "timed_unlocated", "timed_located"))
    s.few_values("distribution", [c for c in DISTRIBUTIONS[mart] if s.has(c)])
    hours = profile.hour_histogram(df.where(good), F.substring(F.trim("Started"), 9, 2))
    return s.add(hours.select(F.concat(F.lit("hour."), "hour").alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("metrics"))).results()


#: Columns of each mart whose values are listed where they are few.
DISTRIBUTIONS = {"cdr": ("Owner", "OwnerMCCMNC", "CallType", "CallEnd"), "gprs": ("Owner", "OwnerMCCMNC", "Apn", "RatType"), "sms": ("Owner", "MCC", "MNC", "SmsType"), "location": ("Owner", "MCC", "MNC", "LocationType")}


def traffic_mix(counts: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Rows of each mart for each key, their total, the share of data sessions, and location rows for each of them. ``counts``: key, mart, n."""
    n = lambda m: F.coalesce(F.sum(F.when(F.col("mart") == m, F.col("n"))), F.lit(0)).cast("long").alias(m)
    out = counts.groupBy(*by).agg(*[n(m) for m in GEO_TYPES])
    out = out.withColumn("total", F.col("cdr") + F.col("sms") + F.col("gprs") + F.col("location"))
    return out.withColumn("gprs_share", F.round(F.col("gprs") / F.nullif("total", F.lit(0)), 6)).withColumn("location_to_gprs", F.round(F.col("location") / F.greatest(F.col("gprs"), F.lit(1)), 6))


def src_marts(marts: dict[str, DataFrame]) -> DataFrame:
    """All marts, and the mix of traffic among them, over all and for each day."""
    out = counts = None
    for mart, df in marts.items():
        day = F.when(S.fourteen_digits("Started"), F.substring(F.trim("Started"), 1, 8))
        one, n = src_mart(df, mart), df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).select("day", F.lit(mart).alias("mart"), "n")
        out, counts = (one, n) if out is None else (out.unionByName(one), counts.unionByName(n))
    metrics = (*GEO_TYPES, "total", "gprs_share", "location_to_gprs")
    whole = traffic_mix(counts.withColumn("all", F.lit("all")), ["all"]).select(F.lit("mix").alias("check_name"), F.lit("info").alias("status"), *metrics)
    days = traffic_mix(counts.where("day is not null")).select(F.concat(F.lit("mix."), "day").alias("check_name"), F.lit("info").alias("status"), *metrics)
    return out.unionByName(as_results(whole.unionByName(days), *metrics))


# marts and facts


def dds_event(df: DataFrame) -> DataFrame:
    from cellframe.plans.events import CODES, location_known

    named = F.lower(F.trim("event_name"))
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v)]), named)
    s = Suite(df, schemas.EVENT.fieldNames()).nulls().rate("timestamp_parseable", S.event_time("event_timestamp").isNotNull(), 0.99, 0.995).none("event_count_positive", ~F.coalesce(F.col("event_count") >= 1, F.lit(False)), "failed")
    s.rate("stg_contract.event", F.col("event").isin(*CODES.values()), 0.999, 1.0).rate("stg_contract.event_name", named.isin(*CODES), 0.999, 1.0).rate("stg_contract.alignment", code == F.col("event"), 0.999, 1.0).rate("stg_contract.location", F.col("location").isNotNull(), 0.90, 0.98).rate("stg_contract.compressible", location_known(), 0.0, 0.5)
    s.rate("aggregated_share", F.col("event_count") > 1, 0.0, 0.0).unique("imsi_ts_event_duplicates", ["imsi", "event_timestamp", "event"], "warning").values("event_name", "event_name").values("tac", "imei", 12)
    b = df.groupBy(S.count_bucket("event_count").alias("bucket")).agg(F.count("*").alias("n"))
    return s.add(b.select(F.concat(F.lit("event_count."), F.coalesce("bucket", F.lit("<NA>"))).alias("check_name"), F.lit("info").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("metrics"))).results()


def dds_event_by_source(df: DataFrame, source: str = "source_id") -> DataFrame:
    """Coverage and the gates of the event table for each source, in one grouped pass: ``check_name`` begins with the source."""
    from cellframe.plans.events import CODES, location_known

    named = F.lower(F.trim("event_name"))
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v)]), named)
    gates = [("timestamp_parseable", S.event_time("event_timestamp").isNotNull(), 0.99, 0.995), ("stg_contract.event", F.col("event").isin(*CODES.values()), 0.999, 1.0), ("stg_contract.event_name", named.isin(*CODES), 0.999, 1.0), ("stg_contract.alignment", code == F.col("event"), 0.999, 1.0), ("stg_contract.location", F.col("location").isNotNull(), 0.90, 0.98), ("stg_contract.compressible", location_known(), 0.0, 0.5)]
    good = [F.avg(F.coalesce(g, F.lit(False)).cast("double")).alias(f"r{i}") for i, (_, g, _, _) in enumerate(gates)]
    t = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("_unknown")).alias("__source")).agg(F.count("*").alias("__rows"), F.sum("event_count").alias("__events"), *good)
    checks = [F.struct(F.lit("coverage").alias("check_name"), F.lit("ok").alias("status"), F.create_map(F.lit("rows"), F.col("__rows").cast("string"), F.lit("events"), F.col("__events").cast("string")).alias("metrics"))]
    checks += [F.struct(F.lit(n).alias("check_name"), gate_status(F.col(f"r{i}"), failed, warn).alias("status"), F.create_map(F.lit("rate"), F.col(f"r{i}").cast("string")).alias("metrics")) for i, (n, _, failed, warn) in enumerate(gates)]
    return t.select("__source", F.explode(F.array(*checks)).alias("c")).select(F.concat_ws(".", "__source", "c.check_name").alias("check_name"), "c.status", "c.metrics")


def fct_bs(df: DataFrame, vocabulary: Sequence[str] = ("m", "i", "x", "f", "o")) -> DataFrame:
    open_ = F.col("date_off").isNull() | (F.col("date_off") == F.lit(schemas.BS_OPEN_END).cast("timestamp_ntz"))
    key = list(schemas.BS_KEYS)
    s = Suite(df, schemas.BS.fieldNames())
    for c in key:
        s.none(f"key_null.{c}", F.col(c).isNull(), "failed")
    s.unique("version_unique", [*key, "date_on"], "warning").none("date_order", F.col("date_off") < F.col("date_on"), "failed").rate("open_share", open_, 0.0, 0.0).none("coords", ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False)))
    s.none("bs_type_vocab", ~F.coalesce(F.col("bs_type").isin(*vocabulary), F.lit(False))).none("standard_vocab", ~F.coalesce(F.col("telecomstandard").isin("2G", "3G", "4G"), F.lit(False)))
    return s.add(_wkt(df, "sector_wkt", "sector_wkt")).add(_wkt(df, "mapinfo_wkt", "mapinfo_wkt")).results()


def stg_geo_all(df: DataFrame) -> DataFrame:
    s = Suite(df, schemas.GEO_EVENT.fieldNames()).distinct(["msisdn", "imsi", "imei", "cgi"])
    for c in "msisdn start_time_utc cgi lat lon".split():
        s.none(f"required.{c}", F.col(c).isNull(), "failed")
    s.none("coords", ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))).none("time_order", F.col("end_time_utc") < F.col("start_time_utc"), "failed").none("event_count", F.col("event_count") < 1, "failed")
    s.none("type_vocab", ~F.coalesce(F.col("source_event_type").isin(*GEO_TYPES), F.lit(False)), "failed").none("utc_offset", ~F.coalesce(F.col("utc_offset").between(-12, 14), F.lit(False))).none("bs_type_vocab", ~F.coalesce(F.col("bs_type").isin("m", "i", "x", "f", "o"), F.lit(False)))
    return s.values("type", "source_event_type").unique("duplicates", "msisdn start_time_utc source_event_type cgi".split(), "warning").results()


def _invariants(df: DataFrame, key: Sequence[str]) -> DataFrame:
    a = intervals.overlap_count(df, key).select(F.lit("overlap_same_pair").alias("check_name"), F.when(F.col("overlaps") > 0, "failed").otherwise("ok").alias("status"), F.col("overlaps").alias("n"))
    b = intervals.mergeable_count(df, key).select(F.lit("mergeable_gap").alias("check_name"), F.when(F.col("mergeable") > 0, "warning").otherwise("ok").alias("status"), F.col("mergeable").alias("n"))
    return as_results(a.unionByName(b), "n")


def _binding(df: DataFrame, schema, kind: str, normal) -> Suite:
    s = Suite(df, schema.fieldNames())
    for c in ("msisdn", kind, "valid_from", "valid_to"):
        s.none(f"null.{c}", F.col(c).isNull(), "failed")
    s.none("order", F.col("valid_to") < F.col("valid_from"), "failed").none("msisdn_format", ~_like("msisdn", r"^\d{7,15}$"), "failed").none("msisdn_canonical", ~F.coalesce(S.msisdn("msisdn") == F.col("msisdn"), F.lit(False)))
    return s.none(f"{kind}_canonical", ~F.coalesce(normal(kind) == F.col(kind), F.lit(False))).unique("exact_duplicates", schema.fieldNames(), "warning")


def fct_msisdn_imei(df: DataFrame) -> DataFrame:
    s = _binding(df, schemas.MSISDN_IMEI, "imei", S.imei).none("imei_format", ~_like("imei", r"^\d{14,16}$"), "failed")
    return s.add(_invariants(df, ["msisdn", "imei"])).results()


def fct_msisdn_imsi(df: DataFrame) -> DataFrame:
    home = F.col("imsi").startswith("250")
    s = _binding(df, schemas.MSISDN_IMSI, "imsi", S.imsi).none("imsi_format", ~_like("imsi", r"^\d{14,15}$"), "failed").none("operator_valid", home & ~F.coalesce(F.col("operator_id").between(0, 99), F.lit(False)), "failed")
    s.none("operator_alignment", home & (F.col("operator_id") != S.operator_of_imsi("imsi")), "failed").none("operator_on_foreign", ~home & F.col("operator_id").isNotNull()).rate("foreign_share", ~home, 0.0, 0.0)
    return s.add(_invariants(df, ["msisdn", "operator_id", "imsi"])).results()


def fct_geo_intervals(df: DataFrame) -> DataFrame:
    s = Suite(df, schemas.STAY.fieldNames())
    for c in ("msisdn", "start_time_utc", "end_time_utc", "cgi_list", "time_key"):
        s.none(f"required.{c}", F.col(c).isNull(), "failed")
    s.none("order", F.col("end_time_utc") < F.col("start_time_utc"), "failed").none("coords", ~F.coalesce(F.col("sub_lat").between(-90, 90) & F.col("sub_lon").between(-180, 180), F.lit(False))).none("bs_type_vocab", ~F.coalesce(F.col("bs_type").isin("m", "i", "x", "f", "o"), F.lit(False)))
    s.none("timezone", ~F.coalesce(F.col("timezone").between(-12, 14), F.lit(False))).none("cgi_list_empty", F.coalesce(F.size("cgi_list"), F.lit(0)) < 1, "failed").unique("duplicates", "msisdn imsi imei start_time_utc end_time_utc bs_type".split(), "warning")
    sized = Suite(df.withColumn("n_cells", F.size("cgi_list")), ()).values("cgi_list_length", "n_cells")
    return s.add(sized.more[0]).results()


def fct_person(df: DataFrame, oksm: DataFrame | None = None) -> DataFrame:
    s = Suite(df, schemas.PERSON.fieldNames())
    for c in "report_date person_id msisdn imsi imei operator_id".split():
        s.none(f"critical_null.{c}", F.col(c).isNull(), "failed")
    for c in ("gender", "age", "citizenship"):
        s.none(f"demographic_null.{c}", F.col(c).isNull())
    s.unique("person_id_unique", ["person_id"], "failed").none("person_id_format", ~_like("person_id", r"^prs_[\da-f]{24}$"), "failed").none("gender_domain", ~F.coalesce(F.col("gender").isin("M", "F", "U"), F.lit(False)), "failed").none("age_domain", ~_like("age", r"^(U|\d{1,2}|1[01]\d|120)$"), "failed")
    s.none("citizenship_domain", ~_like("citizenship", r"^(U|\d{3})$"), "failed").none("confidence_domain", ~F.coalesce(F.col("person_confidence").isin("high", "medium", "low"), F.lit(False)), "failed").none("sim_count_domain", ~F.coalesce(F.col("sim_count") >= 1, F.lit(False)), "failed")
    s.rate("low_confidence", F.col("person_confidence") != "low", 0.0, 0.70).none("id_digits", ~_like("msisdn", r"^\d{7,15}$") | ~_like("imsi", r"^\d{14,15}$") | ~_like("imei", r"^\d{14,16}$"))
    one = df.agg(F.countDistinct("report_date").alias("dates"))
    s.add(as_results(one.select(F.lit("single_report_date").alias("check_name"), F.when(F.col("dates") > 1, "failed").otherwise("ok").alias("status"), "dates"), "dates"))
    extra = [c for c in df.columns if c not in schemas.PERSON.fieldNames()]
    s.fixed.append(("extra_columns", "warning" if extra else "ok", {"n": str(len(extra))}))
    if oksm is not None:
        s.add(_missing("citizenship_known", df.where("citizenship <> 'U'"), "citizenship", oksm, "numeric_code", "failed"))
    return s.results()
