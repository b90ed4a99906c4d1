"""Queries over the check suites: all checks, their status and their figures, against SQL that counts the same by other means.

Each suite's input is derived from the driver's tables by a statement that both engines understand; so both sides see the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.dq import suites
from cellframe.plans.catalogue import QUERIES, SQL, table


def derived(spark, d: str, sql: str) -> DataFrame:
    """A statement whose tables are written ``{name}``, over the driver's tables."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def flat(results: DataFrame) -> DataFrame:
    """A row for each figure of a check; the names of columns that the schema's check gives aren't figures."""
    kept = F.map_filter("metrics", lambda k, _: ~F.col("check_name").endswith("schema"))
    rows = results.select("check_name", "status", F.explode_outer(kept).alias("metric", "text"))
    return rows.select("check_name", "status", "metric", F.round(F.col("text").try_cast("double"), 6).alias("value"))


class Oracle:
    """SQL of a suite's checks, put together check by check."""

    def __init__(self, rows: str, prefix: str = "", frame: bool = True, alias: str = "t"):
        self.rows, self.prefix, self.alias, self.parts = plain(rows), prefix, alias, []
        if frame:
            self.row("presence", "'ok'").row("basic", "case when count(*) > 0 then 'ok' else 'warning' end", {"rows": "count(*)"})

    def row(self, name: str, status: str, metrics: dict[str, str] | None = None, rows: str | None = None) -> Oracle:
        """One check: aggregates over the rows."""
        rows = rows or self.alias
        named = name if name.startswith("'") else f"'{self.prefix}{name}'"
        for m, v in (metrics or {None: "null"}).items():
            self.parts.append(f"select {named} check_name, {status} status, {f"'{m}'" if m else 'null'} metric, cast({v} as double) val from {rows}" if m or rows == self.alias else f"select {named}, {status}, null, null from {rows}")
        return self

    def rate(self, name: str, good: str, failed: float, warn: float, among: str = "true") -> Oracle:
        x = f"case when {among} then case when {good} then 1.0 else 0.0 end end"
        r = f"coalesce(avg({x}), 1.0)"
        return self.row(name, f"case when {r} < {failed} then 'failed' when {r} < {warn} then 'warning' else 'ok' end", {"rate": r, "bad": f"coalesce(sum(1 - ({x})), 0)"})

    def none(self, name: str, bad: str, severity: str = "warning") -> Oracle:
        n = f"count(*) filter (where {bad})"
        return self.row(name, f"case when {n} > 0 then '{severity}' else 'ok' end", {"bad": n})

    def nulls(self, columns: Sequence[str], severity: str = "info") -> Oracle:
        for c in columns:
            r = f"coalesce(avg(case when {c} is null then 1.0 else 0.0 end), 1.0)"
            self.row(f"nulls.{c}", f"case when {r} > 0 then '{severity}' else 'ok' end", {"null_rate": r})
        return self

    def distinct(self, columns: Sequence[str]) -> Oracle:
        for c in columns:
            self.row(f"cardinality.{c}", "'info'", {"n_distinct": f"count(distinct {c})"})
        return self

    def unique(self, name: str, key: str, severity: str) -> Oracle:
        n = "coalesce(sum(n) filter (where n > 1), 0)"
        return self.row(name, f"case when {n} > 0 then '{severity}' else 'ok' end", {"rows": n, "keys": "count(*) filter (where n > 1)"}, f"(select count(*) n from {self.alias} group by {key})")

    def values(self, name: str, value: str, top: int | None = 20, nulls: bool = True, pct: bool = True, among: str = "true", few: int | None = None) -> Oracle:
        v = f"coalesce(cast({value} as varchar), '<NA>')" if nulls else f"cast({value} as varchar)"
        counted = f"select v, n, total, row_number() over (order by n desc, v) k, count(*) over () kinds from (select v, count(*) n, sum(count(*)) over () total from (select {v} v from {self.alias} where {among}) where v is not null group by v)"
        rows = f"(select * from ({counted}) where " + " and ".join([f"k <= {top}" if top else "true", f"kinds <= {few}" if few else "true"]) + ")"
        for m, e in (("n", "n"), *((("pct", "round(100.0 * n / total, 4)"),) if pct else ())):
            self.parts.append(f"select '{self.prefix}{name}.' || v, 'info', '{m}', cast({e} as double) from {rows}")
        return self

    def sql(self) -> str:
        schema = "" if not any("'ok' status, null metric" in p and "presence" in p for p in self.parts) else f" union all select '{self.prefix}schema', 'ok', null, null"
        first = "select cast(null as varchar) check_name, cast(null as varchar) status, cast(null as varchar) metric, cast(null as double) val where false"
        return f"with t as ({self.rows}), r as ({first} union all " + " union all ".join(self.parts) + schema + ") select distinct check_name, status, metric, round(val, 6) as value from r"


def register(name: str, doc: str, run: Callable, *oracles: Oracle) -> None:
    def query(spark, d):
        return flat(run(spark, d))

    query.__name__, query.__doc__ = name, doc
    QUERIES[name] = query
    if len(oracles) == 1:
        SQL[name] = oracles[0].sql()
    else:
        SQL[name] = " union all ".join(f"select * from ({o.sql()})" for o in oracles)


def one_table(name: str, suite: Callable[[DataFrame], DataFrame], rows: str, oracle: Oracle) -> None:
    register(name, (suite.__doc__ or f"All checks of the suite {suite.__name__}.").split("\n")[0], lambda spark, d: suite(derived(spark, d, rows)), oracle)


def _blank(c: str) -> str:
    return f"coalesce(trim(cast({c} as varchar)), '') = ''"


def _full(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches(cast({c} as varchar), '{pattern}'), false)"


def _number(c: str) -> str:
    return f"try_cast({c} as double)"


def _wkt(o: Oracle, c: str, name: str) -> Oracle:
    """Texts of four kinds only: right, a point, garbage, an open ring."""
    wrong = {"present": f"{c} is not null", "parse_errors": f"{c} = 'garbage'", "wrong_type": f"{c} like 'POINT%'", "empty": f"{c} like '%EMPTY'", "invalid": f"{c} = 'POLYGON((0 0,1 0,1 1))'"}
    bad = " or ".join(list(wrong.values())[1:])
    return o.row(name, f"case when count(*) filter (where {bad}) > 0 then 'warning' else 'ok' end", {k: f"count(*) filter (where {v})" for k, v in wrong.items()})


def _shape(k: str) -> str:
    return f"case {k} % 5 when 0 then 'POLYGON((0 0,1 0,1 1,0 0))' when 1 then 'POINT(1 2)' when 2 then 'garbage' when 3 then 'POLYGON((0 0,1 0,1 1))' end"


# dimensions

_OKTMO = f"select {_shape('n_nationkey')} as WKT, case when n_nationkey < 8 then 1 when n_nationkey = 24 then 3 else 2 end as level, case when n_nationkey < 7 then null when n_nationkey = 7 then '9' when n_nationkey = 23 then '' else cast(n_nationkey % 9 as string) end as parent_code, case when n_nationkey = 20 then 'x1' when n_nationkey = 21 then '19' else cast(n_nationkey as string) end as code, case when n_nationkey % 6 = 0 then '-' when n_nationkey % 7 = 0 then '' else n_name end as name from {{nation}}"
_o = Oracle(_OKTMO).nulls(["WKT", "level", "parent_code", "code", "name"]).distinct(["code", "parent_code", "level"])
_o.none("level_domain", "coalesce(level not in (1, 2), true)").none("code_numeric", f"not {_full('code', '^[0-9]+$')}").none("parent_numeric", f"parent_code is not null and not {_full('parent_code', '^[0-9]+$')}").none("hierarchy.level1_with_parent", f"level = 1 and not ({_blank('parent_code')})").none("hierarchy.level2_without_parent", f"level = 2 and {_blank('parent_code')}").none("name_empty", f"{_blank('name')} or trim(name) = '-'").unique("code_unique", "code", "warning")
for _n, _a, _b in (("orphans", "select distinct parent_code c from t where level = 2 and parent_code is not null", "select code from t where level = 1"), ("childless", "select distinct code c from t where level = 1", "select parent_code from t where level = 2 and parent_code is not null")):
    _o.row(f"hierarchy.{_n}", "case when count(*) > 0 then 'warning' else 'ok' end", {"missing": "count(*)"}, f"({_a}) where c not in ({_b})")
one_table("dq_dim_territories", suites.dim_oktmo, _OKTMO, _wkt(_o, "WKT", "geometry"))

_ZONES = f"select n_nationkey as code, n_name as name, case when n_nationkey = 3 then null else n_nationkey - 9 end as timezone, {_shape('n_nationkey')} as geometry from {{nation}}"
_o = Oracle(_ZONES).nulls(["code", "name", "timezone", "geometry"]).distinct(["code", "timezone"]).none("code_numeric", "code is null").none("timezone_range", "not coalesce(timezone between -12 and 14, false)").values("timezone", "timezone")
one_table("dq_dim_time_zones", suites.dim_time_zones, _ZONES, _wkt(_o, "geometry", "geometry"))

_TAC = "select case when p_partkey % 50 = 0 then cast(p_partkey as string) when p_partkey % 51 = 0 then '00000001' else lpad(cast(p_partkey as string), 8, '0') end as tac, case when p_partkey % 7 = 0 then '' else p_brand end as manufacturer, p_name as model_name, p_name as marketing_name, case p_partkey % 4 when 0 then 'Modem' when 1 then 'Vehicle Unit' when 2 then null else 'Smartphone' end as equipment_type, p_type as radio_technology, p_type as sim_form_factor, case p_partkey % 3 when 0 then '2020-01-05' when 1 then '05.01.2020' else null end as allocation_date, p_brand as reporting_body, p_brand as chipset, p_name as comment, p_partkey % 4 = 0 or p_partkey % 13 = 0 as is_m2m from {part}"
_tac_columns = "tac manufacturer model_name marketing_name equipment_type radio_technology sim_form_factor allocation_date reporting_body chipset comment is_m2m".split()
_o = Oracle(_TAC).nulls(_tac_columns).none("tac_format", f"not {_full('tac', '^[0-9]{8}$')}", "failed").unique("tac_unique", "tac", "failed").none("m2m_matches_equipment", "is_m2m <> coalesce(equipment_type in ('IoT Device', 'M2M Module', 'Modem', 'Module', 'Vehicle Unit', 'WLAN Router'), false)", "failed")
_o.none("allocation_date_format", f"not ({_blank('allocation_date')}) and not {_full('allocation_date', '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')}").none("manufacturer_empty", _blank("manufacturer")).rate("m2m_share", "is_m2m", 0.0, 0.001)
one_table("dq_dim_device_types", suites.dim_tac, _TAC, _o)

_OKSM = "select case when n_nationkey = 5 then '43' else lpad(cast(n_nationkey * 28 as string), 3, '0') end as numeric_code, case when n_nationkey = 4 then '' else n_name end as name_short, n_name as name_full, case when n_nationkey % 9 = 0 then 'x1' else upper(substr(n_name, 1, 2)) end as alpha2, upper(substr(n_name, 1, 3)) as alpha3, case when n_nationkey = 7 then null else cast(n_nationkey % 20 as string) end as autokey from {nation}"
_o = Oracle(_OKSM).nulls(["numeric_code", "name_short", "name_full", "alpha2", "alpha3", "autokey"]).none("numeric_format", f"not {_full('numeric_code', '^[0-9]{3}$')}", "failed").none("alpha2_format", f"not {_full('alpha2', '^[A-Z]{2}$')}", "failed").none("alpha3_format", f"not {_full('alpha3', '^[A-Z]{3}$')}", "failed")
for _c in ("numeric_code", "alpha2", "alpha3", "autokey"):
    _o.unique(f"{_c}_unique", _c, "failed")
for _a, _b in (("numeric_code", "alpha2"), ("numeric_code", "alpha3"), ("alpha2", "alpha3")):
    _m = {"pairs": f"count(distinct {_a} || '|' || {_b})", "first": f"count(distinct {_a})", "second": f"count(distinct {_b})"}
    _o.row(f"pairs.{_a}.{_b}", f"case when {_m['pairs']} = {_m['first']} and {_m['pairs']} = {_m['second']} then 'ok' else 'warning' end", _m)
_o.none("names", f"{_blank('name_short')} or {_blank('name_full')}", "failed").none("autokey_empty", _blank("autokey"), "failed").distinct(["numeric_code", "alpha2"])
_o.row("home_present", "case when coalesce(max(case when numeric_code = '643' then 1 else 0 end), 0) = 1 then 'ok' else 'warning' end", {"found": "coalesce(max(case when numeric_code = '643' then 1 else 0 end), 0)"})
one_table("dq_dim_countries", suites.dim_oksm, _OKSM, _o)


# sources

_BS = """select case when o_orderkey % 97 = 0 then 'ERR' else '250' end as mcc, case when o_orderkey % 41 = 0 then '-1' else cast(o_orderkey % 4 as string) end as mnc, case when o_orderkey % 53 = 0 then '200000' else cast(o_custkey as string) end as lac, case when o_orderkey % 59 = 0 then null else cast(o_orderkey % 9000 as string) end as cell,
 case when o_orderkey % 61 = 0 then 'never' else cast(o_orderdate as string) end as date_on, case when o_orderkey % 19 = 0 then '1990-01-01 00:00:00' when o_orderkey % 23 = 0 then null else cast(o_orderdate + interval '40' day as string) end as date_off, case when o_orderkey % 29 = 0 then '700' when o_orderkey % 31 = 0 then '' else cast(37 + o_custkey % 10 as string) end as coord_x, case when o_orderkey % 37 = 0 then '95' else cast(55 + o_custkey % 7 as string) end as coord_y,
 case o_orderkey % 3 when 0 then 'outdoor' when 1 then 'indoor' end as bs_type, case o_orderkey % 5 when 0 then '4G' when 1 then '3g' when 2 then 'LTE' when 3 then '' else '2G' end as generation, case when o_orderkey % 7 = 0 then '400' when o_orderkey % 8 = 0 then '' else cast(o_orderkey % 360 as string) end as azimuth, cast(o_orderkey % 180 as string) as power, case when o_orderkey % 6 = 0 then null else cast(o_orderkey % 260 as string) end as height,
 cast(o_orderkey % 9 as string) as tilt, case o_orderkey % 3 when 0 then '900' when 1 then '1800' else '2600' end as frequency, case o_orderkey % 4 when 0 then '10, 20.5' when 1 then 'x' when 2 then '' end as frequency_in, case o_orderkey % 4 when 0 then 'yes' when 1 then 'maybe' when 2 then '0' end as border from {orders}"""
_x, _y, _on, _off = _number("coord_x"), _number("coord_y"), "try_cast(date_on as timestamp)", "try_cast(date_off as timestamp)"
_lac, _cell = _number("lac"), _number("cell")
_expected = "mcc mnc lac cell date_on date_off coord_x coord_y bs_type generation".split()
_o = Oracle(_BS).nulls(_expected).distinct(["mcc", "mnc", "bs_type", "generation"])
_o.rate("stg_contract.lac_cell", f"{_lac} >= 0 and {_lac} < 1e5 and {_cell} >= 0 and {_cell} < 1e6", 0.995, 0.999).rate("stg_contract.coords", f"{_x} between -180 and 180 and {_y} between -90 and 90", 0.995, 0.999).rate("stg_contract.temporal_order", f"{_off} is null or {_off} >= {_on}", 0.99, 0.995).rate("stg_contract.generation_present", f"not ({_blank('generation')})", 0.99, 0.995)
_o.rate("contract.mcc_rf", f"{_number('mcc')} = 250", 0.99, 0.999).rate("contract.mnc_valid", f"{_number('mnc')} between 0 and 99", 0.99, 0.999).rate("contract.lac_cell_non_negative", f"{_lac} >= 0 and {_cell} >= 0", 0.995, 0.999).none("contract.date_off_present", f"{_off} is null", "failed").rate("contract.coords_present", f"{_x} is not null and {_y} is not null", 0.995, 0.999)
_o.rate("contract.generation_vocab", "upper(trim(generation)) in ('2G', '3G', '4G')", 0.95, 0.99).rate("contract.azimuth_semantics", f"{_number('azimuth')} between 0 and 360", 0.98, 0.995, f"not ({_blank('azimuth')})")
for _c, _r in {"power": (0, 150), "height": (-50, 240), "tilt": (-120, 120)}.items():
    _o.rate(f"contract.range.{_c}", f"{_number(_c)} between {_r[0]} and {_r[1]}", 0.98, 0.995, f"not ({_blank(_c)})")
_o.rate("contract.frequency_list.frequency_in", "frequency_in = '10, 20.5'", 0.98, 0.995, f"not ({_blank('frequency_in')})").none("contract.border_boolean", "border = 'maybe'").unique("key_integrity", "mcc, mnc, lac, cell, date_on", "warning").values("bs_type", "bs_type").values("generation", "generation")
_o.row("contract.cells_per_coordinate", "'info'", {"p50": "quantile_cont(n, 0.5)", "p95": "quantile_cont(n, 0.95)", "max": "max(n)"}, f"(select count(*) n from t where {_x} between -180 and 180 and {_y} between -90 and 90 group by coord_x, coord_y)")
_o.row("spatial.ranges", "'info'", {"bad_lon": f"count(*) filter (where {_x} not between -180 and 180)", "bad_lat": f"count(*) filter (where {_y} not between -90 and 90)", "no_lon": f"count(*) filter (where {_x} is null)", "no_lat": f"count(*) filter (where {_y} is null)"})
for _c in ("power", "height", "tilt", "azimuth", "frequency"):
    _v = _number(_c)
    _o.row(f"numeric.{_c}", "'info'", {"n": f"count({_v})", "nulls": f"count(*) - count({_v})", "min": f"min({_v})", "p50": f"quantile_cont({_v}, 0.5)", "p95": f"quantile_cont({_v}, 0.95)", "max": f"max({_v})", "mean": f"avg({_v})", "std": f"coalesce(stddev_samp({_v}), 0)"})
    _o.row(f"radio.presence.{_c}", "'info'", {"empty": f"count(*) filter (where {_blank(_c)})", "filled": f"count(*) filter (where not ({_blank(_c)}))", "n_distinct": f"count(distinct case when not ({_blank(_c)}) then trim({_c}) end)"})
for _c in ("mcc", "mnc", "bs_type", "generation", "frequency"):
    _o.values(f"unique_values.{_c}", _c, None, nulls=False, few=20)
_o.none("radio.power_without_height", f"{_number('power')} is not null and {_number('height')} is null", "info").values("radio.generation_bs_type", "coalesce(generation, '<NA>') || '.' || coalesce(bs_type, '<NA>')", None)
_o.row("temporal.active_cells_a_day", "'info'", {"p50": "quantile_cont(n, 0.5)", "p95": "quantile_cont(n, 0.95)", "max": "max(n)", "days": "count(*)"}, f"(select g.d, count(s.a) n from (select unnest(generate_series((select min(cast({_on} as date)) from t where {_off} is null or cast({_off} as date) >= cast({_on} as date)), (select max(cast({_on} as date)) from t where {_off} is null or cast({_off} as date) >= cast({_on} as date)), interval 1 day)) d) g left join (select cast({_on} as date) a, cast({_off} as date) b from t where {_on} is not null and ({_off} is null or cast({_off} as date) >= cast({_on} as date))) s on s.a <= g.d and (s.b is null or g.d <= s.b) group by g.d)")
_o.row("scope", "'info'", {"rows": "count(*)", "operators": "count(distinct mcc || '|' || mnc)", "cells": "count(distinct mcc || '|' || mnc || '|' || lac || '|' || cell)"})
for _n, _t in (("month", _on), ("month_off", _off)):
    _o.values(f"temporal.{_n}", f"strftime({_t}, '%Y-%m')", None, pct=False)
one_table("dq_source_cells", suites.src_bs, _BS, _o)

_PERSON_SOURCE = """select case o_orderkey % 6 when 0 then 1 when 1 then 3 when 2 then 4 when 3 then 5 else 2 end as identity_type, o_custkey % 4 as operator_Id, case when o_orderkey % 17 = 0 then '' when o_orderkey % 18 = 0 then '8912' else concat('79', lpad(cast(o_custkey as string), 9, '0')) end as isdn, case when o_orderkey % 13 = 0 then null else concat('25001', lpad(cast(o_custkey as string), case when o_orderkey % 11 = 0 then 8 else 10 end, '0')) end as imsi,
 case when o_orderkey % 14 = 0 then null else lpad(cast(o_orderkey as string), 15, '3') end as imei, case when o_orderkey % 15 = 0 then '123' else lpad(cast(o_orderkey as string), 19, '8') end as iccid, case when o_orderkey % 9 = 0 then 1 else 0 end as client_type, o_orderdate as actually_from, case when o_orderkey % 25 = 0 then o_orderdate - interval '3' day when o_orderkey % 4 = 0 then null else o_orderdate + interval '90' day end as actually_to,
 case when o_orderkey % 21 = 0 then cast(null as date) when o_orderkey % 22 = 0 then cast('2020-05-05' as date) else cast('1970-03-04' as date) end as birth_day, case when o_orderkey % 9 = 0 and o_orderkey % 2 = 0 then null when o_orderkey % 31 = 0 then '' else 'Ivan' end as first_name, 'X' as second_name, case when o_orderkey % 9 = 0 and o_orderkey % 2 = 0 then null else 'Petrov' end as last_name, case when o_orderkey % 16 = 0 then '4010123456' when o_orderkey % 3 = 0 then '' else '4010 123456' end as document from {orders}"""
_gsm, _phys, _named = "identity_type in (2, 4, 5)", "client_type = 0", f"(not ({_blank('last_name')}) and not ({_blank('first_name')}))"
_filled = lambda c: f"not ({_blank(c)})"
_o = Oracle(_PERSON_SOURCE).nulls("identity_type operator_Id isdn imsi imei iccid client_type actually_from actually_to birth_day first_name second_name last_name document".split()).distinct(["operator_Id", "isdn", "imsi"])
for _c in ("isdn", "imsi", "imei"):
    _o.rate(f"identity.{_c}_filled", _filled(_c), 0.90, 0.98, _gsm).rate(f"stg_contract.{_c}_present", _filled(_c), 0.99, 0.995, _phys)
_o.rate("non_gsm_isdn_leak", _blank("isdn"), 0.0, 0.99, f"not ({_gsm})").rate("isdn_format", _full("isdn", "^7[0-9]{10}$"), 0.95, 0.99, _filled("isdn")).rate("imsi_length", _full("imsi", "^[0-9]{15}$"), 0.95, 0.99, _filled("imsi")).rate("imei_length", _full("imei", "^[0-9]{15}$"), 0.95, 0.99, _filled("imei")).rate("iccid_length", _full("iccid", "^[0-9]{18,20}$"), 0.90, 0.98, _filled("iccid"))
_o.rate("passport", _full("document", "^[0-9]{4} [0-9]{6}$"), 0.90, 0.98, f"{_phys} and {_filled('document')}").rate("age_range", "date_diff('day', birth_day, date '2024-01-01') / 365.25 between 14 and 110", 0.90, 0.98, f"{_phys} and birth_day is not null").rate("fio_physical", _named, 0.95, 0.98, _phys).rate("fio_corporate_absent", f"not {_named}", 0.0, 0.95, f"not ({_phys})")
_o.rate("stg_contract.interval_order", "actually_to is null or actually_to >= actually_from", 0.995, 0.999).rate("stg_contract.fio_present", _named, 0.95, 0.98, _phys).unique("operator_isdn_key", "operator_Id, isdn, actually_from", "warning").unique("four_key", "operator_Id, isdn, imsi, actually_from", "warning").values("operator", "operator_Id").values("cross", "identity_type || '.' || client_type", None)
one_table("dq_source_subscriptions", lambda df: suites.src_person(df, F.lit("2024-01-01").cast("date")), _PERSON_SOURCE, _o)

_INVENTORY = "select cast(o_orderdate as date) as day, count(*) as rows, min(o_orderkey) % 3 <> 0 as success from {orders} where o_orderkey % 40 = 0 group by cast(o_orderdate as date)"
_low, _high = "date '1996-03-01'", "date '1996-05-31'"
_in = f"(select * from t where day between {_low} and {_high})"
_o = Oracle(_INVENTORY, frame=False).row("date_range", "case when count(*) > 0 then 'ok' else 'warning' end", {"days": "count(*)", "span": "date_diff('day', min(day), max(day)) + 1"}, _in)
_o.row("calendar_coverage", "case when count(*) > 0 then 'warning' else 'ok' end", {"missing": "count(*)"}, f"(select unnest(generate_series({_low}, {_high}, interval 1 day)) g) where cast(g as date) not in (select day from t)")
for _k, _c in (("success", "success"), ("partial", "not success")):
    _o.row(f"period_volume.{_k}", "'info'", {"days": "count(*)", "min": "min(rows)", "p50": "quantile_cont(rows, 0.5)", "p95": "quantile_cont(rows, 0.95)", "max": "max(rows)", "mean": "avg(rows)"}, f"{_in} where {_c}")
_o.row("success_days", "case when count(*) filter (where success) > 0 then 'ok' else 'warning' end", {"days": "count(*)", "success_days": "count(*) filter (where success)", "share": "count(*) filter (where success) / nullif(count(*), 0)", "latest_day": "max(case when success then day(day) end)"}, _in)
one_table("dq_snapshot_inventory", lambda df: suites.snapshot_inventory(df, F.lit("1996-03-01").cast("date"), F.lit("1996-05-31").cast("date")), _INVENTORY, _o)

_EXCLUDED = {"imsi": "select case when c_custkey % 10 = 0 then null else cast(c_custkey % 700 as string) end as value from {customer}", "imei": "select cast(s_suppkey as string) as value from {supplier}"}
_parts = []
for _k, _s in _EXCLUDED.items():
    _parts.append(Oracle(_s, f"{_k}.").row("totals", "'info'", {"rows": "count(*)", "n_unique": "count(distinct value)", "nulls": "count(*) filter (where value is null)"}))
_gone = Oracle("select 1", "msisdn.", frame=False).row("presence", "'failed'")
register("dq_source_exclusions", "Checks of three exclusion lists, one of which isn't there.", lambda spark, d: suites.src_exclusions({**{k: derived(spark, d, s) for k, s in _EXCLUDED.items()}, "msisdn": None}, spark), *_parts)
SQL["dq_source_exclusions"] += " union all select 'msisdn.presence', 'failed', null, null"

_MART = """select case when event_id % 89 = 0 then 'bad' else {time} end as Started, case when event_id % 3 = 0 then null else concat('25001', lpad(cast(user_id as string), 10, '0')) end as IMSI, cast(null as string) as IMEI, case when event_id % 77 = 0 then '12' else concat('7916', lpad(cast(user_id as string), 7, '0')) end as phone, case when event_id % 43 = 0 then -1 else user_id % 7 end as lac, event_id % 90 as cell, 1 + event_id % 3 as Owner, case when event_id % 2 = 0 then '25001' else '25002' end as code, '250' as MCC, '01' as MNC, event_type from {events}"""
_SPARK_TIME, _DUCK_TIME = "date_format(ts, 'yyyyMMddHHmmss')", "strftime(ts, '%Y%m%d%H%M%S')"


def _mart_rows(spark, d) -> dict[str, DataFrame]:
    from cellframe.plans.events import CELL, PARTY

    base, out = derived(spark, d, _MART.replace("{time}", _SPARK_TIME)), {}
    for mart, kind in (("cdr", "click"), ("gprs", "view"), ("sms", "purchase"), ("location", "signup")):
        lac, cell = CELL[mart]
        rows = base.where(F.col("event_type") == kind).withColumnRenamed("phone", PARTY[mart]).withColumnRenamed("lac", lac).withColumnRenamed("cell", cell)
        out[mart] = rows.withColumnRenamed("code", "OwnerMCCMNC") if mart in ("cdr", "gprs") else rows
    return out


def _mart_oracle(mart: str, kind: str) -> Oracle:
    from cellframe.plans.events import CELL, PARTY

    lac, cell = CELL[mart]
    party, good = PARTY[mart], "regexp_full_match(Started, '[0-9]{14}')"
    rows = f"select Started, IMSI, IMEI, phone as {party}, lac as {lac}, cell as {cell}, Owner, code as OwnerMCCMNC, MCC, MNC from ({_MART.replace('{time}', _DUCK_TIME)}) where event_type = '{kind}'"
    o = Oracle(rows, f"{mart}.").nulls(["Started", "IMSI", "IMEI", party, lac, cell]).rate("stg_contract.started", good, 0.99, 0.995).rate("stg_contract.owner", "Owner in (1, 2)", 0.99, 0.995).rate("stg_contract.lac_cell", f"{lac} >= 0 and {lac} < 1e5 and {cell} >= 0 and {cell} < 1e6", 0.99, 0.995)
    o.rate("stg_contract.imsi", "coalesce(length(IMSI), 0) >= 10", *suites._IMSI_LIMITS[mart]).rate("stg_contract.msisdn", f"length({party}) between 10 and 15", 0.98, 0.99)
    if mart in ("cdr", "gprs"):
        o.unique("imsi_started_duplicates", "IMSI, Started", "warning")
    o.row("coverage", "case when count(distinct substr(Started, 1, 8)) > 0 then 'ok' else 'warning' end", {"rows": "count(*)", "well_timed": f"count(*) filter (where {good})", "days": f"count(distinct case when {good} then substr(Started, 1, 8) end)"})
    located = f"({lac} >= 0 and {cell} >= 0)"
    o.row("filters", "'info'", {"untimed": f"count(*) filter (where not {good})", "timed_unlocated": f"count(*) filter (where {good} and not {located})", "timed_located": f"count(*) filter (where {good} and {located})"})
    for c in suites.DISTRIBUTIONS[mart]:
        if c in ("Owner", "OwnerMCCMNC", "MCC", "MNC"):
            o.values(f"distribution.{c}", c, None, nulls=False, few=20)
    return o.values("hour", "substr(Started, 9, 2)", None, pct=False, among=good)


_kinds = {"cdr": "click", "gprs": "view", "sms": "purchase", "location": "signup"}
register("dq_source_marts", "Checks of four marts and the mix of traffic among them.", lambda spark, d: suites.src_marts(_mart_rows(spark, d)), *[_mart_oracle(m, k) for m, k in _kinds.items()])
_counted = ", ".join(f"count(*) filter (where event_type = '{k}') {m}" for m, k in _kinds.items())
_mix = f"with m as (select case when event_id % 89 = 0 then null else strftime(ts, '%Y%m%d') end as day, event_id, event_type from events where event_type in ('click', 'view', 'purchase', 'signup')), c as (select '' as suffix, {_counted} from m union all select '.' || day, {_counted} from m where day is not null group by day)"
SQL["dq_source_marts"] += " union all (" + _mix + " " + " union all ".join(f"select 'mix' || suffix, 'info', '{n}', round(cast({e} as double), 6) from c" for n, e in {**{m: m for m in _kinds}, "total": "cdr + sms + gprs + location", "gprs_share": "round(gprs / nullif(cdr + sms + gprs + location, 0), 6)", "location_to_gprs": "round(location / greatest(gprs, 1), 6)"}.items()) + ")"


# marts and facts

_EVENT = """select case when event_id % 120 = 0 then 'x' else {time} end as event_timestamp, concat('25001', lpad(cast(user_id as string), 10, '0')) as imsi, case when event_id % 4 = 0 then null else lpad(cast(user_id as string), 15, '3') end as imei, '79160000000' as msisdn, {location} as location, case when event_id % 500 = 0 then 7 else case event_type when 'click' then 10001 when 'view' then 10003 when 'purchase' then 10002 else 10004 end end as event,
 case event_type when 'click' then 'cdr' when 'view' then ' GPRS' when 'purchase' then 'sms' when 'error' then 'other' else 'location' end as event_name, event_id % 25 as event_count, case when event_id % 3 = 0 then 'far-east' when event_id % 3 = 1 then 'central' end as source_id from {events}"""
_LOC = "named_struct('mcc', '250', 'mnc', case when event_id % 10 = 0 then ' ' else '01' end, 'lac', user_id, 'cell', event_id)"
_DLOC = "{'mcc': '250', 'mnc': case when event_id % 10 = 0 then ' ' else '01' end, 'lac': user_id, 'cell': event_id}"


def _event_rows(spark, d):
    return derived(spark, d, _EVENT.replace("{time}", _SPARK_TIME).replace("{location}", f"if(event_id % 15 = 0, null, {_LOC})").replace("event_id % 25 as", "cast(event_id % 25 as bigint) as"))


_event_sql = plain(_EVENT.replace("{time}", _DUCK_TIME).replace("{events}", "events").replace("{location}", "<loc>")).replace("<loc>", f"case when event_id % 15 = 0 then null else {_DLOC} end")


class _Events(Oracle):
    def __init__(self, frame: bool = True, prefix: str = ""):
        super().__init__("select 1", prefix, frame)
        self.rows = _event_sql


_known = "coalesce(location is not null and trim(location.mcc) <> '' and trim(location.mnc) <> '' and location.lac is not null and location.cell is not null, false)"
_parse, _nm = "regexp_full_match(event_timestamp, '[0-9]{14}')", "lower(trim(event_name))"
_code = f"case {_nm} when 'cdr' then 10001 when 'sms' then 10002 when 'gprs' then 10003 when 'location' then 10004 end"
_o = _Events().nulls("event_timestamp imsi imei msisdn location event event_name event_count".split()).rate("timestamp_parseable", _parse, 0.99, 0.995).none("event_count_positive", "not coalesce(event_count >= 1, false)", "failed").rate("stg_contract.event", "event in (10001, 10002, 10003, 10004)", 0.999, 1.0)
_o.rate("stg_contract.event_name", f"{_nm} in ('cdr', 'sms', 'gprs', 'location')", 0.999, 1.0).rate("stg_contract.alignment", f"{_code} = event", 0.999, 1.0).rate("stg_contract.location", "location is not null", 0.90, 0.98).rate("stg_contract.compressible", _known, 0.0, 0.5).rate("aggregated_share", "event_count > 1", 0.0, 0.0)
_o.unique("imsi_ts_event_duplicates", "imsi, event_timestamp, event", "warning").values("event_name", "event_name").values("tac", "imei", 12).values("event_count", "case when event_count > 20 then '>20' when event_count > 5 then '6-20' when event_count > 1 then '2-5' when event_count > 0 then '1' end", None, pct=False)
register("dq_events", "All checks of the unified event table.", lambda spark, d: suites.dds_event(_event_rows(spark, d)), _o)

_gates = [("timestamp_parseable", _parse, 0.99, 0.995), ("stg_contract.event", "event in (10001, 10002, 10003, 10004)", 0.999, 1.0), ("stg_contract.event_name", f"{_nm} in ('cdr', 'sms', 'gprs', 'location')", 0.999, 1.0), ("stg_contract.alignment", f"{_code} = event", 0.999, 1.0), ("stg_contract.location", "location is not null", 0.90, 0.98), ("stg_contract.compressible", _known, 0.0, 0.5)]
_each = "(select coalesce(source_id, '_unknown') src, * from t) group by src"
_o = _Events(frame=False)
for _m, _e in (("rows", "count(*)"), ("events", "sum(event_count)")):
    _o.parts.append(f"select src || '.coverage', 'ok', '{_m}', cast({_e} as double) from {_each}")
for _n, _g, _f, _w in _gates:
    _r = f"avg(case when {_g} then 1.0 else 0.0 end)"
    _o.parts.append(f"select src || '.{_n}', case when {_r} < {_f} then 'failed' when {_r} < {_w} then 'warning' else 'ok' end, 'rate', cast({_r} as double) from {_each}")
register("dq_events_by_source", "Coverage and gates of each source's events.", lambda spark, d: suites.dds_event_by_source(_event_rows(spark, d)), _o)

_FCT_BS = f"select cast(250 as smallint) as mcc, case when s_suppkey % 40 = 0 then null else cast(s_suppkey % 3 as smallint) end as mnc, s_nationkey as lac, s_suppkey % 60 as cell_id, case s_suppkey % 4 when 0 then '5G' when 1 then null when 2 then '4G' else '2G' end as telecomstandard, 900 as frequency, case s_suppkey % 5 when 0 then 'q' when 1 then null when 2 then 'i' else 'o' end as bs_type, cast(case when s_suppkey % 30 = 0 then 95 else 55 end as double) as lat, cast(case when s_suppkey % 31 = 0 then null else 37 end as double) as lon, 'g' as geohash, 1.0 as azimuth, 1.0 as sector_angle, 1.0 as sector_radius, {_shape('s_suppkey')} as sector_wkt, 1.0 as sector_wkt_area, 1.0 as sector_wkt_centroid_lon, 1.0 as sector_wkt_centroid_lat, {_shape('(s_suppkey + 1)')} as mapinfo_wkt, 1.0 as mapinfo_wkt_area, 1.0 as mapinfo_wkt_centroid_lon, 1.0 as mapinfo_wkt_centroid_lat, 3 as timezone, '01' as oktmo_code_1, '0101' as oktmo_code_2, 'a' as address, 'l' as location, 'd' as description, <t1> as date_on, case s_suppkey % 3 when 0 then <t2> when 1 then null else <t0> end as date_off from {{supplier}}"
_stamp = lambda sql, ntz: sql.replace("<t0>", f"cast('2023-01-01 00:00:00' as {ntz})").replace("<t1>", f"cast('2024-01-01 00:00:00' as {ntz})").replace("<t2>", f"cast('2262-04-11 00:00:00' as {ntz})")
_o = Oracle(_stamp(_FCT_BS, "timestamp"))
for _c in ("mcc", "mnc", "lac", "cell_id"):
    _o.none(f"key_null.{_c}", f"{_c} is null", "failed")
_o.unique("version_unique", "mcc, mnc, lac, cell_id, date_on", "warning").none("date_order", "date_off < date_on", "failed").rate("open_share", "date_off is null or date_off = timestamp '2262-04-11 00:00:00'", 0.0, 0.0).none("coords", "not coalesce(lat between -90 and 90 and lon between -180 and 180, false)")
_o.none("bs_type_vocab", "not coalesce(bs_type in ('m', 'i', 'x', 'f', 'o'), false)").none("standard_vocab", "not coalesce(telecomstandard in ('2G', '3G', '4G'), false)")
one_table("dq_cells", suites.fct_bs, _stamp(_FCT_BS, "timestamp_ntz"), _wkt(_wkt(_o, "sector_wkt", "sector_wkt"), "mapinfo_wkt", "mapinfo_wkt"))
SQL["dq_cells"] = _o.sql()

_GEO = "select case when event_id % 70 = 0 then null else user_id end as msisdn, user_id + event_id % 2 as imsi, event_id % 90 as imei, ts as start_time_utc, case when event_id % 60 = 0 then ts - interval '1' minute when event_id % 2 = 0 then ts end as end_time_utc, case when event_id % 80 = 0 then 20 else 3 end as utc_offset, cast(case when event_id % 50 = 0 then 91 else 55 end as double) as lat, cast(37 as double) as lon, case event_id % 9 when 0 then 'z' when 1 then null when 2 then 'i' else 'o' end as bs_type, case when event_id % 65 = 0 then null else event_id % 12 end as cgi, event_id % 4 as event_count, case event_type when 'click' then 'cdr' when 'view' then 'gprs' when 'purchase' then 'sms' when 'error' then 'fax' else 'location' end as source_event_type, '01' as oktmo_code_1, '02' as oktmo_code_2 from {events}"
_kinds_bs = "not coalesce(bs_type in ('m', 'i', 'x', 'f', 'o'), false)"
_o = Oracle(_GEO).distinct(["msisdn", "imsi", "imei", "cgi"])
for _c in "msisdn start_time_utc cgi lat lon".split():
    _o.none(f"required.{_c}", f"{_c} is null", "failed")
_o.none("coords", "not coalesce(lat between -90 and 90 and lon between -180 and 180, false)").none("time_order", "end_time_utc < start_time_utc", "failed").none("event_count", "event_count < 1", "failed").none("type_vocab", "not coalesce(source_event_type in ('cdr', 'sms', 'gprs', 'location'), false)", "failed")
_o.none("utc_offset", "not coalesce(utc_offset between -12 and 14, false)").none("bs_type_vocab", _kinds_bs).values("type", "source_event_type").unique("duplicates", "msisdn, start_time_utc, source_event_type, cgi", "warning")
one_table("dq_geo_events", suites.stg_geo_all, _GEO, _o)


def _binding_oracle(rows: str, kind: str, columns: str, canonical: str, low: int, high: int, key: str) -> Oracle:
    o = Oracle(rows)
    for c in ("msisdn", kind, "valid_from", "valid_to"):
        o.none(f"null.{c}", f"{c} is null", "failed")
    o.none("order", "valid_to < valid_from", "failed").none("msisdn_format", f"not {_full('msisdn', '^[0-9]{7,15}$')}", "failed").none("msisdn_canonical", f"not coalesce({_full('msisdn', '^[0-9]{7,15}$')} and length(msisdn) <> 10 and not (length(msisdn) = 11 and msisdn like '8%'), false)")
    o.none(f"{kind}_canonical", f"not coalesce({canonical}, false)").unique("exact_duplicates", columns, "warning").none(f"{kind}_format", f"not {_full(kind, f'^[0-9]{{{low},{high}}}$')}", "failed")
    keys = " and ".join(f"{c} is not null" for c in key.split(", "))
    reach = f"(select *, max(valid_to) over (partition by {key} order by valid_from, valid_to rows between unbounded preceding and 1 preceding) reach from t where {keys} and valid_from is not null and valid_to is not null)"
    o.row("overlap_same_pair", "case when coalesce(sum(case when valid_from <= reach then 2 else 0 end), 0) > 0 then 'failed' else 'ok' end", {"n": "coalesce(sum(case when valid_from <= reach then 2 else 0 end), 0)"}, reach)
    near = "coalesce(sum(case when epoch_us(valid_from) - epoch_us(reach) <= 1000000 then 1 else 0 end), 0)"
    return o.row("mergeable_gap", f"case when {near} > 0 then 'warning' else 'ok' end", {"n": near}, reach)


_PAIR = "select case when o_orderkey % 45 = 0 then null when o_orderkey % 46 = 0 then '89160000001' when o_orderkey % 47 = 0 then 'x' else concat('7916', lpad(cast(o_custkey as string), 7, '0')) end as msisdn, {value}, case when o_orderkey % 90 = 0 then null else o_orderdate end as valid_from, case when o_orderkey % 44 = 0 then o_orderdate - interval '1' day else o_orderdate + interval '20' day end as valid_to from {orders}"
_IMEI = _PAIR.replace("{value}", "case when o_orderkey % 33 = 0 then '12' else lpad(cast(o_custkey % 5 as string), 15, '3') end as imei")
one_table("dq_bindings_device", suites.fct_msisdn_imei, _IMEI, _binding_oracle(_IMEI, "imei", "msisdn, imei, valid_from, valid_to", _full("imei", "^[0-9]{14,16}$"), 14, 16, "msisdn, imei"))
_IMSI = _PAIR.replace("{value}", "case when o_orderkey % 33 = 0 then '12' when o_orderkey % 8 = 0 then '401020000000001' else concat('25001', lpad(cast(o_custkey % 3 as string), 10, '0')) end as imsi, case when o_orderkey % 35 = 0 then null when o_orderkey % 36 = 0 then 2 when o_orderkey % 37 = 0 then 200 else 1 end as operator_id")
_o = _binding_oracle(_IMSI, "imsi", "msisdn, imsi, operator_id, valid_from, valid_to", _full("imsi", "^[0-9]{14,15}$"), 14, 15, "msisdn, operator_id, imsi")
_home = "imsi like '250%'"
_o.none("operator_valid", f"{_home} and not coalesce(operator_id between 0 and 99, false)", "failed").none("operator_alignment", f"{_home} and operator_id <> 1", "failed").none("operator_on_foreign", f"not ({_home}) and operator_id is not null").rate("foreign_share", f"not ({_home})", 0.0, 0.0)
one_table("dq_bindings_sim", suites.fct_msisdn_imsi, _IMSI, _o)

_STAY = "select case when event_id % 40 = 0 then null else user_id end as msisdn, user_id as imsi, user_id as imei, ts as start_time_utc, case when event_id % 30 = 0 then ts - interval '1' minute else ts + interval '5' minute end as end_time_utc, case when event_id % 25 = 0 then <empty> when event_id % 3 = 0 then <two> else <one> end as cgi_list, cast(case when event_id % 50 = 0 then 91 else 55 end as double) as sub_lat, cast(37 as double) as sub_lon, case event_id % 9 when 0 then 'z' when 1 then null when 2 then 'i' else 'o' end as bs_type, case when event_id % 80 = 0 then 20 else 3 end as timezone, '01' as oktmo_code_1, '02' as oktmo_code_2, cast(ts as date) as time_key from {events}"
_list = lambda sql, spark_: sql.replace("<empty>", "cast(array() as array<string>)" if spark_ else "[]::varchar[]").replace("<two>", "array('1', '2')" if spark_ else "['1', '2']").replace("<one>", "array('1')" if spark_ else "['1']")
_o = Oracle(_list(_STAY, False))
for _c in ("msisdn", "start_time_utc", "end_time_utc", "cgi_list", "time_key"):
    _o.none(f"required.{_c}", f"{_c} is null", "failed")
_o.none("order", "end_time_utc < start_time_utc", "failed").none("coords", "not coalesce(sub_lat between -90 and 90 and sub_lon between -180 and 180, false)").none("bs_type_vocab", _kinds_bs).none("timezone", "not coalesce(timezone between -12 and 14, false)").none("cgi_list_empty", "coalesce(len(cgi_list), 0) < 1", "failed")
_o.unique("duplicates", "msisdn, imsi, imei, start_time_utc, end_time_utc, bs_type", "warning").values("cgi_list_length", "len(cgi_list)")
one_table("dq_stays", suites.fct_geo_intervals, _list(_STAY, True), _o)

_PERSON = "select cast(case when c_custkey = 9 then '2024-02-01' else '2024-01-01' end as date) as report_date, case when c_custkey % 60 = 0 then 'prs_1' else concat('prs_', lpad(cast(c_custkey as string), 24, 'a')) end as person_id, 'bio:x' as person_cluster_key, case c_custkey % 3 when 0 then 'high' when 1 then 'low' else 'none' end as person_confidence, c_custkey % 3 as sim_count, case when c_custkey % 40 = 0 then null else '79160000000' end as msisdn, case when c_custkey % 41 = 0 then '12' else '250010000000000' end as imsi, '350000000000000' as imei, case c_custkey % 4 when 0 then 'M' when 1 then 'X' when 2 then null else 'F' end as gender, case c_custkey % 5 when 0 then '121' when 1 then 'U' else '33' end as age, case c_custkey % 7 when 0 then '999' when 1 then 'U' when 2 then 'RU' else '643' end as citizenship, 1 as operator_id, <t> as actually_from, <t> as actually_to, 1 as more from {customer}"
_p = lambda kind: _PERSON.replace("<t>", f"cast('2024-01-01 00:00:00' as {kind})")
_o = Oracle(_p("timestamp"))
for _c in "report_date person_id msisdn imsi imei operator_id".split():
    _o.none(f"critical_null.{_c}", f"{_c} is null", "failed")
for _c in ("gender", "age", "citizenship"):
    _o.none(f"demographic_null.{_c}", f"{_c} is null")
_o.unique("person_id_unique", "person_id", "failed").none("person_id_format", f"not {_full('person_id', '^prs_[0-9a-f]{24}$')}", "failed").none("gender_domain", "not coalesce(gender in ('M', 'F', 'U'), false)", "failed").none("age_domain", f"not {_full('age', '^(U|[0-9]{1,2}|1[01][0-9]|120)$')}", "failed").none("citizenship_domain", f"not {_full('citizenship', '^(U|[0-9]{3})$')}", "failed")
_o.none("confidence_domain", "not coalesce(person_confidence in ('high', 'medium', 'low'), false)", "failed").none("sim_count_domain", "not coalesce(sim_count >= 1, false)", "failed").rate("low_confidence", "person_confidence <> 'low'", 0.0, 0.70)
_o.none("id_digits", f"not {_full('msisdn', '^[0-9]{7,15}$')} or not {_full('imsi', '^[0-9]{14,15}$')} or not {_full('imei', '^[0-9]{14,16}$')}").row("single_report_date", "case when count(distinct report_date) > 1 then 'failed' else 'ok' end", {"dates": "count(distinct report_date)"}).row("extra_columns", "'warning'", {"n": "1"}, "(select 1)")
_o.row("citizenship_known", "case when count(*) > 0 then 'failed' else 'ok' end", {"missing": "count(*)"}, "(select distinct citizenship c from t where citizenship <> 'U') where c <> '643'")
register("dq_persons", "All checks of person profiles, an extra column among them.", lambda spark, d: suites.fct_person(derived(spark, d, _p("timestamp_ntz")), spark.createDataFrame([("643",)], "numeric_code string")), _o)
