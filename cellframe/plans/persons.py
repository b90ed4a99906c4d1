"""Person profiles of a month: subscriptions, exclusion, entity resolution, stable ids, demographics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.functions import scalar as S
from cellframe.operators import entity, joins
from cellframe.session import checkpointed


def month_bounds(month: date) -> tuple[date, date]:
    if month.day != 1:
        raise ValueError("the month is named by its first day")
    after = date(month.year + month.month // 12, month.month % 12 + 1, 1)
    return month, after - timedelta(days=1)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def prepare_subscriptions(raw: DataFrame, month: date, imsi_bindings: DataFrame, imei_bindings: DataFrame) -> DataFrame:
    """Subscriptions of natural persons that overlap the month, with normalised and filled identifiers.

    A begin after midnight of the month's last day falls out, as it does in the original.
    """
    first, last = month_bounds(month)
    number = lambda c, f: f(F.coalesce(S.number_to_digits(c), F.col(c).cast("string")))
    rows = raw.where(F.col("client_type").try_cast("int") == 0)
    rows = rows.withColumn("actually_from", F.col("actually_from").try_cast("timestamp_ntz")).withColumn("actually_to", F.coalesce(F.col("actually_to").try_cast("timestamp_ntz"), _ts(schemas.BINDING_OPEN_END)))
    rows = rows.where((F.col("actually_from") <= _ts(str(last))) & (F.col("actually_to") >= _ts(str(first))))
    rows = rows.select(
        number("isdn", S.msisdn).alias("msisdn"), number("imsi", S.imsi).alias("imsi"), number("imei", S.imei).alias("imei"), S.blank_to_null("iccid").alias("iccid"), F.col("operator_Id").try_cast("bigint").alias("operator_id"), "actually_from", "actually_to",
        F.col("birth_day").try_cast("date").alias("birth_day"), *[S.blank_to_null(c).alias(c) for c in "first_name second_name last_name dul_department document".split()],
    )
    at = _ts(f"{last} 23:59:59")
    for b, key, value in ((imsi_bindings, "msisdn", "imsi"), (imsi_bindings, "imsi", "msisdn"), (imei_bindings, "msisdn", "imei"), (imei_bindings, "imei", "msisdn")):
        rows = joins.fill_at_instant(rows, b, key, value, at)
    return rows.dropna(subset="msisdn imsi imei operator_id actually_from actually_to".split())


def identifier_edges(rows: DataFrame, imsi_bindings: DataFrame, imei_bindings: DataFrame, month: date) -> DataFrame:
    """Edges of the month: from subscriptions and from bindings that overlap it."""
    first, last = month_bounds(month)
    low, high = _ts(str(first)), _ts(f"{last} 23:59:59")
    hub = ("msisdn", "msisdn")
    e = entity.edges_of(rows, hub, [*((c, c) for c in ("imsi", "imei", "iccid")), ("", "bio_key")])
    for b, c in ((imsi_bindings, "imsi"), (imei_bindings, "imei")):
        held = b.where((F.col("valid_from") <= high) & (F.coalesce("valid_to", _ts(schemas.BINDING_OPEN_END)) >= low))
        e = e.unionByName(entity.edges_of(held, hub, [(c, c)]))
    return e.distinct()


def build_persons(raw: DataFrame, month: date, imsi_bindings: DataFrame, imei_bindings: DataFrame, previous: DataFrame | None = None, exclusions: dict[str, DataFrame] | None = None, machine_tacs: DataFrame | None = None, codes: dict[str, str] | None = None, country_names: list[tuple[str, str]] = ()) -> DataFrame:
    """Profiles of a month by the contract. ``exclusions``: value lists by column; ``machine_tacs``: ``tac`` of machines; ``previous``: last month's profiles."""
    rows = prepare_subscriptions(raw, month, imsi_bindings, imei_bindings)
    norm = {"msisdn": S.msisdn, "imsi": S.imsi, "imei": S.imei}
    lists = {c: x.select(norm[c]("value").alias("value")) for c, x in (exclusions or {}).items()}
    if lists:
        rows = joins.exclude(rows, lists)
        imsi_bindings = joins.exclude(imsi_bindings, {k: v for k, v in lists.items() if k != "imei"})
        imei_bindings = joins.exclude(imei_bindings, {k: v for k, v in lists.items() if k != "imsi"})
    if machine_tacs is not None:
        rows = joins.exclude_by(rows, S.tac_of_imei("imei"), machine_tacs, "tac")
        imei_bindings = joins.exclude_by(imei_bindings, S.tac_of_imei("imei"), machine_tacs, "tac")
    # read for the edges and for the profiles
    rows = checkpointed(rows.withColumn("bio_key", S.bio_key("last_name", "first_name", "second_name", "birth_day", "document")))
    comps = entity.connected_components(identifier_edges(rows, imsi_bindings, imei_bindings, month))
    keyed = entity.clusters(comps)
    # every identifier of a row hangs on its phone number, so that one node tells the component
    rows = rows.withColumn("__node", entity.node("msisdn", "msisdn")).join(comps.withColumnRenamed("node", "__node"), "__node").join(keyed, "root").drop("__node", "root")
    prev = None if previous is None else previous.select(F.col("person_cluster_key").alias("cluster_key"), "person_id")
    rows = entity.stable_ids(rows, prev)
    # a person of many subscriptions is grouped in parts: no window holds them in one place, nor does each of their rows carry all numbers
    last = F.struct(-F.unix_micros(F.col("actually_from").cast("timestamp")), "msisdn", "imsi", "imei", "iccid")
    rest = F.struct(*[c for c in rows.columns if c != "person_id"])
    first = rows.groupBy("person_id").agg(F.count_distinct(F.concat_ws("|", "imsi", F.coalesce("iccid", F.lit("")))).cast("bigint").alias("sim_count"), F.min_by(rest, last).alias("__first")).select("person_id", "__first.*", "sim_count")
    return schemas.contract(
        first.withColumns(
            {
                "report_date": F.lit(month), "person_cluster_key": F.col("cluster_key"), "person_confidence": F.col("confidence"), "gender": S.gender("first_name", "second_name"), "age": S.age_at("birth_day", F.lit(month)),
                "citizenship": S.citizenship("dul_department", "document", "first_name", "second_name", "last_name", codes or {"RU": "643"}, country_names),
            }
        ),
        schemas.PERSON,
    )
