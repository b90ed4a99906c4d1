"""Slowly changing dimension of the second kind: one merge of a snapshot into versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the greatest by ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)


def merge(history: DataFrame, snapshot: DataFrame, key: Sequence[str], compare: Sequence[str], effective: Column, open_end: Column, start: str = "date_on", end: str = "date_off") -> DataFrame:
    """Versions after the snapshot: what changed or disappeared is closed a microsecond before ``effective`` (never before its own begin),
    what is new or changed gets a version from ``effective`` on. ``effective`` is a parameter, so a repeated merge changes nothing.
    """
    open_ = F.col(end).isNull() | (F.col(end) == open_end)
    closed, active = history.where(~open_), history.where(open_)
    rest = [c for c in history.columns if c not in key]
    old = active.select(*key, F.lit(True).alias("__old"), *[F.col(c).alias(f"__old_{c}") for c in rest])
    new = snapshot.select(*key, F.lit(True).alias("__new"), *[F.col(c).cast(history.schema[c].dataType).alias(f"__new_{c}") for c in compare])
    j = old.join(new, list(key), "full_outer")
    had, has = F.coalesce("__old", F.lit(False)), F.coalesce("__new", F.lit(False))
    same = had & has & F.struct(*[f"__old_{c}" for c in compare]).eqNullSafe(F.struct(*[f"__new_{c}" for c in compare]))
    until = F.greatest(F.col(f"__old_{start}"), effective - F.make_dt_interval(secs=F.lit(0.000001)))
    kind = {c: history.schema[c].dataType for c in rest}
    kept = F.struct(*[(F.when(same, F.col(f"__old_{c}")).otherwise(until).cast(kind[c]) if c == end else F.col(f"__old_{c}")).alias(c) for c in rest])
    begun = F.struct(*[(effective if c == start else open_end if c == end else F.col(f"__new_{c}") if c in compare else F.lit(None)).cast(kind[c]).alias(c) for c in rest])
    # both versions of a key come out of the joined row itself. As rows of an array they are also opaque to the optimiser, which would
    # otherwise rewrite a comparison of many columns once for every subset of the renamed ones
    versions = F.filter(F.array(F.when(had, kept), F.when(has & ~same, begun)), lambda v: v.isNotNull())
    return closed.unionByName(j.select(*key, F.explode(versions).alias("v")).select(*key, "v.*").select(*closed.columns))
