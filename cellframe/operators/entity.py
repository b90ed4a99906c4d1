"""Entity resolution: identifier graph, connected components, stable person ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.scalar import confidence, person_id
from cellframe.session import checkpointed


def node(kind: str, c: str):
    return F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))


def edges_of(rows: DataFrame, hub: tuple[str, str], spokes: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct edges from each row's hub node to its other nodes; ``(kind, column)``. A key that has its kind already is given kind ''."""
    def as_node(kind, c):
        return node(kind, c) if kind else F.col(c)

    pairs = F.array(*[F.struct(as_node(*hub).alias("u"), as_node(*s).alias("v")) for s in spokes])
    return rows.select(F.explode(pairs).alias("e")).select("e.u", "e.v").dropna().distinct()


def _with_least(edges: DataFrame, key: str, least: DataFrame, hub: int) -> DataFrame:
    """Edges ``u, v`` with ``m`` of their node in ``key``. Nodes of over ``hub`` edges, of which there are few, are broadcast, so that no task gets all of a hub's edges."""
    hot = F.broadcast(least.where(F.col("n") > hub).select(F.col("w").alias("__w"), F.col("m").alias("__m")))
    met = edges.join(hot, F.col(key) == F.col("__w"), "left")
    cold = met.where("__w is null").select("u", "v").join(least.where(F.col("n") <= hub).select(F.col("w").alias(key), "m"), key)
    return met.where("__w is not null").select("u", "v", F.col("__m").alias("m")).unionByName(cold.select("u", "v", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = 100_000) -> DataFrame:
    """``node, root``: root is the least node of the component, by large-star and small-star in turn, each round checkpointed.

    A component ends as a star around its root, however large; see ``_with_least`` for such hubs. A round has two checkpoints, as each of its halves is read thrice.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # an edge leads from the greater node u to the lesser v
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = checkpointed(_with_least(e, "v", least, hub).select("u", F.col("m").alias("v")))
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, "u", least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    alone = edges.where("u = v").select(F.col("u").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("root")))


def clusters(components: DataFrame) -> DataFrame:
    """``root, cluster_key, confidence``: the key is the least biographic node, else the least iccid, else the least node."""
    def least(prefix: str):
        return F.min(F.when(F.col("node").startswith(prefix), F.col("node")))

    keyed = components.groupBy("root").agg(least("bio:").alias("b"), least("iccid:").alias("i"), F.min("node").alias("n"))
    return keyed.select("root", F.coalesce("b", "i", "n").alias("cluster_key"), confidence(F.filter(F.array("b", "i"), lambda x: x.isNotNull())).alias("confidence"))


def stable_ids(keyed: DataFrame, previous: DataFrame | None, key: str = "cluster_key") -> DataFrame:
    """Adds ``person_id``: that of the previous period for the same key (the least, should there be several), else a hash of the key."""
    if previous is None:
        return keyed.withColumn("person_id", person_id(key))
    known = previous.where(F.col(key).isNotNull() & F.col("person_id").isNotNull()).groupBy(key).agg(F.min("person_id").alias("__known"))
    return keyed.join(known, key, "left").withColumn("person_id", F.coalesce("__known", person_id(key))).drop("__known")
