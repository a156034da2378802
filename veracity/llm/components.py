"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.storage import materialize


def _star(arcs: DataFrame, keep) -> DataFrame:
    """Link every kept neighbour of u to the least of u and its neighbours.

    The minimum is a pre-aggregated group-by and comes back by an equi-join, so a hub's neighbours
    are never gathered in one task.
    """
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = arcs.join(least, "u")
    return met.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable from each id that has a link.

    Loops and repeated links do no harm; links with a null end are ignored; no links, no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, before = materialize(e.distinct(), "cc"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: u itself goes to the least neighbour too
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    # settled: every edge leads from an id straight to its component's least id
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
