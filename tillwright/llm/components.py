"""Connected components by alternating large and small stars (Kiveris et al., 2014), as DataFrame rounds.

Every round is staged in the shared folder, so that no lineage grows and a lost executor costs one stage. The minimum
of a neighbourhood is a partial aggregate that is joined back; a hub is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.plans.staging import stage

MAX_ROUNDS = 64


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).withColumn("low", F.least("low", "a"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it (every edge points down) move to the least of them."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).filter("a > b").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("mix")
    ).first()
    return row["n"], row["mix"]


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; root is the least node reachable.

    ``links`` has two columns ``a, b`` of one orderable type. Repeated links, loops and both directions are fine;
    links with a null end are ignored. No links give no rows.
    """
    edges = stage(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        edges = stage(_small_star(stage(_large_star(edges), "large-star")), "small-star")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
