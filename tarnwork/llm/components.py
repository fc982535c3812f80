"""Connected components of a link table by alternating star operations.

Every node is moved to the least node among its neighbours, first for the
greater neighbours (large star), then for the lesser ones (small star), until
nothing changes.  Each round is two aggregates with map-side reduction and two
lookups; a node with very many links is split by the join, not gathered.  The
table of each round is cut from its lineage by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.keyed import lookup_join
from tarnwork.session import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours, from links in both directions."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = lookup_join(both, _least(both), ["u"], "inner").where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup_join(down, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link.  ``links`` has columns u and v."""
    links = cut_lineage(links.where("u != v").distinct())
    before = _checksum(links)
    for _ in range(most_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        after = _checksum(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Now every node points to the least one of its component.
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
