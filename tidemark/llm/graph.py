"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged


def _stars(links: DataFrame) -> DataFrame:
    """Every node with the smallest node of its neighbourhood, itself included."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root): the smallest node reachable from u, for every node of ``links`` (u, v).

    Alternates two steps until nothing changes: larger neighbours are linked to the smallest
    neighbour, then smaller ones are. Every round is a table in the shared folder, so a lost
    executor costs one round. Joins are plain equi-joins; where a grouping by the same node follows, AQE
    cannot split a node with very many links. Loops and repeated links are allowed; no links give no rows.
    """
    links = staged(links.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_stars(links), "u").select(F.col("v").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("root"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("root").alias("v"))
        small = small.unionByName(low.select("u", F.col("root").alias("v"))).filter("u <> v").distinct()
        links = staged(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select("u", F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        last = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
