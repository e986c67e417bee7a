"""Connected components of an edge table, without gathering any of it at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import join_by_size, materialise, release


#: Up to so many pairs no vertex is looked out for.
FEW = 2000


def _star(pairs: DataFrame, total: int, name: str, keep) -> DataFrame:
    """Table of ``keep(star)``, where star is the ``total`` pairs (u, v) or less with u's least neighbour or itself as m."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    if total <= FEW or least.agg(F.max("degree")).first()[0] <= max(250, total // 1000):
        return materialise(keep(pairs.join(least, "u")).where("u <> v").distinct(), name)
    least = materialise(least, "least")
    table = materialise(keep(join_by_size(pairs, least, "u", "degree")).where("u <> v").distinct(), name)
    release(least)
    return table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has an edge; component is the least node of its component.

    Alternates large-star and small-star steps until the edge set no longer changes; each round is written to the
    checkpoint folder and the round before deleted. The number of rounds grows with the logarithm of the longest chain,
    and no step puts more rows on a node than the edges it already has; the edges of a hub are not gathered. Null ends and
    loops are ignored.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * mark[0], "large-star", lambda s: s.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = _star(large, 2 * mark[0], "edges", lambda s: s.select(ends.alias("e")).select("e.*"))
        release(edges, large)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
