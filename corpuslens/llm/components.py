"""Connected components of a link table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest node among them and itself."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    linked = both.join(least, "a")
    if large:
        linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    ordered = linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    return ordered if large else ordered.distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node is either linked to one smaller node, once, or has only larger neighbours."""
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    of_node = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of_node.where("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node of its component.

    ``edges`` has long columns a and b; repeated links, both directions and loops are
    fine. They are read a few times, so what is costly to compute should be staged. Each
    pass is two grouped minima over the links, written to the shared folder; the number
    of passes grows with the logarithm of the longest chain, and none follows once all
    links go to roots. Nodes without a link are not in the result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while not _settled(now):
        now = stage(_star(_star(now, True), False), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
