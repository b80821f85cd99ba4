"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stash, unstash


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node ties its larger (large) or smaller neighbours to the least node it sees.
    Sums come before the join, and Spark splits the join where a node has very many links."""
    rows = _both_ways(links) if large else links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = rows.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("low"))
    met = rows.join(least, rows["src"] == least["node"])
    if large:
        out = met.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = met.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(least.select(F.col("node").alias("src"), F.col("low").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component: the least node of its component, for every node with a link.

    links: src, dst of one orderable type. Large and small stars alternate until nothing moves,
    which takes a number of rounds that grows with the logarithm of the graph; each round is a
    written table, so none is ever computed again. Nulls and loops are no links.
    """
    now = stash(links.select("src", "dst").where("src <> dst").distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        nxt = stash(_star(_star(now, True), False), "links")
        unstash(now)
        now = nxt
    loops = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(loops)
