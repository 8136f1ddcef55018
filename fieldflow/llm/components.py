"""Connected components of a graph of links, by rounds of contraction.

In a round every node looks at its neighbours and takes the one with the smallest random rank, if that is
below its own, as its parent; links are moved to the parents and those inside one node vanish. Ranks are
drawn anew each round, so chains shrink by a constant factor. The parents of all rounds, followed from the
last round back, give each node its root.

Only minima per node and joins on nodes are taken, with partial sums; each round is a written table, so a
lost executor costs one round at most, and nothing but row counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflow.session import cut_lineage


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a long, b long); roots are equal inside a component only."""
    links = cut_lineage(links.where("a <> b").select("a", "b").distinct(), "links")
    parents, round_ = [], 0
    while links.limit(1).count():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("rank"), F.col(c).alias("node"))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
        parent = F.least(F.col("low"), rank("a"))["node"]
        parents.append(cut_lineage(lowest.select(F.col("a").alias("node"), parent.alias("root")), "parents"))
        to = parents[-1]
        moved = (
            links.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
        )
        links = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        round_ += 1
    if not parents:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = parents[0]
    for later in parents[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
