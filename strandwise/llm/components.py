"""Connected components of a graph given as an edge table, by alternating star contractions.

Each round replaces edges so that nodes hang on ever smaller nodes; the number
of edges never grows. Nothing but row counts comes to the driver, every round
is a written table, and a hub's edges are folded map-side: a node's smallest
neighbour is a `min` aggregate, never a gathered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import cut_lineage, drop_table


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge; root is the component's smallest node.

    Direction, loops and repeated edges don't matter; edges with a null end are
    left out; without edges the result is empty.
    """
    up, down = F.greatest(a, b), F.least(a, b)
    links = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(up.alias("u"), down.alias("v"))
        .where("u <> v")
        .distinct()
    )
    links = cut_lineage(links)
    state = None
    while True:
        # Large star: larger neighbours of a node go to the smallest of it and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: smaller neighbours and the node itself go to the smallest neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = cut_lineage(small)
        drop_table(links)
        links = after
        # Settled: the same edges as a round before; count and hash sum tell.
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == now:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
