"""Connected components of a link table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.storage import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Links point from the larger node to the smaller. Two steps alternate until nothing changes:
    a link goes on to the smallest neighbour of its smaller end, then every node hands all its
    smaller neighbours to the smallest. Each is a minimum per node and a join; the table never
    holds more rows than there are links and nodes.
    A hub with many links is one key of a join against one row, which adaptive execution splits.
    Rounds grow with the logarithm of the longest chain. Null ends and self links are left out.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(big, small).distinct())
    seen = None
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = (edges.join(least.withColumnRenamed("u", "v"), "v", "left")
                 .select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(least, "u").where("v != m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
