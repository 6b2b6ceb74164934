"""Subtree totals of a large tree by parallel contraction.

Two steps alternate. Compress: chains of nodes with one child each shrink to an edge, by doubling
what every node of the chain skips. Rake: childless nodes hand what they hold to their parents and
go. After a compress every inner node has two children, so a rake removes half of the tree or more,
and rounds grow with the logarithm of its size, however deep or broad it is. Then the chains are
expanded again, last ones first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.storage import cut


def _sum(columns: list[str], a: str, b: str) -> list:
    return [(F.coalesce(F.col(f"{a}{c}"), F.lit(0)) + F.coalesce(F.col(f"{b}{c}"), F.lit(0)))
            for c in columns]


def _skip(links: DataFrame, columns: list[str]) -> DataFrame:
    """Every link goes on with the link of its end, if that has one."""
    ends = links.select(F.col("id").alias("to"), F.col("to").alias("next"),
                        *(F.col(c).alias(f"next_{c}") for c in columns))
    joined = links.join(ends, "to", "left")
    return joined.select("id", F.coalesce("next", "to").alias("to"),
                         *(x.alias(c) for x, c in zip(_sum(columns, "", "next_"), columns)),
                         F.col("next").isNotNull().alias("more"))


def _chains(tree: DataFrame, columns: list[str]) -> DataFrame | None:
    """(id, to, columns) of nodes with one child (roots excepted): the first node below that has
    none or several, and what is held from the node down to just above it."""
    children = tree.where("parent IS NOT NULL").groupBy("parent").agg(
        F.count("*").alias("n"), F.first("id").alias("to"),
        *(F.first(f"up_{c}").alias(f"below_{c}") for c in columns)).where("n = 1")
    links = cut(tree.where("parent IS NOT NULL").join(
        children.withColumnRenamed("parent", "id"), "id").select(
        "id", "to", *(x.alias(c) for x, c in zip(_sum(columns, "", "below_"), columns))))
    if links.isEmpty():
        return None
    while True:
        links = cut(_skip(_skip(links, columns).drop("more"), columns))
        if links.where("more").isEmpty():
            return links.drop("more")


def subtree_totals(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, columns): for every node the sums of the columns over its subtree, itself included.

    `nodes` has id, parent (null for a root) and the columns (long; null counts as 0). Ids are
    unique and may be of any type that can be joined on; every parent is there, and no node is
    above itself. No node's children are gathered: they are summed, partially first.
    """
    tree = cut(nodes.select("id", "parent", *(F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                              for c in columns),
                            *(F.lit(0).cast("long").alias(f"up_{c}") for c in columns)))
    finished, contracted = [], []
    while True:
        chains = _chains(tree, columns)
        if chains is not None:
            contracted.append(chains)
            gone = chains.select(F.col("id").alias("parent"), F.lit(True).alias("inner"))
            tops = tree.join(chains.withColumnsRenamed({c: f"held_{c}" for c in columns}), "id").join(
                gone, "parent", "left").where("inner IS NULL").select(
                F.col("to").alias("id"), F.col("parent").alias("above"),
                *(x.alias(f"held_{c}") for x, c in zip(_sum(columns, "up_", "held_"), columns)))
            tree = cut(tree.join(chains.select("id"), "id", "left_anti").join(
                tops, "id", "left").select(
                "id", F.coalesce("above", "parent").alias("parent"), *columns,
                *(F.coalesce(f"held_{c}", f"up_{c}").alias(f"up_{c}") for c in columns)))
        raked = tree.join(tree.select(F.col("parent").alias("id")), "id", "left_anti")
        handed = raked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *(F.sum(F.col(c) + F.col(f"up_{c}")).alias(f"sum_{c}") for c in columns))
        finished.append(cut(raked.select("id", *columns)))
        tree = cut(tree.join(finished[-1].select("id"), "id", "left_anti").join(
            handed, "id", "left").select(
            "id", "parent", *(x.alias(c) for x, c in zip(_sum(columns, "", "sum_"), columns)),
            *(f"up_{c}" for c in columns)))
        if tree.isEmpty():
            break
    totals = finished[0]
    for part in finished[1:]:
        totals = totals.unionByName(part)
    for chains in reversed(contracted):
        ends = totals.select(F.col("id").alias("to"), *(F.col(c).alias(f"end_{c}") for c in columns))
        totals = cut(totals.unionByName(chains.join(ends, "to").select(
            "id", *(x.alias(c) for x, c in zip(_sum(columns, "", "end_"), columns)))))
    return totals
