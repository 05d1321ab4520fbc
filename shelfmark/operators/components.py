"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014).

Each step is a ``groupBy.min`` (combined before the shuffle) and an equi join in which one
side has a single row per node, so a hub with a third of all edges is split by AQE.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.stable import pinned


def _signature(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component."""
    current = pinned(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = _signature(current)
    while before["n"]:
        current = pinned(_small_star(_large_star(current)))
        after = _signature(current)
        if after == before:
            break
        before = after
    children = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return children.unionByName(roots)
