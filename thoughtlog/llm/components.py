"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtlog.sources.scratch import Scratch


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One half step: hang every neighbour of a node on the least of the node and them.

    Large: on both directions of each link, moving the neighbours above the node. Small: from
    the upper end of each link only, moving the lower ones and the node itself.
    """
    if large:
        links = pairs.union(pairs.select(F.col("low").alias("high"), F.col("high").alias("low")))
        links = links.toDF("node", "next")
    else:
        links = pairs.toDF("node", "next")
    least = links.groupBy("node").agg(F.min(F.least("node", "next")).alias("least"))
    moved = links.join(least, "node")
    if large:
        moved = moved.where(F.col("next") > F.col("node")).select(F.col("next").alias("high"), F.col("least").alias("low"))
    else:
        moved = moved.select(F.col("next").alias("high"), F.col("least").alias("low")).union(
            least.select(F.col("node").alias("high"), F.col("least").alias("low"))
        )
    return moved.where(F.col("high") != F.col("low")).distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node is the lower end of its links or has one link, as its upper end."""
    ends = pairs.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(pairs.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up + down > 1 AND up > 0").isEmpty()


def components(spark: SparkSession, links: DataFrame, tables: Scratch) -> DataFrame:
    """(node, root) for every node with a link; the root is the least node it can reach.

    ``links`` has two BIGINT columns. Each round writes the links to the shared folder, so a lost
    executor repeats one round at most; rounds grow with the logarithm of the longest chain and end
    when every node hangs on its root. The number of links never grows, and no task gathers the
    links of a node.
    """
    a, b = links.columns
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    pairs = tables.store(pairs, "links")
    while not _settled(pairs):
        pairs = tables.store(_stars(_stars(pairs, True), False), "links")
        for path in tables.paths[-2:-1]:
            tables.drop(path)
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
