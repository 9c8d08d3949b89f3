"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerlake.session import checkpoint_dir


def _settled(links: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    ends = links.select("u", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        links.select(F.col("v").alias("u"), F.lit(0).alias("p"), F.lit(1).alias("c")))
    per = ends.groupBy("u").agg(F.sum("p").alias("p"), F.max("c").alias("c"))
    return per.where("p > 1 or (p > 0 and c > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Each step points a node's larger neighbours (then its smaller ones and
    itself) at the smallest of them, until every node points straight at a root;
    a node's rows are only ever reduced to a minimum, so a node with many links
    needs no list. The links are written to the shared checkpoint folder after
    every step.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    while not _settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
