"""Connected components of an edge table, by alternating star contractions; nothing but one truth value a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import written


def _is_forest(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v with u > v) are stars already: a node with a smaller neighbour has one only and is nobody's root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.coalesce(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))), F.lit(False))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable. Without edges there are no rows.

    In the large star, every node passes its larger neighbours on to its smallest one; in the small star, its smaller ones. Both only
    shorten paths and keep what is connected; as soon as the edges are stars, their centres are the roots. The minima are combined
    before they are shuffled, so a node with very many neighbours costs no task more than its share.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now = written(now, "cc-edges")
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(now.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
