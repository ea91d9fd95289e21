"""Connected components of links between integer ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.runtime import cut, cut_counted, release


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id reachable.

    Large-star and small-star rounds: each joins every neighbour with the
    smallest neighbour of its centre, and they end when every edge leads to the
    centre of a star. Minima are combined before the shuffle, so a centre with
    very many neighbours is no hot group; rounds grow with the logarithm of the
    longest path. An empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, found = cut_counted(edges, "edges", rows=F.lit(True))
    while found["rows"] and not _stars(edges):
        # Large star: every larger neighbour of a centre links to the centre's least neighbour.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a centre and its smaller neighbours link to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        new = cut(small_star.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
        release(edges)
        edges = new
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has one edge and is the v of none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    sums = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
    return sums.where("ups > 1 or ups = 1 and all > 1").isEmpty()
