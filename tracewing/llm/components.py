"""Connected components of a graph given as links, by rounds of star contraction.

Each round ties every node to the least node that it or a neighbour knows,
first for the larger neighbours and then for the smaller ones; the number of
rounds grows with the logarithm of the longest chain.  Links and labels stay
tables in the shared folder, and only their number and checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of (a, b) links: neighbours on one side of a node are tied to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        sides = both
    else:
        sides = both.where("b < a")
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # read from files, a node with very many links can be split in the join
    least = stored(least, "least-neighbours")
    joined = sides.join(least, F.col("a") == F.col("n"))
    if larger:
        tied = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return tied.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the least node that it can reach.

    ``links`` has columns a and b of one orderable type; loops and repeated
    links don't matter; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    before, now = None, _mark(edges)
    while now != before and now[0]:
        edges = stored(_star(_star(edges, True), False), "stars")
        before, now = now, _mark(edges)
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
