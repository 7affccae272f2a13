"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.session import materialise


def _stamp(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``node``, ``root``: two linked ids) but the roots,
    which are the smallest ids of their components.

    Large and small stars in turn: each pass links a node's neighbours to its smallest one, by a
    minimum and a join, so a node with very many neighbours is summed before it is shuffled and
    its join is split by AQE. The number of passes grows with the logarithm of the longest chain.
    """
    links = materialise(edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "edges")
    before = _stamp(links)
    while before.n:
        both = links.unionAll(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        links = materialise(small.unionAll(least.select("node", F.col("m").alias("root"))).distinct(), "edges")
        if (now := _stamp(links)) == before:
            break
        before = now
    return links
